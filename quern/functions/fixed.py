"""Words, tables, patterns and numbers that results depend on.

Patterns are in Java's syntax, for ``rlike`` and ``regexp_*``.
"""

# --- numbers
RRF_K, SIGNAL_DEPTH, TOP_FILES, WEAK_RATIO = 60, 40, 5, 0.88
CANDIDATES, TOP_K, GROUPS, PER_FILE = 50, 6, 25, 3
LEXICAL_FILES, LEXICAL_CHUNKS, SYNOPSIS_FILES, SYNOPSIS_CHUNKS = 5, 2, 5, 2
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 1200, 200, 60
SIMILAR, ROOT_VOTES, CANONICAL_CHUNKS = 0.85, 15, 100
NUMERIC_LINES, NUMERIC_RATIO, NUMERIC_SAMPLE = 150, 0.55, 400
PROBE_THRESHOLD, PROBE_CANDIDATES = 0.5, 3
FULL_DOC, SECTION_CHARS, NEIGHBOURS = 7200, 5000, 2
POINT_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"

# --- file name endings and their categories, first match wins
CATEGORIES = (
    ("pdf", (".pdf",)),
    ("hwp", (".hwp", ".hwpx")),
    ("docx", (".docx",)),
    ("doc_legacy", (".doc",)),
    ("pptx", (".pptx",)),
    ("ppt_legacy", (".ppt",)),
    ("xlsx", (".xlsx",)),
    ("xls_legacy", (".xls",)),
    ("text", (".txt", ".md", ".markdown", ".rtf", ".tex", ".bib")),
    ("table", (".csv", ".tsv")),
    ("text", (".json", ".xml", ".html", ".htm")),
    ("image", (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic")),
    ("code", (".py",)),
    ("notebook", (".ipynb",)),
    ("code", (".c", ".cpp", ".h", ".hpp", ".m", ".java", ".js", ".ts", ".sh", ".yaml", ".yml", ".toml")),
    ("video", (".mp4", ".mov", ".avi", ".mkv", ".webm")),
    ("audio", (".mp3", ".wav", ".m4a")),
    ("archive", (".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar")),
    ("data", (".npy", ".npz", ".pkl", ".pt", ".pth", ".h5", ".hdf5", ".bag", ".pcd", ".ply", ".mat")),
)
TEXT_CATEGORIES = ("pdf", "hwp", "docx", "pptx", "xlsx", "text", "table", "notebook", "doc_legacy", "ppt_legacy")
MODEL_CATEGORIES = ("image", "video", "audio")
CONVERT_CATEGORIES = ("xls_legacy",)
SKIP_TEXTS = (
    ("OCR", "스캔 문서라 본문 검색이 아직 지원되지 않습니다"),
    ("ASR", "음성·영상이라 본문 검색이 아직 지원되지 않습니다"),
    ("변환", "지원하지 않는 옛 포맷이라 변환이 필요합니다"),
    ("빈 파일", "빈 파일이라 내용이 없습니다"),
    ("대상 아님", "검색 대상 포맷이 아닙니다"),
)
SKIP_DEFAULT = "현재 본문 검색이 지원되지 않는 파일입니다"

# --- lexical terms
TERM_STOPWORDS = (
    "알려줘", "보여줘", "찾아줘", "말해줘", "요약해줘", "설명해줘", "정리해줘",
    "에", "에서", "의", "으로", "기준", "대한", "관련", "이", "가", "은", "는", "들",
    "우리", "이거", "그거", "해당", "최근", "최신", "현재", "올해", "그리고",
    "내용", "자료", "정보", "파일", "문서", "목록", "무엇", "어디", "누구", "언제", "뭐",
)
PARTICLES = ("들", "은", "는", "이", "가", "을", "를", "에서", "에", "의", "으로", "로")
NOTICE_GENERIC = ("서비스", "소개", "자료", "문서", "파일", "사용", "안내", "연구", "관련", "내용", "정보")
TOKEN = "[0-9A-Za-z가-힣]+"

# --- periods and dates
MONTH = r"(?:(20[0-9]{2})\s*년\s*)?(0?[1-9]|1[0-2])\s*월"
RECENT_SPAN = r"최근\s*([0-9]+)\s*(일|주)"
FULL_DATE = r"(?<![0-9])(20[0-9]{2})(?:\s*년\s*|[-_./／])(0?[1-9]|1[0-2])(?:\s*월\s*|[-_./／])(0?[1-9]|[12][0-9]|3[01])(?:\s*일)?(?![0-9])"
COMPACT_DATE = r"(?<![0-9])(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?![0-9])"
SHORT_DATE = r"(?<![0-9])([0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?![0-9])"

# --- intent
CHANNEL = r"#([0-9A-Za-z가-힣_-]+?)(?=(?:에서|으로|의|와|과|,|\s|$))"
PERSON = r"([가-힣]{2,4})\s*님"
DRIVE_WORD = r"(?i)(?:Google\s*)?Drive|구글\s*드라이브|드라이브"
SLACK_WORD = "(?i)Slack|슬랙"
LOCATION_WORD = r"(?i)어디|어느\s*폴더|위치|경로|링크|\.(?:pdf|docx?|xlsx?|pptx?|hwp|hwpx|csv|txt)\b"
TABLE_WORD = r"(?:표로|표\s*형식|테이블)"
INTENT_STOPWORDS = (
    "업무", "기록", "내용", "자료", "관련", "에서", "으로", "를", "을", "의",
    "찾아줘", "정리해줘", "요약해줘", "알려줘", "Google", "Drive", "Slack",
    "구글", "드라이브", "슬랙", "담당자별", "날짜별", "표로", "최근", "지난달",
    "이번", "이번달",
)
TOPIC_SUFFIX = "(?:에서|관련|업무|기록|내용|자료|부터|까지)$"

# --- routing
ROUTE_MODES = ("auto", "general", "rag", "location", "web", "rag_web")
HINT_LOCATION = r"(?i)(어디|어느\s*폴더|위치|경로|링크|찾아\s*줘|찾아\s*주|\.(?:pdf|docx?|xlsx?|pptx?|hwp|hwpx|csv|txt)\b)"
HINT_INTERNAL = (
    r"(?i)(우리\s*(?:연구실|랩)|연구실|랩미팅|과제|실험|레이블링|라벨링|프로젝트|연구비|회의록|슬랙|slack|채널|drive|드라이브|내부\s*문서|"
    r"논문|데이터셋|Conference|출장|방문|참여(?:자|인원)|담당(?:자|업무)|업무\s*기록|다녀\s*온|갔다\s*온|현장\s*테스트)"
)
HINT_GENERAL = (
    r"(?i)(안녕|반가워|고마워|감사|날씨|설명해|개념|번역해|영어로|한국어로|작성해|써\s*줘|아이디어|코드|코딩|파이썬|python|일반적으로|장단점|"
    r"여행지|여행\s*추천|추천\s*해|뭐\s*(?:먹|하지)|루틴)"
)
HINT_DRIVE = r"(?i)(?:구글\s*)?(?:drive|드라이브)"
HINT_SLACK = "(?i)(?:slack|슬랙)"
HINT_LAB = r"(?i)(우리|연구실|랩|Conference|구글\s*드라이브|drive|드라이브|slack|슬랙|내부)"
HINT_CURRENT_WEB = r"(?i)(?:최신|최근|현재|이번\s*주|요즘).{0,20}(?:뉴스|동향|논문|제품|정책|추천)"
HINT_PRODUCT = "(?i)(?:제품|정책)(?:.{0,20}(?:추천|비교|최신|알려|장단점|어떻게|바뀌)|$)"
HINT_WEB = "(?i)(웹|인터넷|뉴스|동향|요즘)"
HINT_TIMELY = r"(?i)(최신|최근|현재|이번\s*주|요즘)"
HINT_EXPLICIT_WEB = r"(?i)(?:웹|인터넷)\s*(?:검색|에서도|에서|자료|최신|동향|(?:도|을|를)\s*(?:함께|같이|검색|찾아))"
HINT_WEB_SOURCE = r"(?i)(?:웹|인터넷)\s*(?:검색|에서도|에서|(?:도|을|를)\s*(?:함께|같이|검색|찾아))"
TASK_HEAD = r"(?i)^\s*###\s*task\s*:"
TASK_GENERATE = r"(?i)^\s*(?:generate|create)\s+(?:a\s+)?(?:concise\s+)?(?:title|tags?|follow[- ]?up\s+questions?|search\s+queries?)\b"
SPLIT_WEB_WORD = r"(?i)(?:웹|인터넷)\s*(?:검색(?:으로)?|에서도|에서)|(?:웹|인터넷)\s*(?:도|을|를)(?=\s*(?:함께|같이|검색|찾아))|(?:웹|인터넷)(?=\s*(?:자료|최신|동향))"
SPLIT_PROJECT_JOIN = r"(?i)(?:과제|프로젝트)\s*(?:와|과|및|그리고)\s*(?=(?:웹|인터넷))"
SPLIT_INTERNAL_WORD = r"(?i)(?:우리\s*)?(?:연구실|랩)\s*|(?:구글\s*)?(?:드라이브|drive)\s*(?:와|과|및|그리고)?\s*|(?:슬랙|slack)\s*(?:와|과|및|그리고)?\s*|내부\s*(?:자료|문서)?\s*"
SPLIT_INTERNAL_FIRST = r"(?i)^(.+)\s*(?:와|과|및|그리고)\s*((?:웹|인터넷).*)$"
SPLIT_WEB_FIRST = r"(?i)^((?:웹|인터넷).+?)\s*(?:와|과|및|그리고)\s*((?:(?:우리\s*)?(?:연구실|랩)|(?:구글\s*)?(?:드라이브|drive)|(?:슬랙|slack)|내부).*)$"
FOLLOW_UP = "^(?:그|당시|그때|이때|이전|그 사람|참여자|담당|결과|일정)"
RECENCY = "최근|최신"
RECENCY_DETAIL = r"갔다\s*온|다녀\s*온|참여(?:자|인원)|담당\s*업무|누가|누구|사람"
LIST_FOLDER = r"폴더.{0,20}(뭐가\s*있|무엇이\s*있|뭐\s*있|파일\s*목록|문서\s*목록)"
CREATED_WORD, MODIFIED_WORD = "작성|생성|만든|올린", "수정|업데이트|갱신"

# --- location
_ARTIFACTS = "파일|자료|서류|문서|폴더|엑셀|보고서|논문|교재|양식|서식|매뉴얼|사진|영상|목록|리스트|시트|표|가이드|영수증|기록|노트|계획서|보고자료"
LOCATE_EXTENSION = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|hwpx?|csv|txt|md|ipynb|zip|jpe?g|png|mp4|hwp)\b"
LOCATE_SEEK = "(?:찾아|찾을|찾고|찾는|찾지|열어|보여|알려|확인)"
LOCATE_WHERE = (
    r"어디\s*(?:에|서|엔|에다)?\s*\S{0,6}\s*(?:있|계|보관|저장|정리|들어|담|올려|넣)|어딨|"
    rf"어느\s*(?:폴더|경로|디렉|드라이브|{_ARTIFACTS})|(?:{_ARTIFACTS})\s*위치|위치\s*(?:알려|찾|정보|어디)|"
    r"경로\s*(?:알려|어디|가\s*어디)|보관\s*(?:돼|되어|된|중)|"
    rf"(?:{_ARTIFACTS})[은는이가를을]?\s*{LOCATE_SEEK}|(?:{_ARTIFACTS})[은는이가를]?\s*어디|어디\s*(?:{_ARTIFACTS})"
)
LOCATE_WRITE = (
    r"(?:어디|어느\s*\S{1,6})\s*(?:에|에다|를|을)?\s*\S{0,4}\s*(?:작성|기록|입력|써야|적어야|넣어야|올려야|제출)|"
    r"(?:작성|기록|입력|제출)\s*(?:해야|하면|할|하는)\s*\S{0,4}\s*(?:곳|문서|파일|양식|표|시트)"
)
LOCATE_CONTENT = (
    r"어떻게|어떤\s*(방법|절차|식|원리)|왜|무슨\s*뜻|의미(가|는)|설명해|요약해|정리해|계산|차이(가|는|점)|방법(은|이|을)|절차(는|가|를)|"
    r"내용(은|이|을)\s*(뭐|무엇|알려)"
)
LOCATE_ARTIFACT = "파일|자료|서류|문서|폴더|엑셀|보고서"
LOCATE_SEEK_WEAK = "찾아|찾을|보여|알려"
ROLE_TEMPLATE = r"(?i)양식|서식|template|form|작성용|빈\s?파일|제출서류|샘플|예시"
ROLE_ARCHIVE = "(?i)제출본|완료|최종|복사본|backup|백업|draft|초안|_구|이전|old"

LOCATE_YEAR = r"\b(20[0-9]{2})년?"
LOCATE_MONTH = r"(?:20[0-9]{2})[년\-./ ]+\s*(1[0-2]|0?[1-9])월?"
LOCATE_RECENT, LOCATE_FOLDER = "최신|최근|가장\\s*최근", r"폴더|디렉터리|모아\s*둔"
LOCATE_QUOTED, LOCATE_FILE = r"""['"]([^'"]+\.[A-Za-z0-9]+)['"]""", r"(\S+\.[A-Za-z0-9]+)"
FOLDER_MIME = "application/vnd.google-apps.folder"
LIVE_FALLBACK = "실시간 Google Drive 검색을 사용할 수 없어 로컬 색인 결과를 사용했어."
AMBIGUOUS_NOTE = '위치를 먼저 찾았어. 내용이나 방법·절차를 알고 싶은 질문이었으면 "~어떻게 해", "~내용 알려줘" 처럼 다시 물어봐.'

# --- layout of answers
ANSWER_BOTH = (
    "[답변 구성]\n본문을 아래 세 제목 순서로 나눠 작성해.\n### Google Drive에서 확인된 내용\n### Slack에서 확인된 내용\n### 두 출처를 종합하면\n"
    "각 사실에는 기존 자료 번호로 인용하고, 종합 섹션에서는 두 출처가 함께 뒷받침하는 내용만 설명해. 억지로 공통점을 만들지 마."
)
ANSWER_DRIVE = "[답변 구성]\n본문 제목을 `### Google Drive에서 확인된 내용`으로 작성하고 각 사실에 기존 자료 번호로 인용해."
ANSWER_SLACK = "[답변 구성]\n본문 제목을 `### Slack에서 확인된 내용`으로 작성하고 각 사실에 기존 자료 번호로 인용해."
ANSWER_FORMATS = (
    ("chronological", "결과를 날짜순으로 정리해."),
    ("by_person", "결과를 담당자별로 정리해."),
    ("table", "결과를 Markdown 표로 정리해."),
    ("table_by_person", "결과를 담당자별 Markdown 표로 정리해."),
)

# --- enrichment
SYNOPSIS_SAMPLE, SYNOPSIS_LEAST, SYNOPSIS_SHORT = 1500, 200, 10
THREAD_SAMPLE, THREAD_LEAST, THREAD_MOST = 6000, 100, 500
THREAD_STATUS = ("참여했다", "참여했습니다", "채널에 들어", "상태 변경")
FILE_NAME_BYTES, FILE_ENDING_BYTES = 200, 20
PDF_PAGES, PDF_TEXT_RATIO = 10, 0.2
SPLIT_DEPTH = 4
CHANNEL_TTL_S, ANCESTRY_TTL_S = 300, 86_400

# --- chat
SYSTEM_EVENT = r"(?i)채널에 참여(?:함|했습니다)|채널에 .*추가했습니다|채널을 떠남|채널에서 자신을 제거했습니다|joined the channel"
CREDENTIAL = r"(?i)(비밀번호|비번|password|passwd|pwd|pass|pw)(\s*(?:(?:은|는|:|=)\s*|is\s+)|\s+)([^\s,;]+)"
TOKEN_SHAPES = r"(?i)\b(?:xox[baprs]-[A-Za-z0-9-]+|xapp-[A-Za-z0-9-]+|gh[pousr]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|sk-[A-Za-z0-9_-]{16,})\b"
#: What every text has that either of the two matches. It begins with one class of characters, so it is quick where it fails.
REDACT_HINT = (
    r"[pP비xXgGsS](?:(?:[aA][sS][sS](?:[wW](?:[oO][rR])?[dD])?|[wW][dD]?|밀번호|번)(?:[\s은는:=]|[iI][sS]\s)|"
    r"[oO][xX][bBaApPrRsS]-|[aA][pP][pP]-|[hH][pPoOuUsSrR]_|[iI][tT][hH][uU][bB]_[pP][aA][tT]_|[kK]-)"
)
CHANNEL_ID = "^[CGD][A-Z0-9]{8,}$"
THREAD_TS = r"^([0-9]{10})\.([0-9]{1,6})$"
CHANNEL_CUE = "(?i)#|채널|슬랙|slack"
CHANNEL_GENERIC = (
    "관련", "업무", "내용", "기록", "자료", "최근", "최신", "진행", "상황", "정리해줘", "알려줘", "찾아줘", "전부", "모두", "에서", "슬랙", "slack",
    "구글", "드라이브",
)

# --- sections
SECTION_NUMBERED = r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.{0,80})$"
SECTION_ROMAN = r"^\s*([IVXivx]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)\s*[.)]\s*(\S.{0,80})$"
SECTION_CHAPTER = r"^\s*제\s*([0-9]+)\s*[장절]\s*(\S.{0,80})$"
BARE_HEADINGS = (
    "abstract", "introduction", "related work", "background", "method", "methods", "methodology", "materials and methods", "experiments",
    "experimental setup", "results", "results and discussion", "discussion", "conclusion", "conclusions", "references", "acknowledgments",
    "acknowledgements", "appendix",
    "초록", "서론", "관련연구", "관련 연구", "이론적 배경", "연구방법", "연구 방법", "실험", "실험방법", "실험 방법", "결과", "결과 및 고찰", "고찰", "결론",
    "참고문헌", "감사의 글", "부록",
)

# --- audit
AUDIT_CREDENTIAL = r"(?i)\b(?:client_secret|access_token|refresh_token|password|passwd|api_key)\b[\"']?\s*[:=]\s*([^#]+)"
AUDIT_PRIVATE_IP = r"\b(?:10(?:\.[0-9]{1,3}){3}|192\.168(?:\.[0-9]{1,3}){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.[0-9]{1,3}){2})\b"

#: What every text has that either of the two matches, quick where it fails.
AUDIT_HINT = r"[_pP1](?:[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][sS][sS][wW]|[iI]_[kK][eE][yY]|(?:0|92\.168|72)\.[0-9])"

AUDIT_FORWARDED = r"^(settings\.|section\.|self\.|os\.|config\.|token\.|data\[|str\(|getenv\(|None|\{\}|\[\])"
AUDIT_EXAMPLE = "^(your-|your_|example-|example_|changeme)"

# --- tabular data
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
DATE_OR_TIME = r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$|^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"
LABELED_VALUE = r"^[A-Za-z_][\w.\[\]]{0,20}[:=](.+)$"
WRAPPERS = "\"'`()[]{}%"

#: What an answer says about the channel that a question names.
NOTE_CHANNEL_INFERRED = "#{} 채널로 이해했어."
NOTE_CHANNEL_UNKNOWN = "말한 채널을 찾지 못해 Slack 전체에서 찾았어."
NOTE_CHANNEL_EMPTY = "#{} 채널에서는 찾지 못해 Slack 전체에서 찾았어."

#: Tokens of one window of late chunking, chunks in front of it, and the mark that ends a chunk.
LATE_TOKENS, LATE_CARRY, LATE_END = 7600, 2, "<|endoftext|>"
#: Characters of a chunk's prompt from the beginning of its file, and of the chunk itself.
HEAD_CHARS, TARGET_CHARS = 700, 2000

#: Items of a live search that count, and seconds that it has.
LIVE_MOST, LIVE_SECONDS = 20, 5.0
