"""Queries of routing and intent, over tables of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import intent as I
from quern.plans.base import query, rows

QUESTIONS = (
    (1, "안녕하세요"), (2, "연구실 회의록 요약해줘"), (3, "예산표 어디 있어?"), (4, "슬랙과 드라이브에서 출장 기록"), (5, "웹에서 최신 뉴스 검색해줘"), (6, "최근 AI 동향 알려줘"),
    (7, "우리 연구실 과제와 웹 검색 결과 비교"), (8, "### Task: generate a title"), (9, "Generate a concise title for this chat"), (10, "드라이브, 슬랙, 그리고 인터넷 검색으로 비교"),
    (11, "요즘 뭐가 좋아"), (12, "사과는 왜 빨간가"), (13, "report.pdf 찾아줘"), (14, "현재 상태는"), (15, "파이썬 코드 작성해줘"),
)


@query("route_table", """SELECT * FROM (VALUES (1,'general','general_hint',false),(2,'rag','internal_hint',false),(3,'location','location_hint',false),(4,'rag','explicit_multi_source',false),(5,'web','web_source_hint',false),
(6,'web','web_hint',false),(7,'rag_web','explicit_internal_web',false),(8,'general','openwebui_task',false),(9,'general','openwebui_task',false),(10,'rag_web','explicit_internal_web',false),(11,'web','web_hint',false),
(12,'auto','ambiguous',true),(13,'location','location_hint',false),(14,'auto','ambiguous_web',true),(15,'general','general_hint',false)) t(id, mode, reason, probe)""")
def route_table(spark, d):
    return rows(spark, "id int, q string", *QUESTIONS).select("id", I.route(F.col("q")).alias("r")).select("id", "r.*")


HEADS = ("", "우리 연구실 ", "슬랙에서 ", "구글 드라이브에 있는 ", "웹에서 ", "최근 ", "드라이브와 슬랙에서 ", "인터넷 자료와 ", "### Task: generate ", "요즘 ", "Create a title for ", "이번 주 ")
SUBJECTS = ("토마토 재배", "로봇 정책", "온실 제품", "plan_2026.pdf", "회의록", "날씨", "기타 연주", "Conference 논문", "웹 크롤러", "과제 예산", "사과")
TAILS = ("알려줘", "찾아줘", "요약해줘", "최신 동향", "추천해줘", "어디 있어?", "장단점은?", "뭐야?", "와 웹 검색 결과", "위치")


def _has(*names: str) -> str:
    return " AND ".join("regexp_matches(q, '" + getattr(fixed, n).replace("'", "''") + "')" for n in names)


def _values(items) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))


ROUTE_SQL = f"""WITH g AS (SELECT 1000 * h.i + 10 * s.i + t.i AS id, h.x || s.x || ' ' || t.x AS q FROM (VALUES {_values(HEADS)}) h(i, x), (VALUES {_values(SUBJECTS)}) s(i, x), (VALUES {_values(TAILS)}) t(i, x)),
k AS (SELECT id, CASE WHEN {_has('TASK_HEAD')} OR {_has('TASK_GENERATE')} THEN 'general,openwebui_task'
 WHEN {_has('DRIVE_WORD', 'SLACK_WORD', 'HINT_EXPLICIT_WEB')} THEN 'rag_web,explicit_internal_web' WHEN {_has('DRIVE_WORD', 'SLACK_WORD')} THEN 'rag,explicit_multi_source'
 WHEN {_has('LOCATION_WORD')} THEN 'location,location_hint' WHEN {_has('HINT_INTERNAL', 'HINT_EXPLICIT_WEB')} THEN 'rag_web,explicit_internal_web' WHEN {_has('HINT_WEB_SOURCE')} THEN 'web,web_source_hint'
 WHEN {_has('HINT_LOCATION')} THEN 'location,location_hint' WHEN {_has('HINT_CURRENT_WEB')} AND NOT {_has('HINT_LAB')} THEN 'web,web_hint' WHEN {_has('HINT_INTERNAL')} THEN 'rag,internal_hint'
 WHEN {_has('HINT_WEB')} OR {_has('HINT_PRODUCT')} THEN 'web,web_hint' WHEN {_has('HINT_TIMELY')} THEN 'auto,ambiguous_web' WHEN {_has('HINT_GENERAL')} THEN 'general,general_hint' ELSE 'auto,ambiguous' END AS k FROM g)
SELECT id, split_part(k, ',', 1) AS mode, split_part(k, ',', 2) AS reason, k LIKE 'auto%' AS probe FROM k"""


@query("route_generated", ROUTE_SQL)
def route_generated(spark, d):
    """The rules in order over 1,320 questions, made from heads, subjects and tails."""
    part = lambda name, items: rows(spark, f"{name}_i int, {name} string", *enumerate(items))
    q = part("h", HEADS).crossJoin(part("s", SUBJECTS)).crossJoin(part("t", TAILS))
    q = q.select((1000 * F.col("h_i") + 10 * F.col("s_i") + F.col("t_i")).alias("id"), F.concat("h", "s", F.lit(" "), "t").alias("q"))
    return q.select("id", I.route(F.col("q")).alias("r")).select("id", "r.*")


@query("route_forced", "SELECT * FROM (VALUES (1, 'web', 'forced'), (2, 'rag', 'forced')) t(id, mode, reason)")
def route_forced(spark, d):
    q = rows(spark, "id int, q string, m string", (1, "아무거나", "web"), (2, "어디 있어", "rag"))
    return q.select("id", I.route(F.col("q"), F.col("m")).alias("r")).select("id", "r.mode", "r.reason")


@query("probe_resolution", "SELECT * FROM (VALUES (1,'rag','probe_relevant'),(2,'general','probe_low'),(3,'web','probe_web'),(4,'general','probe_error'),(5,'web','probe_web'),(6,'rag','internal_hint')) t(id, mode, reason)")
def probe_resolution(spark, d):
    cases = ((1, "사과는 왜 빨간가", 0.8, False), (2, "사과는 왜 빨간가", 0.2, False), (3, "현재 상태는", 0.1, False), (4, "사과는 왜 빨간가", 0.0, True), (5, "현재 상태는", 0.0, True), (6, "연구실 회의록", 0.0, True))
    q = rows(spark, "id int, q string, s double, e boolean", *cases)
    return q.select("id", I.resolve_probe(I.route(F.col("q")), F.col("s"), F.col("e")).alias("r")).select("id", "r.*")


@query("intent_table", """SELECT * FROM (VALUES (1, 'content', ['drive','slack'], ['출장'], ['김철수'], CAST([] AS VARCHAR[]), 'summary', '2026년 6월 드라이브와 슬랙에서 김철수님 출장 기록'),
(2, 'location', CAST([] AS VARCHAR[]), ['예산표', '어디', '있어'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'summary', '예산표 어디 있어'),
(3, 'content', ['slack'], ['회의'], CAST([] AS VARCHAR[]), ['work-log'], 'table_by_person', '슬랙 #work-log에서 담당자별 회의 표로'),
(4, 'content', CAST([] AS VARCHAR[]), ['실험'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'chronological', '2026년 6월 지난달 실험 날짜별')) t(id, task, sources, topics, people, channels, output_format, retrieval_query)""")
def intent_table(spark, d):
    cases = ((1, "6월 드라이브와 슬랙에서 김철수님 출장 기록"), (2, "예산표 어디 있어"), (3, "슬랙 #work-log에서 담당자별 회의 표로"), (4, "지난달 실험 날짜별"))
    q = rows(spark, "id int, q string", *cases).select("id", I.intent(F.col("q"), F.expr("date'2026-07-31'")).alias("i"))
    return q.select("id", *[F.col(f"i.{c}") for c in ("task", "sources", "topics", "people", "channels", "output_format", "retrieval_query")])


@query("location_intent", "SELECT * FROM (VALUES (1,'location'),(2,'write_target'),(3,'location'),(4,'ambiguous'),(5,'content'),(6,'ambiguous')) t(id, intent)")
def location_intent(spark, d):
    cases = ((1, "예산표 어디에 있어?"), (2, "출장 신청은 어디에 작성해야 해"), (3, "'깃허브 사용법.docx' 찾아줘"), (4, "보고서 위치와 작성 방법은"), (5, "이 실험은 왜 실패했어"), (6, "엑셀 좀 크게 보여줘"))
    return rows(spark, "id int, q string", *cases).select("id", I.location_intent(F.col("q")).alias("intent"))


@query("write_role", "SELECT * FROM (VALUES (1,'양식'),(2,'과거·제출본'),(3,'작업본')) t(id, role)")
def write_role(spark, d):
    cases = ((1, "출장 양식.hwp", "admin"), (2, "report_final.docx", "backup/2025"), (3, "plan.docx", "work"))
    return rows(spark, "id int, n string, p string", *cases).select("id", I.write_role(F.col("n"), F.col("p")).alias("role"))


@query("hybrid_split", """SELECT * FROM (VALUES (1, '우리 연구실 회의록', '회의록와 웹 최신 동향'), (2, '우리 연구실 자료', '웹 최신 동향'), (3, '로봇 논문을 비교', '웹에서 로봇 논문을 비교')) t(id, internal, web)""")
def hybrid_split(spark, d):
    cases = ((1, "우리 연구실 회의록와 웹 최신 동향"), (2, "웹 최신 동향과 우리 연구실 자료"), (3, "웹에서 로봇 논문을 비교"))
    return rows(spark, "id int, q string", *cases).select("id", I.split_hybrid(F.col("q")).alias("s")).select("id", "s.*")


@query("generic_recency", "SELECT * FROM (VALUES (1, true, true), (2, false, true), (3, true, false), (4, false, false)) t(id, is_generic, forces_recent)")
def generic_recency(spark, d):
    cases = ((1, "최근 슬랙에서 뭐 있는지 알려줘"), (2, "최신 에너지 제안서"), (3, "슬랙 대화 요약해줘"), (4, "최근 출장 다녀온 사람"))
    return rows(spark, "id int, q string", *cases).select("id", I.generic_recency(F.col("q")).alias("is_generic"), I.forces_recent(F.col("q")).alias("forces_recent"))


@query("location_fallback", "SELECT * FROM (VALUES (1, 'location'), (2, 'rag'), (3, 'rag_web'), (4, 'location')) t(id, mode)")
def location_fallback(spark, d):
    cases = ((1, "auto", True, "예산표 어디"), (2, "auto", False, "예산표 어디"), (3, "auto", False, "웹에서 예산표 어디"), (4, "location", False, "예산표 어디"))
    return rows(spark, "id int, m string, f boolean, q string", *cases).select("id", I.after_location(F.col("m"), F.col("f"), F.col("q")).alias("mode"))


@query("timestamp_mode", "SELECT * FROM (VALUES (1, 'created'), (2, 'modified')) t(id, mode)")
def timestamp_mode(spark, d):
    return rows(spark, "id int, q string", (1, "2026년에 만든 문서"), (2, "최근 문서")).select("id", I.timestamp_mode(F.col("q")).alias("mode"))
