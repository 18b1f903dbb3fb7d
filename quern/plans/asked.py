"""The rules over questions asked in every conversation, and over names made from every file and order.

A question is a cue, by conversation and turn, with a word of the message's own text in the place of ``~``. The SQL says what
each cue means, so an error in a rule shows for every message that has its cue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dates, fixed
from quern.functions import intent as I
from quern.functions import text as X
from quern.operators import threads
from quern.plans.base import FILES, MESSAGES, files, messages, query
from quern.plans.routing import HEADS, ROUTE_SQL, SUBJECTS, TAILS
from quern.session import table

WORD = "[a-z]{3,8}"


def asked(spark, d, cues: tuple[str, ...]) -> DataFrame:
    """``conv_id, turn, k, w, q``: the number of the cue, the word, and the question."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    w = F.coalesce(F.nullif(F.regexp_extract("text", WORD, 0), F.lit("")), F.lit("zzz"))
    k = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(cues))).cast("int")
    c = c.select("conv_id", "turn", k.alias("k"), w.alias("w"))
    return c.withColumn("q", F.replace(F.get(F.array(*[F.lit(x) for x in cues]), F.col("k")), F.lit("~"), F.col("w")))


def asked_sql(cues: tuple[str, ...]) -> str:
    listed = ", ".join("'" + c.replace("'", "''") + "'" for c in cues)
    return f"""WITH a AS (SELECT conv_id, turn, CAST((conv_id * 5 + turn) % {len(cues)} AS INTEGER) AS k, coalesce(nullif(regexp_extract(text, '{WORD}'), ''), 'zzz') AS w FROM conversations),
asked AS (SELECT *, replace(([{listed}])[k + 1], '~', w) AS q FROM a) """


def by_cue(*values: str) -> str:
    """The value of each cue, as SQL."""
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


ROUTED = tuple(f"{HEADS[i % len(HEADS)]}{SUBJECTS[i % len(SUBJECTS)]} ~ {TAILS[i % len(TAILS)]}" for i in range(131))


@query("route_asked", asked_sql(ROUTED).rstrip() + ", " + ROUTE_SQL.split("k AS (SELECT id")[1].join(("k AS (SELECT conv_id, turn", "")).replace("FROM g)", "FROM asked)").replace("SELECT id,", "SELECT conv_id, turn,"))
def route_asked(spark, d):
    return asked(spark, d, ROUTED).select("conv_id", "turn", I.route(F.col("q")).alias("r")).select("conv_id", "turn", "r.*")


FORCED = ("~ 어디 있어?", "웹에서 ~ 최신 동향", "~")
MODES = ("web", "rag", "location", "general")


@query("forced_asked", asked_sql(FORCED) + "SELECT conv_id, turn, (['web', 'rag', 'location', 'general'])[turn % 4 + 1] AS mode, 'forced' AS reason FROM asked")
def forced_asked(spark, d):
    """A mode that the user sets counts, whatever the question says."""
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), (F.col("turn") % 4).cast("int"))
    return asked(spark, d, FORCED).select("conv_id", "turn", I.route(F.col("q"), mode).alias("r")).select("conv_id", "turn", "r.mode", "r.reason")


PERIODS = ("2026년 6월 ~ 회의록", "6월 ~", "지난달 ~", "최근 2주 ~", "최근 10일 ~", "이번 달 ~", "~ 그냥 질문", "12월 ~")
_DAYS = (("2026-06-01", "2026-07-01"), ("2026-06-01", "2026-07-01"), ("2026-06-01", "2026-07-01"), ("2026-07-18", "2026-08-01"), ("2026-07-22", "2026-08-01"), ("2026-07-01", "2026-08-01"), None, ("2026-12-01", "2027-01-01"))
_FULL = ("q", "'2026년 ' || q", "'2026년 6월 ' || q", "'2026년 ' || q", "'2026년 ' || q", "'2026년 7월 ' || q", "q", "'2026년 ' || q")


@query("period_asked", asked_sql(PERIODS) + f"""SELECT conv_id, turn, {by_cue(*['NULL' if x is None else f"DATE '{x[0]}'" for x in _DAYS])} AS start_day, {by_cue(*['NULL' if x is None else f"DATE '{x[1]}'" for x in _DAYS])} AS end_day,
 {by_cue('false', 'true', 'true', 'false', 'false', 'true', 'NULL', 'true')} AS inferred, {by_cue(*_FULL)} AS full_query FROM asked""")
def period_asked(spark, d):
    q = asked(spark, d, PERIODS).withColumn("p", dates.period(F.col("q"), F.expr("date'2026-07-31'")))
    return q.select("conv_id", "turn", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), F.col("p.inferred").alias("inferred"), dates.with_year(F.col("q"), F.col("p")).alias("full_query"))


INTENTS = ("드라이브와 슬랙에서 김철수님 ~ 기록", "~ 어디 있어", "슬랙 #work-log에서 담당자별 ~ 표로", "지난달 ~ 날짜별")


@query("intent_asked", asked_sql(INTENTS) + f"""SELECT conv_id, turn, {by_cue("'content'", "'location'", "'content'", "'content'")} AS task, {by_cue("['drive', 'slack']", "[]::VARCHAR[]", "['slack']", "[]::VARCHAR[]")} AS sources,
 list_contains({by_cue('[w]', '[w]', '[w]', '[w]')}, w) AS has_topic, {by_cue("['김철수']", "[]::VARCHAR[]", "[]::VARCHAR[]", "[]::VARCHAR[]")} AS people, {by_cue("[]::VARCHAR[]", "[]::VARCHAR[]", "['work-log']", "[]::VARCHAR[]")} AS channels,
 {by_cue("'summary'", "'summary'", "'table_by_person'", "'chronological'")} AS output_format FROM asked""")
def intent_asked(spark, d):
    q = asked(spark, d, INTENTS).select("conv_id", "turn", "w", I.intent(F.col("q"), F.expr("date'2026-07-31'")).alias("i"))
    return q.select("conv_id", "turn", "i.task", "i.sources", F.array_contains("i.topics", F.col("w")).alias("has_topic"), "i.people", "i.channels", "i.output_format")


PLACES = ("~ 예산표 어디에 있어?", "~ 신청은 어디에 작성해야 해", "'~ 사용법.docx' 찾아줘", "~ 보고서 위치와 작성 방법은", "이 ~ 실험은 왜 실패했어")


@query("location_asked", asked_sql(PLACES) + f"SELECT conv_id, turn, {by_cue(*[repr(x) for x in ('location', 'write_target', 'location', 'ambiguous', 'content')])} AS intent FROM asked")
def location_asked(spark, d):
    return asked(spark, d, PLACES).select("conv_id", "turn", I.location_intent(F.col("q")).alias("intent"))


FOUND = ("~ 예산표 어디", "웹에서 ~ 예산표 어디")


@query("location_fallback_asked", asked_sql(FOUND) + "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR turn % 2 = 0 THEN 'location' WHEN k = 1 THEN 'rag_web' ELSE 'rag' END AS mode FROM asked")
def location_fallback_asked(spark, d):
    """Where a location question goes that found a file (even turns) or none, and one whose mode was set (every third)."""
    mode = F.when(F.col("turn") % 3 == 2, "location").otherwise("auto")
    return asked(spark, d, FOUND).select("conv_id", "turn", I.after_location(mode, F.col("turn") % 2 == 0, F.col("q")).alias("mode"))


RECENT = ("최근 슬랙에서 뭐 있는지 알려줘", "최신 ~ 제안서", "슬랙 대화 요약해줘", "최근 ~ 다녀온 사람", "2026년에 만든 ~ 문서")


@query("recency_asked", asked_sql(RECENT) + f"SELECT conv_id, turn, k IN (0, 2) AS is_generic, k IN (0, 1) AS forces_recent, {by_cue(*[repr(x) for x in ('modified',) * 4], repr('created'))} AS stamp FROM asked")
def recency_asked(spark, d):
    q = F.col("q")
    return asked(spark, d, RECENT).select("conv_id", "turn", I.generic_recency(q).alias("is_generic"), I.forces_recent(q).alias("forces_recent"), I.timestamp_mode(q).alias("stamp"))


SPLITS = ("우리 연구실 ~와 웹 최신 동향", "웹 최신 동향과 우리 연구실 ~", "웹에서 ~ 논문을 비교")


@query("hybrid_split_asked", asked_sql(SPLITS) + f"""SELECT conv_id, turn, {by_cue("'우리 연구실 ' || w", "'우리 연구실 ' || w", "w || ' 논문을 비교'")} AS internal, {by_cue("w || '와 웹 최신 동향'", "'웹 최신 동향'", "q")} AS web FROM asked""")
def hybrid_split_asked(spark, d):
    return asked(spark, d, SPLITS).select("conv_id", "turn", I.split_hybrid(F.col("q")).alias("s")).select("conv_id", "turn", "s.*")


TERMS = ("2026년 ~에서 쓰는 장비는?", "~ ~ 명단 알려줘", "최근 자료")


@query("terms_asked", asked_sql(TERMS) + f"""SELECT conv_id, turn, {by_cue("[w || '에서', w, '쓰는', '장비는', '장비']", "[w, '명단']", "[]::VARCHAR[]")} AS terms FROM asked""")
def terms_asked(spark, d):
    """Terms of questions: each once, with and without its particle, without numbers and stop words."""
    return asked(spark, d, TERMS).select("conv_id", "turn", X.lexical_terms(F.col("q")).alias("terms"))


CHANNELS = ("#team-3 ~ 정리", "슬랙 ~ 정리", "team-5채널 ~ 요약", "~ 정리")


@query("channels_asked", asked_sql(CHANNELS) + f"""SELECT conv_id * 1000 + turn AS id, {by_cue("['team-3']", "[]::VARCHAR[]", "['team-5']", "[]::VARCHAR[]")} AS names, {by_cue("'confirmed'", "''", "'confirmed'", "''")} AS confidence FROM asked""")
def channels_asked(spark, d):
    """Questions of all conversations against the channels that the messages have."""
    q = asked(spark, d, CHANNELS).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "q")
    return threads.resolve_channels(q, messages(spark, d).select(F.col("channel_name").alias("name")).distinct())


@query("follow_ups", MESSAGES + """, u AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 OR conv_id % 3 = 0 THEN text ELSE '그 사람은 ' || text END AS text FROM conversations WHERE role = 'user'),
b AS (SELECT *, trim(text) AS q, lag(trim(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u) SELECT conv_id, turn, sha256(CASE WHEN before IS NOT NULL AND q LIKE '그 사람은 %' THEN before || chr(10) || q ELSE q END) AS routed_hash FROM b""")
def follow_ups(spark, d):
    """Turns of users, some of which begin like a follow-up and are routed behind the turn before them."""
    c = table(spark, d, "conversations")
    text = F.when((F.col("turn") % 4 == 0) | (F.col("conv_id") % 3 == 0), F.col("text")).otherwise(F.concat(F.lit("그 사람은 "), "text"))
    return threads.routing_queries(c.withColumn("text", text)).select("conv_id", "turn", F.sha2("routed", 256).alias("routed_hash"))


@query("notices", "SELECT conv_id, turn, conv_id % 4 > 1 AS kept FROM conversations")
def notices(spark, d):
    """Messages with notices of people coming and going put into half of them."""
    notice = F.when(F.col("conv_id") % 4 == 0, "X Joined the channel ").when(F.col("conv_id") % 4 == 1, "님이 채널에 민수님을 추가했습니다 ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", threads.meaningful(F.concat(notice, "text")).alias("kept"))


@query("secrets_masked", """SELECT conv_id, turn, sha256(CASE turn % 4 WHEN 0 THEN 'password: [REDACTED] ' WHEN 1 THEN '비밀번호는 [REDACTED] 입니다 ' WHEN 2 THEN 'token [REDACTED] ' ELSE 'use [REDACTED] ' END || text) AS safe_hash FROM conversations""")
def secrets_masked(spark, d):
    """Messages with a secret of each kind put in front; the rest of the text stays as it is."""
    secret = F.concat(F.lit("a"), (F.col("conv_id") * 7919 + 12345).cast("string"))
    turn = F.col("turn") % 4
    front = F.when(turn == 0, F.concat(F.lit("password: "), secret, F.lit(" "))).when(turn == 1, F.concat(F.lit("비밀번호는 "), secret, F.lit(" 입니다 "))).when(turn == 2, F.concat(F.lit("token xoxb-12-"), secret, F.lit(" "))).otherwise(F.concat(F.lit("use ghp_"), secret, F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.redact(F.concat(front, "text")), 256).alias("safe_hash"))


NAMED = """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, strftime(o_orderdate::DATE, '%y%m%d') AS short, strftime(o_orderdate::DATE, '%Y%m%d') AS long FROM orders) """


def _dated(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.withColumns({"short": F.date_format("day", "yyMMdd"), "long": F.date_format("day", "yyyyMMdd")})


@query("dates_in_names", NAMED + """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN []::DATE[] WHEN o_orderkey % 5 = 3 AND CAST(day + INTERVAL 30 YEAR AS DATE) <> DATE '2025-01-31' THEN [CAST(day + INTERVAL 30 YEAR AS DATE), DATE '2025-01-31'] ELSE [CAST(day + INTERVAL 30 YEAR AS DATE)] END AS days FROM o""")
def dates_in_names(spark, d):
    """Dates of names made from all orders, thirty years on: long, with separators, short, two of them, and numbers that are none."""
    o, k = _dated(spark, d).withColumn("day", F.add_months("day", 360)), F.col("o_orderkey") % 5
    form = lambda f: F.date_format("day", f)
    name = F.when(k == 0, F.concat(F.lit("report "), form("yyyyMMdd"), F.lit(".pdf"))).when(k == 1, F.concat(form("yyyy/M/d"), F.lit(".txt"))).when(k == 2, F.concat(form("yyMMdd"), F.lit("_plan.hwp")))
    name = name.when(k == 3, F.concat(F.lit("2025-02-30 "), form("yyyy'년' M'월' d'일'"), F.lit(" and 20250131"))).otherwise("v1234567890")
    return o.select("o_orderkey", dates.explicit_dates(name).alias("days"))


@query("years_in_names", NAMED + """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN true ELSE short LIKE '95%' OR (o_orderkey % 3 = 1 AND year(day) = 1995) END AS in_year, CASE WHEN o_orderkey % 3 = 2 THEN true WHEN o_orderkey % 3 = 0 THEN short LIKE '9504%' ELSE year(day) = 1995 END AS in_month FROM o""")
def years_in_names(spark, d):
    """Names that begin with a short date, that hold a year, and that hold the year asked for."""
    n = F.when(F.col("o_orderkey") % 3 == 0, F.concat("short", F.lit("_plan.hwp"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("report "), F.date_format("day", "yyyy"), F.lit(" final"))).otherwise("report 1995 final")
    n = X.normalize(n)
    return _dated(spark, d).select("o_orderkey", dates.name_has_year(n, "1995").alias("in_year"), dates.name_has_year(n, "1995", "04").alias("in_month"))


@query("file_citations", FILES + """SELECT file_id, concat_ws(' · ', name, CASE WHEN seq % 3 = 0 THEN (seq % 40) || '쪽' END, CASE WHEN seq % 2 = 0 THEN '§' || root END, CASE WHEN seq % 5 = 0 THEN 'T' || seq END) AS citation,
 CASE WHEN seq % 4 = 0 THEN file_id || 'a' ELSE file_id END AS primary_id, 'https://drive.google.com/file/d/' || CASE WHEN seq % 4 = 0 THEN file_id || 'a' ELSE file_id END || '/view' AS link FROM files""")
def file_citations(spark, d):
    """Citations and links of all files, of which some have a page, a section, a label, or several ids in one field."""
    f = files(spark, d)
    s = F.col("seq")
    page, section = F.when(s % 3 == 0, (s % 40).cast("int")), F.when(s % 2 == 0, F.col("root")).otherwise("")
    ids = F.when(s % 4 == 0, F.concat(F.lit(" "), "file_id", F.lit("a\t"), "file_id", F.lit("b"))).otherwise(F.col("file_id"))
    return f.select("file_id", X.citation(F.col("name"), page, section, F.when(s % 5 == 0, F.concat(F.lit("T"), s.cast("string")))).alias("citation"), X.primary_id(ids).alias("primary_id"), X.file_link(ids).alias("link"))


_REASON = "CASE " + " ".join(f"WHEN contains(e, '{w}') THEN '{t}'" for w, t in fixed.SKIP_TEXTS) + f" ELSE '{fixed.SKIP_DEFAULT}' END"


@query("file_reasons", FILES + f""", r AS (SELECT *, coalesce(error, '') || ' ' || ([{', '.join(repr(w) for w, _ in fixed.SKIP_TEXTS)}])[seq % {len(fixed.SKIP_TEXTS)} + 1] AS e FROM files WHERE status <> 'indexed') SELECT file_id, {_REASON} AS reason FROM r""")
def file_reasons(spark, d):
    """What is told of files that aren't indexed: their error, with each of the known words in turn."""
    f = files(spark, d).where(F.col("status") != "indexed")
    word = F.get(F.array(*[F.lit(w) for w, _ in fixed.SKIP_TEXTS]), (F.col("seq") % len(fixed.SKIP_TEXTS)).cast("int"))
    return f.select("file_id", X.friendly_reason(F.concat(F.coalesce("error", F.lit("")), F.lit(" "), word)).alias("reason"))


@query("event_numbers", "SELECT event_id, true AS value, true AS labelled, true AS at, false AS kind, false AS props FROM events")
def event_numbers(spark, d):
    """Numbers, labelled numbers and times of all events are told from their words and records."""
    e, n = table(spark, d, "events"), X.numeric_token
    value = F.format_string("%.2f", "value")
    return e.select("event_id", n(F.concat(F.lit('"'), value, F.lit('"'))).alias("value"), n(F.concat(F.lit("x:"), value)).alias("labelled"), n(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"), n(F.col("event_type")).alias("kind"), n(F.col("props")).alias("props"))


PROBED = ("~ 사과는 왜 빨간가", "~ 현재 상태는", "연구실 ~ 회의록")


@query("probe_asked", asked_sql(PROBED) + """, s AS (SELECT *, (turn * 37 + conv_id * 11) % 100 / 100.0 AS score, conv_id % 5 = 0 AS failed FROM asked)
SELECT conv_id, turn, CASE WHEN k = 2 THEN 'rag' WHEN failed THEN CASE k WHEN 1 THEN 'web' ELSE 'general' END WHEN score >= 0.5 THEN 'rag' WHEN k = 1 THEN 'web' ELSE 'general' END AS mode,
 CASE WHEN k = 2 THEN 'internal_hint' WHEN failed THEN CASE k WHEN 1 THEN 'probe_web' ELSE 'probe_error' END WHEN score >= 0.5 THEN 'probe_relevant' WHEN k = 1 THEN 'probe_web' ELSE 'probe_low' END AS reason FROM s""")
def probe_asked(spark, d):
    """Routes after a probe of the stores with any score, and after one that failed."""
    score, failed = F.pmod(F.col("turn") * 37 + F.col("conv_id") * 11, F.lit(100)) / 100.0, F.col("conv_id") % 5 == 0
    return asked(spark, d, PROBED).select("conv_id", "turn", I.resolve_probe(I.route(F.col("q")), score, failed).alias("r")).select("conv_id", "turn", "r.*")


@query("roles_of_files", FILES + "SELECT file_id, CASE seq % 3 WHEN 0 THEN '양식' WHEN 1 THEN '과거·제출본' ELSE '작업본' END AS role FROM files")
def roles_of_files(spark, d):
    """What files are for, by their name or folder: forms, old versions, and working copies."""
    f, k = files(spark, d), F.col("seq") % 3
    name = F.when(k == 0, F.concat(F.lit("출장 양식 "), "name")).otherwise(F.col("name"))
    path = F.when(k == 1, F.concat(F.lit("backup/2025/"), "path")).otherwise(F.col("path"))
    return f.select("file_id", I.write_role(name, path).alias("role"))
