"""What a question asks for: sources, people, topics, format, route and location. Rules in order; the first match wins.

Every function gives a Column, so a whole table of questions is classified in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import dates, fixed
from quern.functions import text as X


def people(q: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(q, F.lit(fixed.PERSON), F.lit(1)))


def channels(q: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(q, F.lit(fixed.CHANNEL), F.lit(1)))


def sources(q: Column) -> Column:
    found = F.array(F.when(q.rlike(fixed.DRIVE_WORD), "drive"), F.when(q.rlike(fixed.SLACK_WORD), "slack"))
    return F.filter(found, lambda x: x.isNotNull())


def topics(q: Column) -> Column:
    """Words that are left without dates, channels, sources and people, without one ending, that aren't generic."""
    bare = q
    for pattern in (fixed.MONTH, fixed.RECENT_SPAN, fixed.CHANNEL, fixed.DRIVE_WORD, fixed.SLACK_WORD, fixed.PERSON):
        bare = F.regexp_replace(bare, pattern, " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit("[0-9A-Za-z가-힣][0-9A-Za-z가-힣_-]*"), F.lit(0)), lambda w: F.regexp_replace(w, fixed.TOPIC_SUFFIX, ""))
    stop = X.array_of(fixed.INTENT_STOPWORDS)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")))


def output_format(q: Column) -> Column:
    by_person, as_table = q.contains("담당자별"), q.rlike(fixed.TABLE_WORD)
    return (
        F.when(by_person & as_table, "table_by_person").when(q.contains("날짜별") | q.contains("시간순"), "chronological")
        .when(by_person, "by_person").when(as_table, "table").otherwise("summary")
    )


def task(q: Column) -> Column:
    return F.when(q.rlike(fixed.LOCATION_WORD), "location").otherwise("content")


def intent(q: Column, today: Column) -> Column:
    """``struct(task, period, sources, topics, people, channels, output_format, retrieval_query)``."""
    p = dates.period(q, today)
    return F.struct(
        task(q).alias("task"), p.alias("period"), sources(q).alias("sources"), topics(q).alias("topics"), people(q).alias("people"), channels(q).alias("channels"),
        output_format(q).alias("output_format"), F.when(p["inferred"], dates.with_year(q, p)).otherwise(q).alias("retrieval_query"),
    )


def _decision(mode: str, reason: str, probe: bool = False) -> Column:
    return F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"), F.lit(probe).alias("probe"))


def route(q: Column, requested: Column | None = None) -> Column:
    """``struct(mode, reason, probe)``: where a question goes. An unknown requested mode is an error."""
    requested = F.lit("auto") if requested is None else requested
    both = q.rlike(fixed.HINT_DRIVE) & q.rlike(fixed.HINT_SLACK)
    web, inside = q.rlike(fixed.HINT_EXPLICIT_WEB), q.rlike(fixed.HINT_INTERNAL)
    rules = (
        (~requested.isin(*fixed.ROUTE_MODES), F.struct(F.raise_error(F.concat(F.lit("unknown mode: "), requested)).cast("string").alias("mode"), F.lit("").alias("reason"), F.lit(False).alias("probe"))),
        (requested != "auto", F.struct(requested.alias("mode"), F.lit("forced").alias("reason"), F.lit(False).alias("probe"))),
        (q.rlike(fixed.TASK_HEAD) | q.rlike(fixed.TASK_GENERATE), _decision("general", "openwebui_task")),
        ((F.size(sources(q)) == 2) & web, _decision("rag_web", "explicit_internal_web")),
        (F.size(sources(q)) == 2, _decision("rag", "explicit_multi_source")),
        (task(q) == "location", _decision("location", "location_hint")),
        (both & web, _decision("rag_web", "explicit_internal_web")),
        (both, _decision("rag", "explicit_multi_source")),
        (inside & web, _decision("rag_web", "explicit_internal_web")),
        (q.rlike(fixed.HINT_WEB_SOURCE), _decision("web", "web_source_hint")),
        (q.rlike(fixed.HINT_LOCATION), _decision("location", "location_hint")),
        (q.rlike(fixed.HINT_CURRENT_WEB) & ~q.rlike(fixed.HINT_LAB), _decision("web", "web_hint")),
        (inside, _decision("rag", "internal_hint")),
        (q.rlike(fixed.HINT_WEB) | q.rlike(fixed.HINT_PRODUCT), _decision("web", "web_hint")),
        (q.rlike(fixed.HINT_TIMELY), _decision("auto", "ambiguous_web", True)),
        (q.rlike(fixed.HINT_GENERAL), _decision("general", "general_hint")),
    )
    out = _decision("auto", "ambiguous", True)
    for condition, decision in reversed(rules):
        out = F.when(condition, decision).otherwise(out)
    return out


def resolve_probe(decision: Column, score: Column, error: Column, threshold: float = fixed.PROBE_THRESHOLD) -> Column:
    """The route after a probe of the stores: inside if the best score reaches the threshold."""
    web = decision["reason"] == "ambiguous_web"
    probed = (
        F.when(error & web, F.struct(F.lit("web").alias("mode"), F.lit("probe_web").alias("reason")))
        .when(error, F.struct(F.lit("general").alias("mode"), F.lit("probe_error").alias("reason")))
        .when(score >= threshold, F.struct(F.lit("rag").alias("mode"), F.lit("probe_relevant").alias("reason")))
        .when(web, F.struct(F.lit("web").alias("mode"), F.lit("probe_web").alias("reason")))
        .otherwise(F.struct(F.lit("general").alias("mode"), F.lit("probe_low").alias("reason")))
    )
    return F.when(decision["probe"], probed).otherwise(F.struct(decision["mode"].alias("mode"), decision["reason"].alias("reason")))


def after_location(decision_mode: Column, found: Column, q: Column) -> Column:
    """Where a location question goes that found nothing on its own: inside, and the web too if it is named as a source."""
    return F.when(found | (decision_mode != "auto"), "location").when(q.rlike(fixed.HINT_WEB_SOURCE), "rag_web").otherwise("rag")


def location_intent(q: Column) -> Column:
    where, content = q.rlike(fixed.LOCATE_WHERE), q.rlike(fixed.LOCATE_CONTENT)
    return (
        F.when(q.rlike(fixed.LOCATE_WRITE), "write_target")
        .when(q.rlike(fixed.LOCATE_EXTENSION) & q.rlike(fixed.LOCATE_SEEK), "location")
        .when(where & ~content, "location")
        .when(where & content, "ambiguous")
        .when(q.rlike(fixed.LOCATE_ARTIFACT) & q.rlike(fixed.LOCATE_SEEK_WEAK), "ambiguous")
        .otherwise("content")
    )


def write_role(name: Column, path: Column) -> Column:
    both = F.concat_ws(" ", name, path)
    return F.when(both.rlike(fixed.ROLE_TEMPLATE), "양식").when(both.rlike(fixed.ROLE_ARCHIVE), "과거·제출본").otherwise("작업본")


def _clean(c: Column) -> Column:
    return F.btrim(F.regexp_replace(X.collapse(c), r"^(?:와|과|및|그리고)\s*", ""), F.lit(" ,"))


def split_hybrid(q: Column) -> Column:
    """``struct(internal, web)``: a question for both sides as one question for each, without the other side's words."""
    t = F.trim(q)
    web_first, inside_first = t.rlike(fixed.SPLIT_WEB_FIRST), t.rlike(fixed.SPLIT_INTERNAL_FIRST)
    no_inside, no_web = (lambda c: _clean(F.regexp_replace(c, fixed.SPLIT_INTERNAL_WORD, ""))), (lambda c: _clean(F.regexp_replace(c, fixed.SPLIT_WEB_WORD, "")))
    clause = _clean(F.regexp_extract(t, fixed.SPLIT_INTERNAL_FIRST, 1))
    other = F.regexp_extract(t, fixed.SPLIT_INTERNAL_FIRST, 2)
    joined = F.when(no_inside(clause) != "", clause).otherwise(_clean(F.concat_ws(" ", clause, no_web(other))))
    internal = F.when(web_first, _clean(F.regexp_extract(t, fixed.SPLIT_WEB_FIRST, 2))).when(inside_first, joined).otherwise(no_web(q))
    topic = no_inside(internal)
    internal = F.when(topic.rlike("(?:과제|프로젝트)$"), F.concat(topic, F.lit(" 회의록 연구 내용"))).otherwise(internal)
    web = F.when(web_first, _clean(F.regexp_extract(t, fixed.SPLIT_WEB_FIRST, 1))).otherwise(no_inside(F.regexp_replace(q, fixed.SPLIT_PROJECT_JOIN, "")))
    return F.struct(F.when(internal == "", q).otherwise(internal).alias("internal"), F.when(web == "", q).otherwise(web).alias("web"))


def generic_recency(q: Column) -> Column:
    """Whether nothing is left of a question without words for "the latest chat"."""
    bare = F.lower(q)
    for pattern in (
        "최근|최신", "(?:slack|슬랙)(?:에서|에는|의|에)?", "(?:내용|대화|메시지)(?:이|가|은|는|을|를)?",
        r"뭐(?:가|야|했어|했나|있는지)?|어떤|알려줘|보여줘|요약해줘|알\s*수\s*있나|있는지|있어|있나|해줘",
    ):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.regexp_replace(bare, "[^0-9a-z가-힣]+", "") == ""


def forces_recent(q: Column) -> Column:
    return q.rlike(fixed.RECENCY) & ~q.rlike(fixed.RECENCY_DETAIL)


def timestamp_mode(q: Column) -> Column:
    return F.when(q.rlike(fixed.CREATED_WORD), "created").otherwise("modified")
