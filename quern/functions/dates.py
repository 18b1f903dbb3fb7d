"""Dates in names and queries, periods, and local days in Seoul."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed

ZONE = "Asia/Seoul"


def explicit_dates(text: Column) -> Column:
    """All dates that a text spells out, as an ordered array without repeats: full forms, then 8 digits, then 6 digits."""

    def found(pattern: str, century: str) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def one(m: Column) -> Column:
            y, mo, d = (F.regexp_extract(m, pattern, i) for i in (1, 2, 3))
            return F.concat(F.lit(century), y, F.lit("-"), F.lpad(mo, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")

        return F.transform(whole, one)

    every = F.concat(found(fixed.FULL_DATE, ""), found(fixed.COMPACT_DATE, ""), found(fixed.SHORT_DATE, "20"))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def local_day(stamp: Column) -> Column:
    """The day in Seoul of an ISO time; without a zone it counts as UTC; null if it can't be read."""
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(F.regexp_replace(F.trim(stamp), "Z$", "+00:00")), ZONE))


def epoch_day(seconds: Column) -> Column:
    """The day in Seoul of seconds since 1970, given as text; null if it isn't a number."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds.try_cast("double")), ZONE))


def in_period(hit: dict[str, Column], start: Column, end: Column) -> Column:
    """Whether a hit lies in ``[start, end)``: chat by its thread's day; a file by any date in its name, citation, path or
    root if there is one, else by the first of its time stamps that can be read; otherwise not."""
    inside = lambda x: (x >= start) & (x < end)
    named = explicit_dates(F.concat_ws(" ", *[F.coalesce(hit.get(k, F.lit("")), F.lit("")) for k in ("name", "citation", "path", "root")]))
    day = F.coalesce(*[local_day(hit[k]) for k in ("mod_time", "modified_time", "created_time") if k in hit])
    by_file = F.when(F.size(named) > 0, F.exists(named, inside)).otherwise(inside(day))
    return F.coalesce(F.when(hit["source"].isin("slack", "slack_parent"), inside(epoch_day(hit["thread_ts"]))).otherwise(by_file), F.lit(False))


def period(query: Column, today: Column) -> Column:
    """``struct(start, end, inferred)`` of the period that a query names, or null: a month with or without its year, the
    last or this month, the last n days or weeks including today."""
    first = F.trunc(today, "month").cast("date")
    year, month = F.regexp_extract(query, fixed.MONTH, 1), F.regexp_extract(query, fixed.MONTH, 2)
    start = F.make_date(F.when(year != "", year.try_cast("int")).otherwise(F.year(today)), month.try_cast("int"), F.lit(1))
    n = F.regexp_extract(query, fixed.RECENT_SPAN, 1).try_cast("int") * F.when(F.regexp_extract(query, fixed.RECENT_SPAN, 2) == "주", 7).otherwise(1)
    span = lambda a, b, inferred: F.struct(a.alias("start"), b.alias("end"), inferred.alias("inferred"))
    return (
        F.when(query.rlike(fixed.MONTH), span(start, F.add_months(start, 1), year == ""))
        .when(query.contains("지난달"), span(F.add_months(first, -1), first, F.lit(True)))
        .when(query.rlike("이번 ?달"), span(first, F.add_months(first, 1), F.lit(True)))
        .when(query.rlike(fixed.RECENT_SPAN), span(F.date_sub(today, F.greatest(n - 1, F.lit(0))), F.date_add(today, 1), F.lit(False)))
    )


def with_year(query: Column, p: Column) -> Column:
    """The query with the year, or year and month, that its period had to infer; unchanged if it names a year."""
    year = F.concat(F.year(p["start"]).cast("string"), F.lit("년 "))
    relative = query.contains("지난달") | query.rlike("이번 ?달")
    longer = F.when(relative, F.concat(year, F.month(p["start"]).cast("string"), F.lit("월 "), query)).otherwise(F.concat(year, query))
    return F.when(p.isNull() | query.rlike(r"20[0-9]{2}\s*년"), query).otherwise(longer)


def name_has_year(normal_name: Column, year: str, month: str = "") -> Column:
    """A file name with the year anywhere, or beginning with its last two digits (and the month)."""
    return normal_name.contains(year) | F.regexp_replace(normal_name, "[^0-9]", "").startswith(year[2:] + month)
