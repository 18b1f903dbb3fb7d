"""What a text of numbers or records holds: numeric share, delimiter, header, key paths, and a summary of it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.scratch import written


def numeric_profile(files: DataFrame, text: str = "text") -> DataFrame:
    """``file_id, n_lines, numeric_ratio, is_table``: a table of numbers has many lines, most of whose tokens are numbers.

    Only the first lines after the header are looked at, inside array functions; nothing is exploded.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    f = files.withColumn("__lines", lines)
    sample = F.slice("__lines", 2, fixed.NUMERIC_SAMPLE - 1)
    tokens = F.filter(F.flatten(F.transform(sample, lambda x: F.split(x, r"[,\t;|\s]+"))), lambda t: F.trim(t) != "")
    f = f.withColumn("__tokens", tokens)
    ratio = F.when(F.size("__tokens") > 0, F.size(F.filter("__tokens", X.numeric_token)) / F.size("__tokens")).otherwise(0.0)
    out = f.select("file_id", F.size("__lines").alias("n_lines"), ratio.alias("numeric_ratio"))
    return out.withColumn("is_table", (F.col("n_lines") >= fixed.NUMERIC_LINES) & (F.col("numeric_ratio") >= fixed.NUMERIC_RATIO))


def delimiter(sample: str) -> str | None:
    """The separator that cuts the first lines into the most columns of equal number."""
    lines = [x for x in sample.split("\n") if x.strip()][:20]
    best: tuple[int, str] | None = None
    for d in (",", "\t", ";", "|"):
        counts = {x.count(d) for x in lines}
        if len(counts) == 1 and (n := counts.pop()) and (best is None or n > best[0]):
            best = (n, d)
    return best[1] if best else None


def key_paths(value: object, depth: int = 4, most: int = 60) -> list[str]:
    """Key paths of a JSON value, ``a.b`` and ``a[]``, to a depth, in order, without repeats."""
    out: dict[str, None] = {}

    def walk(v: object, path: str, left: int) -> None:
        if len(out) >= most:
            return
        if isinstance(v, dict) and left:
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else str(k), left - 1)
        elif isinstance(v, list) and left and v:
            walk(v[0], path + "[]", left - 1)
        elif path:
            out.setdefault(path, None)

    walk(value, "", depth)
    return list(out)


def _kind(v: Column) -> Column:
    """``object``, ``array`` or another word for the kind of a variant; null for null."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def _children(nodes: DataFrame) -> DataFrame:
    """The values of all objects among ``nodes`` (``file_id, path, v``), with their key behind the path."""
    objects = nodes.where(_kind(F.col("v")) == "object")
    each = objects.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return each.select("file_id", F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("value").alias("v"))


def records_profile(files: DataFrame, least: int = 30, depth: int = 3, key_depth: int = 4) -> DataFrame:
    """``file_id, n_records, keys`` of texts that hold records: ``least`` JSON lines at least, all of them objects, or an array of
    as many objects below ``depth`` keys at most, of which the longest counts, ties by path. ``keys``: those of the first record, sorted,
    nested ones with dots, arrays with ``[]``. ``files``: ``file_id, text``.

    The JVM-side counterpart of :func:`json_records` for whole tables: texts are parsed once to variants, objects are opened
    level by level, and arrays are only measured. Texts that are no JSON give no row.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = files.select("file_id", "text", lines.alias("lines"))
    many = rows.where(F.size("lines") >= least).select("file_id", F.size("lines").alias("n"), F.transform("lines", F.try_parse_json).alias("vs"))
    objects = F.forall("vs", lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)))
    by_line = many.where(objects).select("file_id", F.col("n").alias("n_records"), F.col("vs")[0].alias("v"))
    level = rows.select("file_id", F.lit("").alias("path"), F.try_parse_json("text").alias("v")).where(F.col("v").isNotNull())
    found = None
    for k in range(depth + 1):
        first = F.try_variant_get("v", "$[0]", "variant")
        here = level.where(_kind(F.col("v")) == "array").withColumn("first", first).where(_kind(F.col("first")) == "object")
        here = here.select("file_id", "path", F.size(F.col("v").cast("array<variant>")).alias("n"), "first").where(F.col("n") >= least)
        found = here if found is None else found.unionByName(here)
        if k < depth:
            level = _children(level)
    order = F.struct((-F.col("n")).alias("n"), "path")
    longest = Window.partitionBy("file_id").orderBy(order)  # some arrays of one file
    best = found.withColumn("k", F.row_number().over(longest)).where(F.col("k") == 1).select("file_id", F.col("n").alias("n_records"), F.col("first").alias("v"))
    records = written(by_line.unionByName(best.join(by_line.select("file_id"), "file_id", "left_anti")), "first-records")  # a record of each file
    nodes, leaves = records.select("file_id", F.lit("").alias("path"), "v"), None
    for k in range(key_depth):
        nodes = _children(nodes)
        array = _kind(F.col("v")) == "array"
        ends = nodes if k == key_depth - 1 else nodes.where(F.coalesce(_kind(F.col("v")) != "object", F.lit(True)))
        ends = ends.select("file_id", F.when(array, F.concat("path", F.lit("[]"))).otherwise(F.col("path")).alias("path"))
        leaves = ends if leaves is None else leaves.unionByName(ends)
    keys = leaves.groupBy("file_id").agg(F.array_sort(F.collect_set("path")).alias("keys"))  # of one record
    return records.select("file_id", "n_records").join(keys, "file_id", "left").select("file_id", F.col("n_records").cast("long").alias("n_records"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def json_records(source: str, least: int = 30, depth: int = 3) -> tuple[int, list[str]] | None:
    """The number of records and their keys: of JSON lines, or of the longest array of objects found to a depth."""
    lines = [x for x in source.split("\n") if x.strip()]
    if len(lines) >= least:
        try:
            records = [json.loads(x) for x in lines]
            if all(isinstance(r, dict) for r in records):
                return len(records), key_paths(records[0])
        except ValueError:
            pass
    try:
        value = json.loads(source)
    except ValueError:
        return None
    best: list = []

    def walk(v: object, left: int) -> None:
        nonlocal best
        if isinstance(v, list):
            if v and isinstance(v[0], dict) and len(v) > len(best):
                best = v
        elif isinstance(v, dict) and left:
            for x in v.values():
                walk(x, left - 1)

    walk(value, depth)
    return (len(best), key_paths(best[0])) if len(best) >= least else None


def summaries(profiles: DataFrame) -> DataFrame:
    """``file_id, text``: one block of text that stands for a table of numbers."""
    t = F.concat_ws(" ", F.lit("table:"), F.col("n_lines").cast("string"), F.lit("lines,"), F.format_string("%.0f%%", F.col("numeric_ratio") * 100), F.lit("numbers"))
    return profiles.where("is_table").select("file_id", t.alias("text"))


def heading(line: str) -> str | None:
    """What :func:`text.section` says of one line, for parsers."""
    s = line.strip()
    if not s or len(s) > 100:
        return None
    bare = re.sub("[.:]+$", "", s)
    if bare.lower() in fixed.BARE_HEADINGS:
        return bare
    for p in (fixed.SECTION_CHAPTER, fixed.SECTION_ROMAN, fixed.SECTION_NUMBERED):
        if m := re.match(p, s):
            number, title = m[1], m[2].strip()
            if "." in number:
                plausible = all(int(x) <= 99 for x in number.split(".") if x)
            else:
                plausible = not number.isascii() or not number.isdigit() or int(number) <= 30
            if plausible and not re.search("[.,;]$", title) and len(title.split()) <= 12:
                return f"{number} {title}"
            return None
    return None


def _numeric(token: str) -> bool:
    t = token.strip().strip(fixed.WRAPPERS).strip()
    fits = lambda x: bool(re.match(fixed.NUMBER, x) or re.match(fixed.DATE_OR_TIME, x))
    if fits(t):
        return True
    m = re.match(fixed.LABELED_VALUE, t)
    return bool(m) and fits(m[1].strip().strip(fixed.WRAPPERS).strip())


def describe(source: str, shown: int = 3) -> str | None:
    """A table of numbers as a few lines: its size, its columns, its first and last rows. None for other texts."""
    lines = [x for x in source.split("\n") if x.strip()]
    if len(lines) < fixed.NUMERIC_LINES:
        return None
    tokens = [t for x in lines[1 : fixed.NUMERIC_SAMPLE] for t in re.split(r"[,\t;|\s]+", x) if t.strip()]
    ratio = sum(map(_numeric, tokens)) / len(tokens) if tokens else 0.0
    if ratio < fixed.NUMERIC_RATIO:
        return None
    sep = delimiter("\n".join(lines))
    first = [c.strip() for c in (lines[0].split(sep) if sep else lines[0].split())]
    header = [] if any(map(_numeric, first)) else first
    out = [f"table: {len(lines)} lines, {100 * ratio:.0f}% numbers"]
    if header:
        out.append("columns: " + ", ".join(header))
    return "\n".join([*out, "first rows:", *lines[bool(header) : shown + bool(header)], "last rows:", *lines[-shown:]])
