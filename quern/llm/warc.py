"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

**Writing.** A record is one string: version line, fields, HTTP head and payload; the writer's line separator is the two line
ends that close a record, so every file it makes is a whole archive. Records of equal payloads (SHA-256) of at least
``least`` bytes are one response, that of the smallest page, and revisits that refer to it and carry no payload.

**Reading.** Files are cut at the version line, by Spark's text reader, which splits them. What follows such a line may be a
record or a piece of a payload that holds such a line. Pass one emits for each piece that parses as a record where its
successor would begin, and follows these links inside its own split, so that each candidate knows where its chain leaves the
split (``exit``). Offsets are relative to the split's first piece; the splits' lengths, added up, make them absolute. Then
pointer jumping from each file's start, whose jumps double each round, finds where the real chain enters each split: as many
rounds as the logarithm of the splits of a file. Pass two reads the files again with each split's entry and keeps the
records on the chain; all other pieces belong to the payload of the record before them. A payload that goes on in later
splits is put together by its record, from one part for each split.

What goes by broadcast is counted first: groups of equal payloads when writing, entries of splits when reading. Beyond
``MOST_BROADCAST`` rows they are joined by a shuffle. No step gathers a file or a group of equal payloads in one task.

Defined cases: a null text is an empty payload, equal to other empty ones; repeated rows of the smallest page are all
responses with one record id; a null id comes after all others and is written without the field that holds it; a null url
has no target field; line ends in a url, and a version line at its end, are percent-encoded. An archive that is cut off, or
whose chain leads to no record, gives the records before that place; a file that doesn't begin with the version line gives
none; no files give an empty result. Header fields must not end with the version line's text, and one record must fit a row
(2 GB). Other columns take no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.text import arrow_schema
from quern.scratch import folder, written
from quern.session import prepared

#: Fixed values of the format.
VERSION, LINE_END, CLOSE = "WARC/1.1", "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = VERSION + LINE_END
#: Rows of a table that may go to all tasks by broadcast.
MOST_BROADCAST = 100_000
NO_ID = "~"
DATE = "2026-01-01T00:00:00Z"
#: Bytes of a block that its HTTP head lies within.
MOST_HEAD = 65_536


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in base 32: five hex digits are four digits of base 32."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _small(df: DataFrame) -> DataFrame:
    """``df``, by broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def marked(pages: DataFrame, least: int = 0, id_col: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """``page, url, payload, first, revisit``: whether a page repeats the payload of another, and the first page that has it.

    The smallest page of each payload comes from partial aggregation over ids and digests; payloads aren't shuffled for it.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    many = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    many = written(many.where(F.col("n") > 1).select(F.col("key").alias("of"), "first", F.lit(True).alias("shared")), "warc-shared")
    joined = rows.join(_small(many), F.col("key") == F.col("of"), "left")
    again = F.coalesce(F.col("shared") & ~F.col("page").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page", "url", "payload", "first", again.alias("revisit"))


def record_text(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``value``: each row of :func:`marked` as a record, without the line ends that close it."""
    name = lambda c: F.coalesce(F.url_encode(c.cast("string")), F.lit(NO_ID))
    digest = base32_sha1(F.col("payload"))
    rid = lambda c: F.concat(F.lit("<urn:page:"), name(c), F.lit(":"), F.col("digest"), F.lit(">"))
    size = F.when(F.col("revisit"), 0).otherwise(F.octet_length("payload"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE_END}Content-Type: text/html; charset=utf-8{LINE_END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CLOSE))
    target = F.regexp_replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), "WARC/1\\.1$", "WARC%2F1.1")
    field = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(LINE_END)), F.lit(""))
    again = lambda c: F.when(F.col("revisit"), c)
    return rows.withColumn("digest", digest).withColumn("head", head).select(
        F.concat(
            F.lit(MAGIC), field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), field("WARC-Record-ID", rid(F.col("page"))), field("WARC-Date", F.lit(date)),
            field("WARC-Target-URI", target), field("Page-Id", F.url_encode(F.col("page").cast("string"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            field("WARC-Profile", again(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), field("WARC-Refers-To", again(rid(F.col("first")))),
            field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", (F.octet_length("head") + size).cast("string")), F.lit(LINE_END),
            "head", F.when(F.col("revisit"), "").otherwise(F.col("payload").cast("string")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, records: int = 0, date: str = DATE, **how) -> None:
    """Writes a record for every page below ``path``; ``records``: of one file at most, 0 for no bound."""
    out = record_text(marked(pages, **how), date)
    out.write.option("lineSep", CLOSE).option("maxRecordsPerFile", records).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, value``: what lies between version lines, in the order of the file within each split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parsed(piece: bytes) -> tuple[int, int] | None:
    """Where the block of a piece that looks like a record begins, and its length; None if it doesn't look like one."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in piece[:end].split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length":
            return (end + 4, int(value)) if value.strip().isdigit() else None
    return None


def _followed(ats: list[int], nexts: list[int]) -> tuple[list[int], list[int]]:
    """For each candidate of a split, where its chain leaves the split, and its last record inside. Links point forward."""
    place = {at: i for i, at in enumerate(ats)}
    out, last = [0] * len(ats), [0] * len(ats)
    for i in range(len(ats) - 1, -1, -1):
        j = place.get(nexts[i])
        out[i], last[i] = (nexts[i], ats[i]) if j is None else (out[j], last[j])
    return out, last


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Pass one. ``path, block, at, exit, last``: candidates, by the place after their version line, relative to their
    split's first piece; a row with ``at`` null has the split's length as ``exit``."""
    ddl = "path string, block long, at long, exit long, last long"
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        here, place, ats, nexts = None, 0, [], []

        def done():
            out, last = _followed(ats, nexts)
            n = len(ats) + 1
            cells = [[here[0]] * n, [here[1]] * n, [*ats, None], [*out, place], [*last, None]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (name, block):
                    if here is not None:
                        yield done()
                    here, place, ats, nexts = (name, block), 0, [], []
                if found := parsed(piece):
                    ats.append(place)
                    nexts.append(place + found[0] + found[1] + len(CLOSE) + len(MAGIC))
                place += len(piece) + len(MAGIC)
        if here is not None:
            yield done()

    prepared(spark)
    return _pieces(spark, path).mapInArrow(run, ddl)


def entries(found: DataFrame) -> DataFrame:
    """``path, block, base, entry, carry`` of every split: its first piece's place in the file, the first record of the chain
    inside (relative; null if none), and the place of the record that goes on into it from an earlier split (null if none).

    ``found``: a table of :func:`candidates`. The two windows are over the splits of one file.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(found.where(F.col("at").isNull()).select("path", "block", F.coalesce(F.sum("exit").over(before), F.lit(0)).alias("base")), "warc-splits")
    links = found.where(F.col("at").isNotNull()).join(_small(splits), ["path", "block"])
    nodes = written(links.select("path", "block", "at", (F.col("base") + F.col("at")).alias("place"), (F.col("base") + F.col("exit")).alias("to"), (F.col("base") + F.col("last")).alias("last")), "warc-nodes")
    jumps = nodes.select("path", "place", "to")
    reached = written(splits.where(F.col("block") == 0).select("path", F.lit(len(MAGIC)).cast("long").alias("place")), "warc-reached")
    while not jumps.isEmpty():
        step = reached.join(jumps, ["path", "place"]).select("path", F.col("to").alias("place"))
        reached = written(reached.unionByName(step).distinct(), "warc-reached")
        onward = jumps.select("path", F.col("place").alias("to"), F.col("to").alias("end"))
        jumps = written(jumps.join(onward, ["path", "to"]).select("path", "place", F.col("end").alias("to")), "warc-jumps")
    first = nodes.join(reached, ["path", "place"], "left_semi").select("path", "block", F.col("at").alias("entry"), "last")
    known = splits.join(first, ["path", "block"], "left")
    return written(known.select("path", "block", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("carry")), "warc-entries")


def chained(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Pass two. ``path, at, off, need, header, block``: the records of the chain, each with the part of its block that lies
    in the split where it begins (``off`` = ``at``), and a row without header for the part in each later split."""
    ddl = "path string, at long, off long, need long, header binary, block binary"
    schema = arrow_schema(ddl)
    pieces = _pieces(spark, path)
    few = _small(known)
    if few is known:
        ordered = pieces.withColumn("seq", F.monotonically_increasing_id()).join(known, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "seq")
        dealt = ordered.select("path", "block", "value", "base", "entry", "carry")
    else:
        dealt = pieces.join(few, ["path", "block"]).select("path", "block", "value", "base", "entry", "carry")

    def run(batches):
        import pyarrow as pa

        magic = MAGIC.encode()
        here = record = due = None
        place, parts = 0, []

        def closed():
            body = b"".join(parts)
            return (here[0], *record[:3], record[3], body if record[2] is None else body[: record[2]])

        for batch in batches:
            out = []
            for name, block, piece, base, entry, carry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (name, block):
                    if record and parts:
                        out.append(closed())
                    here, place, due = (name, block), 0, entry
                    record, parts = (carry, base, None, None) if carry is not None else None, []
                if place == due and (found := parsed(piece)):
                    if record and parts:
                        out.append(closed())
                    start, n = found
                    record, parts = (base + place, base + place, n, piece[: start - 4]), [piece[start:]]
                    due = place + start + n + len(CLOSE) + len(MAGIC)
                elif record:
                    # the first piece of a split begins behind a version line as all others do, except that of a file
                    parts += [magic, piece]
                place += len(piece) + len(MAGIC)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if record and parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(closed(), strict=True), schema, strict=True)], schema=schema)

    prepared(spark)
    return dealt.mapInArrow(run, ddl)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, at, header, block`` of every record of the chains of the files below ``path``; ``at``: the byte behind its
    version line. Records whose blocks are cut off by the end of the file are left out."""
    found = written(candidates(spark, path), "warc-candidates")
    known = entries(found)
    parts = chained(spark, path, known)
    whole = parts.where(F.octet_length("block") == F.col("need")).select("path", "at", "header", "block")
    if known.where(F.col("carry").isNotNull() & ~F.col("entry").eqNullSafe(F.lit(0))).isEmpty():
        return whole
    rest = parts.where(F.col("need").isNull() | (F.octet_length("block") < F.col("need")))
    item = F.struct(F.col("off").alias("off"), F.col("block").alias("block"))  # one for each split that the record lies in
    each = rest.groupBy("path", "at").agg(F.max("need").alias("need"), F.max("header").alias("header"), F.array_sort(F.collect_list(item)).alias("parts"))
    each = each.withColumn("block", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"])))
    each = each.where(F.octet_length("block") >= F.col("need")).select("path", "at", "header", F.substring("block", F.lit(1), F.col("need").cast("int")).alias("block"))
    return whole.unionByName(each)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_type, record_id, page, url, refers_to, digest, payload``: the records below ``path``, with fields as written
    and payloads without the HTTP head."""
    text = F.concat(F.lit(LINE_END), F.col("header").cast("string"), F.lit(LINE_END))
    field = lambda key: F.nullif(F.regexp_extract("text", rf"(?i)\r\n{key}:[ \t]*([^\r]*?)[ \t]*\r\n", 1), F.lit(""))
    head = F.substring_index(F.substring("block", 1, MOST_HEAD).cast("string"), CLOSE, 1)
    body = F.substring("block", F.octet_length("head") + len(CLOSE) + 1, F.octet_length("block"))
    rows = raw_records(spark, path).withColumn("text", text).withColumn("head", head)
    is_http = F.coalesce(field("Content-Type"), F.lit("")).startswith("application/http")
    return rows.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), F.url_decode(field("Page-Id")).alias("page"), field("WARC-Target-URI").alias("url"),
        field("WARC-Refers-To").alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), F.when(is_http, body).otherwise(F.col("block")).alias("payload"),
    )


def archived_pages(pages: DataFrame, least: int = 0, id_col: str = "page_id", url: str = "url", text: str = "html", path: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from archives that are written and
    read back. Length and digest of a response are those of the payload that was read; a revisit has those of the response
    that its record refers to."""
    spark = pages.sparkSession
    prepared(spark)
    path = path or f"{folder(spark, 'warc')}/archives"
    write_archives(pages, path, least=least, id_col=id_col, url=url, text=text)
    kind = pages.schema[id_col].dataType
    read = read_archives(spark, path).select(
        "record_type", "record_id", "refers_to", F.col("page").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    rows = written(read, "warc-read", by=("record_type",))
    is_new = F.col("record_type") == "response"
    responses = rows.where(is_new).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = rows.where(~is_new).select("page_id", "record_type", F.col("refers_to").alias("of"))
    if again.isEmpty():
        return responses
    # repeated rows share a record id; as a table of its own it leaves Spark free to split the revisits of one response
    named = rows.where(is_new).join(_small(written(again.select("of").distinct(), "warc-asked")), F.col("record_id") == F.col("of"), "left_semi")
    named = written(named.groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")), "warc-targets")
    revisits = again.join(_small(named), F.col("of") == F.col("record_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)
