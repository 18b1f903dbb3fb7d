"""Prompt and answer texts from ranked hits: context blocks, source lists, structure, message histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X


def joined(rank: Column, line: Column, sep: str) -> Column:
    """An aggregate: lines in the order of their rank."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), line.alias("l")))), lambda x: x["l"]), sep)


def context_block(hits: DataFrame) -> DataFrame:
    """One row: the numbered texts of the hits of one answer. Input: ``rank, citation, text``."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "citation", F.lit("\n"), "text")
    return hits.agg(joined(F.col("rank"), line, "\n\n").alias("block"))


def sources_block(hits: DataFrame) -> DataFrame:
    """One row for each kind of source: its links, with the numbers the texts have. Input: ``rank, citation, file_url, kind``."""
    link = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ["), X.markdown_text(F.col("citation")), F.lit("]("), X.markdown_url(F.col("file_url")), F.lit(")"))
    return hits.groupBy("kind").agg(joined(F.col("rank"), link, "\n").alias("block"), F.count(F.lit(1)).alias("n"))


def structure(kinds: Column, output_format: Column) -> Column:
    """How an answer should be laid out: by the kinds of its sources, then by the asked format."""
    has = lambda k: F.array_contains(kinds, k)
    heads = F.when(has("drive") & has("slack"), fixed.ANSWER_BOTH).when(has("drive"), fixed.ANSWER_DRIVE).when(has("slack"), fixed.ANSWER_SLACK).otherwise("")
    form = F.lit("")
    for name, text in fixed.ANSWER_FORMATS:
        form = F.when(output_format == name, text).otherwise(form)
    return F.array_join(F.filter(F.array(heads, form), lambda x: x != ""), "\n")


def messages(mode: str, question: str, system: str, history: Sequence[tuple[str, str]] = (), context: str = "", web: str = "", layout: str = "") -> list[dict[str, str]]:
    """The messages of one answer: instructions, the last turns of the conversation, and the question with its material.

    ``mode``: ``rag``, ``general``, ``web`` or ``rag_web``. General answers keep seven turns, others six; material that the
    mode doesn't use is left out; turns of other roles than user and assistant, and empty ones, don't count.
    """
    if mode not in ("rag", "general", "web", "rag_web"):
        raise ValueError(f"unknown mode: {mode}")
    turns = [(r, t) for r, t in history if r in ("user", "assistant") and t and t.strip()][-(7 if mode == "general" else 6) :]
    parts = [context if "rag" in mode else "", web if "web" in mode else "", layout if mode != "general" else ""]
    body = "\n\n".join([*[x for x in parts if x], question])
    return [{"role": "system", "content": system}, *[{"role": r, "content": t} for r, t in turns], {"role": "user", "content": body}]


def histories(conversations: DataFrame, turns: int = 6) -> DataFrame:
    """Per conversation the messages before the last question, ``turns`` at most, as an array in order."""
    from pyspark.sql import Window

    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    before = conversations.withColumn("__last", last).where((F.col("turn") < F.col("__last")) & F.col("role").isin("user", "assistant"))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    few = before.withColumn("__n", newest).where(F.col("__n") <= turns)
    return few.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])).alias("history"))


def web_block(hits: DataFrame, preview: int = 1500) -> DataFrame:
    """One row: numbered web results with sanitised titles, links and a preview. Results without a usable link are left out."""
    clean = hits.withColumn("url", X.clean_url(F.col("url"))).where(F.col("url") != "")
    from quern.operators.fusion import with_rank

    numbered = with_rank(clean, "n", F.col("rank"))
    text = F.concat(F.lit("[W"), F.col("n").cast("string"), F.lit("] "), X.clean_title(F.col("title")), F.lit("\nURL: "), "url", F.lit("\n"), F.left(F.coalesce("content", F.lit("")), F.lit(preview)))
    return numbered.agg(joined(F.col("n"), text, "\n\n").alias("block"), F.count(F.lit(1)).alias("n"))


def intent_block(i: Column) -> Column:
    """The parts of an intent that are set, a line each."""
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    period = F.when(i["period"].isNotNull(), F.concat(F.lit("period: "), i["period"]["start"].cast("string"), F.lit(" to "), i["period"]["end"].cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("task: "), i["task"]), period, listed("sources: ", i["sources"]), listed("topics: ", i["topics"]), listed("people: ", i["people"]), listed("channels: ", i["channels"]), F.concat(F.lit("format: "), i["output_format"]))
