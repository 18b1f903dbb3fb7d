"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word is the sum, over all ways to cut it
into pieces, of the products of their probabilities; the forward algorithm gives that sum for all languages at once. A
text's likelihood is the product over its words (runs of letters in lower case, each with the mark of a word's
beginning), and its score is the winner's share with all languages equally likely beforehand.

Training takes a bounded sample (``MOST_ROWS`` rows of each language, chosen by hash; fewer with over ``MOST_LANGUAGES``)
and counts its words on the executors; the driver gets the words and estimates the pieces' probabilities by expectation
maximisation over the same lattices. The model is a table of pieces by
languages, some 32,000 rows. Scoring reads whole texts; a worker keeps what it has computed of words.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text if there is nothing to
learn from; equal likelihoods go to the first language by code point; equal texts get equal results; a text of any length
is scored whole, from its distinct words; of training rows that have one id and language, one is chosen; an empty table gives
an empty result. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import map_rows

DEFAULT_FILE = "piece_bpe_32k.model"
#: Training rows of each language, and languages up to which each has so many; with more, each has fewer, one at least.
MOST_ROWS, MOST_LANGUAGES = 300, 200
#: Characters of the longest piece of letters in the vocabulary, with the mark; a longer one is an error.
MOST_PIECE, ROUNDS, SMOOTH = 16, 3, 0.02
#: Words a worker keeps before it begins anew.
MOST_WORDS = 300_000
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = DEFAULT_FILE) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters in lower case, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and p.lower() == p and p.removeprefix(MARK).isalpha()}
    if any(len(p) > MOST_PIECE for p in found):
        raise ValueError(f"{path} has pieces of over {MOST_PIECE} characters")
    return {p: i for i, p in enumerate(sorted(found | {MARK}))}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lattices(batch: list[str], known: dict[str, int]) -> np.ndarray:
    """For words of equal length: the piece of each beginning and length, the next number for a lone unknown character and
    the one after that where there is none. The words carry their mark."""
    n, unknown, none = len(batch[0]), len(known), len(known) + 1
    m, get = min(MOST_PIECE, n), known.get
    flat = [get(w[s : s + k], unknown if k == 1 else none) if s + k <= n else none for w in batch for s in range(n) for k in range(1, m + 1)]
    return np.array(flat, np.int32).reshape(len(batch), n, m)


def forward(ids: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all segmentations up to each place, and the logarithms that were taken out of them on the way.

    ``prob`` has a row for each piece and the two extra numbers, and a column for each language.
    """
    count, n, m = ids.shape
    alpha = np.zeros((n + 1, count, prob.shape[1]))
    alpha[0] = 1
    logs = np.zeros((count, prob.shape[1]))
    for end in range(1, n + 1):
        for k in range(1, min(m, end) + 1):
            alpha[end] += alpha[end - k] * prob[ids[:, end - k, k - 1]]
        if end % 16 == 0:
            out = alpha[end].copy()
            alpha[max(0, end - m + 1) : end + 1] /= out
            logs += np.log(out)
    return alpha, logs


def log_likelihoods(batch: list[str], known: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """A row for each word: its log-probability in each language, over all segmentations."""
    out = np.zeros((len(batch), prob.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(batch):
        by_length.setdefault(len(w), []).append(i)
    for rows in by_length.values():
        for at in range(0, len(rows), 2048):
            part = rows[at : at + 2048]
            alpha, logs = forward(lattices([MARK + batch[i] for i in part], known), prob)
            out[part] = np.log(alpha[-1]) + logs
    return out


def estimate(counts: dict[str, int], known: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from the counts of its words. Words over 40 characters are learnt in parts."""
    size = len(known) + 2
    prob = np.full(size, 1 / size)
    prob[-1] = 0
    by_length: dict[int, list[str]] = {}
    parts: dict[str, int] = {}
    for w, c in counts.items():
        line = MARK + w
        for a in range(0, len(line), 41):
            parts[line[a : a + 41]] = parts.get(line[a : a + 41], 0) + c
    for w in sorted(parts):
        by_length.setdefault(len(w), []).append(w)
    grids = [(lattices(ws[a : a + 4096], known), np.array([parts[w] for w in ws[a : a + 4096]], float)) for ws in by_length.values() for a in range(0, len(ws), 4096)]
    for _ in range(rounds):
        expected = np.zeros(size)
        for ids, weight in grids:
            count, n, m = ids.shape
            f = np.zeros((n + 1, count))
            f[0] = 1
            for end in range(1, n + 1):
                for k in range(1, min(m, end) + 1):
                    f[end] += f[end - k] * prob[ids[:, end - k, k - 1]]
            b = np.zeros((n + 1, count))
            b[n] = weight / f[n]
            for start in range(n - 1, -1, -1):
                for k in range(1, min(m, n - start) + 1):
                    b[start] += b[start + k] * prob[ids[:, start, k - 1]]
            for start in range(n):
                for k in range(1, min(m, n - start) + 1):
                    at = ids[:, start, k - 1]
                    np.add.at(expected, at, f[start] * prob[at] * b[start + k])
        prob = (expected + SMOOTH) / (expected[:-1].sum() + SMOOTH * (size - 1))
        prob[-1] = 0
    return prob


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray
    path: str
    key: str = field(default="")


_KEPT: dict[str, tuple[dict[str, int], np.ndarray, int]] = {}


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    known = pieces(model.path)
    index, table, used = _KEPT.get(model.key) or ({}, np.zeros((1024, len(model.languages))), 0)
    split = [words(t) if t else [] for t in texts]
    if used > MOST_WORDS:
        index, used = {}, 0
    new = sorted({w for ws in split for w in ws if w not in index})
    lettered = [w for w in new if any(c.isalpha() for c in w)]
    for w in set(new) - set(lettered):
        index[w] = -1
    if lettered:
        if used + len(lettered) > len(table):
            table = np.concatenate((table[:used], np.zeros((used + 2 * len(lettered), table.shape[1]))))
        table[used : used + len(lettered)] = log_likelihoods(lettered, known, model.prob)
        index.update(zip(lettered, range(used, used + len(lettered)), strict=True))
        used += len(lettered)
    _KEPT.clear()
    _KEPT[model.key] = (index, table, used)
    names, scores = [], []
    for ws in split:
        rows = [i for w in ws if (i := index[w]) >= 0]
        if not rows or not model.languages:
            names.append("und")
            scores.append(0.0)
            continue
        total = table[rows].sum(axis=0)
        best = int(total.argmax())
        names.append(model.languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return names, scores


def training_words(docs: DataFrame, allowed, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most: int = MOST_ROWS) -> dict[str, dict[str, int]]:
    """Word counts of each language over at most ``most`` of its rows that are ``allowed``: those with the smallest hashes.

    Rows are chosen on narrow columns before any text is read; texts then come by a join with that bounded choice.
    """
    i, x = F.col(f"`{id_col}`"), F.col(f"`{lang}`")
    narrow = docs.select(i.alias("id"), x.alias("lang")).where(x.isNotNull() & allowed(i)).withColumn("h", F.xxhash64("id"))
    languages = narrow.select("lang").distinct().count()
    most = max(1, min(most, most * MOST_LANGUAGES // max(1, languages)))
    few = narrow.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("k") <= most)
    few = few.select(F.col("lang").alias("of_lang"), F.col("id").alias("of_id")).distinct()
    rows = docs.select(i.alias("id"), x.alias("lang"), F.col(f"`{text}`").alias("text")).join(F.broadcast(few), (F.col("id") == F.col("of_id")) & (F.col("lang") == F.col("of_lang")))
    # one row of each id and language, whatever the table has of them
    rows = rows.groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(langs, bodies):
        per: dict[tuple[str, str], int] = {}
        for a, body in zip(langs, bodies, strict=True):
            for w in words(body or ""):
                per[a, w] = per.get((a, w), 0) + 1
        return [a for a, _ in per], [w for _, w in per], list(per.values())

    counted = map_rows(rows, "lang string, word string, n long", count).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {a: {} for (a,) in rows.select("lang").distinct().collect()}
    for r in counted.orderBy("lang", "word").collect():
        out[r["lang"]][r["word"]] = r["n"]
    return out


def learn(counts: dict[str, dict[str, int]], path: str | None = None) -> Model:
    import hashlib

    path = path or vocabulary_path()
    known = pieces(path)
    langs = sorted(counts)
    prob = np.stack([estimate(counts[x], known) for x in langs], axis=1) if langs else np.zeros((len(known) + 2, 0))
    return Model(langs, prob, path, hashlib.sha256(prob.tobytes()).hexdigest())


def held_out(doc_id):
    """Rows that training never sees: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_table(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    i = F.col(f"`{id_col}`")
    if model is None:
        model = learn(training_words(docs, lambda x: ~held_out(x), text, lang, id_col))
    narrow = docs.select(i.alias("doc_id"), held_out(i).alias("held_out"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, of fixed size
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_rows(narrow, f"doc_id {kind}, held_out boolean, lang_pred string, score double", lambda ids, held, texts: (ids, held, *predict(shared.value, texts)), rows=256)
