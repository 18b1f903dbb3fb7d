"""Byte-level BPE encoding and decoding with a public vocabulary file.

A piece of text (see ``PATTERN``) starts as its bytes in a doubly linked list. A priority queue holds the neighbouring
pairs that the merge table knows, by rank and then by place. Popping a pair merges it if both ends are still what they
were when it was queued; otherwise the entry is stale and skipped. A merge queues the two pairs it creates. Decoding
concatenates the vocabulary strings of the ids, byte by byte.

Defined cases: a null text counts as empty and has no ids; special tokens of the file that occur in a text are single ids;
a text of any length is encoded whole; repeated rows get equal results; an empty table gives an empty result. Other columns take
no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import prepared

DEFAULT_FILE = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer's pattern of byte-level files of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps. Beyond it the kept pieces are dropped and collected anew.
MOST_PIECES = 200_000
#: Piece lengths (characters) that are kept.
MOST_PIECE_CHARS = 32


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.string: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = special
        self.string |= {i: s.encode() for s, i in special.items()}
        self.decimal = {i: str(i) for i in self.string}
        self.pieces = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split if special else None
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        known = self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := known((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one end was merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := known((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := known((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def plain(self, text: str, out: list[int]) -> None:
        kept = self.kept
        for piece in self.pieces(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= MOST_PIECE_CHARS:
                    if len(kept) >= MOST_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.parts is None or not any(s in text for s in self.special):
            self.plain(text, out)
            return out
        for part in self.parts(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self.plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included. Ids that aren't in the vocabulary count as empty."""
        get = self.string.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file in a worker; reused workers keep what they know of pieces."""
    return Codec(path)


def vocabulary_path(name: str = DEFAULT_FILE) -> str:
    return public_tokenizers.path(name)


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_pydict(make(batch.slice(start, 512)))

    prepared(df.sparkSession)
    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` for every row."""
    path = path or vocabulary_path()

    def make(batch):
        import pyarrow as pa

        c = codec(path)
        return {"doc_id": batch.column(0), "ids": pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))}

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _mapped(narrow, f"doc_id {narrow.schema[0].dataType.simpleString()}, ids array<int>", make)


def decoded(tokens: DataFrame, path: str | None = None, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` for every row of ids; null ids give an empty text."""
    path = path or vocabulary_path()

    def make(batch):
        import pyarrow as pa

        c = codec(path)
        return {"doc_id": batch.column(0), "text": pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())}

    narrow = tokens.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    return _mapped(narrow, f"doc_id {narrow.schema[0].dataType.simpleString()}, text string", make)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass, with only digests leaving Python."""
    path = path or vocabulary_path()

    def make(batch):
        import pyarrow as pa

        c = codec(path)
        sizes, of_ids, of_texts = [], [], []
        for t in batch.column(1).to_pylist():
            ids = c.encode(t)
            sizes.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            of_texts.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_texts}

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _mapped(narrow, f"doc_id {narrow.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encoded_rows(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens, ids`` for every row of a corpus."""
    path = path or vocabulary_path()
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in ((id_col, "doc_id"), (source, "source"), (text, "text"))])

    def make(batch):
        import pyarrow as pa

        c = codec(path)
        ids = [c.encode(t) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "source": batch.column(1), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}

    of = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return _mapped(narrow, f"doc_id {of['doc_id']}, source {of['source']}, n_tokens long, ids array<int>", make)
