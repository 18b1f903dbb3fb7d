"""A quality classifier: a convolutional network over bytes, in numpy.

A text is covered by chunks of ``CHUNK`` bytes that overlap by half. Learned filters of ``WIDTH`` bytes slide over each
chunk; a filter's answer to a byte at a place is a learned number, so a filter is a table of 256 numbers for each place.
Rectified answers are max-pooled over the chunk. A text is described by the largest, smallest and mean pooled answer of
each filter over its chunks and by the logarithm of its length, and a hidden layer turns these into one probability.

Training takes a bounded sample of labelled rows to the driver: ``MOST_ROWS`` of those whose id the table has, by hash. Each
text is taken whole; one that would bring their bytes over ``MOST_BYTES`` is passed over, and the next ones are looked at.
Adam runs over mini-batches from a fixed seed, over all chunks of each text and pooled as in scoring. An eighth of the sample
is kept for validation: when its loss hasn't fallen for ``PATIENCE`` epochs training ends, with the weights of the best one.
Scoring reads every byte of every text. The network is of fixed size (some 60 KB) and goes to the tasks in the closure.

Defined cases: null and empty texts have one chunk of zero bytes and get a score like any other; equal texts get equal
scores; without any labelled rows every score is 0.5 (texts over the byte bound don't make it so: the shortest of each label
is always taken); an id that has several texts or labels trains with each; a text of any
length is scored whole, 16 KB at a time; an empty table gives an empty result. Other columns take no part, whatever they
are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import map_rows

CHUNK, STEP, WIDTH, FILTERS, HIDDEN = 512, 256, 6, 24, 16
COLUMNS = np.arange(FILTERS)
#: Labelled rows the driver trains on, and bytes of their texts together, at most.
MOST_ROWS, MOST_BYTES = 3_000, 64 * 1024 * 1024
EPOCHS, BATCH, RATE = 12, 32, 4e-3
#: Epochs without a smaller loss on the validation rows that end training, and rows from which on some are kept for it.
PATIENCE, LEAST_VALIDATED = 2, 200
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        n = 3 * FILTERS + 1
        f = np.float32
        return Network(
            r.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, n**-0.5, (n, HIDDEN)).astype(f), np.zeros(HIDDEN, f),
            r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f), np.zeros(1, f), np.zeros(n, f), np.ones(n, f),
        )

    def trained(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]


def answers(net: Network, data: np.ndarray) -> np.ndarray:
    """Each filter's answer at each place of the bytes, before the rectifier."""
    n = len(data) - WIDTH + 1
    out = np.take(net.table[0], data[:n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(net.table[k], data[k : k + n], axis=0)
    return out


def _bytes(text: bytes | None) -> np.ndarray:
    data = np.frombuffer(text or b"", np.uint8)
    return data if len(data) >= WIDTH else np.concatenate((data, np.zeros(WIDTH - len(data), np.uint8)))


def pooled(net: Network, data: np.ndarray) -> np.ndarray:
    """A row for each chunk of the whole text: the largest rectified answer of each filter.

    Half chunks are pooled once and neighbours combined, so an answer is computed once however many chunks share it. The
    places that begin in a half chunk look up to ``WIDTH - 1`` bytes beyond it.
    """
    rows = []
    for start in range(0, len(data), 64 * STEP):
        part = answers(net, data[start : start + 64 * STEP + WIDTH - 1]) if len(data) - start >= WIDTH else None
        if part is None or not len(part):
            break
        rows.append(np.maximum.reduceat(part, range(0, len(part), STEP), axis=0))
    halves = np.concatenate(rows)
    n_tail = (len(data) - WIDTH + 1) % STEP
    if len(halves) > 1:
        if n_tail and len(halves) > 2:
            # a short last half would make a chunk of its own look poor: it joins the chunk before it
            halves[-2] = np.maximum(halves[-2], halves[-1])
            halves = halves[:-1]
        halves = np.maximum(halves[:-1], halves[1:])
    return np.maximum(halves + net.bias, 0)


def pooled_from(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of :func:`pooled` and the places that their answers come from."""
    best, places = [], []
    for start in range(0, len(data) - WIDTH + 1, 64 * STEP):
        part = answers(net, data[start : start + 64 * STEP + WIDTH - 1])
        for at in range(0, len(part), STEP):
            half = part[at : at + STEP]
            peak = half.argmax(axis=0)
            best.append(half[peak, COLUMNS])
            places.append(start + at + peak)
    halves, peaks = np.stack(best), np.stack(places)

    def join(i, j):
        first = halves[i] >= halves[j]
        return np.where(first, halves[i], halves[j]), np.where(first, peaks[i], peaks[j])

    if len(halves) > 1:
        if (len(data) - WIDTH + 1) % STEP and len(halves) > 2:
            halves[-2], peaks[-2] = join(-2, -1)
            halves, peaks = halves[:-1], peaks[:-1]
        halves, peaks = join(slice(None, -1), slice(1, None))
    return np.maximum(halves + net.bias, 0), peaks


def features(rows: np.ndarray, n_bytes: int) -> np.ndarray:
    return np.concatenate((rows.max(axis=0), rows.min(axis=0), rows.mean(axis=0), [np.log1p(n_bytes) / 10])).astype(np.float32)


def score(net: Network, text: bytes | None) -> float:
    x = features(pooled(net, _bytes(text)), len(text or b""))
    hidden = np.maximum(((x - net.mean) / net.scale) @ net.w1 + net.b1, 0)
    z = float(hidden @ net.w2 + net.b2[0])
    return 1 / (1 + np.exp(-z)) if z > -50 else 0.0


def loss(net: Network, texts: list[bytes | None], labels: list[int]) -> float:
    """The mean logistic loss."""
    p = np.clip([score(net, t) for t in texts], 1e-7, 1 - 1e-7)
    return float(-np.mean(np.where(np.array(labels) == 1, np.log(p), np.log(1 - p))))


def train(texts: list[bytes | None], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the logistic loss. Gradients pass to the place where a filter's answer is largest, per chunk."""
    net, r = Network.fresh(), np.random.default_rng(seed)
    if not texts:
        net.w2[:] = 0
        return net
    kept = r.permutation(len(texts))[: len(texts) // 8 if len(texts) >= LEAST_VALIDATED else 0].tolist()
    unseen = [texts[i] for i in kept], [labels[i] for i in kept]
    texts, labels = ([x for i, x in enumerate(of) if i not in set(kept)] for of in (texts, labels))
    least, since, best = float("inf"), 0, None
    bodies = [_bytes(t) for t in texts]
    y = np.array(labels, np.float32)
    weights = net.trained()
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    first = np.stack([features(pooled(net, d), len(t or b"")) for t, d in zip(texts, bodies, strict=True)])
    net.mean, net.scale = first.mean(axis=0), first.std(axis=0) + np.float32(0.1)
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = r.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            grads = [np.zeros_like(w) for w in weights]
            batch = order[b : b + BATCH]
            for i in batch:
                data = bodies[i]
                rows, peaks = pooled_from(net, data)
                x = (features(rows, len(texts[i] or b"")) - net.mean) / net.scale
                h = x @ net.w1 + net.b1
                hidden = np.maximum(h, 0)
                z = float(hidden @ net.w2 + net.b2[0])
                dz = np.float32((1 / (1 + np.exp(-z)) - y[i]) / len(batch))
                grads[4] += dz * hidden
                grads[5] += dz
                dh = dz * net.w2 * (h > 0)
                grads[2] += np.outer(x, dh)
                grads[3] += dh
                dx = (net.w1 @ dh) / net.scale
                top, low, mean = dx[:FILTERS], dx[FILTERS : 2 * FILTERS], dx[2 * FILTERS : 3 * FILTERS]
                drow = np.tile(mean / len(rows), (len(rows), 1))
                drow[rows.argmax(axis=0), COLUMNS] += top
                drow[rows.argmin(axis=0), COLUMNS] += low
                drow *= rows > 0
                grads[1] += drow.sum(axis=0)
                for k in range(WIDTH):
                    cells = data[peaks + k].astype(np.int64) * FILTERS + COLUMNS
                    grads[0][k] += np.bincount(cells.ravel(), drow.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for w, g, u, v in zip(weights, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                w -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if kept:
            now = loss(net, *unseen)
            since = 0 if now < least else since + 1
            if now < least:
                least, best = now, [w.copy() for w in weights]
            if since == PATIENCE:
                break
    for w, b in zip(weights, best or weights, strict=True):
        w[:] = b
    return net


def training_rows(
    docs: DataFrame, labels: DataFrame, allowed, text: str = "text", id_col: str = "doc_id", label: str = "quality", most: int = MOST_ROWS, most_bytes: int = MOST_BYTES
) -> tuple[list, list]:
    """Texts and labels of at most ``most`` labelled rows whose id is ``allowed`` and in ``docs``: those with the smallest
    hashes, without those whose texts would bring all before them over ``most_bytes``. Rows are chosen on ids and lengths;
    texts then come by a join with that choice."""
    i, body = F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("binary")
    marked = labels.select(i.alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isNotNull() & allowed(F.col("id"))).distinct()
    known = docs.select(i.alias("id"), F.coalesce(F.octet_length(body), F.lit(0)).alias("n"), F.coalesce(F.md5(body), F.lit("")).alias("m")).where(F.col("id").isNotNull())
    few = known.join(marked, "id").distinct().orderBy(F.xxhash64("id"), "id", "y", "m").limit(most)
    few = few.withColumn("nth", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id", "y", "m")))
    sizes = few.select("nth", "n", "y").orderBy("nth").collect()  # most rows of three numbers
    chosen, total = {min(own)[1] for y in {r["y"] for r in sizes} if (own := [(r["n"], r["nth"]) for r in sizes if r["y"] == y])}, 0
    for r in sizes:
        if total + r["n"] <= most_bytes:
            chosen.add(r["nth"])
            total += r["n"]
    few = few.where(F.col("nth").isin(sorted(chosen))).select(F.col("id").alias("of"), "y", F.col("m").alias("of_m"))
    rows = docs.select(i.alias("id"), body.alias("text")).withColumn("m", F.coalesce(F.md5("text"), F.lit("")))
    rows = rows.join(F.broadcast(few), (F.col("id") == F.col("of")) & (F.col("m") == F.col("of_m"))).groupBy("id", "y", "m").agg(F.first("text").alias("text"))
    got = rows.orderBy("id", "y", "m").collect()
    return [None if x["text"] is None else bytes(x["text"]) for x in got], [x["y"] for x in got]


def held_out(doc_id):
    """Rows that training never sees: CRC-32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_table(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    if net is None:
        net = train(*training_rows(docs, labels, lambda i: ~held_out(i), text, id_col))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))

    def make(ids, held, texts):
        scores = [score(net, t) for t in texts]
        return ids, held, scores, [int(s >= THRESHOLD) for s in scores]

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_rows(narrow, f"doc_id {kind}, held_out boolean, score double, predicted int", make, rows=64)
