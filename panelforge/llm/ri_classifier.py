"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer network with temperature-calibrated probabilities.

* Tokens (letter runs, digit runs, single other characters) are hashed into
  ``SLOTS`` vocabulary slots.  Every slot has a fixed sparse ternary index
  vector; its word vector is the sum of the index vectors of all neighbours
  within ``REACH`` tokens, over the whole corpus.  Tasks add up their share
  in blocks of slots, blocks are summed after one shuffle; the table has
  SLOTS x DIM numbers at any corpus size, so it may go to every task.
* A document is the mean and the standard deviation of its tokens' unit
  vectors, with its log length (all texts whole).
* The network is fitted on at most ``MAX_TRAIN`` labelled rows (least id
  hash), its temperature on those of them that the fit left out.

NULL and empty texts have a zero vector and are scored like any other.  Labels
given twice for an id are averaged; rows with a NULL id are never trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import by_bytes, handed_text, id_hash, rest_of_row, row_of, slim, with_row

SLOTS, DIM, NONZERO, REACH = 1 << 14, 48, 4, 2
BLOCK_SLOTS = 512
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
CHUNK_TOKENS, CACHE_WORDS = 1 << 17, 1 << 19


class _Slots(dict):
    """Token -> slot; forgets all when it has grown too large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        slot = self[token] = crc32(token.encode("utf-8", "surrogatepass")) % SLOTS
        return slot


_slots = _Slots()


def codes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_slots.__getitem__, TOKEN.findall(text or "")), np.int32)


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of each slot's non-zero entries; one more, all-zero slot parts documents."""
    rng = np.random.default_rng(seed)
    cols = rng.permuted(np.tile(np.arange(DIM), (SLOTS + 1, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], size=(SLOTS + 1, NONZERO))
    signs[SLOTS] = 0
    return cols, signs


def add_contexts(total: np.ndarray, tokens: np.ndarray, a: int, b: int, cols: np.ndarray, signs: np.ndarray) -> None:
    """Add, for all pairs at most REACH apart whose left token is in [a, b),
    each token's index vector to the other (``total``: flat, (SLOTS + 1) x DIM)."""
    at, weights = [], []
    for shift in range(1, REACH + 1):
        right = tokens[a + shift:b + shift]
        left = tokens[a:a + len(right)]
        for word, other in ((left, right), (right, left)):
            at.append((word[:, None] * DIM + cols[other]).ravel())
            weights.append(signs[other].ravel())
    total += np.bincount(np.concatenate(at), np.concatenate(weights), minlength=len(total))


def word_table(df: DataFrame, text_col: str) -> np.ndarray:
    """SLOTS x DIM unit word vectors from the contexts of the whole corpus."""
    src = slim(df, text=text_col)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, signs = index_vectors()
        total, seen = np.zeros((SLOTS + 1) * DIM), False
        gap = np.full(REACH, SLOTS, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            joined = np.concatenate(held)
            for a in range(0, len(joined), CHUNK_TOKENS):
                add_contexts(total, joined, a, min(len(joined), a + CHUNK_TOKENS), cols, signs)

        for batch in batches:
            for text in batch.column(0):
                held += [codes(text.as_py()), gap]
                size += len(held[-2]) + REACH
                seen = True
                if size >= CHUNK_TOKENS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if seen:
            _slots.clear()
            blocks = total[:SLOTS * DIM].reshape(-1, BLOCK_SLOTS * DIM)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[b].astype("<f4").tobytes() for b in some], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(raw.as_py(), "<f4")
                sums[block] = sums[block] + part if block in sums else part.astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    parts = src.mapInArrow(gather, schema).repartition("block").mapInArrow(add, schema)
    table = np.zeros((SLOTS, DIM), np.float32)
    for row in parts.toLocalIterator():  # SLOTS / BLOCK_SLOTS rows
        table[row["block"] * BLOCK_SLOTS:(row["block"] + 1) * BLOCK_SLOTS] = np.frombuffer(row["sums"], "<f4").reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(norm > 0, norm, 1)


def pooled(text: str | None, table2: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the tokens' vectors, and log length."""
    at = codes(text)
    out = np.zeros(2 * DIM + 1, np.float32)
    if len(at):
        sums = np.zeros(2 * DIM)
        for a in range(0, len(at), CHUNK_TOKENS):
            sums += table2[at[a:a + CHUNK_TOKENS]].sum(axis=0)
        sums /= len(at)
        out[:DIM] = sums[:DIM]
        out[DIM:2 * DIM] = np.sqrt(np.maximum(sums[DIM:] - sums[:DIM] ** 2, 0))
    out[-1] = np.log1p(len(at))
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 11) -> Network:
    """Adam on the rows outside ``calibrate``; the temperature by log loss on those inside."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    fit = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
    z, t = (x[fit] - net.shift) / net.scale, y[fit].astype(float)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // BATCH)):
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            err = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - t[rows]) / len(rows)
            back = err[:, None] * net.w2 * (1 - h * h)
            grads = (z[rows].T @ back + DECAY * net.w1, back.sum(0), h.T @ err + DECAY * net.w2, np.array([err.sum()]))
            step += 1
            moved = []
            for g, m in zip(grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                moved.append(RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moved[0], net.b1 - moved[1], net.w2 - moved[2], net.b2 - float(moved[3][0])
    if calibrate.any():
        raw, held = net.logits(x[calibrate]), y[calibrate].astype(float)
        losses = {t: np.mean(np.logaddexp(0, raw / t) - held * raw / t) for t in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def id_fold(key: Column) -> Column:
    """crc32(key as text) mod 5; NULL keys are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


def classify(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
             threshold: float = 0.3, max_train: int = MAX_TRAIN, carry: Sequence[str] = ()) -> DataFrame:
    """``key``, ``held_out`` (fold 0: never trained on), ``score``, ``predicted``
    and, with ``carry``, a struct ``row`` of those columns; a row per input row."""
    spark = df.sparkSession
    src = with_row(df, rest_of_row(carry, text_col), key=id_col, text=text_col)
    known = slim(labels, key=label_id, y=labels[label_col].cast("double")).filter("key is not null and y is not null and not isnan(y)").groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = known.filter(id_fold(F.col("key")) != 0)
    # at most max_train rows, chosen by hash so that more data only draws another sample
    sample = known.join(src.select("key").distinct(), "key", "left_semi").orderBy(id_hash(F.col("key")), "key").limit(max_train)
    table = word_table(src, "text")
    table2 = spark.sparkContext.broadcast(np.hstack([table, table ** 2]).astype(np.float32))  # SLOTS x 2 DIM floats
    kind = src.schema["key"].dataType

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pooled(t.as_py(), table2.value).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["key", "v"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("v", T.BinaryType())])
    train = src.join(F.broadcast(sample), "key")  # sample: at most max_train ids
    rows = train.select("key", "text").mapInArrow(vectors, schema).join(F.broadcast(sample), "key").select("key", "v", "y", id_fold(F.col("key")).alias("fold")).collect() if max_train else []
    rows.sort(key=lambda r: (str(r["key"]), r["v"]))
    if rows:
        x = np.stack([np.frombuffer(r["v"], np.float32) for r in rows])
        net = fit_network(x, np.array([r["y"] for r in rows]), np.array([r["fold"] == 1 for r in rows]))
    else:  # no labels: nothing is known about quality
        net = Network(np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1), np.zeros((2 * DIM + 1, 1)), np.zeros(1), np.zeros(1), 0.0)

    scored_schema = T.StructType([T.StructField("key", kind), T.StructField("score", T.DoubleType()), *(handed := handed_text(src, carry, text_col))])
    handed = [f.name for f in handed]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            x = np.stack([pooled(t.as_py(), table2.value) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(x), pa.float64()), *(batch.column(c) for c in handed)], scored_schema.names)
        _slots.clear()  # a worker that is used again starts without this stage's words

    scored = src.mapInArrow(score, scored_schema)
    return scored.select("key", (id_fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *row_of(carry, text_col))
