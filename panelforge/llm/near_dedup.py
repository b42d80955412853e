"""Near-duplicate classes by Order MinHash and banded alignment.

* Texts are reduced to distinct texts (a class of exact copies is one node).
  A text is the sequence of its 5-word shingles, equal shingles numbered by
  occurrence; fewer than five words make one shingle.
* Order MinHash: for each of ``FUNCTIONS`` hash functions the ``MINIMA`` least
  numbered shingles are put in text order and hashed.  Two long texts of
  shingle similarity s share such a tuple with probability about s^MINIMA, so
  at s = 0.8 a pair meets in no bucket with probability (1 - 0.8^8)^64 < 1e-5
  (at 0.85 1e-9), while texts that only share a passage, s = 0.3 say, meet
  with probability 0.004.  With few shingles the probability is less, C(m,8) /
  C(u,8) for m common ones of u, so texts of up to ``SHORT`` take another way:
* Short texts meet by an exact prefix filter.  In an order common to all texts
  (rare shingles first), the first ``COMBINED`` of the shingles that two similar
  texts have aligned are among the first n - ceil(threshold n) + ``COMBINED`` of
  either; every so many of those, in text order, are a bucket.  Texts of up to
  ``SHORT`` / threshold shingles, all that a short text can be similar to, are
  put there too, so no pair with a short text is lost.
* Candidates are verified by alignment: numbered shingles are unique in a
  text, so the longest common subsequence of two texts is the longest
  increasing run of matched positions, and matches further off the diagonal
  than ``threshold`` allows are cut away (the band).  With m aligned shingles,
  similarity = m / (|a| + |b| - m); at least ``threshold`` links a and b.
* A pair is made only if its odd sketches allow it.  The sketch has the parity
  of the shingles that hash to each of ``SKETCH_BITS`` places; two sketches
  differ in at most as many bits as there are shingles in only one of the
  texts, and a similar pair has few of those, so the test loses nothing.
* A bucket never emits its pairs.  In each round some members of a bucket
  (1, then 16, 256, ...) are its pivots and meet the other members that are not
  in their class yet; links join classes; buckets whose remaining members all
  share a class are done.  Rounds go on until every pair of a bucket has met
  a pivot or shares a class, so no link between different texts is lost to a
  cap and a large group of copies costs one pass.

NULL texts count as empty; equal texts (empty ones too) share a class; texts
without words link to equal texts only.  The class id is the least non-NULL
id in it.  Only the key column is carried along.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import scratch_table, slim

SHINGLE, THRESHOLD = 5, 0.8
FUNCTIONS, MINIMA = 64, 8
SKETCH_BITS = 2048
#: Texts of up to so many shingles are found by prefixes, that many shingles at a time.
SHORT, COMBINED = 40, 2
#: Pivots of a bucket in a round, as a multiple of those of the round before.
GROWTH = 16
CACHE_WORDS = 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_MIX = np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.random.default_rng(3).integers(1, 1 << 32, FUNCTIONS, np.uint32)


class _Words(dict):
    """Word -> 64-bit hash; forgets all when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order, numbered by occurrence (unique within the text)."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    at = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(at))
    n = len(at) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = _mix(out + at[j:j + n] * _ODD[j % len(_ODD)])
    order = np.argsort(out, kind="stable")
    same = out[order[1:]] == out[order[:-1]]
    if same.any():
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
        number = np.empty(n, np.uint64)
        number[order] = (np.arange(n) - starts).astype(np.uint64)
        out = np.where(number > 0, _mix(out + number * _ODD[1]), out)
    return out


def tuples(sh: np.ndarray, functions: int = FUNCTIONS, minima: int = MINIMA) -> np.ndarray:
    """One hash per function: its least shingles, in text order."""
    if not len(sh):
        return np.zeros(0, np.int64)
    take = min(minima, len(sh))
    out = np.arange(functions, dtype=np.uint64)
    high = (sh >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // len(sh))
    for a in range(0, functions, step):
        ranks = (high[None, :] ^ _SEEDS[a:a + step, None]) * np.uint32(0x85EBCA6B)
        ranks ^= ranks >> np.uint32(15)
        ranks *= np.uint32(0xC2B2AE35)
        least = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < len(sh) else np.tile(np.arange(take), (len(ranks), 1))
        least.sort(axis=1)
        for j in range(take):
            out[a:a + step] = _mix(out[a:a + step] * _ODD[0] + sh[least[:, j]])
    return out.view(np.int64)


def prefix_buckets(size: int, shared: list[tuple[int, int, int]], threshold: float, combined: int = COMBINED) -> list[int]:
    """Buckets of a text of ``size`` shingles, of which other texts have ``shared``
    (number of texts, shingle, position).  The others come first in the order, in no bucket."""
    least = math.ceil(threshold * size - 1e-9)
    alone = size - len(shared)
    ranked = sorted(shared)
    out = []
    # pairs with fewer aligned shingles than are combined (of tiny texts) meet by all of those
    for k in range(max(1, min(least, combined)), combined + 1):
        first = sorted(ranked[:max(0, min(size, size - least + k) - alone)], key=lambda x: x[2])
        out += [xxhash.xxh64_intdigest(np.array([x[1] for x in some], np.int64).tobytes(), k) for some in combinations(first, k)]
    return out


def odd_sketch(sh: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each place, packed into longs."""
    counts = np.bincount((sh >> np.uint64(8)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def may_reach(threshold: float) -> Column:
    """Join condition over (n, odd) and (na, odd_a): can the two texts be that similar?"""
    total = F.col("n") + F.col("na")
    differ = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("odd_a", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (F.least("n", "na") >= total * (threshold / (1 + threshold)) - 1e-6) & (differ <= total * ((1 - threshold) / (1 + threshold)) + 1e-6)


def needed(na: int, nb: int, threshold: float) -> int:
    """Aligned shingles by which two texts reach the threshold."""
    return math.ceil(threshold * (na + nb) / (1 + threshold) - 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Can at least ``least`` shingles be aligned in order?"""
    if min(len(a), len(b)) < least:
        return False
    _, i, j = np.intersect1d(a, b, return_indices=True)
    close = np.abs(i - j) <= len(a) + len(b) - 2 * least  # the band: each step off the diagonal is an unaligned shingle
    i, j = i[close], j[close]
    if len(i) < least:
        return False
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return True
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) >= least


def renamed(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct edges (low < high) between the classes that ``names`` (cls, to) gives
    the ends of ``edges``; ends without a name keep theirs, edges within a class go."""
    if names is not None:
        for end in ("low", "high"):
            edges = edges.join(names.withColumnRenamed("cls", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).filter("low < high").distinct()


def join_classes(links: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``node``, ``cls`` (least node of its class) once ``links`` (a, b) have joined ``classes``.
    Every class hooks to its least neighbour, pointers are followed, and only the
    edges that still cross classes go on; the nodes are renamed once, at the end."""
    edges = links.select(F.col("a").alias("low"), F.col("b").alias("high"))
    names = None if classes is None else classes.select(F.col("node").alias("cls"), F.col("cls").alias("to"))
    edges = scratch_table(renamed(edges, names), "edges")
    hooks = []
    while not edges.isEmpty():
        least = edges.groupBy(F.col("high").alias("cls")).agg(F.min("low").alias("to"))
        hook = least
        for _ in range(3):
            hook = hook.join(least.select(F.col("cls").alias("to"), F.col("to").alias("far")), "to", "left").select("cls", F.coalesce("far", "to").alias("to"))
        hooks.append(scratch_table(hook, "hooks"))
        edges = scratch_table(renamed(edges, hooks[-1]), "edges")
    if classes is not None and not hooks:
        return classes
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cls", F.col("node"))
    if classes is not None:
        labels = classes.unionByName(labels.join(classes, "node", "left_anti"))
    for hook in hooks:
        labels = labels.join(hook, "cls", "left").select("node", F.coalesce("to", "cls").alias("cls"))
    return scratch_table(labels, "labels")


def labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the class of their ``node`` (a node without links is its own)."""
    return rows.join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node"))


def short_buckets(nodes: DataFrame, threshold: float) -> DataFrame:
    """``bucket``, ``node``: prefix buckets of the nodes that have ``short`` (their shingles)."""
    own = nodes.select("node", F.size("short").alias("size"), F.posexplode("short").alias("at", "sh"))
    shared = own.groupBy("sh").agg(F.count("*").alias("n")).filter("n > 1")
    listed = own.join(shared, "sh").groupBy("node", "size").agg(F.collect_list(F.struct("n", "sh", "at")).alias("shared"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [prefix_buckets(size, [(x["n"], x["sh"], x["at"]) for x in some], threshold) for size, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            named = np.array([x for some in got for x in some], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in got]))], ["bucket", "node"])

    return listed.mapInArrow(combine, "bucket long, node long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``key`` and ``class_id``, a row per input row."""
    src = slim(df, key=id_col, text=F.coalesce(df[text_col], F.lit("")))
    kind = src.schema["key"].dataType
    with_prefix = math.floor(SHORT / threshold + 1e-9)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            long = [tuples(x if len(x) > SHORT else x[:0]) for x in got]
            short = [(x if len(x) <= with_prefix else x[:0]).view(np.int64) for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (long, short))], ["key", "tid", "tuples", "short"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("tid", T.StringType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("tuples", "short"))])
    rows = scratch_table(src.select("key", F.md5("text").alias("tid"), "text").mapInArrow(sketch, schema), "sketches")
    # a node per distinct text; numbered once, on disk
    nodes = scratch_table(rows.groupBy("tid").agg(F.min("key").alias("rep"), F.first("tuples").alias("tuples"), F.first("short").alias("short")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", F.posexplode("tuples").alias("f", "t")).select(F.xxhash64("f", "t").alias("bucket"), "node")
    buckets = buckets.unionByName(scratch_table(short_buckets(nodes, threshold), "prefixes"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    active = scratch_table(buckets.join(shared, "bucket", "left_semi"), "buckets")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.uint32).tobytes() for x in got], pa.binary()),
                                              pa.array([len(x) for x in got], pa.int32()), pa.array([odd_sketch(x) for x in got], pa.list_(pa.int64()))], ["node", "sh", "n", "odd"])

    # shingles (32 bits each) of the texts that share a bucket
    wanted = nodes.join(active.select("node").distinct(), "node", "left_semi").select("tid", "node")
    texts = src.withColumn("tid", F.md5("text")).join(wanted, "tid").dropDuplicates(["node"]).select("node", "text")
    numbered = scratch_table(texts.mapInArrow(number, "node long, sh binary, n int, odd array<long>"), "shingles")
    active = scratch_table(active.join(numbered.select("node", "n", "odd"), "node").withColumn("cls", F.col("node")), "buckets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                linked.append(aligned(a, b, needed(len(a), len(b), threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    classes, met, pivots = None, None, 1
    while not active.isEmpty():
        # the least members that have not been pivots yet; a limit by group, so no task sorts a whole bucket
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
        chosen = active.withColumn("turn", turn).filter(F.col("turn") <= pivots).select("bucket", F.col("node").alias("a"), F.col("cls").alias("ca"), F.col("n").alias("na"), F.col("odd").alias("odd_a"))
        pairs = active.withColumnRenamed("node", "b").join(chosen, "bucket").filter("a < b and ca <> cls").filter(may_reach(threshold)).select("a", "b").distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        sides = [numbered.select(F.col("node").alias(c), F.col("sh").alias(f"sh_{c}")) for c in "ab"]
        judged = scratch_table(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sh_a", "sh_b").mapInArrow(verify, "a long, b long, linked boolean"), "judged")
        met = judged if met is None else met.unionByName(judged)
        classes = join_classes(judged.filter("linked").select("a", "b"), classes)
        # members that have not been pivots, in buckets where those are of several classes; the
        # pivots leave by (bucket, node), so that a large bucket is dealt over many tasks
        rest = active.select("bucket", "node").join(chosen.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        rest = scratch_table(labelled(rest, classes), "rest")
        mixed = rest.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("bucket")
        active = scratch_table(active.drop("cls").join(rest.join(mixed, "bucket", "left_semi"), ["bucket", "node"]), "buckets")
        pivots *= GROWTH

    named = nodes.select("tid", "rep", "node")
    if classes is None:
        named = named.select("tid", F.col("rep").alias("class_id"))
    else:
        named = named.join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node"))
        least = named.groupBy("cls").agg(F.min("rep").alias("class_id"))
        named = named.join(least, "cls").select("tid", "class_id")
    return rows.select("key", "tid").join(named, "tid").select("key", "class_id")
