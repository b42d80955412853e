"""Sharding by a hierarchical weighted hash tree.

A tree lists leaves (region, rack, shard, weight).  A row descends from the
root: at each node every child draws -ln(u) / weight, u a hash of the row's
key, the node and the child, and the least draw wins, so a child is chosen
with probability weight / sum and a child whose weight did not change keeps
its draw.  A weight change therefore moves rows only towards (or out of) the
subtrees whose weights changed; inside other subtrees nothing moves.  A shard
that is added as a region of its own takes rows only into itself
(``grown``); one added inside a region also draws on that region's subtree.

Rows with a NULL key share one draw and land in one shard; repeated keys land
together.  Only the key and the columns in ``carry`` are returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import scratch_table

Leaf = tuple[int, int, int, float]
REGION_SHARDS, RACK_SHARDS, BASE_SHARDS = 4, 2, 16
ROWS_PER_BUCKET = 100_000


def uniform_tree(n_shards: int) -> list[Leaf]:
    """Up to ``BASE_SHARDS`` shards in regions of 4 and racks of 2; every later shard opens a region."""
    base = [(s // REGION_SHARDS, s % REGION_SHARDS // RACK_SHARDS, s, 1.0) for s in range(min(n_shards, BASE_SHARDS))]
    first = -(-BASE_SHARDS // REGION_SHARDS)
    return base + [(first + s - BASE_SHARDS, 0, s, 1.0) for s in range(BASE_SHARDS, n_shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    return [*tree, (max(r for r, *_ in tree) + 1, 0, max(s for _, _, s, _ in tree) + 1, weight)]


def _draw(key: Column, node: list[Column], child: int, weight: Column) -> Column:
    bits = F.xxhash64(key, *node, F.lit(child)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    return F.when(weight > 0, F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight).alias("d"), F.lit(child).alias("c")))


def _choose(key: Column, node: list[Column], weights: list[Column]) -> Column:
    return F.array_min(F.array(*[_draw(key, node, c, w) for c, w in enumerate(weights)]))["c"]


def place(df: DataFrame, key: str, tree: Sequence[Leaf], out: str) -> DataFrame:
    """``df`` with the shard of ``key`` (expressions only: no shuffle, no Python).
    One projection per level keeps each draw evaluated once."""
    regions = sorted({r for r, *_ in tree})
    racks = {r: sorted({k for a, k, *_ in tree if a == r}) for r in regions}
    leaves = {(r, k): [(s, float(w)) for a, b, s, w in tree if (a, b) == (r, k)] for r in regions for k in racks[r]}
    if any(not math.isfinite(w) or w < 0 for *_, w in tree):
        raise ValueError("weights must be finite and not negative")
    total = {n: sum(w for _, w in got) for n, got in leaves.items()}
    wide, deep = max(map(len, racks.values())), max(map(len, leaves.values()))
    slots = [(leaves[r, racks[r][k]] if k < len(racks[r]) else []) for r in regions for k in range(wide)]

    def listed(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    region, rack, node, leaf = (f"_{out}_{x}" for x in ("region", "rack", "node", "leaf"))
    rack_weights = listed([total[r, racks[r][k]] if k < len(racks[r]) else 0 for r in regions for k in range(wide)])
    leaf_weights = listed([got[i][1] if i < len(got) else 0 for got in slots for i in range(deep)])
    names = F.array(*[F.lit(got[i][0] if i < len(got) else -1) for got in slots for i in range(deep)])
    k = F.col(key)
    df = df.withColumn(region, _choose(k, [F.lit("region")], [F.lit(sum(total[r, x] for x in racks[r])) for r in regions]))
    df = df.withColumn(rack, _choose(k, [F.lit("rack"), F.col(region)], [F.get(rack_weights, F.col(region) * wide + i) for i in range(wide)]))
    df = df.withColumn(node, F.col(region) * wide + F.col(rack))
    df = df.withColumn(leaf, _choose(k, [F.lit("shard"), F.col(node)], [F.get(leaf_weights, F.col(node) * deep + i) for i in range(deep)]))
    return df.withColumn(out, F.get(names, F.col(node) * deep + F.col(leaf))).drop(region, rack, node, leaf)


def shard(df: DataFrame, id_col: str, tree: Sequence[Leaf], carry: dict[str, Column] | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``shard``, ``grown_shard`` (with one more
    shard) and ``slot``, gapless from 0 in each shard.  Slots are numbered per
    hash bucket of a shard, after the rows of the buckets before, so no task
    orders a whole shard; ``spread`` columns keep repeated keys apart."""
    rows = df.select(df[id_col].alias("key"), *[c.alias(n) for n, c in (carry or {}).items()])
    rows = scratch_table(place(place(rows, "key", tree, "shard"), "key", grown(tree), "grown_shard"), "shards")
    buckets = max(8, math.ceil(rows.count() / len(tree) / ROWS_PER_BUCKET))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("key", *spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("key", *spread)
    numbered = rows.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_start", "_row")
