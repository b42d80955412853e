"""How far the sources of a language differ in their words: an audit over run-length columns.

1. Term counts per (lang, source) are summed in each task first (whole batches,
   tables of bounded size) and then by Spark.
2. A language keeps the terms of at least ``MIN_DOCS`` documents.  The counts of
   one term in all sources are its *vector*; terms of equal vectors are collapsed
   to one row with their number.
3. The vocabulary is reordered by (total count, sources that have the term, hash of
   the vector) with a range partitioning into blocks, so that equal counts come to lie together.  Within a block the
   rows are put in the order of the columns with the fewest different counts first,
   and every source's column becomes runs of equal counts.
4. For a pair of sources the borders of their runs are intersected; f of the two
   values counts as often as the piece is long.  Blocks give partial sums.

p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) and f = floor((p - q)^2 / (p + q));
all arithmetic is on integers (decimals of 38 digits where 64 bits could overflow).

The answer has one row per ordered pair of sources of a language, so the sources of one
language are few by nature: a vector and a block's columns hold one entry per
source.  Documents, terms and blocks may be any number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import scratch_table, slim

MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Term counts that a task holds before it hands them on, and vectors in a block.
HELD_TERMS, BLOCK_VECTORS = 200_000, 4096
#: A-Z become a-z, every other ASCII character that is no letter a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of columns lang, source, text."""
    schema = "lang string, source string, term string, count long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs) in counts.items():
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(count), pa.binary()).cast(pa.string()),
                     pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())], ["lang", "source", "term", "count", "docs"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                count, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, found = len(count), terms(text.as_py())
                count.update(found)
                docs.update(set(found))
                held += len(count) - before
                if held > HELD_TERMS:
                    yield from out()
                    counts, held = {}, 0
        yield from out()

    partial = docs.select("lang", "source", "text").mapInArrow(run, schema)
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """p of a count, given N and V; NULL without terms."""
    wide = "decimal(38,0)"
    up = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * size).cast("decimal(20,0)"))
    return F.when(size > 0, up.cast(wide).cast("long") + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); at most about 10^18 / 10^9, exact in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _runs(column: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal values ends, its value)."""
    last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
    return np.cumsum(sizes)[last], column[last]


def block_pairs(columns: list[np.ndarray], sizes: np.ndarray) -> list[list[int]]:
    """Sum of f for every pair of columns (symmetric), each over the pieces of both columns' runs."""
    keys = sorted(columns, key=lambda c: -len(np.unique(c)))  # lexsort takes the last key first
    order = np.lexsort(keys)
    runs = [_runs(c[order], sizes[order]) for c in columns]
    out = [[0] * len(columns) for _ in columns]
    for i, (ends, p) in enumerate(runs):
        for j in range(i):
            other, q = runs[j]
            cuts = np.union1d(ends, other)
            x, y = p[np.searchsorted(ends, cuts)], q[np.searchsorted(other, cuts)]
            f = (x - y) ** 2 // (x + y)
            out[i][j] = out[j][i] = int(f @ np.diff(cuts, prepend=0))
    return out


def pair_sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over the kept terms, per ordered pair.

    ``vectors`` has lang, total, vector (array of source and p where the count is
    not 0) and n_terms, ``groups`` lang, source and none (p of count 0).
    """
    spark = vectors.sparkSession
    n = max(1, -(-vectors.count() // BLOCK_VECTORS))
    # the range bounds are sampled through the driver: a short key stands for the vector
    blocks = vectors.repartitionByRange(n, "lang", "total", F.size("vector"), F.xxhash64("vector")).withColumn("block", F.spark_partition_id())
    blocks = scratch_table(blocks, "divergence-blocks")
    cells = blocks.select("lang", "block", "vector", "n_terms")
    heads = blocks.select("lang", "block").distinct().join(groups, "lang").groupBy("lang", "block").agg(
        F.sort_array(F.collect_list(F.struct("source", F.col("none").alias("p")))).alias("vector"))
    rows = cells.unionByName(heads.select("lang", "block", "vector", F.lit(None).cast("long").alias("n_terms")))

    def intersect(table: pa.Table) -> pa.Table:
        sizes, vectors = table.column("n_terms").to_pylist(), table.column("vector").to_pylist()
        head = vectors[sizes.index(None)]
        cells = [(v, n) for v, n in zip(vectors, sizes) if n is not None]
        at = {h["source"]: k for k, h in enumerate(head)}
        columns = [np.full(len(cells), h["p"], np.int64) for h in head]
        for r, (vector, _) in enumerate(cells):
            for cell in vector:
                columns[at[cell["source"]]][r] = cell["p"]
        sums = block_pairs(columns, np.array([n for _, n in cells], np.int64))
        names = list(at)
        rows = [(a, b, sums[i][j]) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))],
                        names=["lang", "source", "item", "value"])

    sums = rows.groupBy("lang", "block").applyInArrow(intersect, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), ranks from 1 by value descending and item ascending (UTF-8).

    Part ``pair``: every other source of the language, f summed over all kept
    terms (0 without any).  Part ``term``: the ``top`` terms whose share in the source
    exceeds the language's, by f.  NULL text, language and source count as
    empty strings; a source without terms has pairs and no terms; a language of one
    source has no pairs.  Repeated rows count as often as they occur, other columns are
    not read, an empty table gives an empty result.
    """
    docs = slim(df, lang=F.coalesce(df[lang_col], F.lit("")), source=F.coalesce(df[source_col], F.lit("")), text=F.coalesce(df[text_col], F.lit("")))
    counts = scratch_table(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("vector"))
    kept = scratch_table(kept.filter(F.col("docs") >= min_docs).select("lang", "term", "total", F.sort_array("vector").alias("vector")), "kept-terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("total").alias("lang_total"))
    cells = kept.select("lang", "term", "total", F.inline("vector"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("group_total"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = scratch_table(groups.fillna(0, ["n_kept", "lang_total", "group_total"]), "divergence-groups")

    # f depends on the counts through p alone: vectors of equal counts are vectors of equal p
    vectors = kept.groupBy("lang", "total", "vector").agg(F.count("*").alias("n_terms"))
    of_lang = groups.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "group_total"))).alias("totals"), F.max("n_kept").alias("n_kept"))
    in_p = F.transform("vector", lambda v: F.struct(v["source"].alias("source"), share(v["count"], F.element_at("totals", v["source"]), F.col("n_kept")).alias("p")))
    vectors = vectors.join(of_lang, "lang").select("lang", "total", in_p.alias("vector"), "n_terms")
    summed = pair_sums(vectors, groups.select("lang", "source", share(F.lit(0).cast("long"), F.col("group_total"), F.col("n_kept")).alias("none")))
    left, right = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = left.join(right, "lang").filter("source <> item").join(summed, ["lang", "source", "item"], "left").fillna(0, ["value"])

    scored = cells.join(groups, ["lang", "source"])
    scored = scored.select("lang", "source", F.col("term").alias("item"), share(F.col("count"), F.col("group_total"), F.col("n_kept")).alias("p"),
                           share(F.col("total"), F.col("lang_total"), F.col("n_kept")).alias("q"))
    scored = scored.filter("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, best = (x.withColumn("rank", F.row_number().over(ranked)) for x in (pairs, scored))
    cols = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(best.filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*cols))
