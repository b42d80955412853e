"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into tokens: a run of at most ``TOKEN_CHARS`` characters without white
space is a token, and of a longer run (text of a script without spaces, base64, minified
code) every character is one, so that no cut depends on an offset.  Every ``K``
tokens in a row are a k-mer, overlapping the next (a text of fewer
tokens is one k-mer).  Equal k-mers of a text are numbered by occurrence, so
that each numbered k-mer is unique.  A hash of (k-mer, number) deals them
into ``BINS`` bins; each bin keeps its ``TUPLE`` = 2 least, puts them back
into text order and hashes the ordered pair.  The fingerprint lists (bin,
pair hash); the likeness of two fingerprints is the share of equal entries
among the bins that either fills.  Two texts share an entry only where both
the minimal k-mers and their order agree, which is what makes the signature
follow edit distance and not only word content.

Everything is array arithmetic within the row: two sorts of packed longs, no
exploded rows.  k-mers are compared by 37 hash bits, and 2^26 tokens of
a text have positions of their own.  A text of fewer k-mers than about ``BINS`` has
bins with a lone k-mer: there its fingerprint follows content more than order.

NULL texts count as empty.  Texts without tokens have an empty fingerprint;
two of those are alike (1.0).  Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import slim
from panelforge.operators.ranges import SortKey, bucket_count, range_bucket

TOKEN_CHARS, K, BIN_BITS = 16, 3, 6
HASH_BITS, POSITION_BITS = 37, 26
ROWS_PER_BUCKET = 1_000
TOKEN = rf"((?<!\S)\S{{1,{TOKEN_CHARS}}}+(?!\S)|\S)"


def _packed(hashed: Column, position: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), POSITION_BITS).bitwiseOR(position.cast("long"))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS + HASH_BITS - BIN_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<bigint>, a (bin, pair hash) entry per filled bin, bins ascending.
    One projection per step: an array that a lambda indexes is a column by then."""
    tok, kmers, starts, numbered = (f"_{out}_{x}" for x in ("tok", "kmers", "starts", "numbered"))
    keep = df.columns
    df = df.withColumn(tok, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(1)))
    words = F.col(tok)
    heads = F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(1)))
    df = df.withColumn(kmers, F.sort_array(F.transform(heads, lambda x, i: _packed(F.xxhash64(x, *[F.get(words, i + j) for j in range(1, K)]), i))))
    first = F.transform(kmers, lambda x, j: F.when((j == 0) | (_hash(F.get(F.col(kmers), j - 1)) != _hash(x)), j))
    df = df.withColumn(starts, F.filter(first, lambda j: j.isNotNull()))
    runs = F.transform(starts, lambda s, r: F.sequence(F.lit(0), F.coalesce(F.get(F.col(starts), r + 1), F.size(kmers)) - s - 1))
    fresh = F.transform(kmers, lambda x: _packed(F.xxhash64(_hash(x), F.lit(0)), _position(x)))
    counted = F.zip_with(F.col(kmers), F.flatten(runs), lambda x, o: _packed(F.xxhash64(_hash(x), o), _position(x)))
    df = df.withColumn(numbered, F.sort_array(F.when(F.size(starts) == F.size(kmers), fresh).otherwise(counted)))
    all_ = F.col(numbered)

    def entry(x: Column, j: Column) -> Column:
        other = F.get(all_, j + 1)
        alone = F.xxhash64(_hash(x))
        pair = F.when(_position(x) < _position(other), F.xxhash64(_hash(x), _hash(other))).otherwise(F.xxhash64(_hash(other), _hash(x)))
        hashed = F.when(other.isNull() | (_bin(other) != _bin(x)), alone).otherwise(pair)
        value = F.shiftleft(_bin(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))
        return F.when((j == 0) | (_bin(F.get(all_, j - 1)) != _bin(x)), value)

    df = df.withColumn(out, F.filter(F.transform(numbered, entry), lambda v: v.isNotNull()))
    return df.select(*keep, out)


def as_text(sketch: Column) -> Column:
    """Fixed-width hex of the entries: two digits of the bin, eight of the hash."""
    return F.concat_ws("", F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")))


def likeness(a: Column, b: Column) -> Column:
    filled = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 32)), F.transform(b, lambda v: F.shiftright(v, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, ``sketch`` and ``next_text``, ``next_sketch`` of the row after it by ascending key (then
    text hash), the first row after the last.  Rows go to range buckets; the first row of each bucket is also
    sent to the bucket before, so that a lead() per bucket sees across the border."""
    base = df.select(key, text, F.xxhash64(text).alias("_th"))
    base = base.withColumn("_bucket", range_bucket(base, [SortKey(key), SortKey("_th")], bucket_count(base.count(), ROWS_PER_BUCKET)))
    # one row per bucket, at most ranges.MAX_BUCKETS of them
    firsts = sorted(base.groupBy("_bucket").agg(F.min(F.struct(F.col(key), F.col("_th"))).alias("f")).collect(), key=lambda r: r["_bucket"])
    rows = base.withColumn("_ghost", F.lit(0))
    if firsts:
        buckets = [r["_bucket"] for r in firsts]
        borders = df.sparkSession.createDataFrame([(b, buckets[i - 1], r["f"][0], r["f"][1]) for i, (b, r) in enumerate(zip(buckets, firsts))],
                                                  f"_bucket int, _before int, _k {dict(df.dtypes)[key]}, _t long")
        ghosts = base.join(F.broadcast(borders), "_bucket").filter(F.col(key).eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_t")))
        ghosts = ghosts.dropDuplicates(["_bucket"]).select(key, text, "_th", F.col("_before").alias("_bucket"), F.lit(1).alias("_ghost"))
        rows = rows.unionByName(ghosts)
    rows = with_sketch(rows, text, "sketch")
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col(key).asc_nulls_first(), "_th")
    rows = rows.withColumns({"next_text": F.lead(text).over(order), "next_sketch": F.lead("sketch").over(order)})
    return rows.filter("_ghost = 0").drop("_ghost", "_bucket", "_th")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``text``, ``sketch``: the fingerprint of every row."""
    return with_sketch(slim(df, key=id_col, text=F.coalesce(df[text_col], F.lit(""))), "text", "sketch")


def edit_probe(df: DataFrame, id_col: str, text_col: str, share: int = 4) -> DataFrame:
    """How the fingerprint answers an edit: each text, the same text with its last
    1/``share`` replaced by as much of the next text's start, and the next text."""
    rows = with_next(slim(df, key=id_col, text=F.coalesce(df[text_col], F.lit(""))), "key", "text")
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select("key", "text", "edited", "sketch", "edited_sketch", likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
