"""Licence scan by canonical digest.

A text's canonical form: lower case, copyright lines dropped, everything but
letters and digits turned to single spaces, equivalent spellings made one.
Its SHA-256 is hash-joined to the digests of known licences, brought to the
same form.  Whole texts are looked up by the join; whole lines (a notice
inside a longer document) by the same digests within the row, so that no
text is taken apart over the network.

NULL and empty texts have the digest of the empty string, which no licence
has.  Known texts that share a canonical form give the least of their names.
Repeated rows give repeated results; only the key column is carried along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import slim
from panelforge.llm.license_texts import KNOWN_TEXTS

#: The known table is broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 10_000
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*"
#: Spellings that mean the same, applied to canonical words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("v2", "version 2"), ("v3", "version 3"), ("https", "http"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical form that still has its line breaks."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark, known: Mapping[str, str] = KNOWN_TEXTS) -> DataFrame:
    """``digest``, ``license``: one row per canonical form."""
    rows = spark.createDataFrame(sorted(known.items()), "license string, text string")
    return rows.select(digest(one_line(canonical_lines(F.col("text")))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(df: DataFrame, id_col: str, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """``key``, ``digest`` (of the canonical text), ``license`` (whole text, else
    NULL), ``line_licenses`` (names of whole lines, sorted), a row per input row."""
    known = known if known is not None else known_digests(df.sparkSession)
    known = known.select("digest", "license").filter("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))
    rows = slim(df, key=id_col, text=text_col).select("key", canonical_lines(F.col("text")).alias("lines"))
    listed = known.orderBy("digest").limit(BROADCAST_ROWS + 1).collect()
    if len(listed) > BROADCAST_ROWS:
        return _scan_by_join(rows, known)
    digests = F.array(*[F.lit(r["digest"]) for r in listed]) if listed else F.array().cast("array<string>")
    names = F.array(*[F.lit(r["license"]) for r in listed]) if listed else F.array().cast("array<string>")
    hits = F.array_intersect(F.transform(F.split("lines", "\n"), lambda x: digest(F.trim(x))), digests)
    found = F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.get(names, (F.array_position(digests, x) - 1).cast("int")))))
    rows = rows.select("key", digest(one_line(F.col("lines"))).alias("digest"), found.alias("line_licenses"))
    return rows.join(F.broadcast(known), "digest", "left").select("key", "digest", "license", "line_licenses")


def _scan_by_join(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same with a known table of any size: lines are joined by shuffle."""
    rows = rows.select("key", F.expr("uuid()").alias("row"), digest(one_line(F.col("lines"))).alias("digest"), F.array_distinct(F.transform(F.split("lines", "\n"), lambda x: digest(F.trim(x)))).alias("line_digests"))
    from panelforge.llm.common import scratch_table
    rows = scratch_table(rows, "license_rows")  # the row names are drawn once
    lines = rows.select("row", F.explode("line_digests").alias("digest")).join(known, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    out = rows.drop("line_digests").join(known, "digest", "left").join(lines, "row", "left")
    return out.select("key", "digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
