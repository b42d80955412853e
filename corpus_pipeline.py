"""A training corpus in five stages, each over what the stage before kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next one's
docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import near_dedup, packing, repeats, ri_classifier, rule_cascade
from panelforge.llm.common import scratch_table, table
from panelforge.llm.queries import PACK_RANKS, PACK_SPECIAL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay.

    A NULL or empty text is scored like any other, without words; NULL and repeated
    ids and repeated rows are judged row by row; other columns of ``docs`` are dropped; no
    documents give none, and without labels every score is 0.5, so all stay."""
    scored = ri_classifier.classify(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality", carry=COLUMNS)
    return scored.filter("predicted = 1").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects stay.

    NULL and empty texts have too few words and go; NULL and repeated ids and
    repeated rows are judged row by row; other columns are dropped; no documents give none."""
    return rule_cascade.apply_cascade(docs, "doc_id", "text", carry=COLUMNS).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of least id, NULL ids last,
    of equal ids that of the least digest of its text.  Of rows that share id and
    text one stays (any; they are the same document).

    Rows are told apart by id and text, so NULL and repeated ids with different texts
    are different documents.  NULL is the empty text; all empty texts are one class.  Other
    columns are dropped; no documents give none."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    docs = docs.select(*COLUMNS, row.alias("_row"))
    classes = near_dedup.near_duplicates(docs, "_row", "text")
    first = classes.filter("key = class_id").select(F.col("key").alias("_row")).distinct()
    return docs.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur more than once go; a character cut in two goes whole.

    A NULL text becomes empty, a text that is all repeated becomes empty and stays a
    document; repeated rows repeat their whole text, which goes from all of them; NULL
    and repeated ids are kept as they are; other columns are dropped; no documents give none."""
    cut = repeats.remove_repeats(docs, "doc_id", "text", carry=("lang", "source"), characters=True)
    cut = cut.select(F.col("key").alias("doc_id"), F.col("kept").cast("string").alias("text"), "row.lang", "row.source")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens, a row per piece.

    An empty or NULL text is the end mark alone; NULL and repeated ids and repeated
    rows are documents of their own; no documents give no pieces."""
    rows = packing.pack(docs, "doc_id", "text", public_tokenizers.path(PACK_RANKS), public_tokenizers.PATTERN, PACK_SPECIAL)
    return rows.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]
#: Models, fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
