"""Exact duplicates by recipes of content-defined chunks.

A text, with every run of white space made one space, is cut into chunks where
its own content says so: after ``MIN_CHARS`` characters at the next place where
two ASCII characters recur four characters further on (for other scripts: where
one character recurs five further on), at the latest after ``MAX_CHARS``.  Equal
passages thus give equal chunks wherever they stand.

* Every chunk is named by the 64-bit hash of its content.  The names are
  verified: the distinct chunks are found by content, once, with map-side
  combining, and a name that two contents share is *doubtful*.
* A document's recipe is the ordered list of its chunk names, about one
  hundredth of the text.  Texts are compared by their recipes, so a long text
  never moves again.  Texts whose recipe has a doubtful name are compared by
  that recipe and their whole text, which keeps the result exact.
* Copies are counted in two levels, (recipe, salt) and recipe, and the answer
  goes back to the rows by (recipe, salt): a text that makes up a third of the
  table is the work of as many tasks as there are salts.

DataFrame functions only: no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import scratch_table, slim

MIN_CHARS, MAX_CHARS = 512, 4096
#: What differs from one space: a run that starts with other white space, or is longer than one.
WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
RECURS = r"([\x00-\x7F])([\x00-\x7F])..\1\2|([^\x00-\x7F])....\3"


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; NULL is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """The text's chunks in order; joined they are the text, and an empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?(?={RECURS})|.{{1,{most}}}"), F.lit(0))


def name(chunk: Column, bits: int = 64) -> Column:
    """A chunk's name: a hash of its content (fewer bits only to test shared names)."""
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def shared_names(pieces: DataFrame, bits: int = 64) -> DataFrame:
    """Names (``id``) that more than one content of column ``pieces`` has."""
    distinct = pieces.select(F.explode("pieces").alias("chunk")).distinct()
    return distinct.groupBy(name(F.col("chunk"), bits).alias("id")).count().filter("count > 1").select("id")


def exact_duplicates(df: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and ``n_chunks`` (the length of its recipe).

    Texts are equal if they are identical after :func:`normalised`; NULL and
    empty texts are one group (a text of white space only is another: one space).
    Exactly one row of a group is kept: that of the least id, NULL ids last; of
    rows that share text and id, one.  ``keep_id`` is its id, NULL only
    if all ids of the group are.  Columns other than the two named are not read,
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = slim(df, key=id_col, text=text_col).select("key", normalised(F.col("text")).alias("text"))
    cut = docs.select("*", chunks(F.col("text")).alias("pieces"))
    recipe = F.transform("pieces", lambda c: name(c, bits))
    shared = scratch_table(shared_names(cut, bits), "shared-names")
    rows = cut.select("key", "text", recipe.alias("recipe"))
    if shared.isEmpty():
        rows = rows.withColumn("exact", F.lit(""))
    else:
        doubtful = rows.select("recipe").distinct().select("recipe", F.explode("recipe").alias("id"))
        doubtful = scratch_table(doubtful.join(shared, "id", "left_semi").select("recipe").distinct(), "doubtful-recipes")
        rows = rows.join(doubtful.withColumn("doubt", F.lit(True)), "recipe", "left")
        rows = rows.withColumn("exact", F.when(F.col("doubt"), F.col("text")).otherwise(""))
    rows = rows.select("key", F.sha2("text", 256).alias("text_sha256"), "recipe", "exact", F.monotonically_increasing_id().alias("row"))
    rows = scratch_table(rows, "recipes")

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    text = ["recipe", "exact"]
    parts = rows.groupBy(*text, "salt").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"), F.count("*").alias("n"))
    parts = scratch_table(parts, "recipe-parts")
    groups = parts.groupBy(*text).agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    answers = parts.select(*text, "salt").join(groups, text)
    out = rows.join(answers, [*text, "salt"])
    return out.select("key", F.col("first.key").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
                      F.size("recipe").cast("long").alias("n_chunks"))
