"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (chunk_bpe, chunk_recipes, license_lookup, near_dedup, order_minhash, packing, repeats, ri_classifier, rule_cascade,
                            shard_tree, source_divergence, url_trees, word_runs)
from panelforge.llm.common import table
from panelforge.llm.corpus_oracle import COPIES_SQL, DIVERGENCE_SQL
from panelforge.llm.license_oracle import LICENSE_SQL
from panelforge.llm.rule_oracle import RULE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_quality_rules": RULE_SQL, "op6_license_scan": LICENSE_SQL, "op11_chunk_recipes": COPIES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
PACK_RANKS, PACK_SPECIAL = "byte_bpe_50k.tiktoken", (("<|endoftext|>", 50256),)
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.edit_probe(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       order_minhash.as_text(F.col("sketch")).alias("fingerprint"), order_minhash.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_cascade.apply_cascade(table(spark, sf_dir, "documents"), "doc_id", "text", measures=rule_cascade.MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(F.col("key").alias("doc_id"), *rule_cascade.MEASURES, failed.alias("base_failed"), "kept")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"), "page_id", "url").withColumnRenamed("key", "page_id")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ri_classifier.classify(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality")
    return scored.withColumnRenamed("key", "doc_id")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_lookup.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "digest", "license", F.concat_ws("; ", "line_licenses").alias("line_licenses"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(PACK_RANKS), public_tokenizers.PATTERN, PACK_SPECIAL)
    return rows.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query
def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    carry = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)}
    rows = shard_tree.shard(docs, "doc_id", shard_tree.uniform_tree(16), carry, spread=("text_crc32",))
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)
    return rows.select(F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_recipes.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose CRC-32 ends in 0, its words from number a on repeat those from a to a + p - 1."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n), " ")).otherwise(text)


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = word_runs.find_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text")), "doc_id", "text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = rows.select(F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                       F.call_function("div", 1000 * F.col("best.length"), -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source")
