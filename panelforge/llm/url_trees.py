"""URL filter: gradient-boosted trees on lexical features.

Host/path rules judge the URLs they fit (longest rule wins); their verdicts,
or any table of labelled URLs, train the trees, which judge the rest.
Features: lengths, depth, digit ratios, character entropy, parameter counts,
hyphens, and statistics of two suffixes: of the host (its last label) and of what
follows the host (the path's first segment), namely how many URLs carry each
and its smoothed share of blocked ones.  Both are hashed into ``SUFFIX_SLOTS``
slots, so the statistics are bounded whatever the corpus holds.

A share that a labelled URL is trained with comes from the labelled hosts of
the other ``FOLDS`` folds, never from its own host.  Trees learn from host
suffixes with labels of both classes, each class having the same weight in its
suffix: where every label of a suffix is the same, as under a rule for a
whole top-level domain, the labels tell suffixes apart and not URLs, and trees
trained with them repeat the rule for every URL of that and any unknown suffix.
If no suffix has both classes, all labels are used, unweighted.

What a verdict is worth: if the labels are only the rules' own verdicts, the
trees extend the rules to URLs that look like those the rules name; no
independent truth is in it.  ``held_out`` measures how well labels of hosts never
trained on are told apart.

NULL URLs, and URLs without "://", have an empty host and path; no rule fits
them and the trees judge them like any other.  Without two classes of labels
everything unruled is allowed.  Repeated rows are judged alike, a row each; an
empty table gives no rows.  Only the key column is carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import id_hash, scratch_table, slim

SUFFIX_SLOTS = 1024
#: Trees are fitted on at most so many labelled URLs (least hash).
MAX_TRAIN = 20_000
TREES, DEPTH, RATE = 20, 4, 0.2
PRIOR_WEIGHT = 10.0
#: Hosts are dealt into so many folds by hash.
FOLDS = 5


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits per character over the kinds of character that URLs are made of."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    out = F.lit(0.0)
    for c in LOWER + "0123456789-./":
        share = count_of(text, c) / n
        out = out - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return out


def slot_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SUFFIX_SLOTS)).cast("int")


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"^/([^/]*)", 1)


FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "host_digits", "entropy", "n_params", "query_len",
            "has_fragment", "hyphens", "host_hyphens", "path_dots", "suffix_log_count", "suffix_block_rate", "segment_log_count", "segment_block_rate")
#: Slot columns and the prefix of their two features.
SUFFIXES = (("slot", "suffix"), ("segment", "segment"))


def lexical(df: DataFrame) -> DataFrame:
    """Feature columns from ``url``, ``host``, ``path`` and ``slot``-wise statistics added later."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    last = F.substring_index(host, ".", -1)
    return df.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"),
        "depth": count_of(path, "/").cast("double"), "labels": count_of(host, ".").cast("double"),
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)), "host_digits": digits(host).cast("double"),
        "entropy": entropy(F.lower(F.concat(F.substring(host, F.lit(1), F.length(host) - F.length(last)), path))),
        "n_params": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(0).cast("double"), "query_len": F.length(query).cast("double"),
        "has_fragment": (F.instr(url, "#") > 0).cast("double"), "hyphens": count_of(url, "-").cast("double"),
        "host_hyphens": count_of(host, "-").cast("double"), "path_dots": count_of(path, ".").cast("double")})


def parsed(rows: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """``rows`` with host, path, suffix slots, fold of the host and the fitting rule."""
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.withColumns({
        "slot": slot_of(F.substring_index("host", ".", -1)), "segment": slot_of(first_segment(F.col("path"))),
        "fold": F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int"), "fit": fitting_rule(F.col("host"), F.col("path"), rules)})


def block_share(blocked: Column, n: Column, prior: float) -> Column:
    return (blocked + PRIOR_WEIGHT * prior) / (n + PRIOR_WEIGHT)


def with_statistics(rows: DataFrame, base: DataFrame, marked: DataFrame, prior: float, out_of_fold: bool) -> DataFrame:
    """``rows`` with count and block share of both suffixes.  Out of fold, the share leaves
    out the labels of the row's own fold.  The joined tables have at most ``SUFFIX_SLOTS``
    rows, times ``FOLDS`` out of fold."""
    for slot, name in SUFFIXES:
        seen = base.groupBy(slot).agg(F.log1p(F.count("*").cast("double")).alias(f"{name}_log_count"))
        rows = rows.join(F.broadcast(seen), slot, "left")
        known = marked.groupBy(slot, "fold").agg(F.count("*").alias("n"), F.sum("block").alias("b"))
        if out_of_fold:
            own = W.partitionBy(slot)
            known = known.select(slot, "fold", block_share(F.sum("b").over(own) - F.col("b"), F.sum("n").over(own) - F.col("n"), prior).alias("share"))
            rows = rows.join(F.broadcast(known), [slot, "fold"], "left")
        else:
            known = known.groupBy(slot).agg(block_share(F.sum("b"), F.sum("n"), prior).alias("share"))
            rows = rows.join(F.broadcast(known), slot, "left")
        rows = rows.withColumns({f"{name}_log_count": F.coalesce(f"{name}_log_count", F.lit(0.0)), f"{name}_block_rate": F.coalesce("share", F.lit(prior))}).drop("share")
    return rows


def scored(rows: DataFrame, base: DataFrame, marked: DataFrame, max_train: int, seed: int) -> DataFrame:
    """``rows`` with ``block_score`` by trees trained on ``marked`` (block 0/1)."""
    total = marked.agg(F.count("*").alias("n"), F.sum("block").alias("b")).first()
    prior = (total["b"] or 0.0) / max(1, total["n"])
    if not 0 < prior < 1:
        return rows.withColumn("block_score", F.lit(0.0))
    classes = marked.groupBy("slot").agg(F.count("*").alias("n"), F.sum("block").alias("b"))
    mixed = classes.filter("0 < b and b < n")  # at most SUFFIX_SLOTS rows
    learned = marked.select("url", "host", "path", "slot", "segment", "fold", "block")
    if mixed.isEmpty():
        learned = learned.withColumn("weight", F.lit(1.0))
    else:
        weight = F.col("n") / (2 * F.when(F.col("block") == 1, F.col("b")).otherwise(F.col("n") - F.col("b")))
        learned = learned.join(F.broadcast(mixed), "slot").withColumn("weight", weight).drop("n", "b")
    picked = learned.orderBy(id_hash(F.col("url")), "url").limit(max_train)
    picked = scratch_table(lexical(with_statistics(picked, base, marked, prior, True)).select(*FEATURES, "block", "weight"), "url_train")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="block", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=seed)
    model = trees.fit(assembler.transform(picked)).setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
    rows = lexical(with_statistics(rows, base, marked, prior, False))
    return model.transform(assembler.transform(rows)).withColumn("block_score", vector_to_array("_p")[1])


def with_labels(df: DataFrame, id_col: str, url_col: str, rules: Sequence[UrlRule], labelled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All rows, parsed, and the labelled ones (by default those that a rule fits)."""
    base = parsed(slim(df, key=id_col, url=url_col), rules)
    if labelled is None:
        return base, base.filter("fit is not null").withColumn("block", (F.col("fit.verdict") == "block").cast("double"))
    return base, parsed(slim(labelled, url="url", block=labelled["block"].cast("double")), rules).filter("block is not null")


def judge(df: DataFrame, id_col: str, url_col: str, rules: Sequence[UrlRule] = RULES, labelled: DataFrame | None = None,
          max_train: int = MAX_TRAIN, seed: int = 5) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``block_score``, a row per
    input row.  ``labelled`` (columns url, block 0/1) defaults to the URLs that a rule fits."""
    base, marked = with_labels(df, id_col, url_col, rules, labelled)
    rows = scored(base, base, marked, max_train, seed)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.select("key", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def held_out(df: DataFrame, id_col: str, url_col: str, rules: Sequence[UrlRule] = RULES, labelled: DataFrame | None = None,
             max_train: int = MAX_TRAIN, seed: int = 5) -> DataFrame:
    """``url``, ``host``, ``block``, ``block_score`` of the labelled URLs whose host is in fold 0,
    by trees and statistics that saw labels of the other folds only."""
    base, marked = with_labels(df, id_col, url_col, rules, labelled)
    rows = scored(marked.filter("fold = 0"), base, marked.filter("fold <> 0"), max_train, seed)
    return rows.select("url", "host", "block", "block_score")
