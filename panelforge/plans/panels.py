"""Panels derived from the driver tables (entity x period).

P1  nation-year      : Code = n_nationkey, Year = year(o_orderdate)
P1g P1 with deterministic NULL gaps in the target
P2  user-day         : events pivoted over the event types (natural NULLs)
P3  customer-quarter : same builder as P1 at customer grain (scale fixture)

Plan shape (P1/P3): ``lineitem`` is aggregated to order grain first
(partial aggregation map side, one shuffle on l_orderkey), so the join
with ``orders`` is 1:1 and never fans out; ``orders`` x ``customer`` is a
shuffle join on the customer key (both sides grow with the data); the
nation/region dimensions are fixed-size (25 / 5 rows) and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.session import Panel

# The priority counted by ``urgent_share``, and the P2
# event types in their natural order.
URGENT_PRIORITY = "1-URGENT"
EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]

P1_PREDICTORS = ("n_orders", "acctbal_mean", "urgent_share", "qty_mean",
                 "discount_mean", "tax_mean", "price_mean")
P1 = Panel(entity="Code", period="Year", target="target", predictors=P1_PREDICTORS,
           ids=("Country", "Code", "Year", "Region"), name="Country", group="Region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ (lineitem aggregated per order) ⋈ customer, order grain."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("li_n"),
               F.sum("l_quantity").alias("li_qty"),
               F.sum("l_discount").alias("li_disc"),
               F.sum("l_tax").alias("li_tax"),
               F.sum("l_extendedprice").alias("li_price")))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .join(li, o.o_orderkey == li.l_orderkey, "left"))


def _panel_aggs() -> list:
    return [
        F.avg("o_totalprice").alias("target"),
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("c_acctbal").alias("acctbal_mean"),
        F.avg(F.when(F.col("o_orderpriority") == URGENT_PRIORITY, 1.0).otherwise(0.0))
        .alias("urgent_share"),
        F.try_divide(F.sum("li_qty"), F.sum("li_n")).alias("qty_mean"),
        F.try_divide(F.sum("li_disc"), F.sum("li_n")).alias("discount_mean"),
        F.try_divide(F.sum("li_tax"), F.sum("li_n")).alias("tax_mean"),
        F.try_divide(F.sum("li_price"), F.sum("li_n")).alias("price_mean"),
    ]


def nation_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: Country, Code, Region, Year, target, predictors (175 rows at sf0.01)."""
    facts = _order_facts(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # Aggregate on the nation key first (25 groups), attach names after:
    # the join with the dimensions then touches 175 rows, not every order.
    agg = (facts.groupBy(F.col("c_nationkey").alias("Code"),
                         F.year("o_orderdate").alias("Year"))
           .agg(*_panel_aggs()))
    dim = (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
           .select(F.col("n_nationkey").alias("Code"), F.col("n_name").alias("Country"),
                   F.col("r_name").alias("Region")))
    out = (agg.join(F.broadcast(dim), "Code", "left")
           .select("Country", "Code", "Region", "Year", "target", *P1_PREDICTORS))
    # The panel (entities x periods) is small next to its inputs and is
    # read by many operators: persist it once; an identical plan built by
    # a later call hits the same cache entry.
    return out.persist()


def gap_rule(code, year):
    """Deterministic gaps (FIXTURES P1g)."""
    return ((code + year) % 4 == 0) | ((year <= 1996) & (code % 3 == 0))


def nation_year_panel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1g: P1 with the target NULL on the gap rule."""
    p = nation_year_panel(spark, sf_dir)
    return p.withColumn("target", F.when(gap_rule(F.col("Code"), F.col("Year")),
                                         F.lit(None).cast("double")).otherwise(F.col("target")))


def user_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: user_id x day, avg(value) per event type (NULL when absent).
    One aggregate over ``events`` with per-type filtered averages."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t)
                   for t in EVENT_TYPES]))


def customer_quarter_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: c_custkey x quarter (Period = year*4 + quarter - 1)."""
    facts = _order_facts(spark, sf_dir)
    period = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("Period")
    return (facts.groupBy(F.col("o_custkey").alias("Code"), period,
                          F.col("c_nationkey").alias("Group"))
            .agg(*_panel_aggs()))


# ----------------------------------------------------------------------------
# Deterministic pseudo-model predictions (oracle-reproducible inputs for the
# metric / report / chart operators): temporal split of P1; model "lag1"
# predicts the previous period's target, model "train_mean" the entity's
# mean train target.  Rows: (Model, Split, Code, Country, Region, Year,
# actual, predicted) for the Test and Val splits.
def pseudo_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.operators.splits import temporal_split
    from panelforge.operators.timeorder import lag_by_halo
    p = temporal_split(nation_year_panel(spark, sf_dir), "Year")
    p = lag_by_halo(p, "Code", "Year", "target", [1]).withColumnRenamed("target_lag1", "_lag")
    tm = (p.filter(F.col("split") == "train").groupBy("Code")
          .agg(F.avg("target").alias("_tm")))
    p = p.join(tm, "Code", "left").filter(F.col("split") != "train")
    split = F.when(F.col("split") == "test", "Test").otherwise("Val")
    keep = ["Code", "Country", "Region", "Year", F.col("target").alias("actual")]
    a = p.select(F.lit("lag1").alias("Model"), split.alias("Split"), *keep,
                 F.col("_lag").alias("predicted"))
    b = p.select(F.lit("train_mean").alias("Model"), split.alias("Split"), *keep,
                 F.col("_tm").alias("predicted"))
    return a.unionByName(b).filter(F.col("predicted").isNotNull())


def nation_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 nation-month (forecasting fixture, ~80 periods per entity):
    Code = nation key, Period = year*12 + month - 1, target = avg order
    price, exogenous n_orders / urgent_share / qty_mean."""
    facts = _order_facts(spark, sf_dir)
    period = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("Period")
    agg = facts.groupBy(F.col("c_nationkey").alias("Code"), period).agg(
        F.avg("o_totalprice").alias("target"), F.count(F.lit(1)).alias("n_orders"),
        F.avg(F.when(F.col("o_orderpriority") == URGENT_PRIORITY, 1.0).otherwise(0.0)).alias("urgent_share"),
        F.try_divide(F.sum("li_qty"), F.sum("li_n")).alias("qty_mean"))
    return agg.persist()
