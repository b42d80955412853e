"""Nested JSON payload ingest (SRC4, SRC5, SRC7).

Payloads are landed files / string columns, one API page per row, so a
page is bounded by the API's page size and pages parse in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record schema of an indicator page (element [1] of the top-level array).
INDICATOR_RECORD = T.ArrayType(T.StructType([
    T.StructField("country", T.StructType([T.StructField("value", T.StringType())])),
    T.StructField("countryiso3code", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("value", T.DoubleType()),
]))

# Record schema of an OData page ({"value": [...]}).
ODATA_PAGE = T.StructType([T.StructField("value", T.ArrayType(T.StructType([
    T.StructField("SpatialDim", T.StringType()),
    T.StructField("TimeDim", T.IntegerType()),
    T.StructField("Dim1", T.StringType()),
    T.StructField("Dim2", T.StringType()),
    T.StructField("NumericValue", T.DoubleType()),
])))])

# OData dimension filter (both sexes, all age groups).
ODATA_DIM1 = "SEX_BTSX"
ODATA_DIM2 = "AGEGROUP_YEARSALL"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload document per file -> one row (column ``payload``)."""
    return (spark.read.option("wholetext", True).text(path)
            .withColumnRenamed("value", "payload"))


def ingest_indicator(pages: DataFrame, column_name: str, entities: DataFrame | None = None,
                     payload_col: str = "payload") -> DataFrame:
    """SRC4: indicator pages ``[paging, [records]]`` -> (Country, Code,
    Year, <column_name>).

    Code is upper-cased, ``date`` cast to int (ANSI: a non-numeric date
    raises), rows with a NULL in any of the four columns are dropped, and
    only entities present in ``entities`` (column Code) are kept, by a
    left-semi join.
    """
    recs = pages.select(F.from_json(F.get_json_object(F.col(payload_col), "$[1]"),
                                    INDICATOR_RECORD).alias("r"))
    flat = recs.select(F.inline("r"))
    out = flat.select(
        F.col("country.value").alias("Country"),
        F.upper("countryiso3code").alias("Code"),
        F.col("date").cast("int").alias("Year"),
        F.col("value").alias(column_name),
    ).dropna(subset=["Country", "Code", "Year", column_name])
    if entities is not None:
        out = out.join(entities.select("Code").distinct(), "Code", "left_semi")
    return out.select("Country", "Code", "Year", column_name)


def ingest_indicators(pages_by_column: dict, base: DataFrame, entities: DataFrame | None = None,
                      on_empty: str = "skip"):
    """SRC4 + JN1 + SRC7: attach several indicators to ``base`` on
    (Code, Year) with left joins.  An indicator whose pages yield no row is
    skipped (``on_empty='skip'``) or raises (``'fail'``).  Returns
    (DataFrame, skipped column names)."""
    out, skipped = base, []
    for column_name, pages in pages_by_column.items():
        ind = ingest_indicator(pages, column_name, entities)
        if ind.isEmpty():
            if on_empty == "fail":
                raise RuntimeError(f"indicator {column_name!r} returned no data")
            skipped.append(column_name)
            continue
        out = out.join(ind.select("Code", "Year", column_name), ["Code", "Year"], "left")
    return out, skipped


def ingest_odata(pages: DataFrame, target: str = "target", payload_col: str = "payload",
                 dim1: str = ODATA_DIM1, dim2: str = ODATA_DIM2,
                 check_empty: bool = True) -> DataFrame:
    """SRC5: OData pages ``{"value": [...]}`` -> (Code, Year, target) for
    one (Dim1, Dim2) cell; raises if nothing survives (the target is
    required)."""
    flat = (pages.select(F.from_json(F.col(payload_col), ODATA_PAGE).alias("p"))
            .select(F.inline("p.value")))
    out = (flat.filter((F.col("Dim1") == dim1) & (F.col("Dim2") == dim2))
           .select(F.col("SpatialDim").alias("Code"), F.col("TimeDim").alias("Year"),
                   F.col("NumericValue").alias(target)))
    if check_empty and out.isEmpty():
        raise RuntimeError("payload returned no data for the requested dimensions")
    return out


def unit_rescale(df: DataFrame, src: str, dst: str, factor: float = 100.0) -> DataFrame:
    """PRJ4: per-1000 -> per-100000 (x100), only if ``src`` is present."""
    if src not in df.columns:
        return df
    return df.withColumn(dst, F.col(src) * factor).drop(src)
