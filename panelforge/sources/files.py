"""File sources and sinks (SRC1-3, SNK1-4)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.reshape import pivot_wide

# Fixed value: columns of the long measure CSV that are used.
LONG_CSV_SCHEMA = T.StructType([
    T.StructField("location_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("cause_name", T.StringType()),
    T.StructField("val", T.DoubleType()),
])


def scan_parquet(spark: SparkSession, path: str, columns=None, where=None) -> DataFrame:
    """SRC2. Column pruning and predicate pushdown reach the scan because
    the projection / filter are declared before any action."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df


def load_table(spark: SparkSession, path: str, csv_schema=None) -> DataFrame:
    """SRC3. Parquet when the path ends in ``.parquet``, else CSV with a
    header (explicit schema when given, no inference pass otherwise the
    columns are strings)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    if csv_schema is not None:
        r = r.schema(csv_schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK1/SNK2. CSV (with header) when the path ends in ``.csv``, else
    Parquet.  Never point this at a path the same plan reads from; stage
    to a new path instead (Spark refuses read+overwrite of one path)."""
    w = df.write.mode(mode)
    if path.rstrip("/").endswith(".csv"):
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def _reason(schema, required) -> Column:
    """Why a row of text columns is malformed; NULL if it is not."""
    why = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        why.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.lit(f"{f.name} is not a {f.dataType.simpleString()}")))
        if f.name in required:
            why.append(F.when(c.isNull(), F.lit(f"{f.name} is empty")))
    return F.nullif(F.concat_ws("; ", *why), F.lit(""))


def malformed_rows(text: DataFrame, schema, required=()) -> DataFrame:
    """(file, line, reason) of the rows of a scan of text columns that do not fit
    ``schema``; ``line`` has the row's fields as JSON."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns]))
    found = text.select(F.col("_metadata.file_path").alias("file"), line.alias("line"), _reason(schema, required).alias("reason"))
    return found.filter("reason IS NOT NULL")


def scan_csv_long(spark: SparkSession, path: str, name_dim: DataFrame,
                  min_year: int = 2000, drop_categories=("All causes",),
                  categories=None, schema=LONG_CSV_SCHEMA, rejects: str | None = None) -> DataFrame:
    """SRC1 + JN13 + RSH1 + FLT1 + PRJ3: long CSV -> wide panel.

    ``name_dim`` (name, Code) replaces the per-row country-name library:
    names are matched on ``lower(trim(name))`` with a left join, so an
    unknown name keeps its rows with a NULL Code.  The pivot raises on a
    duplicate (name, Code, year, category) key.  ``drop_categories`` are
    removed strictly (error if absent), as in the source.

    A malformed row, one with a field that is not of its type or without a
    year, is an error that names some of them; with ``rejects`` such rows go to
    that Parquet table instead (:func:`malformed_rows`) and the others are read.
    """
    # columns are taken by name: an export may have more of them, in any order
    text = spark.read.option("header", True).csv(path)
    absent = [f.name for f in schema.fields if f.name not in text.columns]
    if absent:
        raise KeyError(f"columns {absent} not found in {path}")
    bad = malformed_rows(text, schema, ["year"])
    if rejects is not None:
        bad.write.mode("overwrite").parquet(rejects)
    elif some := bad.limit(5).collect():
        raise ValueError(f"{bad.count()} malformed rows in {path}, among them " + "; ".join(f"{r['reason']}: {r['line']}" for r in some))
    raw = text.filter(_reason(schema, ["year"]).isNull())
    raw = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    raw = raw.filter(F.col("year") >= F.lit(min_year))
    dim = name_dim.select(F.lower(F.trim(F.col("name"))).alias("_k"),
                          F.col("Code"))
    coded = (raw.withColumn("_k", F.lower(F.trim("location_name")))
             .join(dim, "_k", "left").drop("_k"))
    if categories is None:
        # Distinct categories are a bounded, tiny list (column names).
        categories = [r[0] for r in coded.select("cause_name").distinct()
                      .orderBy("cause_name").collect()]
    for c in drop_categories:
        if c not in categories:
            raise KeyError(f"category {c!r} not found in {path}")
    wide = pivot_wide(coded, ["location_name", "Code", "year"], "cause_name",
                      "val", categories)
    wide = wide.drop(*drop_categories)
    return wide.withColumnsRenamed({"location_name": "Country", "year": "Year"})


def export_bundle(tables: dict, out_dir: str, csv: bool = False) -> dict:
    """SNK3. Write each named table to ``<out_dir>/<name>/`` (Parquet,
    optionally also CSV).  Returns name -> path."""
    out = {}
    for name, df in tables.items():
        p = os.path.join(out_dir, name)
        df.write.mode("overwrite").parquet(p)
        if csv:
            df.write.mode("overwrite").option("header", True).csv(p + ".csv")
        out[name] = p
    return out
