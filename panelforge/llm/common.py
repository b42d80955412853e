"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import checkpoint_dir, release_unreferenced

#: Output batches of Python stages are closed once they hold this many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: cuts lineage, survives lost executors, computes shared inputs once.
    The shuffle files of the step are then garbage; they are released at once,
    so that a job of many steps needs the disk of one."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    release_unreferenced(spark)
    return spark.read.schema(df.schema).parquet(path)


def slim(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other
    columns of the caller can never clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in cols.items()])


def with_row(df: DataFrame, carry: Sequence[str], **cols: str | Column) -> DataFrame:
    """:func:`slim` and, if ``carry`` names columns, a struct ``row`` of them that a Python stage hands on."""
    return slim(df, **cols, **({"row": F.struct(*[df[c] for c in carry])} if carry else {}))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices, each closed once ``column`` holds that many bytes in it."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(total // limit)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def rest_of_row(carry: Sequence[str], text_col: str) -> list[str]:
    """The columns that need a struct of their own beside the text, which a Python stage has anyway."""
    return [c for c in carry if c != text_col]


def handed_text(src: DataFrame, carry: Sequence[str], text_col: str) -> list[T.StructField]:
    """The fields that a Python stage hands on: the text once, if ``carry`` names it, and the struct."""
    return [f for f in src.schema.fields if f.name == "row" or f.name == "text" and text_col in carry]


def row_of(carry: Sequence[str], text_col: str) -> list[Column]:
    """The struct ``row`` of all carried columns, put together from what was handed on."""
    return [F.struct(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in carry]).alias("row")] if carry else []


def handed_on(src: DataFrame) -> list[T.StructField]:
    """The schema of that struct, if there is one."""
    return [f for f in src.schema.fields if f.name == "row"]


def id_hash(*cols: Column) -> Column:
    """Non-negative hash of a row's key (NULL hashes to a fixed value)."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))
