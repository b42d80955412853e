"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "panelforge",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session configured for this engine.

    On a cluster, ``master`` is None and the cluster's own settings win:
    we only fill in settings that are unset.  Tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Broadcast only tables the planner can prove small; the explicit
        # broadcasts in this package are fixed-size dimensions or
        # bounded parameter rows.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor (Spark's default
        # heap is 1 GB); a cluster keeps its own sizing.
        conf["spark.driver.memory"] = os.environ.get("PANELFORGE_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # Settings the cluster already made (spark-defaults / spark-submit,
    # visible as spark.* system properties) win over these defaults;
    # ``extra`` is the caller's explicit choice and always applies.
    from pyspark import SparkConf, SparkContext
    preset = set()
    if not master:
        SparkContext._ensure_initialized()  # attach to the launcher's JVM first
        preset = {k for k, _ in SparkConf().getAll()}
    conf = {k: v for k, v in conf.items() if k not in preset}
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage (``df.checkpoint()``) and to
    stage written tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there).  Only when it is unset AND the master is local
    (tests) do we create one under the system temp folder; on a cluster
    an unset value is an error rather than a machine-local fallback.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder "
                               "(HDFS / object store) that every executor can read")
        d = tempfile.mkdtemp(prefix="panelforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a cluster ships it with --py-files; that setting is kept)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet below the shared checkpoint folder, read back: computed
    once, its lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_unreferenced(spark: SparkSession) -> None:
    """Let Spark's ContextCleaner reclaim broadcasts, shuffle files and
    cached blocks of DataFrames that are no longer referenced: drop the
    Python handles, then ask the driver JVM for a GC (the cleaner works
    from weak references; its own periodic GC runs only every 30 min).
    Used between the many short jobs of iterative model fitting."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame, partition_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``df`` in partitions of about ``partition_rows`` rows, never more partitions than it
    has, and the cached frame behind it, to be unpersisted: the many short jobs of
    iterative fitting on a small panel then start few tasks."""
    held = df.cache()
    return held.coalesce(max(1, math.ceil(held.count() / partition_rows))), held


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Panel:
    """Column roles of an entity x period panel.

    ``predictors`` empty means every column without a role
    (see :func:`panelforge.operators.relational.predictor_list`).
    """
    entity: str = "Code"
    period: str = "Year"
    target: str = "target"
    predictors: tuple = field(default_factory=tuple)
    ids: tuple = ("Country", "Code", "Year", "Region")
    name: str = "Country"
    group: str = "Region"

    @property
    def roles(self) -> frozenset:
        """All columns that have a role."""
        return frozenset({*self.ids, self.entity, self.period, self.name, self.group, self.target})
