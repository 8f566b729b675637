"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import webloom

# Adaptive execution re-plans joins and splits skewed partitions at run time.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "webloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def name_folder(spark: SparkSession, folder: str) -> None:
    """Use this folder if the session names none; for local sessions, where any folder is shared."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the one given to the context."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors.

    ``keep_layout`` also keeps partitioning and order, so later joins on the same keys do not
    shuffle these rows again.  An adaptive plan does not report its layout, so this one is planned
    in a session of its own without adaptive execution; give it an explicit ``repartition``.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    if not keep_layout:
        return df.checkpoint(eager=True)
    kept = with_settings(df.select("*"), {"spark.sql.adaptive.enabled": "false"}).checkpoint(eager=True)
    return _planned_in(kept, spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: cuts lineage like a checkpoint.

    The files tell their size.  A checkpoint keeps the estimate of its plan, and over the rounds of a
    loop that joins what it made, estimates grow beyond all bounds.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_settings(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same rows in a copy of the session that differs in these settings; its own session keeps them as they are."""
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    for key, value in settings.items():
        own.conf().set(key, value)
    return _planned_in(df, SparkSession(spark.sparkContext, own))


def _planned_in(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows, planned with the settings of another session of this application."""
    datasets = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(datasets.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers that this session starts find the package where the driver has it."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    root = str(Path(webloom.__file__).resolve().parent.parent)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
