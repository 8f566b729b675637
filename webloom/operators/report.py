"""Report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_size(size: Column) -> Column:
    """Size with two decimals in the largest unit; ties round to the even digit."""
    units = ((1_073_741_824, "GB"), (1_048_576, "MB"), (1_024, "KB"))
    text = F.concat(size.cast("string"), F.lit(" bytes"))
    for factor, unit in reversed(units):
        text = F.when(
            size >= factor, F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / factor, 2))
        ).otherwise(text)
    return text


def site_totals(files: DataFrame, fetch_log: DataFrame | None = None) -> DataFrame:
    """Files, bytes and failed downloads per site: (target_domain, files, bytes, size, failed)."""
    totals = files.groupBy("target_domain").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )
    if fetch_log is None:
        totals = totals.withColumn("failed", F.lit(0).cast("bigint"))
    else:
        failed = failed_urls(fetch_log).groupBy("target_domain").agg(F.count("*").alias("failed"))
        totals = totals.join(failed, "target_domain", "left").withColumn(
            "failed", F.coalesce("failed", F.lit(0).cast("bigint"))
        )
    return totals.withColumn("size", format_size(F.col("bytes")))


def failed_urls(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.where(F.col("status") != 0)


def duration(start: Column, end: Column) -> Column:
    return end - start
