"""Streams of arriving pages: validation counts and newly found URLs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators.links import internal_links
from webloom.operators.validate import check_pages, issue_rows
from webloom.session import let_workers_import, stored, with_settings


URL = ["target_domain", "url"]
#: State on the disks of executors instead of their heaps, with a log of changes in the checkpoint.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def issue_counts(
    pages: DataFrame, window: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Issues per time window of arrival (column ``ts``), for batches and streams."""
    checked = check_pages(pages.withWatermark("ts", late))
    return (
        issue_rows(checked, ("ts",))
        .groupBy(F.window("ts", window).alias("w"), "issue")
        .agg(F.count("*").alias("pages"))
        .select(F.col("w.start").alias("window_start"), "issue", "pages")
    )


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Issues of each arriving page; stateless."""
    return issue_rows(check_pages(pin(pages, path=U.local_path(F.col("url")))))


def discovered_urls(
    pages: DataFrame,
    patterns: Iterable[str] = (),
    domains: Iterable[str] = (),
    late: str | None = "10 minutes",
) -> DataFrame:
    """Internal URLs of arriving pages: (target_domain, url, ts).

    In a stream each comes once within the watermark; without one (``late`` None) it may come again in
    every batch, and no state is kept here.
    """
    links = internal_links(
        pages, patterns, domains, keys=("page_id", "url", "target_domain", "ts")
    ).select("target_domain", F.col("norm_url").alias("url"), "ts")
    if not pages.isStreaming:
        return links.groupBy("target_domain", "url").agg(F.min("ts").alias("ts"))
    if late is None:
        return links
    return links.withWatermark("ts", late).dropDuplicatesWithinWatermark(URL)


def thinned(urls: DataFrame) -> DataFrame:
    """Repeated rows of (target_domain, url) taken out of each Arrow batch.

    A stream drops duplicates only behind a shuffle.  Before it, a URL that a large share of all pages
    link to becomes one row for each batch of many thousands.
    """
    let_workers_import(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(URL).aggregate([]).to_batches()

    return urls.select(*URL).mapInArrow(run, "target_domain string, url string")


def start_missing_urls(
    discovered: DataFrame, inventory: DataFrame, folder: str, checkpoint: str
) -> StreamingQuery:
    """Write discovered URLs that are not stored, each once, to ``folder``.

    URLs that were listed are keyed state, which grows with the list and lies in RocksDB on the
    executors and in the checkpoint; no batch reads what earlier ones wrote.  The inventory is stored as a
    table of paths first, so that a batch reads that and does not make it anew.  A batch that is run again
    replaces its own files.
    """
    stored_paths = stored(inventory.select("target_domain", "path").distinct(), "stream-inventory")
    missing = pin(thinned(discovered), path=U.local_path(F.col("url"))).join(
        stored_paths, ["target_domain", "path"], "left_anti"
    )
    listed = missing.select(*URL, "path").dropDuplicates(URL)
    return start_append(with_settings(listed, ROCKSDB), folder, checkpoint)


def start_counts(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the running counts of a windowed stream; ``current_counts`` reads the last of each.

    Every batch writes the windows it has changed, so the windows at the end of the stream are there
    without waiting for the watermark.  A batch that is run again overwrites its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Latest count of each window and issue."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("window_start", "issue").agg(F.max_by("pages", "batch").alias("pages"))


def start_append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
