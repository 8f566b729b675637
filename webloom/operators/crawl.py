"""Crawl graph: reachability, cached and missing files, download plans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators.joins import running_total, tiles
from webloom.operators.links import css_edges, html_edges
from webloom.session import cut_lineage, let_workers_import, shuffle_width, stored

NODE = ["target_domain", "url"]
#: Bits of a URL's number that are its place in its partition, as ``monotonically_increasing_id`` gives them.
PLACE_BITS = 33
#: Tables of a round each before they become one.
MOST_LEVELS = 16
STATE = "part bigint, node bigint, bits binary"


def crawl_edges(
    pages: DataFrame,
    sheets: DataFrame,
    patterns: Iterable[str] = (),
    domains: Iterable[str] = (),
) -> DataFrame:
    """Edges out of every stored file; its kind is told by the path it is saved under."""
    patterns, domains = list(patterns), list(domains)
    kind = U.suffix(U.local_path(F.col("url")))
    return html_edges(pages.where(kind.isin(".html", ".htm")), patterns, domains).unionByName(
        css_edges(sheets.where(kind == ".css"), patterns, domains)
    )


def numbered(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """URLs as (target_domain, url, node), edges as (src, dst), seeds as (node): a number for each URL.

    A number is the partition of the URL in the table of URLs and its place there, so the numbers of a
    partition are dense.
    """
    # Stored as texts once: finding them is the dear part.
    edges = stored(edges.select("target_domain", "src_url", "dst_url"), "crawl-edges")
    ends = [edges.select("target_domain", F.col(c).alias("url")) for c in ("src_url", "dst_url")]
    every = reduce(DataFrame.unionByName, [*ends, seeds.select(*NODE)]).distinct()
    urls = stored(every.withColumn("node", F.monotonically_increasing_id()), "crawl-urls")

    def numbers(rows: DataFrame, column: str, name: str) -> DataFrame:
        named = urls.withColumnsRenamed({"url": column, "node": name})
        return rows.join(named, ["target_domain", column]).drop(column)

    pairs = numbers(numbers(edges, "src_url", "src"), "dst_url", "dst").drop("target_domain")
    return urls, pairs, numbers(seeds.select(*NODE), "url", "node").select("node")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 0) -> DataFrame:
    """Breadth-first search of all sites at once: (target_domain, url, depth, processed).

    ``max_depth`` 0 has no limit; otherwise URLs one level deeper are seen but not processed.
    URLs are numbered first, and rounds move numbers only.  Edges are partitioned and sorted by their
    source and keep that layout in a checkpoint.  What was seen is a bitmap for each partition of numbers,
    a bit for a URL; a round aggregates what it finds before it is shuffled, and looks it up there.
    """
    width = shuffle_width(edges.sparkSession)
    urls, pairs, start = numbered(edges, seeds)
    by_source = pairs.repartition(width, "src").distinct().sortWithinPartitions("src")
    outgoing = cut_lineage(by_source, keep_layout=True)
    level = 0
    state = stored(unseen(start.distinct(), None), "crawl-round")
    frontier, size = _round(state, level)
    levels = [frontier]
    while (max_depth == 0 or level <= max_depth) and size:
        level += 1
        state = stored(unseen(newly_found(frontier, outgoing), state), "crawl-round")
        frontier, size = _round(state, level)
        levels.append(frontier)
        if len(levels) > MOST_LEVELS:
            levels = [stored(reduce(DataFrame.unionByName, levels), "crawl-levels")]
    seen = reduce(DataFrame.unionByName, levels)
    processed = F.lit(True) if max_depth == 0 else F.col("depth") <= max_depth
    return urls.join(seen, "node").select(*NODE, "depth", processed.alias("processed"))


def newly_found(frontier: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Numbers one step beyond the frontier, each once."""
    step = frontier.select(F.col("node").alias("src")).join(outgoing, "src")
    return step.select(F.col("dst").alias("node")).distinct()


def unseen(found: DataFrame, state: DataFrame | None) -> DataFrame:
    """What was not seen before, and what is seen from now on: rows (part, node) and rows (part, bits).

    ``found`` has each number once; ``state`` is the result of the round before.
    """
    let_workers_import(found.sparkSession)
    fresh = found.select(F.shiftright("node", PLACE_BITS).alias("part"), "node")
    empty = found.sparkSession.createDataFrame([], STATE)
    seen = (empty if state is None else state).where("bits is not null").select("part", "bits")
    return fresh.groupBy("part").cogroup(seen.groupBy("part")).applyInArrow(_marked, STATE)


def _marked(found: pa.Table, seen: pa.Table) -> pa.Table:
    part = (found if found.num_rows else seen)["part"][0].as_py()
    place = found["node"].to_numpy() & ((1 << PLACE_BITS) - 1)
    old = np.frombuffer(seen["bits"][0].as_py() if seen.num_rows else b"", np.uint8)
    bits = np.zeros(max(len(old), int(place.max(initial=-1)) // 8 + 1), np.uint8)
    bits[: len(old)] = old
    new = place[bits[place >> 3] >> (place & 7) & 1 == 0]
    np.bitwise_or.at(bits, new >> 3, (1 << (new & 7)).astype(np.uint8))
    n = len(new)
    return pa.table(
        {
            "part": pa.array(np.full(n + 1, part), pa.int64()),
            "node": pa.array([None, *((part << PLACE_BITS) + new).tolist()], pa.int64()),
            "bits": pa.array([bits.tobytes(), *[None] * n], pa.binary()),
        }
    )


def _round(state: DataFrame, level: int) -> tuple[DataFrame, int]:
    frontier = state.where("node is not null").select("node", F.lit(level).alias("depth"))
    return frontier, frontier.count()


def edges_of_available(edges: DataFrame, available: DataFrame) -> DataFrame:
    """Drop edges out of pages that could not be fetched: they keep their depth, lead nowhere."""
    ok = available.select("target_domain", F.col("url").alias("src_url")).distinct()
    return edges.join(ok, ["target_domain", "src_url"], "left_semi")


def with_status(reached: DataFrame, inventory: DataFrame) -> DataFrame:
    """Mark every processed URL as present or missing on disk."""
    stored = inventory.select("target_domain", "path").distinct().withColumn("_hit", F.lit(True))
    return (
        pin(reached.where("processed"), path=U.local_path(F.col("url")))
        .join(stored, ["target_domain", "path"], "left")
        .withColumn("status", F.when(F.col("_hit"), "present").otherwise("missing"))
        .drop("_hit", "processed")
    )


def cached_urls(urls: DataFrame, inventory: DataFrame) -> DataFrame:
    return _by_path(urls, inventory, "left_semi")


def missing_urls(urls: DataFrame, inventory: DataFrame) -> DataFrame:
    """What a resumed crawl still has to fetch."""
    return _by_path(urls, inventory, "left_anti")


def _by_path(urls: DataFrame, inventory: DataFrame, how: str) -> DataFrame:
    stored = inventory.select("target_domain", "path").distinct()
    return pin(urls, path=U.local_path(F.col("url"))).join(
        stored, ["target_domain", "path"], how
    )


def crawl_stats(status: DataFrame, with_total: bool = False) -> DataFrame:
    """Counts per site and status; optionally a line for all sites (target_domain NULL)."""
    counts = status.groupBy("target_domain", "status").agg(F.count("*").alias("urls"))
    if not with_total:
        return counts
    total = (
        counts.groupBy("status")
        .agg(F.sum("urls").alias("urls"))
        .select(F.lit(None).cast("string").alias("target_domain"), "status", "urls")
    )
    return counts.unionByName(total)


def crawl_figures(reached: DataFrame, inventory: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Per site: URLs visited, and of those within the depth how many were cached, fetched or failed.

    ``fetch_log`` (target_domain, url, status) has the requests of this run, status 0 for a success; a
    missing URL without an entry was not asked for and counts as visited only.
    """
    tried = fetch_log.groupBy("target_domain", "url").agg((F.min("status") == 0).alias("_ok"))
    beyond = reached.where(~F.col("processed")).select(*NODE, F.lit("beyond").alias("status"))
    status = with_status(reached, inventory).select(*NODE, "status").unionByName(beyond)
    joined = status.join(tried, NODE, "left")
    missing = F.col("status") == "missing"
    return joined.groupBy("target_domain").agg(
        F.count("*").alias("visited"),
        F.count_if(F.col("status") == "present").alias("cached"),
        F.count_if(missing & F.col("_ok")).alias("downloaded"),
        F.count_if(missing & ~F.col("_ok")).alias("failed"),
    )


def jitter_permille(url: Column) -> Column:
    """Repeatable waiting factor of a URL, 500 to 1500 thousandths."""
    return F.lit(500) + F.pmod(F.xxhash64(url), F.lit(1001))


def politeness_schedule(
    urls: DataFrame, wait_ms: int, factor_permille: Column | None = None
) -> DataFrame:
    """When each request of a site may start, in milliseconds after the first one."""
    factor = F.lit(1000) if factor_permille is None else factor_permille
    own = F.floor(F.lit(wait_ms) * factor / 1000).cast("bigint")
    total = running_total(
        urls.withColumn("_wait", own), ["target_domain"], ["depth", "url"], F.col("_wait"), "_until"
    )
    return total.withColumn("start_ms", F.col("_until") - F.col("_wait")).drop("_until", "_wait")


def download_batches(urls: DataFrame, parallel: int) -> DataFrame:
    """Split the distinct URLs of every site into ``parallel`` even lists."""
    return tiles(urls.select(*NODE).distinct(), ["target_domain"], ["url"], parallel, "batch")
