"""Helpers of the operators in this folder: stored tables, Arrow maps, components, even groups."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

import webloom

from webloom.session import shared_folder

#: Words of all contracts: runs of bytes other than ASCII white space.  ``bytes.split()`` cuts at
#: exactly these six characters (tab, line feed, vertical tab, form feed, return, space).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id: later than every other id.
NO_ID = 2**63 - 1
#: Links that a task joins at a time.
FOREST = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like a checkpoint (the files survive lost executors), but compressed and by
    column.  One folder per application; the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` for functions that yield columns as a dict; empty results yield nothing."""
    spark = df.sparkSession
    # Workers that this session starts find the package where the driver has it.
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(webloom.__file__).resolve().parent.parent)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    kinds = spark.createDataFrame([], schema).schema
    names = kinds.names
    arrow = to_arrow_schema(kinds)

    def run(batches):
        for columns in function(batches):
            arrays = [
                x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n).type)
                for n, x in ((n, columns[n]) for n in names)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """Values one by one, so that a batch of long texts is not held twice."""
    return (x.as_py() for x in batch.column(column))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of one string column."""
    for batch in batches:
        array = batch.column(column)
        if batch.num_rows == 0:
            continue
        sizes = np.array(
            pc.fill_null(pc.binary_length(array), 0), dtype=np.int64
        )
        part = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """Links (a, b) of one task, ``most`` at a time, as links to the smallest node that they connect."""
    held, rows = [], 0

    def joined():
        pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        labels = joined_labels(np.arange(len(nodes)), at[:, 0], at[:, 1])
        far = labels != np.arange(len(nodes))
        return {"a": nodes[far], "b": nodes[labels[far]]}

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1))
        rows += batch.num_rows
        if rows < most:
            continue
        found = joined()
        rows = len(found["a"])
        held = [np.stack((found["a"], found["b"]), 1)]
        if 2 * rows > most:
            yield found
            held, rows = [], 0
    if rows:
        yield joined()


def components(edges: DataFrame, name: str, most: int = FOREST) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): (node, root), root the smallest node.

    Each task first joins what it reads, ``most`` links at a time: each node gets a link to the smallest one that
    these links reach.  Large-star / small-star rounds follow until each node has one link, to a node that has none:
    every step is a minimum per node (summed up before the shuffle) and a join that adaptive execution can split, so
    a node with very many links is no bottleneck.  Nodes without links are not in the result.
    """

    def done(table: DataFrame) -> bool:
        ends = table.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.union(table.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        return ends.where("out > 1 or out > 0 and into > 0").agg(F.count("*").alias("n")).first()["n"] == 0

    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = stored(arrow_map(pairs, lambda batches: _forests(batches, most), "a bigint, b bigint"), name)
    while not done(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def block_pairs(rows: DataFrame, key: str, spread_by: Sequence[str], limit: int, name: str) -> DataFrame:
    """Split groups with more than ``limit`` rows so that no task has to hold one of them whole.

    Adds (block, left, right).  A group of c rows is dealt into n = ceil(c / limit) parts, and each
    pair of parts becomes one block of about 2 * limit rows; a row goes to the n blocks of its
    part.  ``left`` and ``right`` say which sides of the block it stands on (both if the block is a
    part with itself).  All pairs of a group meet in exactly one block.
    """
    hot = (
        rows.groupBy(key)
        .agg(F.count("*").alias("_c"))
        .where(F.col("_c") > limit)
        .select(key, F.ceil(F.col("_c") / limit).cast("int").alias("_n"))
    )
    hot = stored(hot, name)
    if hot.isEmpty():
        return rows.withColumns(
            {"block": F.lit(0).cast("bigint"), "left": F.lit(True), "right": F.lit(True)}
        )
    dealt = (
        rows.join(hot, key, "left")
        .withColumn("_n", F.coalesce("_n", F.lit(1)))
        .withColumn("_p", F.pmod(F.xxhash64(*spread_by), F.col("_n")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    )
    low, high = F.least("_p", "_q"), F.greatest("_p", "_q")
    return dealt.withColumns(
        {
            "block": low.cast("bigint") * F.col("_n") + high,
            "left": F.col("_p") <= F.col("_q"),
            "right": F.col("_p") >= F.col("_q"),
        }
    ).drop("_n", "_p", "_q")


def runs(keys: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal rows in sorted key columns."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 50_000
) -> Iterator[pa.RecordBatch]:
    """Join sorted batches so that no group of ``keys`` is cut; a bounded number of rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches(max_chunksize=max(1, table.num_rows))[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = joined()
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts, _ = runs(columns)
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut)
        held, rows = [whole.slice(cut)], whole.num_rows - cut
        least = max(least, 2 * rows)
    if held:
        yield joined()


def pairs_in(
    starts: np.ndarray, ends: np.ndarray, most: int = 2_000_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside each run, about ``most`` at a time."""
    size = int(ends[-1]) if len(ends) else 0
    stop = np.repeat(ends, ends - starts)
    counts = stop - np.arange(size) - 1
    total = np.cumsum(counts)
    a = 0
    while a < size:
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + most, side="right")))
        c = counts[a:b]
        i = np.repeat(np.arange(a, b), c)
        inner = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        if len(i):
            yield i, i + 1 + inner
        a = b


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected through the links (i, j), given the labels so far."""
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        for side in (i, j):
            np.minimum.at(new, labels[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new
