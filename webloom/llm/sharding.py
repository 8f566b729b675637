"""Shards of nearly equal size in bytes by histogram sort.

Rows are ordered by a hash of their text and then by a hash of their id and their place, so equal texts
stand side by side.  To cut this order into shards, rounds of probes count the exact bytes below
candidate keys: every task counts its rows between the probes, the counts are added up, and each
splitter keeps the interval that holds its target.  A splitter is done when a probe lies within the
tolerance.  The first key decides as long as it can, so a group of equal texts is cut only where a
splitter cannot be met beside it.  When all splitters are known, the rows move once, to their part of a
shard, where they get their slots.

Nulls: a null text has no bytes, so its size is 1.  A null doc_id is hashed like a value.  Repeated
rows are told apart by their place in the input, which has to be read in the same order twice (a
stored table is).  Input columns named like an output column are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, stored

SHARDS = 16
#: A splitter may be this share of a shard's bytes away from its target.
TOLERANCE = 0.002
#: Bytes that move to one part of a shard, and the most parts of a shard.
PART = 16 << 20
MOST_PARTS = 1024
#: Probes per open splitter and round, and those of a round in all: what driver and tasks hold.
PROBES = 256
MOST_PROBES = 1 << 16
LEVELS = ("_k1", "_k2", "_k3")


def _keys(docs: DataFrame) -> DataFrame:
    """Non-negative sort keys of every row, and its size."""
    return docs.withColumns(
        {
            "_k1": F.shiftrightunsigned(F.xxhash64("text"), 1),
            "_k2": F.shiftrightunsigned(F.xxhash64("doc_id"), 1),
            "_k3": F.monotonically_increasing_id(),
            "_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1,
        }
    )


def encoded(k1, k2, k3) -> np.ndarray:
    """Keys as byte strings that sort like the three numbers."""
    joined = np.empty((len(k1), 3), ">i8")
    joined[:, 0], joined[:, 1], joined[:, 2] = k1, k2, k3
    # A last byte keeps trailing zero bytes from being cut off.
    wide = np.concatenate((joined.view(np.uint8).reshape(-1, 24), np.ones((len(k1), 1), np.uint8)), 1)
    return np.ascontiguousarray(wide).view("S25").ravel()


def _counted(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe (a sorted array of encoded keys)."""

    def run(batches: Iterator[pa.RecordBatch]):
        size = np.zeros(len(probes) + 1, np.int64)
        rows = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            k = encoded(*(batch.column(n).to_numpy() for n in LEVELS))
            # A probe counts the rows below it, so equal keys stand after it.
            at = np.searchsorted(probes, k, "right")
            np.add.at(size, at, batch.column("_size").to_numpy())
            np.add.at(rows, at, 1)
        used = np.flatnonzero(rows)
        yield {"at": used, "size": size[used], "rows": rows[used]}

    counts = arrow_map(keys, run, "at bigint, size bigint, rows bigint")
    total = counts.groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    size = np.zeros(len(probes) + 1, np.int64)
    rows = np.zeros(len(probes) + 1, np.int64)
    for r in total.collect():
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, targets: np.ndarray, slack: np.ndarray) -> list[tuple[int, int, int]]:
    """A key for each target, such that the bytes below it are the target's, give or take ``slack``.

    ``keys``: (_k1, _k2, _k3, _size), stored.  The driver holds the probes and their counts only.
    """
    end = 2**63 - 1
    # Each open splitter: level, fixed upper keys, interval [low, high) on the level.
    state = [(0, (), 0, end)] * len(targets)
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(targets):
        probes: dict[tuple[int, int, int], None] = {}
        grid: dict[tuple, list[tuple[int, int, int]]] = {}
        cells = {state[k] for k in range(len(targets)) if k not in done}
        each = max(4, min(PROBES, MOST_PROBES // len(cells)))
        for cell in cells:
            level, fixed, low, high = cell
            step = max(1, -(-(high - low) // each))
            points = [*range(low, high, step), high]
            grid[cell] = [(*fixed, p, *(0,) * (2 - level)) for p in points]
            probes.update(dict.fromkeys(grid[cell]))
        ordered = sorted(probes)
        size, _ = _counted(keys, encoded(*np.array(ordered, np.int64).T))
        below = dict(zip(ordered, size.tolist()))
        for k, target in enumerate(targets.tolist()):
            if k in done:
                continue
            level, fixed, low, high = state[k]
            points = grid[state[k]]
            counts = [below[p] for p in points]
            best = min(range(len(points)), key=lambda i: (abs(counts[i] - target), i))
            if abs(counts[best] - target) <= slack[k]:
                done[k] = points[best]
                continue
            inside = max(i for i in range(len(points) - 1) if counts[i] <= target or i == 0)
            a, b = points[inside][level], points[inside + 1][level]
            if b - a > 1:
                state[k] = (level, fixed, a, b)
            elif level < 2:
                state[k] = (level + 1, (*fixed, a), 0, end)
            else:
                done[k] = points[best]  # between two rows: the nearer side
    return [done[k] for k in range(len(targets))]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (position in the shard, without gaps)."""
    keyed = _keys(docs.drop("shard", "slot"))
    keys = stored(keyed.select(*LEVELS, "_size"), "shard-keys")
    total = keys.agg(F.sum("_size").alias("n")).first()["n"] or 0
    fine = max(1, min(MOST_PARTS, -(-total // (shards * PART))))
    number = np.arange(1, shards * fine)
    targets = (number * total) // (shards * fine)
    slack = np.where(number % fine == 0, tolerance * total / shards, 0.2 * total / (shards * fine))
    cut = encoded(*np.array(splitters(keys, targets, slack), np.int64).reshape(-1, 3).T)
    # Rows before each part: exact, so slots need no second look at the rows.
    _, before = _counted(keys, cut) if len(cut) else (None, np.zeros(0, np.int64))
    first = np.append(0, before).astype(np.int64)

    @F.pandas_udf("int")
    def part(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        at = encoded(a.to_numpy(), b.to_numpy(), c.to_numpy())
        return pd.Series(np.searchsorted(cut, at, "right").astype(np.int32))

    @F.pandas_udf("bigint")
    def place(parts: pd.Series) -> pd.Series:
        p = parts.to_numpy()
        return pd.Series(first[p] - first[p // fine * fine])

    inside = F.row_number().over(W.partitionBy("_part").orderBy(*LEVELS)) - 1
    return (
        keyed.withColumn("_part", part(*LEVELS))
        .withColumn("slot", inside)
        .withColumn("slot", F.col("slot") + place("_part"))
        .withColumn("shard", F.floor(F.col("_part") / fine).cast("int"))
        .drop(*LEVELS, "_size", "_part")
    )


def digests(docs: DataFrame) -> DataFrame:
    """Where each document is: (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    return shard(docs.select("doc_id", "text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
