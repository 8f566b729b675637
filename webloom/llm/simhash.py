"""Near duplicates by SimHash fingerprints and pigeonring filtering.

The 64 bits stand on a ring of 16 segments of 4 bits.  If two fingerprints differ in at most 3 bits,
some segment starts a chain whose cumulative differences stay within their share of the budget at
every length: at most floor(3 * l / 16) after l segments.  So the first 5 segments of that chain are
equal, and the next 5 differ in at most one bit, so one half of them is equal too.  Fingerprints meet
in a join on (start, 5 segments, one equal half); a pair goes on to the full Hamming check only if its
chain keeps within the budget at every length.  No pair within the distance is lost.

Equal fingerprints are one class before anything is joined, and a group yields links to one
representative per connected part, not all its pairs; a group of any size is worked on in blocks.

Nulls: a null text has no words; its fingerprint is zero, like that of an empty text, and it is linked
as any other.  A null doc_id keeps its row and counts as no id: the component takes the smallest other
id, or null if there is none.  Repeated rows stay.  Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import (
    NO_ID,
    arrow_map,
    block_pairs,
    components,
    joined_labels,
    pairs_in,
    runs,
    stored,
    whole_groups,
)

DISTANCE = 3
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
#: Segments of a chain that must be equal, and those that may hold one difference.
EQUAL, NEARLY = 5, 10


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 values (seed 42) have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    a, b = start[: len(words) - size + 1].tolist(), end[size - 1 :].tolist()
    hashes = np.fromiter((digest(joined[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    over = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fingerprint of each whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = (fingerprint(x.as_py()) for x in batch.column("text"))
            fp = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield {"doc_id": batch.column("doc_id"), "fp": fp}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def _ring(fp: Column, at: int, bits: int) -> Column:
    """``bits`` bits of the ring from bit ``at`` on, as a number."""
    at %= 64
    turned = fp
    if at:
        turned = F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, 64 - at))
    return F.shiftrightunsigned(turned, 64 - bits)


def chain_keys(fp: Column) -> Column:
    """Join keys of a fingerprint: two for each start of a chain."""
    keys = []
    half = (NEARLY - EQUAL) * WIDTH // 2
    for start in range(SEGMENTS):
        at = start * WIDTH
        head = _ring(fp, at, EQUAL * WIDTH)
        for k in range(2):
            part = _ring(fp, at + EQUAL * WIDTH + k * half, half)
            tag = F.lit((2 * start + k) << 40).cast("bigint")
            keys.append(tag.bitwiseOR(F.shiftleft(head, half)).bitwiseOR(part))
    return F.array(*keys)


def within_chain(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from ``start`` keeps to its share of the budget at every length."""
    turn = (start * WIDTH).astype(np.uint64)
    ring = difference << turn | difference >> (np.uint64(64) - turn & np.uint64(63))
    ring = np.where(turn == 0, difference, ring)
    good = np.ones(len(ring), bool)
    for length in range(1, SEGMENTS + 1):
        seen = np.bitwise_count(ring >> np.uint64(64 - length * WIDTH))
        good &= seen <= DISTANCE * length // SEGMENTS
    return good


def links(classes: DataFrame, limit: int = 4096) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within the distance."""
    keyed = classes.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    dealt = block_pairs(keyed, "key", ["fp"], limit, "simhash-hot")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in whole_groups(batches, ("key", "block")):
            fp, key, block, left, right = (
                batch.column(n).to_numpy(zero_copy_only=False)
                for n in ("fp", "key", "block", "left", "right")
            )
            bits = fp.view(np.uint64)
            start = key >> 41
            first, end = runs((key, block))
            labels = np.arange(len(fp))
            for i, j in pairs_in(first, end):
                apart = bits[i] ^ bits[j]
                near = ((left[i] & right[j]) | (left[j] & right[i])) & (apart != 0)
                i, j, apart = i[near], j[near], apart[near]
                near = within_chain(apart, start[i])
                i, j, apart = i[near], j[near], apart[near]
                near = np.bitwise_count(apart) <= DISTANCE
                if near.any():
                    labels = joined_labels(labels, i[near], j[near])
            far = np.flatnonzero(labels != np.arange(len(fp)))
            if len(far):
                yield {"a": fp[far], "b": fp[labels[far]]}

    return arrow_map(dealt, run, "a bigint, b bigint").distinct()


def classes_of(found: DataFrame, limit: int = 4096) -> DataFrame:
    """(fp, first, component_id): the component of each different fingerprint of stored rows.

    ``first`` is the smallest doc_id with the fingerprint, ``component_id`` the smallest of all that can
    be reached over links.
    """
    classes = stored(
        found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes"
    )
    grouped = components(links(classes.select("fp"), limit), "simhash-links")
    rooted = (
        classes.join(grouped, classes["fp"] == grouped["node"], "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "first", "component_id")


def near_duplicates(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    ``component_id`` is the smallest doc_id that can be reached over links.  ``limit`` is the number
    of fingerprints with one key that one task compares; larger groups are split into blocks.
    """
    found = stored(fingerprints(docs), "simhash")
    return found.join(classes_of(found, limit), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    A component without any doc_id keeps one of its rows, and so do rows that share the smallest one
    (the row whose text has the smallest hash).
    """
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("th"),
        F.struct(*docs.columns).alias("row"),
    )
    rows = stored(
        keyed.select("id", "th", F.pandas_udf(_signed, "bigint")("row.text").alias("fp")), "simhash"
    )
    roots = classes_of(rows.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "fp"))
    chosen = (
        rows.join(roots.select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min(F.struct("id", "th")).alias("s"))
        .select("s.id", "s.th")
    )
    # Rows that agree in both are repeated rows: one of them stays.
    kept = keyed.join(chosen, ["id", "th"]).dropDuplicates(["id", "th"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _signed(texts: pd.Series) -> pd.Series:
    values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))
