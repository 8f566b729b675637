"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers (by hash) is its first
or its last one.  Whether a k-mer is chosen depends on the k-mer alone, so a passage gives the same
anchors wherever it stands and whatever stands around it.  ``anchors`` returns them with positions.

A fingerprint holds every anchor of a text, its whole hash and its position, so it grows with the text.  How
alike two texts are is told from all different anchors of both, which their fingerprints hold, and ``matched``
pairs two of them by position.

Nulls: a null text is an empty text; its fingerprint is the empty string.  Two texts without anchors
are alike (1), one without and another are not (0).  A text that has no closed syncmer (a short one)
has one anchor, the hash of the whole, at position 0.  A null doc_id comes after all others in descending
order; rows with the same doc_id stand in the order of their texts.  A single row is its own next document.
Repeated rows all stay.  Other input columns are not read.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map

K = 20
S = 10
#: One anchor in so many stands in a fingerprint: each one.
ONE_IN = 1
#: An anchor of a fingerprint: 12 bytes, 16 signs in base 64.
ANCHOR = np.dtype([("hash", ">u8"), ("position", ">u4")])
#: Characters of fingerprints that a task gathers before it hands them on.
HELD = 8 << 20
BASE = 0x9E3779B97F4A7C15
#: Characters of text that one ordered part should hold, and the most parts: their borders and first
#: ids are all that the driver holds.  A task streams its part, so larger parts take longer, not more memory.
PART = 8 << 20
MOST_PARTS = 10_000

_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(max(n, 1 << 14), np.uint64(base), np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(29)


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 64-bit hashes of the closed syncmers of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    inner = _mixed((sums[s:] - sums[:-s]) * down[: n - s + 1])
    low, have, want = inner, 1, k - s + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[want - 1 :] == low))
    return at, _mixed((sums[at + k] - sums[at]) * down[at] + np.uint64(k))


def placed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of a text; a text without syncmers is one anchor."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = closed_syncmers(text)
    if len(h):
        return at, h
    whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    return np.zeros(1, np.int64), np.frombuffer(whole[:8], ">u8").astype(np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Different hashes in order."""
    out = np.sort(hashes)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def written(at: np.ndarray, h: np.ndarray) -> str:
    """Fingerprint of placed anchors: the hash and the position of each, in base 64."""
    held = np.empty(len(h), ANCHOR)
    held["hash"], held["position"] = h, at
    return b64encode(held.tobytes()).decode()


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint, in order of position."""
    held = np.frombuffer(b64decode(fingerprint), ANCHOR)
    return held["hash"].astype(np.uint64), held["position"].astype(np.int64)


def matched(a: str, b: str) -> list[tuple[int, int]]:
    """Positions (in a, in b) of anchors that stand exactly once in both fingerprints, in order of a.

    Anchors of one common passage have a constant difference of positions.
    """
    (x, i), (y, j) = parsed(a), parsed(b)
    once = [np.unique(z, return_index=True, return_counts=True) for z in (x, y)]
    (u, p, _), (v, q, _) = ([c[n == 1] for c in (z, at, n)] for z, at, n in once)
    _, left, right = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return sorted(zip(i[p[left]].tolist(), j[q[right]].tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors that two texts have in common (Dice), from all different hashes of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    return float(2 * np.count_nonzero(both[1:] == both[:-1]) / len(both))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash): every closed syncmer, for positional matching between documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                at, h = closed_syncmers(batch.column("text")[k].as_py() or "")
                if len(at):
                    ids = batch.column("doc_id").slice(k, 1)
                    yield {
                        "doc_id": ids.take(pa.array(np.zeros(len(at), np.int64))),
                        "position": at,
                        "hash": h.view(np.int64),
                    }

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, position bigint, hash bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """Deal the documents into ordered parts, each with the first document of the part after it.

    (place, head, doc_id, text), sorted: descending doc_id inside a place, and last, with ``head``
    true, the document that follows the place.  The text moves once.  Only the borders and the
    first id of each part pass the driver.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, min(MOST_PARTS, -(-total // PART)))
    borders = []
    if parts > 1:
        found = ids.stat.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts)
        borders = sorted({int(x) for x in found})

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, np.int64), values.to_numpy(), "right"))

    tops = ids.groupBy(part("id").alias("p")).agg(F.max("id").alias("top")).collect()
    order = sorted(((r["p"], r["top"]) for r in tops), reverse=True)
    # The first document of a part also goes to the part before it; the very first to the last part.
    before = {top: order[k - 1][0] for k, (_, top) in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(values: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [2 * bisect_right(borders, v), 2 * before[v] + 1]
                if v in before
                else [2 * bisect_right(borders, v)]
                for v in values.tolist()
            ]
        )

    coded = docs.select("doc_id", "text").withColumn(
        "code", F.explode(places(F.coalesce("doc_id", F.lit(-(2**63)))))
    )
    dealt = coded.select(
        F.shiftright("code", 1).alias("place"),
        (F.col("code") % 2 == 1).alias("head"),
        "doc_id",
        "text",
    )
    return dealt.repartition(parts, "place").sortWithinPartitions(
        "place", "head", F.col("doc_id").desc_nulls_last(), "text"
    )


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        done = -1
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(n) for n in ("place", "head", "doc_id", "text")]
            for k in range(batch.num_rows):
                place, head, doc_id, text = (c[k].as_py() for c in columns)
                if place == done:
                    continue  # further rows with the id of the head
                text = text or ""
                at, h = placed(text)
                own = distinct(h), written(at, h)
                if held is not None:
                    rows.append(_row(*held, text, own[0]))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                held = (doc_id, text, own)
                if head:
                    held, done = None, place
                if len(rows) >= 500 or size >= HELD:
                    yield _columns(rows)
                    rows, size = [], 0
        if rows:
            yield _columns(rows)

    def _row(doc_id, text, own, next_text, next_known):
        changed = edited(text, next_text)
        known, fingerprint = own
        if changed == text:
            new, changed_print = known, fingerprint
        else:
            at, h = placed(changed)
            new, changed_print = distinct(h), written(at, h)
        return (
            doc_id,
            len(text),
            hashlib.sha256(changed.encode()).hexdigest(),
            fingerprint,
            changed_print,
            likeness(known, new),
            likeness(known, next_known),
        )

    names = (
        "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    )

    def _columns(rows):
        return dict(zip(names, map(list, zip(*rows))))

    return arrow_map(
        with_next(docs),
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
