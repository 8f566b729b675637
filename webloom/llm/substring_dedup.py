"""Exact substring deduplication over words by seed and extend.

Seeds: a document is winnowed.  Every window of ``LENGTH`` words holds LENGTH - SEED + 1 seeds of SEED
words, and its anchor is the seed with the smallest hash (the leftmost of equal ones).  Equal windows
have equal anchors at the same place, so documents that share a window meet in a join on anchors.

Extend: the consecutive windows of a document with one anchor are its stretch around the seed, as far
as a match can go to the left and to the right before another anchor takes over.  Equal stretches are
one class, and only the first document of a class is looked at further.  If an anchor stands in several
classes, the representatives extend word by word: their windows are compared by hash, once per class
and not once per pair, and each learns the first document that has the same window.  Matches of
neighbouring stretches join to maximal repeats when a document's spans are merged.

A window is removed if an equal one starts in a document with a smaller doc_id, judged on the input.
Hashes have 64 bits; two of them with different bases (anchor and stretch, anchor and window) must
agree.

Nulls: a null text has no words.  A null doc_id counts as larger than every other: such a document
loses what others have and takes nothing from them.  Documents with less than LENGTH words lose
nothing.  Rows with the same doc_id take nothing from each other, and repeated rows are all kept; extra
columns stay in ``without_repeats`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import NO_ID, arrow_map, stored

LENGTH = 50
SEED = 10
# Odd bases of the rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Different words whose hashes a worker remembers.
MEMORY = 400_000
WORD = re.compile(r"[^\x20\x09-\x0d]+")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), np.uint64(base), np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


class Rolling:
    """Hashes of all word ranges of one document."""

    def __init__(self, words: list[bytes], base: int):
        n = len(words)
        if len(_HASHES) > MEMORY:
            _HASHES.clear()
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        # Mix, so that the smallest hash is as good as random.
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)


def stretches(words: list[bytes], length: int = LENGTH, seed: int = SEED):
    """Runs of windows with one anchor: (anchor, first window, number of windows, content hash)."""
    n = len(words)
    if n < length:
        return None
    roll = Rolling(words, BASES[0])
    at = np.arange(n - seed + 1)
    h = roll.of(at, at + seed)
    # Leftmost smallest seed of each window, by doubling.
    best, have, want = at, 1, length - seed + 1
    while have < want:
        step = min(have, want - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        have += step
    first = np.append(0, np.flatnonzero(best[1:] != best[:-1]) + 1)
    count = np.diff(np.append(first, len(best)))
    content = Rolling(words, BASES[1]).of(first, first + count + length - 1)
    content ^= (count * 64 + best[first] - first).astype(np.uint64)
    return h[best[first]].view(np.int64), first, count, content.view(np.int64)


def windows(words: list[bytes], first: int, count: int, length: int = LENGTH) -> np.ndarray:
    """Hashes of ``count`` windows from ``first`` on."""
    at = np.arange(count)
    part = words[first : first + count + length - 1]
    return Rolling(part, BASES[1]).of(at, at + length).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("th"),
        "text",
    )


def anchors(docs: DataFrame) -> DataFrame:
    """(id, th, anchor, first, count, content): the stretches of all documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held, rows = [], 0
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                found = stretches((text or "").encode().split())
                if found is None:
                    continue
                held.append((np.full(len(found[0]), k), *found))
                rows += len(found[0])
                if rows > 100_000:
                    yield _columns(batch, held)
                    held, rows = [], 0
            if held:
                yield _columns(batch, held)

    def _columns(batch, held):
        row, anchor, first, count, content = (np.concatenate(c) for c in zip(*held))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        hashes = batch.column("th").to_numpy(zero_copy_only=False)
        return {
            "id": ids[row],
            "th": hashes[row],
            "anchor": anchor,
            "first": first.astype(np.int32),
            "count": count.astype(np.int32),
            "content": content,
        }

    return arrow_map(
        _keyed(docs), run, "id bigint, th bigint, anchor bigint, first int, count int, content bigint"
    )


def repeats(docs: DataFrame) -> DataFrame:
    """(id, th, start, end): word ranges to remove, not yet merged."""
    found = stored(anchors(docs), "anchors")
    classes = stored(
        found.groupBy("anchor", "content").agg(
            F.min(F.struct("id", "th", "first", "count")).alias("s"), F.max("id").alias("last")
        ),
        "anchor-classes",
    )
    shared = (
        classes.groupBy("anchor")
        .agg(
            F.count("*").alias("classes"),
            F.min("s.id").alias("low"),
            F.greatest(F.max("last"), F.max("s.id")).alias("high"),
        )
        .where("low < high")
    )
    seeds = stored(
        classes.join(shared, "anchor").select("anchor", "content", "s", "last", "classes"), "seeds"
    )

    # Anchors with several classes: extend the first document of each.
    wanted = (
        seeds.where("classes > 1")
        .groupBy(F.col("s.id").alias("id"), F.col("s.th").alias("th"))
        .agg(
            F.collect_list(
                F.struct("anchor", "content", F.col("s.first").alias("f"), F.col("s.count").alias("c"))
            ).alias("runs")
        )
    )
    extended = arrow_map(
        _keyed(docs).join(wanted, ["id", "th"]).select("id", "text", "runs"),
        _extend,
        "anchor bigint, content bigint, id bigint, t int, window bigint",
    )
    extended = stored(extended.distinct(), "windows")
    least = extended.groupBy("anchor", "window").agg(
        F.min("id").alias("least"), F.max("id").alias("most")
    ).where("least < most")
    hits = (
        extended.join(least, ["anchor", "window"])
        .where(F.col("id") > F.col("least"))
        .groupBy("anchor", "content")
        .agg(F.collect_set("t").alias("ts"))
    )
    # Equal stretches: all documents but the first of the class lose theirs.  The first one (it may
    # hold the class several times) loses the windows that a document before it has.
    info = (
        seeds.select(
            "anchor",
            "content",
            F.col("s.id").alias("least"),
            (F.col("last") > F.col("s.id")).alias("several"),
        )
        .join(hits, ["anchor", "content"], "left")
        .where(F.col("several") | F.col("ts").isNotNull())
    )
    # Stored, so that both sides of the next join are dealt out by it and a hot class can be split.
    info = stored(info, "shared-classes")
    first, count = F.col("first"), F.col("count")
    span = F.when(
        F.col("id") > F.col("least"),
        F.array(F.struct(first.alias("start"), (first + count + (LENGTH - 1)).alias("end"))),
    ).when(
        F.col("id") == F.col("least"),
        F.transform(
            "ts", lambda t: F.struct((first + t).alias("start"), (first + t + LENGTH).alias("end"))
        ),
    )
    return (
        found.join(info, ["anchor", "content"])
        .select("id", "th", F.explode(span).alias("span"))
        .select("id", "th", "span.start", "span.end")
    )


def _extend(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for k in range(batch.num_rows):
            words = (batch.column("text")[k].as_py() or "").encode().split()
            doc = batch.column("id")[k].as_py()
            runs = batch.column("runs")[k].as_py()
            hashes = [windows(words, r["f"], r["c"]) for r in runs]
            sizes = [len(h) for h in hashes]
            yield {
                "anchor": np.repeat(np.array([r["anchor"] for r in runs], np.int64), sizes),
                "content": np.repeat(np.array([r["content"] for r in runs], np.int64), sizes),
                "id": np.full(sum(sizes), doc),
                "t": np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                "window": np.concatenate(hashes),
            }


def covered(n: int, spans) -> np.ndarray:
    """Mask of ``n`` words of those inside one of the spans: the merged, maximal repeats."""
    depth = np.zeros(n + 1, np.int64)
    if len(spans):
        start, end = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
        np.add.at(depth, start, 1)
        np.add.at(depth, end, -1)
    return np.cumsum(depth[:n]) > 0


def _spans(docs: DataFrame) -> DataFrame:
    return (
        repeats(docs)
        .groupBy("id", "th")
        .agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; all columns and rows stay.

    White space before a removed word goes with it; the rest of the text stays as it is.  ``n_chars``,
    if there is such a column, is counted anew for texts that have changed.
    """
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
        F.xxhash64("text").alias("_th"),
    )
    spans = _spans(docs).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_spans")
    joined = keyed.join(spans, ["_id", "_th"], "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None else remaining(t, s) for t, s in zip(texts, spans)])

    text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(
        cut("_row.text", "_spans")
    )
    joined = joined.withColumn("_new", text)
    columns = []
    for field in docs.schema.fields:
        value = F.col("_row").getField(field.name)
        if field.name == "text":
            value = F.col("_new")
        elif field.name == "n_chars":
            value = F.when(F.col("_spans").isNull(), value).otherwise(
                F.length("_new").cast(field.dataType)
            )
        columns.append(value.alias(field.name))
    return joined.select(*columns)


def remaining(text: str, spans) -> str:
    """``text`` without the words inside the spans."""
    places = [m.span() for m in WORD.finditer(text)]
    pairs = [(s["start"], s["end"]) for s in spans]
    gone = covered(len(places), pairs)
    parts, before = [], 0
    for (_, end), drop in zip(places, gone.tolist()):
        if not drop:
            parts.append(text[before:end])
        before = end
    parts.append(text[before:])
    out = "".join(parts)
    return out.lstrip(" \t\n\x0b\x0c\r") if gone[:1].any() else out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("th"),
        "text",
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, gone, sums = [], [], []
            for k in range(batch.num_rows):
                words = (batch.column("text")[k].as_py() or "").encode().split()
                spans = batch.column("_spans")[k]
                if spans.is_valid:
                    mask = covered(len(words), [(s["start"], s["end"]) for s in spans.as_py()])
                    kept = [w for w, g in zip(words, mask.tolist()) if not g]
                else:
                    kept = words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield {
                "doc_id": batch.column("doc_id"),
                "n_words": n,
                "n_removed": gone,
                "kept_sha256": sums,
            }

    joined = keyed.join(_spans(docs), ["id", "th"], "left").select("doc_id", "text", "_spans")
    return arrow_map(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
