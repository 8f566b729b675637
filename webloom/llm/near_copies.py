"""Near copies by SimHash and the exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of 5-word shingles have a similarity of at least 0.8.  Texts with the
same set are one class before anything is compared.

First come the classes whose SimHash fingerprints (``simhash``, over the same shingles) are linked: each is compared
exactly with the first class that its links reach.  Fingerprints of texts at the border differ in about ten
bits, so what they have not connected goes on to an exact search.

Candidates of the search: sets of like size are cut into the same parts by hash (about 64 to 256 shingles each).  If two sets
are alike, they are as alike in some part, so it is enough that alike parts meet.  All shingles have one global
order, and a part of n shingles is known by its first n - ceil(0.8 n) + 1: two parts that are as alike share one of
these (prefix filter).  Parts that share one are tested by sizes, places in the order and a bitmap of parities:
each shingle flips one bit, so two bitmaps differ in no more bits than the parts do in shingles.  Only pairs that
pass are compared shingle by shingle.  No pair is lost.

Shingles that are common in a sample of the texts come last in the order, so a common passage brings few
texts together.  The sample is bounded and any order gives the same pairs.

A group of n near copies has n * n pairs, but only its connected parts count: each text is compared with one
centre first (the text that shares most with others, as an unchanged original does) if they pass these tests, and
then only pairs that are not yet connected.  Only texts in pairs that are compared are read again.

Nulls: a null text has no shingles, and texts without any are near copies of each other.  A text of fewer
than five words is one shingle.  Words are compared without regard to ASCII case, as in ``simhash``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import simhash
from webloom.llm.common import (
    NO_ID,
    arrow_map,
    block_pairs,
    components,
    pairs_in,
    runs,
    stored,
    texts_of,
    whole_groups,
)

SIZE = 5
#: Least similarity as a fraction, so that comparisons are exact.
SHARE, OF = 4, 5
#: Rows of the sample that shows which shingles are common, and the most shingles that it names.
SAMPLE, COMMON = 50_000, 1 << 18
#: Bits of the filter for texts that stand in some pair: 2 ** 19 numbers of 64 bits.
FILTER = 19
#: Most shingles of a set in one part (on average, as a set is cut into a power of four of parts), and the bits of a part's map.
PART, BITS = 256, 512
#: Bytes of a text that are cut into words at a time, and of the longest word that is not hashed on its own.
PIECE, LONG = 1 << 20, 64
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_ODD = np.array([xxhash.xxh64_intdigest(bytes([k]), 42) | 1 for k in range(SIZE)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(29)


def _hashed(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of some bytes, in order."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~_BLANK[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    length = end - start
    eights = np.ndarray(len(codes), "<u8", data + bytes(8), strides=(1,))
    out = length.astype(np.uint64)
    # Eight bytes of all words that have them at a time; long words are few and hashed one by one.
    left = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        if not len(left):
            break
        unused = np.maximum(8 - (length[left] - k), 0).astype(np.uint64) * np.uint64(8)
        h = (out[left] ^ eights[start[left] + k] << unused) * _ODD[0]
        out[left] = h ^ h >> np.uint64(32)
        left = left[length[left] > k + 8]
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]], 42)
    return _mixed(out)


def shingles(text: str | None) -> np.ndarray:
    """Different 64-bit hashes of the shingles of a text, in order; the text is cut into words by pieces of bounded size."""
    data = (text or "").encode().lower()
    found, a = [], 0
    while a < len(data):
        blank = _BLANKS.search(data, a + PIECE)
        b = blank.end() if blank else len(data)
        found.append(_hashed(data[a:b]))
        a = b
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(SIZE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _ODD[k]
    out = np.sort(_mixed(out))
    return out[np.append(True, out[1:] != out[:-1])]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of SHARE / OF or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (SHARE + OF) * both >= SHARE * (len(a) + len(b))


def may_be_alike(n, m, i, j):
    """Whether sets of n and m shingles that share the i-th of one and the j-th of the other can be alike."""
    most = np.minimum(i, j) + np.minimum(n - i, m - j)
    return (SHARE + OF) * most >= SHARE * (n + m)


def bands(n: int) -> list[int]:
    """Powers of four of parts that a set of n shingles is cut into.

    A pair is compared in the band of its smaller set, and 0.8 n is the least size of a set that is alike: so a set
    stands in one band or in two that follow each other.
    """

    def band(m: int) -> int:
        k = 0
        while m > PART << 2 * k:
            k += 1
        return k

    return sorted({band(-(-SHARE * n // OF)), band(n)})


def ranked(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Level of each shingle in the global order: how often it stands in the sample, 0 if seldom."""
    if not len(common) or not len(found):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return np.where(common[at] == found, count[at], 0)


def parts_of(
    found: np.ndarray, level: np.ndarray, band: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, bitmaps, and lengths and keys of the prefixes of the parts of a set that hold a shingle."""
    part = (found >> np.uint64(64 - 2 * band)).astype(np.int64) if band else np.zeros(len(found), np.int64)
    size = np.bincount(part, minlength=1 << 2 * band)
    cell = part * BITS + (found % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(size) * BITS) & 1).astype(np.uint8)
    bits = np.packbits(odd.reshape(-1, BITS), axis=1)
    order = np.lexsort((found, level, part))
    place = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
    length = np.where(size > 0, size - -(-SHARE * size // OF) + 1, 0)
    keys = found[order][place < np.repeat(length, size)] ^ np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    used = size > 0
    return size[used], bits[used], length[used], keys


def common_shingles(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more texts of a sample, and in how many; ``texts`` has (t1, text)."""
    part = max(1, -(-total // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("t1"), F.lit(part)) == 0).dropDuplicates(["t1"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text in texts_of(batch):
                yield {"shingle": shingles(text).view(np.int64)}

    counts = arrow_map(sample.select("text"), run, "shingle bigint").groupBy("shingle")
    counts = counts.agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    common = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    return common[order], rows["n"].to_numpy()[order]


def _sets(texts: DataFrame, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """(id, t1, t2, k1, k2, fp, parts) of every row of (id, t1, t2, text); k1 and k2 name the set of shingles."""
    shared = texts.sparkSession.sparkContext.broadcast((common, count))
    digest = xxhash.xxh64_intdigest

    def nested(rows: list[list[tuple]]) -> pa.Array:
        pieces = [x for row in rows for x in row]
        size, bits, length, keys = (
            np.concatenate([x[k] for x in pieces]) if pieces else np.zeros((0, BITS // 8) if k == 1 else 0, np.uint8)
            for k in range(4)
        )
        edges = np.append(0, np.cumsum(length)).astype(np.int32)
        held = pa.Array.from_buffers(
            pa.binary(),
            len(size),
            [None, pa.py_buffer((np.arange(len(size) + 1) * (BITS // 8)).astype(np.int32)), pa.py_buffer(bits.tobytes())],
        )
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.astype(np.uint64).view(np.int64)))
        structs = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), held, lists], ["size", "bits", "keys"])
        counts = [sum(len(x[0]) for x in row) for row in rows]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), structs)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                fp, k1, k2, parts = [], [], [], []
                for text in texts_of(part):
                    s = shingles(text)
                    whole = s.tobytes()
                    fp.append(simhash.fingerprint(text, SIZE))
                    k1.append(digest(whole, 1) - (1 << 63))
                    k2.append(digest(whole, 2) - (1 << 63))
                    level = ranked(s, *shared.value)
                    parts.append([parts_of(s, level, k) for k in bands(len(s))])
                kept = {c: part.column(c) for c in ("id", "t1", "t2")}
                yield {**kept, "k1": k1, "k2": k2, "fp": np.array(fp, np.uint64).view(np.int64), "parts": nested(parts)}

    return arrow_map(
        texts,
        run,
        "id bigint, t1 bigint, t2 int, k1 bigint, k2 bigint, fp bigint, "
        "parts array<struct<size: int, bits: binary, keys: array<bigint>>>",
    )


def _held(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of ``wanted`` (node, t1, t2); the filter keeps most other texts from being shuffled."""
    word = F.shiftrightunsigned("t1", 64 - FILTER)
    bit = F.expr("shiftleft(1L, cast(t1 & 63 as int))")
    rows = wanted.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(1 << FILTER, np.uint64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            t1 = batch.column("t1").to_numpy().view(np.uint64)
            held = shared.value[t1 >> np.uint64(64 - FILTER)] >> (t1 & np.uint64(63))
            part = batch.filter(pa.array((held & np.uint64(1)).astype(bool)))
            if part.num_rows:
                yield {c: part.column(c) for c in ("t1", "t2", "text")}

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield {"node": part.column("node"), "shingles": [shingles(x).tobytes() for x in texts_of(part)]}

    found = arrow_map(texts.select("t1", "t2", "text"), run, "t1 bigint, t2 int, text string")
    found = found.dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("node", "text")
    return arrow_map(found, cut, "node bigint, shingles binary")


def _compared(pairs: DataFrame, texts: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Those of the stored pairs (a, b) of classes that are alike, stored."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.join(nodes, "node").select("node", "s.t1", "s.t2")
    held = stored(_held(texts, wanted), "copies-sets")
    left = held.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = held.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sides = zip(texts_of(batch, "left"), texts_of(batch, "right"))
            good = (alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sides)
            part = batch.filter(pa.array(np.fromiter(good, bool, batch.num_rows)))
            if part.num_rows:
                yield {"a": part.column("a"), "b": part.column("b")}

    return stored(arrow_map(both.select("a", "b", "left", "right"), run, "a bigint, b bigint"), name)


def _fingerprinted(classes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of a class and the first one that links of SimHash fingerprints reach from it."""
    found = classes.select("fp", F.col("node").alias("doc_id"))
    near = simhash.classes_of(found, limit).select("fp", F.col("component_id").alias("b"))
    return classes.select("fp", F.col("node").alias("a")).join(near, "fp").where("a <> b").select("a", "b")


def _rooted(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of groups with the roots of their nodes; groups of one connected part have nothing left to compare."""
    rooted = groups.join(roots, "node", "left").select(*groups.columns, F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rooted.join(open_.where("low <> high").select("key"), "key")


def _centred(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class and the centre that it shares most keys with, if some part of both may be alike."""
    # An original shares all of its keys, a copy has changed ones of its own.
    weight = groups.groupBy("node").agg(F.sum("c").alias("weight"))
    top = F.max(F.struct("weight", "node", "part", "size", "at", "root")).alias("top")
    centres = groups.join(weight, "node").groupBy("key").agg(top)
    most = F.least("at", "top.at") + F.least(F.col("size") - F.col("at"), F.col("top.size") - F.col("top.at"))
    sizes = (F.col("size") + F.col("top.size")).alias("sizes")
    votes = (
        groups.join(centres, "key")
        .where((F.col("root") != F.col("top.root")) & ((SHARE + OF) * most >= SHARE * (F.col("size") + F.col("top.size"))))
        .select(F.col("node").alias("a"), F.col("part").alias("i"), F.col("top.node").alias("b"), F.col("top.part").alias("j"), sizes)
        .groupBy("a", "i", "b", "j", "sizes")
        .agg(F.count("*").alias("votes"))
    )
    star = votes.groupBy("a").agg(F.max(F.struct("votes", "b", "i", "j", "sizes")).alias("v")).select("a", "v.*")
    left = maps.select(F.col("node").alias("a"), F.col("part").alias("i"), F.col("bits").alias("left"))
    right = maps.select(F.col("node").alias("b"), F.col("part").alias("j"), F.col("bits").alias("right"))
    both = star.join(left, ["a", "i"]).join(right, ["b", "j"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(texts_of(batch, n)), np.uint64).reshape(-1, BITS // 64) for n in ("left", "right"))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            good = (SHARE + OF) * apart <= (OF - SHARE) * batch.column("sizes").to_numpy().astype(np.int64)
            part = batch.filter(pa.array(good))
            if part.num_rows:
                yield {"a": part.column("a"), "b": part.column("b")}

    return arrow_map(both.select("a", "b", "sizes", "left", "right"), run, "a bigint, b bigint")


def _pairs(groups: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) with a common key that may be alike and have different roots."""
    dealt = block_pairs(groups, "key", ["node"], limit, "copies-hot")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in whole_groups(batches, ("key", "block")):
            node, key, block, left, right, root, size, at = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("node", "key", "block", "left", "right", "root", "size", "at")
            )
            bits = np.frombuffer(b"".join(texts_of(batch, "bits")), np.uint64).reshape(-1, BITS // 64)
            found = []
            for i, j in pairs_in(*runs((key, block)), 1 << 18):
                good = ((left[i] & right[j]) | (left[j] & right[i])) & (root[i] != root[j])
                i, j = i[good], j[good]
                good = may_be_alike(size[i], size[j], at[i], at[j])
                i, j = i[good], j[good]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                good = (SHARE + OF) * apart <= (OF - SHARE) * (size[i].astype(np.int64) + size[j])
                i, j = i[good], j[good]
                if len(i):
                    pair = np.stack((np.maximum(node[i], node[j]), np.minimum(node[i], node[j])), 1)
                    found.append(np.unique(pair, axis=0))
            if found:
                a, b = np.unique(np.concatenate(found), axis=0).T
                yield {"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b)}

    return arrow_map(dealt, run, "a bigint, b bigint").distinct()


def links(texts: DataFrame, classes: DataFrame, limit: int = 4096) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs that are alike.

    ``texts`` has (t1, t2, text), ``classes`` is stored and has (node, s, fp, parts).
    """
    first = _compared(stored(_fingerprinted(classes, limit), "copies-printed"), texts, classes, "copies-first")
    roots = components(first, "copies-printed")
    part = classes.select("node", F.posexplode("parts").alias("part", "held"))
    maps = part.select("node", "part", "held.bits")
    keyed = part.select("node", "part", "held.size", F.posexplode("held.keys").alias("at", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    groups = stored(keyed.join(shared, "key"), "copies-groups")
    star = stored(_centred(_rooted(groups, roots), maps), "copies-star")
    second = _compared(star, texts, classes, "copies-second")
    # Roots are links that connect the same classes, at most one for each of them.
    roots = components(roots.toDF("a", "b").union(second), "copies-links")
    rooted = _rooted(groups, roots).join(maps, ["node", "part"])
    tried = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = _pairs(stored(rooted, "copies-rooted"), limit).join(tried, ["a", "b"], "left_anti")
    return roots.toDF("a", "b").union(_compared(stored(rest, "copies-rest"), texts, classes, "copies-third"))


def representatives(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """One document of each connected group of near copies, with all its columns: the smallest doc_id.

    A group without any doc_id keeps one of its rows, and so do rows that share the smallest one
    (the row whose text has the smallest hash).  ``limit`` is the number of texts with one shingle that
    one task compares; larger groups are split into blocks.
    """
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("t1"),
        F.hash("text").alias("t2"),
        F.struct(*docs.columns).alias("row"),
    )
    texts = keyed.select("id", "t1", "t2", F.col("row.text").alias("text"))
    sets = _sets(texts, *common_shingles(texts, docs.count()))
    classes = sets.groupBy("k1", "k2").agg(
        F.min(F.struct("id", "t1", "t2")).alias("s"), F.first("parts").alias("parts"), F.min("fp").alias("fp")
    )
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "s", "fp", "parts")
    classes = stored(classes, "copies-classes")
    roots = components(links(texts, classes, limit), "copies-components")
    chosen = (
        classes.select("node", "s")
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("s").alias("s"))
        .select("s.id", "s.t1", "s.t2")
    )
    # Rows that agree in all three are repeated rows: one of them stays.
    kept = keyed.join(chosen, ["id", "t1", "t2"]).dropDuplicates(["id", "t1", "t2"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
