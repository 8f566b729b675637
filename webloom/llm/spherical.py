"""Near-duplicate vectors by spherical-cap filters.

Filters are the directions of a structured random product code: a vector is turned, cut into two
halves, and each half has its own code of unit vectors; a filter is one code word of either half, and a
vector passes it if the two inner products add up to at least ``alpha``.  List decoding finds all
filters that a vector passes without looking at the rest: only code words that can still reach alpha
with the best word of the other half are combined.  Vectors that pass a common filter are compared by
their cosine in double precision.

Equal vectors are one class before anything is joined.  A pair is counted under the smallest filter
that both pass, so no list of pairs is made: a filter yields its vectors' numbers of links and one
link to a representative per connected part.  A filter that very many vectors pass is worked on in
blocks; no candidate is dropped.  A vector that passes fewer than LEAST filters goes to its LEAST best
ones, so that vectors between the code words are found as well as others.

Nulls: a vector that is null, empty, zero, or holds a null or a number that is not finite links with
nothing.  Vectors of different length do not link.  A null vec_id keeps its row and counts as no
id: the component takes the smallest other id.  Repeated rows are links of each other.  Other input
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, block_pairs, components, joined_labels, runs, stored, whole_groups

COSINE = 0.95
#: Filters that a vector passes on average and at least, and vectors that pass a filter on average.
PASSED = 24
LEAST = 12
LOAD = 48
#: Vectors under one filter that are compared in one piece.
LIMIT = 2048
SEED = 7


@lru_cache(8)
def code(dimension: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the code words of both halves."""
    rng = np.random.default_rng((SEED, dimension, words))
    turn, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    half = dimension // 2
    books = []
    for size in (max(half, 1), max(dimension - half, 1)):
        book = rng.standard_normal((words, size))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return turn, books[0], books[1]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def decoded(vectors: np.ndarray, words: int, passed: float = PASSED) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that unit vectors pass, in order."""
    n, dimension = vectors.shape
    turn, low, high = code(dimension, words)
    alpha = NormalDist().inv_cdf(1 - passed / words**2) * np.sqrt(2 / dimension)
    turned = vectors @ turn
    half = low.shape[1]
    right = turned[:, half:] if dimension > 1 else turned
    a, b = turned[:, :half] @ low.T, right @ high.T
    best_a, best_b = a.max(1), b.max(1)
    # The best sums are among those of the best words of either half.
    few = min(LEAST, words)
    top_a, top_b = (-np.partition(-x, few - 1, axis=1)[:, :few] for x in (a, b))
    sums = (top_a[:, :, None] + top_b[:, None, :]).reshape(n, -1)
    limit = np.minimum(alpha, -np.partition(-sums, few - 1, axis=1)[:, few - 1] - 1e-12)
    row_a, word_a = np.nonzero(a >= (limit - best_b)[:, None])
    row_b, word_b = np.nonzero(b >= (limit - best_a)[:, None])
    count = np.bincount(row_b, minlength=n)
    start = np.cumsum(count) - count
    times = count[row_a]
    row = np.repeat(row_a, times)
    at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + start[row]
    first, second = np.repeat(word_a, times), word_b[at]
    good = a[row, first] + b[row, second] >= limit[row]
    row, found = row[good], (first[good] * words + second[good]).astype(np.int64)
    order = np.lexsort((found, row))
    return row[order], found[order]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def filtered(classes: DataFrame, words: int) -> DataFrame:
    """(filter, node, n, embedding, passed): one row for each filter that a class passes."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                column = batch.column("embedding")
                sizes = np.array(pc.list_value_length(column))
                for d in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == d)
                    part = column.take(pa.array(rows))
                    row, found = decoded(unit(matrix(part)), words)
                    found += d << 44
                    count = np.bincount(row, minlength=len(rows))
                    edges = np.append(0, np.cumsum(count)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(found))
                    yield {
                        "filter": found,
                        "node": batch.column("node").to_numpy()[rows][row],
                        "n": batch.column("n").to_numpy()[rows][row],
                        "embedding": part.take(pa.array(row)),
                        "passed": lists.take(pa.array(row)),
                    }

    return arrow_map(
        classes,
        run,
        f"filter bigint, node bigint, n bigint, embedding {kind}, passed array<bigint>",
    )


def _shared_before(lists: pa.ListArray, limit: int) -> np.ndarray:
    """For all pairs of rows whether both have a common filter below ``limit``."""
    sizes = np.array(pc.list_value_length(lists))
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), sizes)
    row, values = row[values < limit], values[values < limit]
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    out = np.zeros((len(lists), len(lists)), bool)
    for a in range(0, int(often.sum()), 2048):
        inside = (column >= a) & (column < a + 2048)
        m = np.zeros((len(lists), 2048), np.float32)
        m[row[inside], column[inside] - a] = 1
        out |= m @ m.T > 0
    return out


def compared(batches: Iterator[pa.RecordBatch]):
    """(a, b, n): for a vector its links under one filter, and its representative there."""
    for batch in whole_groups(batches, ("filter", "block"), 20_000):
        names = ("filter", "block", "left", "right", "node", "n")
        key, block, left, right, node, n = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in names
        )
        out = []
        for s, e in zip(*runs((key, block))):
            if e - s < 2:
                continue
            vectors = unit(matrix(batch.column("embedding").slice(s, e - s)))
            l, r = left[s:e], right[s:e]
            near = np.zeros((e - s, e - s), bool)
            for a in range(0, e - s, 1024):
                near[a : a + 1024] = vectors[a : a + 1024] @ vectors.T >= COSINE
            near |= near.T
            np.fill_diagonal(near, False)
            if not (l & r).all():
                near &= (l[:, None] & r[None, :]) | (r[:, None] & l[None, :])
            hit = np.flatnonzero(near.any(1))
            if not len(hit):
                continue
            near = near[np.ix_(hit, hit)]
            labels = joined_labels(np.arange(len(hit)), *np.nonzero(near))
            lists = batch.column("passed").slice(s, e - s).take(pa.array(hit))
            near &= ~_shared_before(lists, int(key[s]))
            own = node[s:e][hit]
            out.append((own, own[labels], near @ n[s:e][hit]))
        if out:
            a, b, c = (np.concatenate(x) for x in zip(*out))
            yield {"a": a, "b": b, "n": c}


def near_duplicates(vectors: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    good = (
        F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "embedding").withColumns(
        {
            "good": F.coalesce(good, F.lit(False)),
            "k1": F.xxhash64("embedding"),
            "k2": F.hash("embedding"),
        }
    )
    classes = (
        rows.where("good")
        .groupBy("k1", "k2")
        .agg(
            F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = stored(classes, "vector-classes")
    words = max(2, int(np.sqrt(classes.count() * PASSED / LOAD)))
    # A code must have more filters than a vector is to pass.
    words = max(words, int(np.sqrt(4 * PASSED)) + 1)
    candidates = stored(filtered(classes.select("node", "n", "embedding"), words), "filters")
    dealt = block_pairs(candidates, "filter", ["node"], limit, "filters-hot")
    dealt = dealt.repartition("filter", "block").sortWithinPartitions("filter", "block")
    found = stored(arrow_map(dealt, compared, "a bigint, b bigint, n bigint"), "vector-links")
    grouped = components(found.select("a", "b"), "vector-components")
    links = found.groupBy("a").agg(F.sum("n").alias("links"))
    rooted = (
        classes.join(grouped, classes["node"] == grouped["node"], "left")
        .join(links, classes["node"] == links["a"], "left")
        .select(
            "k1",
            "k2",
            "first",
            F.coalesce("root", classes["node"]).alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = rooted.join(least, "root").select("k1", "k2", "n_links", "component_id")
    class_of = class_of.withColumn("good", F.lit(True))
    out = rows.select("vec_id", "good", "k1", "k2").join(class_of, ["k1", "k2", "good"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
