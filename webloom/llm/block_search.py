"""Nearest vectors by largest inner product: int8 product tiles, exact scores for what survives them.

Queries and candidates are dealt into blocks, and every query block meets every candidate stripe in one
tile, so no task and no broadcast holds either side whole.  In a tile both sides are rounded to int8 with
one scale per vector.  The product of the rounded vectors differs from the inner product by at most

    |x^| * |e_y| + |e_x| * |y|        (x^ rounded, e what rounding lost; Cauchy-Schwarz)

A pair whose product plus that bound stays below the k-th best score its query has so far cannot be among
the k nearest.  All other pairs are computed again in double precision, added up in the order of the
components, so equal vectors have equal scores wherever they stand.  Each query keeps a heap of k; heaps
of the stripes are merged by one more pass over (query, heap) rows.  The result is exact.

Work is one tile product per pair, the rest is small; rows moved are (candidates x query blocks) and
(queries x stripes).  A stripe is read in slices, so its size is no matter of memory.

Ties go to the smaller vec_id.  Nulls: a vector that is null, empty, zero, or holds a null or a number that is not
finite takes no part.  Vectors of another length are no candidates.  A null vec_id is no query, and as a
candidate it stands behind the others of its score.  Repeated rows are queries and candidates each for
itself.  Other input columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import NO_ID, arrow_map, runs, stored

#: Queries of a block, candidates of a stripe for each query block, candidates multiplied at once.
QUERIES = 8192
STRIPE = 8192
SLICE = 512
#: Components whose int8 products add up exactly in single precision.
EXACT = 1024
SCHEMA = "place bigint, query_id bigint, ids array<bigint>, scores array<double>"


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rounded:
    """Vectors as int8 rows with a scale, and the norms that bound what rounding lost."""

    def __init__(self, vectors: np.ndarray):
        top = np.abs(vectors).max(1)
        self.scale = np.maximum(top / 127, np.finfo(np.float64).tiny)
        steps = vectors / self.scale[:, None]
        cells = np.rint(steps)
        # In steps no square is too small or too large; a part in 2^20 covers the rounding of all sums below.
        up = self.scale * (1 + 2**-20)
        self.norm, self.lost, self.whole = (np.linalg.norm(x, axis=1) * up for x in (cells, steps - cells, steps))
        self.cells = cells.astype(np.int8)

    def products(self, other: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """For all pairs: product of the rounded vectors, and how far the inner product may be from it."""
        width = self.cells.shape[1]
        parts = (
            self.cells[:, a : a + EXACT].astype(np.float32) @ other.cells[:, a : a + EXACT].astype(np.float32).T
            for a in range(0, width, EXACT)
        )
        # Of more than one part, the sum is taken in double precision.
        tile = reduce(lambda x, y: x.astype(np.float64) + y, parts).astype(np.float64)
        tile *= self.scale[:, None]
        tile *= other.scale[None, :]
        bound = np.outer(self.norm, other.lost)
        bound += np.outer(self.lost, other.whole)
        bound += np.outer(self.whole * 2**-40, other.whole)
        return tile, bound


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(queries))
    for c in range(queries.shape[1]):
        total += queries[:, c] * candidates[:, c]
    return total


class Tile:
    """A block of queries with their heaps; candidates arrive in slices."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.place, self.ids, self.vectors, self.k = place, ids, vectors, k
        self.rounded = Rounded(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, place: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        rounded = Rounded(vectors)
        tile, bound = self.rounded.products(rounded)
        least = self.least
        if len(ids) > self.k + 1 and np.isneginf(least).any():
            # Until a heap is full, k + 1 lower bounds of this slice say what is too small (one may be the query's own row).
            lower = np.partition(tile - bound, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
            least = np.fmax(least, lower)
        tile += bound
        i, j = np.nonzero(~(tile < least[:, None]))
        other = self.place[i] != place[j]
        i, j = i[other], j[other]
        for a in range(0, len(i), 1 << 18):
            rows, columns = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            scores = exact(self.vectors[rows], vectors[columns])
            entries = zip(rows.tolist(), scores.tolist(), (-ids[columns]).tolist())
            for row, score, name in entries:
                heap = self.heaps[row]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, name))
                elif (score, name) > heap[0]:
                    heapq.heapreplace(heap, (score, name))
        for row in np.unique(i).tolist():
            if len(self.heaps[row]) == self.k:
                self.least[row] = self.heaps[row][0][0]

    def rows(self) -> dict:
        """The heaps, best first."""
        best = [sorted(h, reverse=True) for h in self.heaps]
        return {
            "place": self.place,
            "query_id": self.ids,
            "ids": [[-name for _, name in b] for b in best],
            "scores": [[score for score, _ in b] for b in best],
        }


def tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[dict]:
    """Rows sorted by tile, the queries of a tile before its candidates, to heaps of its queries."""
    key, tile, held = None, None, []

    def opened() -> Tile:
        return Tile(*(np.concatenate(x) for x in zip(*held)), k)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("width", "block", "stripe", "side")]
        for s, e in zip(*runs(columns)):
            here = tuple(int(c[s]) for c in columns[:3])
            if here != key:
                if tile:
                    yield tile.rows()
                key, tile, held = here, None, []
            for a in range(s, e, SLICE):
                part = batch.slice(a, min(SLICE, e - a))
                vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                rows = (
                    part.column("place").to_numpy(),
                    part.column("id").to_numpy(),
                    vectors.astype(np.float64).reshape(part.num_rows, -1),
                )
                if columns[3][s] == 0:
                    held.append(rows)
                elif held:
                    tile = tile or opened()
                    tile.add(*rows)
    if tile:
        yield tile.rows()


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[dict]:
    """Rows sorted by query, one heap each, to the k best of every query with their ranks."""
    key, query, heap = None, None, []
    names = ("query_id", "rank", "id", "score")
    out: list[tuple] = []

    def close() -> None:
        for rank, (score, name) in enumerate(sorted(heap, reverse=True), 1):
            out.append((query, rank, -name, score))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("place", "query_id", "ids", "scores"))
        for place, own, ids, scores in zip(*columns):
            if place != key:
                close()
                key, query, heap = place, own, []
            entries = [*heap, *((s, -i) for i, s in zip(ids, scores))]
            heap = heapq.nlargest(k, entries)
        if out:
            yield dict(zip(names, map(list, zip(*out))))
            out = []
    close()
    if out:
        yield dict(zip(names, map(list, zip(*out))))


def nearest(vectors: DataFrame, is_query: Column, k: int, block: int = QUERIES, stripe: int = STRIPE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product of each query."""
    rows = stored(
        vectors.select("vec_id", "embedding")
        .where(usable())
        .select(
            F.monotonically_increasing_id().alias("place"),
            F.coalesce("vec_id", F.lit(NO_ID)).alias("id"),
            "embedding",
            F.size("embedding").alias("width"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ),
        "search-vectors",
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    blocks = max(1, -(-sizes["asked"] // block))
    # More query blocks give tiles enough, so stripes may then be longer.
    stripes = max(1, -(-sizes["n"] // (stripe * blocks)))
    spot = F.xxhash64("place")
    columns = ("width", "block", "stripe", "side", "place", "id", "embedding")
    asking = (
        rows.where("asks")
        .withColumns({"block": F.pmod(spot, F.lit(blocks)), "side": F.lit(0)})
        .withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<bigint>")))
    )
    given = rows.withColumns({"stripe": F.pmod(spot, F.lit(stripes)), "side": F.lit(1)}).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )
    tile = ("width", "block", "stripe")
    both = asking.select(*columns).unionByName(given.select(*columns))
    # One partition for a tile or a few, so that tiles run side by side.
    dealt = both.repartition(min(blocks * stripes, 100_000), *tile).sortWithinPartitions(*tile, "side")
    heaps = stored(arrow_map(dealt, lambda b: tiles(b, k), SCHEMA), "search-heaps")
    by_query = heaps.repartition("place").sortWithinPartitions("place")
    found = arrow_map(
        by_query, lambda b: merged(b, k), "query_id bigint, rank int, id bigint, score double"
    )
    return found.select(
        "query_id",
        "rank",
        F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"),
        "score",
    )


#: Fixed values of the query: every 20th id asks, for 20 vectors.
EVERY, NEAREST = 20, 20


def searched(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % EVERY == 0, NEAREST)


#: DuckDB SQL of ``searched`` over ``embeddings``.
SQL = f"""
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 FOR x IN embedding IF x <> 0]) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""
