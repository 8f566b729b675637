import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import block_search as B

INF, NAN = float("inf"), float("nan")


def table(spark, rows, kind="float"):
    rows = [(i, v, "x", 1, 2.0, "y") for i, v in rows]
    return spark.createDataFrame(
        rows, f"vec_id bigint, embedding array<{kind}>, place string, id int, score double, block string"
    )


def product(v, w):
    total = 0.0
    for x in (v * w).tolist():
        total += x
    return total


def plainly(rows, k, every, kind=np.float32):
    """Every query against every other row, sums in the order of the components."""
    good = [
        (n, i, np.array(v, kind).astype(float))
        for n, (i, v) in enumerate(rows)
        if v and None not in v and np.isfinite(v).all() and any(v)
    ]
    out = []
    for n, i, v in good:
        if i is None or i % every:
            continue
        entries = []
        for m, j, w in good:
            if m != n and len(w) == len(v):
                entries.append((-product(v, w), j is None, j))
        entries.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(entries[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 24)).astype(np.float32)
    vectors = centres[rng.integers(0, 5, 600)] + rng.standard_normal((600, 24)).astype(np.float32) * 0.02
    vectors *= rng.choice([1e-3, 1, 50], (600, 1)).astype(np.float32)
    out = [(k * 5, v.tolist()) for k, v in enumerate(vectors.astype(np.float32))]
    hot = vectors[0].astype(np.float32).tolist()
    out += [(5000 + k, hot) for k in range(300)]
    out += [(20, hot), (20, hot), (None, hot), (None, None), (7000, None), (7020, []), (7040, [0.0] * 24)]
    out += [(7060, [None, 1.0]), (7080, [NAN, 1.0]), (7100, [INF] * 24), (-40, [1.0, 2.0]), (-41, [1.0, 2.0]), (7120, [3.0])]
    out += [(8000, [-0.0, 1e-40] + [0.0] * 22), (8020, [3e38] * 24), (-20, [-3e38] * 24)]
    return out


@pytest.mark.parametrize("block,stripe", [(8192, 8192), (16, 40)])
def test_like_brute_force(spark, rows, block, stripe):
    frame = B.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20, block, stripe)
    assert got(frame) == plainly(rows, 20, 20)


def test_doubles_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    wide = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((60, 2500)))]
    frame = B.nearest(table(spark, wide, "double"), F.col("vec_id") % 3 == 0, 4, 8, 8)
    assert got(frame) == plainly(wide, 4, 3, float)


def test_fewer_candidates_than_asked(spark):
    few = [(0, [1.0, 0.0]), (1, [2.0, 0.0])]
    assert got(B.searched(table(spark, few))) == [(0, 1, 1, 2.0)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((200, 40)) * rng.choice([1e-200, 1e-3, 1, 1e80], (200, 1))
    b = rng.standard_t(1.5, (300, 40))
    tile, bound = B.Rounded(a).products(B.Rounded(b))
    assert (np.abs(a @ b.T - tile) <= bound).all()
    # Most pairs of unit vectors are told apart by the tile alone.
    u = b / np.linalg.norm(b, axis=1, keepdims=True)
    _, bound = B.Rounded(u).products(B.Rounded(u))
    assert np.median(bound) < 0.03


def test_sql(spark, rows):
    ok = [r for r in rows if r[0] not in (None, 20)]
    con = duckdb.connect()
    con.register("embeddings", table(spark, ok).select("vec_id", "embedding").toArrow())
    assert got(B.searched(table(spark, ok))) == sorted(con.sql(B.SQL).fetchall(), key=str)


def test_empty(spark):
    assert B.searched(table(spark, [])).count() == 0
