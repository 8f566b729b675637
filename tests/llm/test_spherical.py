import math

import numpy as np
import pytest

from webloom.llm import spherical as S

SCHEMA = "vec_id bigint, embedding array<float>, label int, filter string, node string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def expected(rows):
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = {}
    for k, (_, v) in enumerate(rows):
        if good(v):
            x = np.array(v, np.float32).astype(float)
            units[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for a in units:
        for b in units:
            if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= S.COSINE:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(links[k]), component, i == component))
    return sorted(out, key=str)


def clustered(n, dimension, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dimension))
    out = []
    for k in range(n):
        noise = rng.standard_normal(dimension) * rng.choice([0, 0.05, 0.2, 0.3])
        out.append((int(k), (centres[rng.integers(len(centres))] + noise).astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("limit", [2048, 5])
def test_clusters(spark, limit):
    rows = clustered(400, 64, 1)
    got = sorted((tuple(r) for r in S.near_duplicates(table(spark, rows), limit).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(spark):
    v = [0.5, -1.0, 2.0, 0.25]
    rows = [
        (1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [math.nan, 1.0, 0.0, 0.0]),
        (6, [math.inf, 1.0, 0.0, 0.0]), (7, v), (7, v), (8, [2 * x for x in v]), (None, v), (9, [-x for x in v]),
        (10, v + [0.0]), (11, [3.0]), (12, [4.0]), (13, [-1.0]), (None, [0.0, 0.0, 0.0, 5.0]), (14, [1e-30] * 4),
        (15, [1e38] * 4),
    ] + [(100 + k, v) for k in range(20)]
    got = sorted((tuple(r) for r in S.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == expected(rows)


def test_decoding_finds_all_filters():
    rng = np.random.default_rng(3)
    x = S.unit(rng.standard_normal((50, 32)))
    turn, low, high = S.code(32, 20)
    turned = x @ turn
    scores = (turned[:, :16] @ low.T)[:, :, None] + (turned[:, 16:] @ high.T)[:, None, :]
    scores = scores.reshape(50, -1)
    rows, found = S.decoded(x, 20, 30)
    for k in range(50):
        mine = found[rows == k]
        limit = scores[k][mine].min()
        assert set(mine) == set(np.flatnonzero(scores[k] >= limit - 1e-12)) and len(mine) >= S.LEAST


def test_recall_at_the_border(spark):
    """Pairs that barely link are found."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9505 * a + math.sqrt(1 - 0.9505**2) * b
        rows += [(2 * k, a.tolist()), (2 * k + 1, c.tolist())]
    found = S.near_duplicates(table(spark, rows)).where("n_links > 0").count()
    assert found >= 0.97 * len(rows)


def test_empty(spark):
    assert S.near_duplicates(table(spark, [])).count() == 0
