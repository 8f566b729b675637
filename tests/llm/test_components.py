import random

import pytest

from webloom.llm import common


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root if find(x) != x}


def graph():
    rng = random.Random(8)
    path = [(-2000 - k, -2001 - k) for k in range(300)]
    hub = [(7, 10 + k) for k in range(200)]
    loose = [(rng.randrange(1000, 1600), rng.randrange(1000, 1600)) for _ in range(280)]
    edges = path + hub + loose + [(5, 5), (2**62, -(2**62))]
    edges += [(b, a) for a, b in edges[::7]] + edges[::5]
    rng.shuffle(edges)
    return edges


@pytest.fixture
def names(monkeypatch):
    """Names of the tables that are written."""
    found = []

    def stored(df, name, write=common.stored):
        found.append(name)
        return write(df, name)

    monkeypatch.setattr(common, "stored", stored)
    return found


@pytest.mark.parametrize("most", [common.FOREST, 40, 2])
@pytest.mark.parametrize("spread", [False, True])
def test_against_union_find(spark, most, spread):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not spread).lower())
    own.conf.set("spark.sql.shuffle.partitions", "5")
    edges = own.createDataFrame(graph(), "a bigint, b bigint")
    rows = common.components(edges, "test", most).collect()
    assert {r.node: r.root for r in rows} == plain(graph()) and len(rows) == len(plain(graph()))


def test_links_that_one_task_holds_take_no_rounds(spark, names):
    """Each round is a plan of some ten stages, which the driver makes and keeps."""
    edges = spark.createDataFrame(graph(), "a bigint, b bigint")
    assert common.components(edges.coalesce(1), "test").count() == len(plain(graph()))
    assert len(names) == 1


def test_no_links(spark, names):
    assert common.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "test").count() == 0
    assert len(names) == 1
