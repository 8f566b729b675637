import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.operators import ranges as R
from webloom.operators import rules


@pytest.mark.parametrize("low,high", [(0, 0), (1, 1_000_000), (7, 123), (0, 999), (-15, 27), (-120, -99), (98, 1002), (-1, 0), (10, 10)])
def test_intervals(low, high):
    match = re.compile("|".join(R.interval(low, high))).fullmatch
    near = {*range(low - 130, low + 130), *range(high - 130, high + 130), *range(-1300, 1300)}
    for n in near:
        assert bool(match(str(n))) == (low <= n <= high), n
    assert not match("007") and not match("-0") and not match("")
    assert len(R.interval(1, 1_000_000)) <= 8


PATTERNS = ["f={1..5}&", "f={1..120..7}", "f={90..12..-1}&p={0..9%3}", "f={1..4%2, 3}$", "f={-12..30}", "{5..1}x", "f={1..2%1,2}",
            "{a..b}", "a{2..3}{2}", "a{2..13}+b", "[{1..3}]z", "a{1..2}b{8..11}", "x{abc}{1..3}", "{1..3..0}", "{1..3..x}&", "{ +1 .. 1_0 }&",
            "a{1..2}|b{3..4}", "plain", "{1..2..3..4}", "f={10..200%015,20, 21 ,x}&", "{3..9}{1..2}", "p{1..3}?q", r"\{1..2}"]


def test_same_verdicts_as_expanded(spark):
    frame = spark.createDataFrame([(p,) for p in PATTERNS], "p string")
    rng = random.Random(2)
    texts = ["".join(rng.choices(["f=", "&", "p=", "a", "b", "x", "z", "-", "{2}", *"0123456789"], k=rng.randint(1, 7))) for _ in range(4000)]
    texts += [f"f={n}&p={n % 11}" for n in range(-20, 220)]
    rows = frame.select("p", rules.expanded(F.col("p")).alias("all")).collect()
    assert len(rows) == len(PATTERNS)
    hits = 0
    for row in rows:
        if row.p.startswith("\\"):
            assert R.compact(row.p) == r"(?:\1)|(?:\2)" and row.all == [r"\1", r"\2"]
            continue
        plain, short = re.compile("|".join(f"(?:{p})" for p in row.all)), re.compile(R.compact(row.p))
        for t in texts:
            assert bool(plain.search(t)) == bool(short.search(t)), (row.p, R.compact(row.p), t)
            hits += bool(short.search(t))
    assert hits > 4000


def test_size_is_a_sum(spark):
    long = R.compact("f={1..1000000%5,77}&p={0..999}&q={100..999999999}&")
    assert len(long) < 800
    rows = spark.createDataFrame([("s", "{1..12}"), (None, None)], "target_domain string, text string")
    assert [r.text for r in R.compacted(rows).collect()] == ["(?:[1-9]|1[0-2])", None]
