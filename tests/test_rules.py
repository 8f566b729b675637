from pyspark.sql import functions as F

from webloom.operators import rules


def test_expansion(one):
    cases = {
        "f={1..5}&": ["f=1&", "f=2&", "f=3&", "f=4&", "f=5&"],
        "f={1..5..2}": ["f=1", "f=3", "f=5"],
        "f={5..1..-2}": ["f=5", "f=3", "f=1"],
        "f={1..4%2, 3}": ["f=1", "f=4"],
        "f={5..5}": ["f=5"],
        "f={-2..0}": ["f=-2", "f=-1", "f=0"],
        "f={1..3..0}": ["f=1", "f=2", "f=3"],
        "f={1..3..x}": ["f=1", "f=2", "f=3"],
        "f={5..1}": ["f={5..1}"],
        "f={1..2%1,2}": ["f={1..2%1,2}"],
        "f={a..b}": ["f={a..b}"],
        "f={1..2..3..4}": ["f={1..2..3..4}"],
        "x{abc}y": ["x{abc}y"],
        "plain": ["plain"],
        "a{1..2}b{8..9}": ["a1b8", "a2b8", "a1b9", "a2b9"],
        "a{x}b{1..2}": ["a{x}b1", "a{x}b2"],
    }
    assert one(rules.expanded, list(cases)) == list(cases.values())


def test_hundred_without_three(one):
    (values,) = one(rules.expanded, ["f={1..100%4,25,40}&"])
    assert len(values) == 97 and "f=4&" not in values and values[-1] == "f=100&"


def test_lists(one):
    assert one(rules.listed, ["a; b ;;c", " ; ", "x"]) == [["a", "b", "c"], [], ["x"]]


def test_merge(spark):
    base = spark.createDataFrame(
        [(2, 3, 0.5, ["a"])],
        "parallel_downloads int, max_depth int, wait_between_requests double, reject_patterns array<string>",
    )
    row = rules.merge_overrides(base, parallel=8, depth=0, wait=0, extra_reject=["x;f={1..2}&", "y"]).first()
    assert row.parallel_downloads == 8 and row.max_depth == 3 and row.wait_between_requests == 0
    assert row.reject_patterns == ["a", "x", "f=1&", "f=2&", "y"]
    same = rules.merge_overrides(base, parallel=0, depth=-1, wait=-1, extra_reject=[" ; "]).first()
    assert same == base.first()
    assert base.first().reject_patterns == ["a"]


def test_expand_rows(spark):
    df = spark.createDataFrame([(1, "a;f={1..2}")], "id int, p string")
    rows = rules.expand_patterns(df, "p", ["id"]).collect()
    assert [(r.id, r.pattern_no, r.pattern) for r in rows] == [(1, 0, "a"), (1, 1, "f=1"), (1, 2, "f=2")]
    assert df.select(rules.is_range(F.lit("1..2"))).first()[0]
