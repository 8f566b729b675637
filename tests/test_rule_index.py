import random
import re

import pytest

from webloom.operators import rule_index as R


@pytest.mark.parametrize(
    "pattern,literal",
    [("abc", "abc"), ("a.bcd", "bcd"), ("x|yy", ""), ("(?i)abc", ""), ("ab+cd", "cd"), ("^/p[.]html$", "/p.html"),
     ("a(bc)d", "abcd"), ("(?:ab|c)de", "de"), ("ab?c", "a"), ("f=[0-9]+&", "f="), ("(?=xyz)a", "a"), ("", "")],
)
def test_required_literals(pattern, literal):
    assert R.required_literal(pattern) == literal


def test_literals_are_in_every_match():
    rng = random.Random(3)
    parts = ["a", "b", "ab", "[ab]", "a+", "(?:ab)?", "(ba)", "(a|b)", ".", "b{2}", "^", "$", "(?i:a)", r"\w"]
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(parts, k=rng.randint(1, 5)))
        text = "".join(rng.choices("abAB", k=8))
        match = re.search(pattern, text)
        if match:
            tried += 1
            assert R.required_literal(pattern) in match[0]
    assert tried > 500


def table(spark, urls, rules):
    return (
        spark.createDataFrame(urls, "target_domain string, url string"),
        spark.createDataFrame(rules, "target_domain string, rule int, kind string, text string"),
    )


def plainly(urls, rules):
    out = set()
    for site, url in urls:
        best = None
        for own, number, kind, text in rules:
            if own == site and url is not None and (best is None or number < best):
                host = re.sub(r"^https?://|[/?#].*$", "", url)
                if re.search(text, url) if kind == "pattern" else bool(host) and text in host:
                    best = number
        out.add((site, url, best))
    return out


def test_against_all_rules(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 40)
    rng = random.Random(1)
    hosts = ["a.org", "analytics.a.org", "cdn.b.net"]
    urls = [(rng.choice(["s", "s", "s", "t", "u"]), f"https://{rng.choice(hosts)}/{rng.randint(0, 60)}.html?f={rng.randint(0, 9)}") for _ in range(500)]
    urls += [(None, "https://a.org/1.html"), ("s", None), ("s", "")]
    rules = [("s", n, "pattern", p) for n, p in enumerate([r"/1\d\.html", "f=3$", "(?i)HTML.f=7", r"\?f=[45]", "|".join(["/7[.]", "/8[.]"])], 10)]
    rules += [("s", 2, "host", "analytics."), ("t", 5, "host", "b.net"), ("t", 6, "pattern", ".*"), ("gone", 1, "host", ""), ("s", 30, "host", "")]
    left, right = table(spark, urls, rules)
    assert set(map(tuple, R.first_rule(left, right).collect())) == plainly(urls, rules)
    kept = {(s, u) for s, u, n in plainly(urls, rules) if n is None}
    assert sorted(map(tuple, R.allowed(left, right).collect()), key=str) == sorted((x for x in urls if x in kept), key=str)


def test_plan_does_not_grow_with_the_rules(spark):
    def size(n):
        left, right = table(spark, [("s", f"https://a.org/{k}") for k in range(50)], [("s", k, "pattern", f"/{k}$") for k in range(n)])
        found = R.first_rule(left, right)
        assert found.where("rule is not null").count() == min(n, 50)
        return len(found._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(10_000) - size(10)) < 200


def test_no_rules(spark):
    left, right = table(spark, [("s", "https://a.org/1")], [])
    assert [tuple(r) for r in R.first_rule(left, right).collect()] == [("s", "https://a.org/1", None)]


def test_no_task_holds_all_rules_of_a_site(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 30)
    monkeypatch.setattr(R, "SLICE", 50)
    urls = [("s", f"https://h{k}.org/{k}/{k % 7}") for k in range(100)] + [("s", None), ("t", "https://a.org/1"), (None, "https://a.org/1")]
    rules = [("s", k, "host", f"h{k % 60}.o") if k % 2 else ("s", k, "pattern", f"/{k % 90}/[0-6]$") for k in range(600, 0, -1)]
    rules += [("t", 4, "pattern", "1$"), ("gone", 1, "host", "")]
    left, right = table(spark, urls, rules)
    named, given = R.dealt(left, right)
    key = ["target_domain", "part", "slice"]
    assert given.where("target_domain = 's'").count() == 600 * 4 and named.where("target_domain = 's'").count() == 101 * 12
    assert given.groupBy(*key).count().agg({"count": "max"}).first()[0] < 100
    assert sorted(map(tuple, R.first_rule(left, right).collect()), key=str) == sorted(plainly(urls, rules), key=str)


@pytest.mark.parametrize(
    "pattern,found,enough",
    [("/(p12|q9)/a/", ["/p12/a/", "/q9/a/"], True), ("x|yy", ["x", "yy"], True), ("(abc|)def", ["def"], True), ("(?i)ab", [""], False),
     ("a[bc]d$", ["abd", "acd"], False), ("(?:abc)+", ["abc"], False), ("(ab|c+d)e", ["e"], False), ("1{2}34", ["34"], False),
     ("(12|13)4", ["124", "134"], True), ("/p12[?]f=[0-9]+", ["/p12?f="], False), ("(a|bc+)", ["a", "b"], False), ("ab[0-z]c1", ["ab"], False)],
)
def test_needles(pattern, found, enough):
    assert sorted(R.needles(pattern)[0]) == sorted(found) and R.needles(pattern)[1] == enough


def test_a_needle_is_in_every_match():
    rng = random.Random(5)
    parts = ["a", "b", "ab", "[ab]", "a+", "(?:ab)?", "(a|bb|)", "(?:b{2}|1)", ".", "^", "$", "(?i:a)", r"\w", "1", "12", "[12]", "[0-9]", "(1|22)+", "|", "(?=a)", "[^a]", "{", "1{1,2}"]
    held = alone = 0
    for _ in range(30_000):
        pattern, text = "".join(rng.choices(parts, k=rng.randint(1, 6))), "".join(rng.choices("abAB12", k=9))
        try:
            match = re.search(pattern, text)
        except re.error:
            continue
        found, enough = R.needles(pattern)
        held += bool(match)
        alone += enough
        assert not match or any(t in text for t in found)
        assert not enough or bool(match) == any(t in text for t in found)
    assert held > 5000 and alone > 1000


def test_needles_of_a_site_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 20)
    monkeypatch.setattr(R, "SLICE", 7)
    monkeypatch.setattr(R, "LONGEST", 9)
    rng = random.Random(2)

    def text(most):
        return "".join(rng.choices("ab1\u00e9\U0001f600", weights=[6, 6, 2, 1, 1], k=rng.randint(1, most)))

    hosts = ["a.org", "abab.a.org", "cdn.b.net"]
    urls = list({(rng.choice("sstu"), f"https://{rng.choice(hosts)}/{text(14)}") for _ in range(300)}) + [("s", None), ("s", ""), (None, "https://a.org/ab")]
    rules = [(rng.choice("stw"), rng.randint(0, 400), "pattern", rng.choice(["{}", "{}$", "({}|zz)b?", "/{}.", "({}|{})1"]).replace("{}", text(12))) for _ in range(300)]
    rules += [(rng.choice("st"), rng.randint(300, 400), "host", rng.choice(["x", "ab", "", "b.n"]) + text(2)) for _ in range(100)]
    # Many rules with one needle, needles that begin others, a rule without a needle, and one that is no expression at a site without URLs.
    rules += [("t", 500 + n, "pattern", f"abab[0-9]{{{n}}}$") for n in range(40)] + [("s", 900 - n, "pattern", "a" * n) for n in range(1, 15)]
    rules += [("u", 3, "pattern", "[0-9]a|[0-9]+b"), ("u", 2, "host", "abab.a.org.and.longer"), ("u", 9, "host", "abab.a.org"), ("gone", 1, "pattern", "(")]
    left, right = table(spark, urls, rules)
    known = [r for r in rules if r[0] != "gone"]
    assert sorted(map(tuple, R.first_rule(left, right).collect()), key=str) == sorted(plainly(urls, known), key=str)


def test_a_url_goes_to_the_slices_of_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 50)
    urls = [("s", f"https://a.org/p{k}.html") for k in range(300)]
    rules = [("s", k, "pattern", f"/p{k}[.]html$") for k in range(2000)] + [("s", k, "host", f"x{k}.org") for k in range(2000)]
    left, right = table(spark, urls, rules)
    cut, router = R.sliced(R.needle_table(right))
    assert cut.select("slice").distinct().count() > 40
    assert cut.groupBy("slice").count().agg({"count": "max"}).first()[0] < 300
    found = R.routed(left.selectExpr("target_domain", "'pattern' kind", "url text"), router)
    assert 300 <= found.count() <= 900


def test_rules_that_share_a_part_are_not_all_tried():
    rules = [(n, f"/(p{n}|q9)/a/[a-z]") for n in range(500)]
    index = R.RuleIndex([(row[2], row[3], row[4]) for n, text in rules for row in R._needle_rows("s", n, "pattern", text)])
    assert [index.first(u) for u in ("https://a.org/p321/a/b.htm", "https://a.org/p321/a/", "https://a.org/x/a/b.htm", "https://a.org/q9/a/b")] == [321, None, None, 0]
    assert len(index.compiled) < 5
