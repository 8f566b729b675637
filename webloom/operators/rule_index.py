"""Reject rules as a table: thousands of them for each site, none of them in the plan.

A rule has needles, texts of which a match must hold at least one: the text of a host rule, or the longest required
literals of a regular expression.  The needles of all sites are sorted and cut into slices of bounded size.  A URL goes
only to the slices whose needles can begin at one of its places, so work grows with URLs plus rules, not with their
product.  There an Aho-Corasick automaton tells the needles that it holds, and only their expressions are tried.
Hosts are looked up once for all URLs that share them.

Only rules without a needle meet every URL of their site: the URLs are dealt into parts and these rules into slices
of bounded size, and each part meets each slice in a task of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from heapq import merge
from itertools import count

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as kinds
from re import _parser as parser

from webloom.functions import urls as U
from webloom.session import let_workers_import, stored

#: URLs that one task looks up at once, and rules that it holds.
PART, SLICE = 200_000, 100_000
#: Needles that one rule may have, characters of one, and characters of texts that are searched for each needle.
MOST, LONGEST, FEW = 32, 200, 2_000
#: What a rule tests: a regular expression anywhere in the URL, or a text anywhere in its host.
PATTERN, HOST = "pattern", "host"
RULE = ["target_domain", "rule", "kind", "text"]
NEEDLE = "target_domain string, kind string, literal string, rule int, text string"
NEEDLE_ARROW = pa.schema([(c, pa.int32() if c == "rule" else pa.string()) for c in ("target_domain", "kind", "literal", "rule", "text")])


def needles(pattern: str, most: int = MOST) -> tuple[list[str], bool]:
    """Texts of which every match of an expression holds one, and whether holding one is a match.

    The longest that can be told, at most ``most``; [''] if none can be told.
    """
    best = None
    if pattern.isascii() and not _NOT_PLAIN.search(pattern):
        # A digit stands for itself here: expressions that differ in digits are parsed once.
        with suppress(re.error):
            best, exact = _shape(_DIGIT.sub("0", pattern), most)
            digits = dict(enumerate(_DIGIT.findall(pattern), _MARK))
            best = [t.translate(digits) for t in best]
    if best is None:
        best, exact = _parsed(pattern, most)
    if len(best) > 1:
        # A text that holds another one of them is found with it.
        best = [t for t in dict.fromkeys(best) if not any(o != t and o in t for o in best)]
    return best, exact


#: Marks for digits, and what makes a digit or a letter more than a character to match.
_MARK, _DIGIT, _NOT_PLAIN = 0xE000, re.compile("[0-9]"), re.compile(r"[\\{]|\(\?|.{1000}", re.DOTALL)


@lru_cache(10_000)
def _shape(pattern: str, most: int) -> tuple[list[str], bool]:
    """Needles of an expression with a mark in place of each digit."""
    marks = count(_MARK)
    return _parsed(_DIGIT.sub(lambda _: chr(next(marks)), pattern), most)


def _parsed(pattern: str, most: int) -> tuple[list[str], bool]:
    found = parser.parse(pattern)
    return ([""], False) if found.state.flags & re.IGNORECASE else _required(found, most)


def _required(items: Iterable, most: int) -> tuple[list[str], bool]:
    """Texts that every match of a sequence of parts holds one of, and whether it matches these and nothing else."""
    runs: list[list[str]] = []
    run, exact = [""], True

    def end() -> None:
        nonlocal run, exact
        runs.append(run)
        run, exact = [""], False

    def extended(choices: Iterable[str]) -> bool:
        nonlocal run
        longer = list(dict.fromkeys(a + b for a in run for b in choices))
        if len(longer) > most:
            return False
        run = longer
        return True

    def walk(items: Iterable) -> None:
        nonlocal run, exact
        for kind, value in items:
            if kind is kinds.LITERAL:
                run = [a + chr(value) for a in run]
            elif kind is kinds.SUBPATTERN and not value[1]:
                walk(value[3])
            elif kind is kinds.AT:
                exact = False
            elif kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
                if not extended([chr(c) for _, c in value]):
                    end()
            elif kind is kinds.BRANCH:
                ways = [_required(way, most) for way in value[1]]
                texts = list(dict.fromkeys(t for own, _ in ways for t in own))
                if not (all(whole for _, whole in ways) and extended(texts)):
                    end()
                    if len(texts) <= most:
                        runs.append(texts)
            else:
                end()
                if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0]:
                    runs.append(_required(value[2], most)[0])

    walk(items)
    runs.append(run)
    return (run, True) if exact else (max(runs, key=lambda r: (min(map(len, r)), -len(r))), False)


def required_literal(pattern: str) -> str:
    """The longest text that every match of an expression holds; '' if none can be told."""
    return needles(pattern, 1)[0][0]


def needle_table(rules: DataFrame) -> DataFrame:
    """(target_domain, kind, literal, rule, text): a row for each needle of a rule.

    ``text`` is the expression to try, null if the needle is a match.  A rule without a needle has the literal ''.
    """

    def analysed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_host = pc.fill_null(pc.equal(batch["kind"], HOST), False)
            hosts, others = batch.filter(is_host), batch.filter(pc.invert(is_host))
            literal = pc.fill_null(hosts["text"], "")
            text = pa.nulls(len(literal), pa.string())
            if pc.any(pc.greater(pc.utf8_length(literal), LONGEST)).as_py():
                text = pa.array([re.escape(t) if len(t) > LONGEST else None for t in literal.to_pylist()], pa.string())
                literal = pc.utf8_slice_codeunits(literal, 0, LONGEST)
            columns = [hosts["target_domain"], hosts["kind"], literal, hosts["rule"], text]
            yield pa.record_batch(columns, schema=NEEDLE_ARROW)
            rows = [row for given in zip(*(others[c].to_pylist() for c in RULE)) for row in _needle_rows(*given)]
            columns = zip(*rows) if rows else [()] * len(NEEDLE_ARROW)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, NEEDLE_ARROW.types)], schema=NEEDLE_ARROW)

    # Of a URL without a site there are no rules.
    known = rules.select(*RULE).where("target_domain is not null and rule is not null")
    return known.withColumn("rule", F.col("rule").cast("int")).mapInArrow(analysed, NEEDLE)


def _needle_rows(site: str, number: int, kind: str, text: str) -> list[tuple]:
    if kind != PATTERN:
        raise KeyError(kind)
    try:
        literals, enough = needles(text)
    except (re.error, TypeError):
        # An error only if a URL meets it.
        literals, enough = [""], False
    return [(site, kind, t[:LONGEST], number, None if enough and 0 < len(t) <= LONGEST else text) for t in literals]


class Router:
    """Tells the slices of sorted needles in which those lie that a text may hold.

    ``lows``: the first (target_domain, kind, literal) of each slice and its number.  A needle that begins what is left
    of a text at some place is sorted before that rest: it lies in the slice where the rest would be, or it begins the
    first literal of that slice too.  ``above`` has the latter with each of their slices.  ``heads``: the first two
    characters of the needles, for sites that do not lie in one slice.
    """

    def __init__(self, lows: list[tuple[tuple, int]], above: Iterable[tuple], heads: Iterable[tuple]):
        self.lows, self.slices = [low for low, _ in lows], [number for _, number in lows]
        places: dict[tuple, list[int]] = {}
        for *needle, number in above:
            places.setdefault(tuple(needle), []).append(number)
        self.above = [[(n[2], places[n]) for n in beginnings(low) if n in places] for low in self.lows]
        self.heads: dict[tuple, set[str]] = {}
        for site, kind, head in heads:
            self.heads.setdefault((site, kind), set()).add(head)

    def range(self, site: str, kind: str) -> tuple[int, int]:
        """Places of the slices that begin with a needle of this site and kind; the one before may hold some too."""
        return bisect_left(self.lows, (site, kind, "")), bisect_left(self.lows, (site, kind + "\0", ""))

    def route(self, site: str, kind: str, text: str, begin: int, end: int) -> set[int]:
        if begin == end:
            return {self.slices[begin - 1]} if begin else set()
        heads, found = self.heads.get((site, kind), ()), set()
        for at in range(len(text)):
            if text[at : at + 2] in heads or text[at] in heads:
                rest = text[at : at + LONGEST]
                place = bisect_right(self.lows, (site, kind, rest), begin, end) - 1
                if place >= 0:
                    found.add(self.slices[place])
                if place >= begin:
                    for needle, numbers in self.above[place]:
                        if rest.startswith(needle):
                            found.update(numbers)
        return found


def beginnings(low: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    site, kind, literal = low
    return [(site, kind, literal[: n + 1]) for n in range(len(literal))]


def sliced(table: DataFrame) -> tuple[DataFrame, Router]:
    """Sorted needles with the number of their slice, and what finds the slices of a text."""
    spark, needle = table.sparkSession, ["target_domain", "kind", "literal"]
    wide = max(1, -(-table.count() // SLICE))
    cut = stored(
        table.repartitionByRange(wide, *needle, "rule").withColumn("slice", F.spark_partition_id()), "rule-slices"
    )
    firsts = cut.groupBy("slice").agg(F.min(F.struct(*needle)).alias("low")).collect()
    lows = sorted((tuple(r.low), r.slice) for r in firsts)

    def rows(tuples: Iterable[tuple], names: list[str]) -> DataFrame:
        columns = zip(*sorted(set(tuples)))
        return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns)}))

    if not lows:
        return cut, Router([], [], [])
    above = cut.join(rows((b for low, _ in lows for b in beginnings(low)), needle), needle)
    large = cut.join(rows((low[:2] for low, _ in lows), needle[:2]), needle[:2])
    return cut, Router(
        lows,
        above.select(*needle, "slice").distinct().collect(),
        large.select(*needle[:2], F.substring("literal", 1, 2)).distinct().collect(),
    )


def routed(texts: DataFrame, router: Router) -> DataFrame:
    """Rows (target_domain, kind, text) with each slice that may hold a needle of the text."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, rows, slices = {}, [], []
            for row, (site, kind, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if (site, kind) not in ranges:
                    ranges[site, kind] = router.range(site, kind)
                own = router.route(site, kind, text, *ranges[site, kind])
                rows.extend([row] * len(own))
                slices.extend(own)
            yield batch.take(pa.array(rows, pa.int64())).append_column("slice", pa.array(slices, pa.int32()))

    return texts.mapInArrow(route, "target_domain string, kind string, text string, slice int")


class RuleIndex:
    """First rule, by number, of those that a text falls under; rows (literal, rule, expression or None)."""

    def __init__(self, rows: Iterable[tuple[str, int, str | None]]):
        self.compiled: dict[str, re.Pattern] = {}
        own: dict[str, tuple[list[int], list[tuple[int, str]]]] = {}
        for literal, number, text in rows:
            enough, tried = own.setdefault(literal, ([], []))
            if text is not None:
                tried.append((number, text))
            elif not enough or number < enough[0]:
                enough[:] = [number]
        self.automaton = ahocorasick.Automaton() if own else None
        for literal, (_, tried) in own.items():
            tried.sort()
            self.automaton.add_word(literal, own[literal])
        if self.automaton:
            self.automaton.make_automaton()

    def first(self, text: str) -> int | None:
        if not self.automaton:
            return None
        held = {id(own): own for _, own in self.automaton.iter(text)}.values()
        best = min((number for enough, _ in held for number in enough), default=None)
        for number, expression in merge(*(tried for _, tried in held)):
            if best is not None and number >= best:
                break
            if expression not in self.compiled:
                self.compiled[expression] = re.compile(expression)
            if self.compiled[expression].search(text):
                return number
        return best


def hits(texts: DataFrame, cut: DataFrame, router: Router) -> DataFrame:
    """(target_domain, kind, text, rule): the first rule of a slice that a text falls under."""
    found = stored(routed(texts, router), "rule-texts")
    counts = found.groupBy("slice").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).collect()
    parts = texts.sparkSession.createDataFrame(
        pa.table({c: pa.array([r[c] for r in counts], pa.int32()) for c in ("slice", "parts")})
    )
    left = found.join(parts, "slice").withColumn("part", _one("text", "parts")).drop("parts")
    right = cut.join(parts, "slice").withColumn("part", _each("parts")).drop("parts")

    def look_up(found: pa.Table, own: pa.Table) -> pa.Table:
        keys, names = list(zip(found["target_domain"].to_pylist(), found["kind"].to_pylist())), found["text"].to_pylist()
        texts: dict[tuple, list[str]] = {}
        for key, name in zip(keys, names):
            texts.setdefault(key, []).append(name)
        # Where texts are few, most needles are in none of them: those need no index.
        few = {key: "\n".join(own) for key, own in texts.items() if sum(map(len, own)) < FEW}
        rows: dict[tuple, list[tuple]] = {key: [] for key in texts}
        for site, kind, *row in zip(*(own[c].to_pylist() for c in NEEDLE_ARROW.names)):
            key = site, kind
            if key in rows and (key not in few or row[0] in few[key]):
                rows[key].append(row)
        indexes = {key: RuleIndex(rows.pop(key)) for key in texts}
        firsts = [indexes[k].first(t) for k, t in zip(keys, names)]
        out = found.select(["target_domain", "kind", "text"]).append_column("rule", pa.array(firsts, pa.int32()))
        return out.filter(out["rule"].is_valid())

    key = ["slice", "part"]
    tried = left.groupBy(*key).cogroup(right.groupBy(*key))
    return tried.applyInArrow(look_up, "target_domain string, kind string, text string, rule int")


def _one(name: str, of: str) -> Column:
    return F.pmod(F.xxhash64(name), F.coalesce(of, F.lit(1))).cast("int")


def _each(of: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))


def dealt(urls: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs and rules, both with (target_domain, part, slice) of the tasks that they go to: each part meets each slice."""
    parts = urls.groupBy("target_domain").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    slices = rules.groupBy("target_domain").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    counts = parts.join(slices, "target_domain")
    left = urls.join(counts, "target_domain").withColumns({"part": _one("url", "parts"), "slice": _each("slices")})
    right = rules.join(counts, "target_domain").withColumns({"slice": _one("rule", "slices"), "part": _each("parts")})
    return left.drop("parts", "slices"), right.drop("parts", "slices")


def tried_on_all(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(target_domain, url, rule): the first rule of a slice that a URL falls under, of rules without a needle."""
    left, right = dealt(urls, rules)

    def look_up(found: pa.Table, own: pa.Table) -> pa.Table:
        rules = sorted(zip(*(own[c].to_pylist() for c in ("rule", "kind", "text"))), key=lambda r: r[0])
        compiled: dict[int, re.Pattern] = {}

        def first(url: str | None, host: str | None) -> int | None:
            for place, (number, kind, text) in enumerate(rules if url is not None else ()):
                if kind == HOST:
                    if host:
                        return number
                    continue
                if place not in compiled:
                    compiled[place] = re.compile(text)
                if compiled[place].search(url):
                    return number
            return None

        firsts = [first(u, h) for u, h in zip(found["url"].to_pylist(), found["host"].to_pylist())]
        out = found.select(["target_domain", "url"]).append_column("rule", pa.array(firsts, pa.int32()))
        return out.filter(out["rule"].is_valid())

    key = ["target_domain", "part", "slice"]
    tried = left.groupBy(*key).cogroup(right.groupBy(*key))
    return tried.applyInArrow(look_up, "target_domain string, url string, rule int")


def first_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(target_domain, url, rule) of the different URLs: the first rule of their site that rejects them, or null.

    ``rules``: target_domain, rule (int), kind (``pattern`` or ``host``), text.
    """
    let_workers_import(urls.sparkSession)
    named = stored(
        urls.select("target_domain", "url").distinct().withColumn("host", U.host(F.col("url"))), "rule-urls"
    )
    table = stored(needle_table(rules), "rule-needles")

    def texts(kind: str, column: str) -> DataFrame:
        return named.select("target_domain", F.lit(kind).alias("kind"), F.col(column).alias("text"))

    sited = texts(PATTERN, "url").unionByName(texts(HOST, "host").distinct())
    sited = sited.where("target_domain is not null and text <> ''")
    found = stored(hits(sited, *sliced(table.where("literal <> ''"))), "rule-hits")
    of_host = found.where(F.col("kind") == HOST).groupBy("target_domain", F.col("text").alias("host")).agg(F.min("rule").alias("rule"))
    out = named.join(of_host, ["target_domain", "host"], "left").select("target_domain", "url", "rule")
    out = out.unionByName(found.where(F.col("kind") == PATTERN).select("target_domain", F.col("text").alias("url"), "rule"))
    bare = table.where("literal = ''")
    if not bare.isEmpty():
        those = named.join(bare.select("target_domain").distinct(), "target_domain", "left_semi")
        out = out.unionByName(tried_on_all(those, bare.select(*RULE)))
    return out.groupBy("target_domain", "url").agg(F.min("rule").alias("rule"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``urls`` that no rule rejects."""
    kept = first_rule(urls, rules).where("rule is null").select("target_domain", "url")
    return urls.join(kept, (urls["target_domain"].eqNullSafe(kept["target_domain"])) & urls["url"].eqNullSafe(kept["url"]), "left_semi")
