"""Phrases that occur more often than their parts let expect, from counts kept in weighted automata.

A shard (a bounded number of words in a task) sorts its windows of up to four words and builds an acyclic
automaton from them: arcs are words, a path is a phrase, and a path's weight is its number of
occurrences.  As the windows are sorted, the automaton grows at its end only, by the words that a window
does not share with the one before; that is also how it is written down.  The weight of a path is the sum over
the windows below it, so all phrases of one to four words are counted by one sort.

Automata are cut at splitters of the key space (language, four words) and sent to the task of their prefix
range, which unites them: the sum of weights of equal paths.  Only paths over the least count leave it,
besides those that a splitter cuts; the ranges' shares of these are added up.  The rests of candidates are an
automaton too; it is composed with the one of the counts, and what both accept is a rest with its count.

Splitters come from windows of a bounded sample of documents; they decide how even ranges are, not what is
counted.  There is one range per RANGE_BYTES of text, up to MOST_RANGES.  A hot word or word pair is cut
by splitters that go down to the fourth word, and a hot window is one path in each shard.

Words and pieces are those of the contract: A-Z in lower case, pieces between punctuation or line
ends, words between blanks or tabs.  Nulls: a null text has no words, a null lang is ``und``.  Empty texts and empty pieces
have no words.  Repeated rows count each for itself.  Other input columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, slices, stored
from webloom.session import shuffle_width

LONGEST = 4
LEAST = 30
TOP = 2000
#: A longer phrase with 80 of 100 occurrences of a shorter one stands for it.
COVERED = 80
NO_LANG = "und"

#: Bytes of text that are split at once, and windows that a shard sorts at once.
SLICE = 4 << 20
SHARD = 2_000_000
#: Distinct words that a task remembers between shards.
MEMORY = 500_000
#: Bytes of text for each prefix range, and the most ranges (the driver holds a splitter for each).
RANGE_BYTES = 12 << 20
MOST_RANGES = 1 << 16
#: Windows that splitters are chosen from, for each range (the driver takes twice as many at most), the
#: bytes of text they are taken from, at least and for each range, and the usual bytes of a word.
SAMPLE, SAMPLE_BYTES, SAMPLE_BYTES_EACH, WORD_BYTES = 16, 32 << 20, 4096, 7
#: Phrases that one task composes with the counts.
COMPOSED = 500_000

# What ends a piece, and what stands between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + PIECE_ENDS + BLANKS, bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS)
)
KEYS = [f"w{k}" for k in range(LONGEST)]
COUNTS = "lang string, phrase string, words int, f bigint"


class Words(dict):
    """Numbers of words in the order they are first seen; 0 ends a piece, 1 is nothing."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text, piece ends as 0, with one at the end."""
        plain = text.encode().translate(_PLAIN)
        parts, a = [], 0
        while a < len(plain):
            # Cut before a blank or a piece end, so that no word is split.
            b = min(a + SLICE, len(plain))
            while b < len(plain) and plain[b] not in b" \n":
                b += 1
            tokens = plain[a:b].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
            parts.append(found[found != 1])
            a = b
        return np.concatenate([*parts, np.zeros(1, np.int32)])


def windows(numbers: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """Words of the windows that start at places a to b, one array per word; 0 after the end of a piece."""
    held = np.append(numbers[a : b + LONGEST - 1], np.zeros(LONGEST, np.int32))
    starts = np.flatnonzero(held[: b - a])
    columns = [held[starts]]
    for k in range(1, LONGEST):
        columns.append(np.where(columns[-1] != 0, held[starts + k], 0))
    return columns


def order_of(columns: Sequence[np.ndarray], base: int) -> np.ndarray:
    """Sorting order of rows of four numbers below ``base``."""
    pairs = [columns[k].astype(np.int64) * base + columns[k + 1] for k in (0, 2)]
    if base < 55_000:
        return np.argsort(pairs[0] * base**2 + pairs[1])
    low = np.argsort(pairs[1], kind="stable")
    return low[np.argsort(pairs[0][low], kind="stable")]


class CountAutomaton:
    """Paths of words with weights, as the sorted windows that all of them begin.

    ``words`` are sorted; the columns hold 1 + the place of a word, or 0 behind the end of a window.
    """

    def __init__(self, words: list[bytes], columns: list[np.ndarray], weights: np.ndarray):
        self.words, self.columns, self.weights = words, columns, weights
        n = len(weights)
        # Words that a window shares with the one before it: only the rest of it adds states.
        same, shared = np.ones(max(n - 1, 0), bool), np.zeros(n, np.int8)
        for c in columns:
            same = same & (c[1:] == c[:-1])
            shared[1:] += same
        self.shared = shared

    @classmethod
    def built(cls, words: Sequence[bytes], columns: Sequence[np.ndarray], weights: np.ndarray | None = None):
        """From windows in any order, whose numbers are 1 + places in ``words``; equal ones are added up."""
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
        columns = [rank[c] for c in columns]
        at = order_of(columns, len(words) + 1)
        columns = [c[at] for c in columns]
        change = np.ones(len(at), bool)
        if len(at):
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(change)
        if weights is None:
            sums = np.diff(np.append(starts, len(at)))
        else:
            sums = np.add.reduceat(weights[at], starts) if len(at) else weights
        return cls([words[k] for k in order], [c[starts] for c in columns], sums.astype(np.int64))

    @classmethod
    def union(cls, parts: Sequence[CountAutomaton]) -> CountAutomaton:
        """Weights of equal paths added up."""
        words: dict[bytes, int] = {}
        columns: list[list[np.ndarray]] = [[] for _ in KEYS]
        for part in parts:
            own = [0, *(words.setdefault(w, len(words)) + 1 for w in part.words)]
            place = np.array(own, np.int32)
            for k, c in enumerate(part.columns):
                columns[k].append(place[c])
        return cls.built(
            list(words), [np.concatenate(c) for c in columns], np.concatenate([p.weights for p in parts])
        )

    def cut(self, splitters: Sequence[tuple[bytes, ...]]) -> list[tuple[int, CountAutomaton]]:
        """(range, part): the windows from one splitter up to the next, for all ranges that have any."""
        place = {w: k for k, w in enumerate(self.words, 1)}
        edges = [0, *(self._before(s, place) for s in splitters), len(self.weights)]
        out = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                used, columns = renumbered([c[a:b] for c in self.columns], len(self.words) + 1)
                words = [self.words[u - 1] for u in used.tolist()]
                out.append((k, CountAutomaton(words, columns, self.weights[a:b])))
        return out

    def _before(self, key: tuple[bytes, ...], place: dict[bytes, int]) -> int:
        """Number of windows below ``key``."""
        a, b = 0, len(self.weights)
        for word, column in zip(key, self.columns):
            at = place.get(word) if word else 0
            if at is None:
                return a + int(np.searchsorted(column[a:b], bisect_left(self.words, word) + 1))
            low, high = np.searchsorted(column[a:b], [at, at + 1])
            a, b = a + int(low), a + int(high)
            if a == b:
                return a
        return a

    def to_bytes(self) -> bytes:
        """The words, and for every window its new states and its weight."""
        labels = np.stack(self.columns, 1)[np.arange(LONGEST)[None, :] >= self.shared[:, None]]
        kind = np.uint16 if len(self.words) < 1 << 16 else np.uint32
        large = np.flatnonzero(self.weights >= 255)
        parts = [
            b"\n".join(self.words),
            self.shared.tobytes(),
            labels.astype(kind).tobytes(),
            np.minimum(self.weights, 255).astype(np.uint8).tobytes(),
            self.weights[large].tobytes(),
        ]
        return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        sizes = np.frombuffer(data, np.int64, 5)
        ends = 40 + np.cumsum(sizes)
        raw = [data[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist())]
        words = raw[0].split(b"\n") if raw[0] else []
        shared = np.frombuffer(raw[1], np.int8)
        kind = np.uint16 if len(words) < 1 << 16 else np.uint32
        labels = np.frombuffer(raw[2], kind).astype(np.int32)
        weights = np.frombuffer(raw[3], np.uint8).astype(np.int64)
        weights[weights == 255] = np.frombuffer(raw[4], np.int64)
        first = np.cumsum(LONGEST - shared.astype(np.int64)) - (LONGEST - shared)
        columns = []
        for k in range(LONGEST):
            # The last window that brought its own word at this depth.
            source = np.maximum.accumulate(np.where(shared <= k, np.arange(len(shared)), 0))
            columns.append(labels[first[source] + k - shared[source]])
        return cls(words, columns, weights)

    def states(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths of ``depth`` words: a window that begins with each, and their weights."""
        if not len(self.weights):
            return np.zeros(0, np.int64), self.weights
        starts = np.flatnonzero(self.shared < depth)
        weights = np.add.reduceat(self.weights, starts)
        real = self.columns[depth - 1][starts] != 0
        return starts[real], weights[real]

    def phrase(self, window: int, depth: int) -> bytes:
        return b" ".join(self.words[c[window] - 1] for c in self.columns[:depth])

    def compose(self, accepted: CountAutomaton) -> list[tuple[bytes, int]]:
        """Whole windows that both automata hold, with this one's weights."""
        mine = {w: k for k, w in enumerate(self.words, 1)}
        place = np.array([0, *(mine.get(w, -1) for w in accepted.words)], np.int32)
        wanted = [place[c] for c in accepted.columns]
        # Walk both in one sorted order: words of ``accepted`` that are unknown here lead nowhere.
        known = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in wanted]))
        both = [np.concatenate([c, w[known]]) for c, w in zip(self.columns, wanted)]
        side = np.append(np.zeros(len(self.weights), np.int8), np.ones(len(known), np.int8))
        at = order_of(both, len(self.words) + 1)
        both, side = [c[at] for c in both], side[at]
        meet = np.logical_and.reduce([c[1:] == c[:-1] for c in both]) & (side[1:] != side[:-1])
        pair = np.minimum(at[1:][meet], at[:-1][meet])
        return [
            (self.phrase(p, int(sum(c[p] != 0 for c in self.columns))), int(self.weights[p]))
            for p in pair.tolist()
        ]


def renumbered(columns: Sequence[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers below ``size`` that occur, but for those that stand for no word, and columns of 1 + their places."""
    marks = np.zeros(size, bool)
    for c in columns:
        marks[c] = True
    marks[0] = False
    used = np.flatnonzero(marks)
    rank = np.zeros(size, np.int32)
    rank[used] = np.arange(1, len(used) + 1)
    return used, [rank[c] for c in columns]


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[tuple[str, CountAutomaton]]:
    """(lang, automaton) of bounded numbers of windows."""
    words = Words()
    held: dict[str, list[np.ndarray]] = {}
    count = 0

    def closed():
        names = list(words)
        for lang, parts in held.items():
            numbers = np.concatenate(parts)
            for a in range(0, len(numbers), size):
                found = windows(numbers, a, min(a + size, len(numbers)))
                used, columns = renumbered(found, len(names))
                if len(used):
                    yield lang, CountAutomaton.built([names[u] for u in used.tolist()], columns)

    for batch in batches:
        for part in slices(iter([batch]), "text", SLICE):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                numbers = words.numbers(text.as_py() or "")
                held.setdefault(NO_LANG if lang is None else lang, []).append(numbers)
                count += len(numbers)
                if count >= size:
                    yield from closed()
                    held, count = {}, 0
                    if len(words) > MEMORY:
                        words = Words()
    yield from closed()


def splitters(docs: DataFrame, ranges: int, size: int) -> list[tuple]:
    """Keys (lang, four words) that cut the windows into ranges of about equal size."""
    if ranges < 2:
        return []

    taken = max(SAMPLE_BYTES, SAMPLE_BYTES_EACH * ranges)
    # Evenly spaced windows, about SAMPLE for each range; each stands for as many others.
    step = max(1, min(size, taken) // (WORD_BYTES * SAMPLE * ranges))

    def run(batches: Iterator[pa.RecordBatch]):
        for lang, automaton in shards(batches):
            columns = [c[step // 2 :: step] for c in automaton.columns]
            names = np.array([b"", *automaton.words], object)
            cells = [names[c].tolist() for c in columns]
            yield {"lang": [lang] * len(cells[0]), **dict(zip(KEYS, cells))}

    every = max(1, -(-size // taken))
    sample = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(every)) == 0)
    names = ", ".join(f"{k} binary" for k in KEYS)
    keys = arrow_map(sample, run, f"lang string, {names}")
    # Long words are no good splitters; they lie in the range of their neighbours.
    short = keys.where(" and ".join(f"length({k}) <= 64" for k in KEYS))
    rows = short.orderBy(F.xxhash64(*KEYS), *KEYS).limit(2 * SAMPLE * ranges).collect()
    found = sorted((r["lang"].encode(), *(bytes(r[k]) for k in KEYS)) for r in rows)
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def _ranges_of(lang: bytes, cuts: Sequence[tuple]) -> tuple[int, list[tuple]]:
    """Number of splitters before a language, and the splitters inside it."""
    a, b = bisect_left(cuts, (lang,)), bisect_left(cuts, (lang + b"\0",))
    return a, [c[1:] for c in cuts[a:b]]


def counted(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, words, f): phrases of up to four words that occur at least ``least`` times.

    A row without a phrase has the number of words of a language.
    """
    docs = docs.select("lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-size // range_bytes)))
    cuts = splitters(docs, ranges, size)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def sent(batches: Iterator[pa.RecordBatch]):
        inside = {}
        for lang, automaton in shards(batches):
            if lang not in inside:
                inside[lang] = _ranges_of(lang.encode(), shared.value)
            first, own = inside[lang]
            for k, part in automaton.cut(own):
                yield {"range": [first + k], "lang": [lang], "automaton": [part.to_bytes()]}

    def united(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def closed():
            if not held:
                return
            number, lang = key
            whole = CountAutomaton.union(held)
            first, own = _ranges_of(lang.encode(), shared.value)
            k = number - first
            borders = [own[x] for x in (k - 1, k) if 0 <= x < len(own)]
            yield from _paths(whole, lang, borders, least)

        for batch in batches:
            columns = (batch.column(c) for c in ("range", "lang", "automaton"))
            for number, lang, data in zip(*columns):
                here = (number.as_py(), lang.as_py())
                if here != key:
                    yield from closed()
                    key, held = here, []
                held.append(CountAutomaton.from_bytes(data.as_py()))
        yield from closed()

    slices_ = arrow_map(docs, sent, "range int, lang string, automaton binary")
    # One task for a range; by a hash of the range some tasks would have several.
    dealt = slices_.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "lang")
    paths = arrow_map(dealt, united, COUNTS)
    total = paths.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return total.where((F.col("f") >= least) | (F.col("words") == 0))


def _paths(whole: CountAutomaton, lang: str, borders: Sequence[tuple], least: int) -> Iterator[dict]:
    """Paths over the least count, and those that go on in a neighbouring range."""
    place = {w: k for k, w in enumerate(whole.words, 1)}
    for depth in range(1, LONGEST + 1):
        starts, weights = whole.states(depth)
        keep = weights >= least
        for key in borders:
            ids = [place.get(w) for w in key[:depth]]
            if None not in ids:
                keep |= np.logical_and.reduce([c[starts] == i for c, i in zip(whole.columns, ids)])
        starts, kept = starts[keep].tolist(), weights[keep]
        yield {
            "lang": [lang] * len(starts),
            "phrase": [whole.phrase(s, depth).decode() for s in starts],
            "words": [depth] * len(starts),
            "f": kept,
        }
        if depth == 1:
            yield {"lang": [lang], "phrase": [""], "words": [0], "f": [int(weights.sum())]}


def composed(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, part, f): the counts of the distinct phrases in ``parts`` (lang, part), by composing both automata."""

    def run(batches: Iterator[pa.RecordBatch]):
        sides: dict[str, tuple[dict, list]] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "part", "f"))
            for lang, part, f in zip(*columns):
                held, asked = sides.setdefault(lang, ({}, []))
                if f is None:
                    asked.append(part.encode())
                else:
                    held[part.encode()] = f
        for lang, (held, asked) in sides.items():
            transducer = of_phrases(list(held), list(held.values()))
            found = transducer.compose(of_phrases(asked, [1] * len(asked)))
            phrases, weights = zip(*found) if found else ((), ())
            yield {"lang": [lang] * len(found), "part": [p.decode() for p in phrases], "f": list(weights)}

    both = counts.select("lang", F.col("phrase").alias("part"), "f").unionByName(
        parts.select("lang", "part", F.lit(None).cast("bigint").alias("f"))
    )
    width = max(shuffle_width(counts.sparkSession), -(-counts.count() // COMPOSED))
    # Both sides are distinct, so no part is hot.
    return arrow_map(both.repartition(width, "lang", "part"), run, "lang string, part string, f bigint")


def of_phrases(phrases: Sequence[bytes], weights: Sequence[int]) -> CountAutomaton:
    """An automaton that accepts whole phrases."""
    words: dict[bytes, int] = {}
    cells = np.zeros((len(phrases), LONGEST), np.int32)
    for row, phrase in enumerate(phrases):
        for k, word in enumerate(phrase.split(b" ")):
            cells[row, k] = words.setdefault(word, len(words)) + 1
    return CountAutomaton.built(list(words), list(cells.T), np.array(weights, np.int64))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counts = stored(counted(docs, least, range_bytes), "phrase-counts")
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ", -1)

    def joined(start: Column, size: Column) -> Column:
        return F.array_join(F.slice(split, start, size), " ")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        joined(F.lit(1), F.col("k")).alias("first"),
        joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    looked_up = stored(composed(counts.where("words > 0"), parts), "phrase-parts")
    # Products and sums in decimals, as they may pass 64 bits.
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    lowest = (
        cuts.join(looked_up.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(looked_up.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = (
        found.where("words > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("most"))
    )
    covered = F.col("most").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * COVERED
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    best = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang",
        F.col("rank").cast("bigint").alias("rank"),
        "phrase",
        "a",
        "cut.l",
        "cut.r",
        "n",
        "cut.score",
    )


#: DuckDB SQL of ``collocations`` over ``documents``.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, m, unnest([array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS phrase
  FROM split, (VALUES (1), (2), (3), (4)) AS sizes(m)
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), found AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m >= 2 AND f >= {LEAST}
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM found)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM found))
  GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank,
    s.phrase, a, l, r, n, score
  FROM lowest s JOIN sizes z ON z.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE most IS NULL OR CAST(most AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {COVERED}
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
