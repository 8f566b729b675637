import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(rows):
    """(lang, phrase as words) of every phrase of up to four words."""
    out = Counter()
    for lang, text in rows:
        for words in pieces(text):
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    out["und" if lang is None else lang, tuple(words[i : i + m])] += 1
    return out


def plainly(rows, least, top):
    f = plain_counts(rows)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    covered = set()
    for (lang, p), c in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * c >= 80 * f[lang, p[i : i + m]]:
                    covered.add((lang, p[i : i + m]))
    out = []
    for lang in n:
        own = []
        for (other, p), a in found.items():
            if other == lang and (lang, p) not in covered:
                cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    words = "the of A b Ünd é́ x\x1cy 日本 to \x00 z".split(" ")
    weights = [30, 20, 9, 8, 5, 5, 4, 4, 3, 2, 2]
    ends = [" ", "\t", "  "] * 9 + [". ", ",", "\n", "\r\n", "\x0b", "!? "]
    out = []
    for k in range(250):
        text = "".join(
            rng.choices(words, weights)[0] + rng.choice(ends) for _ in range(rng.choice([0, 3, 40, 120]))
        )
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    out += [("fr", None), ("fr", ""), ("fr", " .\n"), ("en", "of the " * 4000), ("en", "z" * 200_000)]
    return out + [("en", "hot words stay here of the")] * 120


@pytest.fixture(scope="module")
def rows():
    return corpus()


def table(spark, rows):
    extra = ("x", 1, "y", 2, "z")
    return spark.createDataFrame(
        [(lang, text, *extra) for lang, text in rows],
        "lang string, text string, phrase string, words int, part string, f int, range string",
    )


@pytest.mark.parametrize("range_bytes,least,top", [(1 << 30, 30, 2000), (700, 5, 40), (5000, 2, 2000)])
def test_like_counter(spark, rows, range_bytes, least, top):
    got = C.collocations(table(spark, rows), least, top, range_bytes).collect()
    assert sorted(map(tuple, got)) == plainly(rows, least, top)


def test_counts_over_many_ranges(spark, rows):
    got = {(r.lang, r.phrase): r.f for r in C.counted(table(spark, rows), 3, 400).collect()}
    want = {(lang, " ".join(p)): c for (lang, p), c in plain_counts(rows).items() if c >= 3}
    totals = Counter()
    for (lang, p), c in plain_counts(rows).items():
        totals[lang, ""] += c if len(p) == 1 else 0
    assert got == want | totals


def test_automata(rows):
    texts = [r for r in rows if r[0] == "en"]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in texts], "text": [r[1] for r in texts]})
    parts = [a for _, a in C.shards(iter([batch]), 500)]
    assert len(parts) > 10
    whole = C.CountAutomaton.union(parts)
    want = {p: c for (_, p), c in plain_counts(texts).items()}

    def paths(automaton):
        out = Counter()
        for depth in range(1, 5):
            starts, weights = automaton.states(depth)
            for s, w in zip(starts.tolist(), weights.tolist()):
                out[tuple(automaton.phrase(s, depth).split(b" "))] += w
        return out

    assert paths(whole) == {tuple(w.encode() for w in p): c for p, c in want.items()}
    # Cut anywhere, written and read, the parts hold the same.
    keys = sorted(tuple(w.encode() for w in p) + (b"",) * (4 - len(p)) for p in random.Random(1).sample(list(want), 40))
    keys = sorted([*keys, (b"zzz", b"a", b"", b"")])
    total, places = Counter(), []
    for part in parts:
        for k, piece in part.cut(keys):
            back = C.CountAutomaton.from_bytes(piece.to_bytes())
            assert [c.tolist() for c in back.columns] == [c.tolist() for c in piece.columns]
            names = [b"", *back.words]
            windows = [tuple(names[c[i]] for c in back.columns) for i in range(len(back.weights))]
            assert windows == sorted(set(windows))
            assert all((k == 0 or w >= keys[k - 1]) and (k == len(keys) or w < keys[k]) for w in windows)
            total += paths(back)
            places.append(k)
    assert total == paths(whole) and len(set(places)) > 20


def test_compose():
    counts = C.of_phrases([b"a", b"a b", b"b c d e", b"c"], [3, 300, 5, 7])
    asked = C.of_phrases([b"a b", b"b c d", b"x", b"b c d e", b"c", b"a x"], [1] * 6)
    assert sorted(counts.compose(asked)) == [(b"a b", 300), (b"b c d e", 5), (b"c", 7)]
    none = C.of_phrases([], [])
    assert none.compose(asked) == counts.compose(none) == []


def test_wide_vocabularies():
    rng = np.random.default_rng(2)
    words = [b"w%d" % k for k in range(70_000)]
    columns = [rng.integers(1, 70_001, 90_000).astype(np.int32) for _ in range(4)]
    built = C.CountAutomaton.built(words, columns)
    back = C.CountAutomaton.from_bytes(built.to_bytes())
    got = sorted(tuple(back.words[c[i] - 1] for c in back.columns) for i in range(len(back.weights)))
    assert got == sorted(tuple(b"w%d" % (c[i] - 1) for c in columns) for i in range(90_000))


def test_sql(spark, rows):
    ok = [r for r in rows if "\x00" not in (r[1] or "")]
    con = duckdb.connect()
    con.register("documents", table(spark, ok).select("lang", "text").toArrow())
    got = sorted(map(tuple, C.collocations(table(spark, ok)).collect()))
    assert got == sorted(con.sql(C.SQL).fetchall())


def test_empty(spark, no_docs):
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(table(spark, [("en", None), (None, "")])).count() == 0
