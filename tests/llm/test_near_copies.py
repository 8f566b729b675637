import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from webloom.llm import near_copies as C
from webloom.llm import simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_kept(pairs):
    """Smallest id of each connected group, by comparing all pairs; ids are different."""
    sets = {i: plain_shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if 5 * len(sets[a] & sets[b]) >= 4 * union and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(i for i in sets if find(i) == i)


def changed(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("limit", [4096, 3])
def test_against_brute_force(make_docs, spark, limit):
    rng = random.Random(3)
    passage = prose(99, 30)
    pairs = [(600, ""), (601, None), (602, " \n"), (603, "One two"), (604, "one TWO"), (605, "one")]
    for k in range(12):
        # Around the similarity of 0.8: an edit takes five shingles of about 200.
        base = prose(k, 200).split()
        pairs += [(20 * k + j, changed(base, rng.randint(0, 6), rng)) for j in range(8)]
    pairs += [(700 + k, f"{passage} {prose(500 + k, 25)}") for k in range(30)]
    rng.shuffle(pairs)
    want = plain_kept(pairs)
    assert len(want) > 45
    docs = make_docs(pairs)
    assert sorted(r.doc_id for r in C.representatives(docs, limit).collect()) == want
    if limit == 4096:
        assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want


def test_one_edited_word_in_45(make_docs, spark):
    rng = random.Random(1)
    base = prose(5, 180).split()
    pairs = [(1, " ".join(base)), *((k, changed(base, 4, rng)) for k in range(2, 20))]
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, make_docs(pairs), "").collect()] == plain_kept(pairs)


def test_odd_rows(odd_docs, no_docs):
    kept = C.representatives(odd_docs).collect()
    assert kept[0].fp == "x" and len(kept[0]) == len(odd_docs.columns)
    ids = [r.doc_id for r in kept]
    assert {1, 4, 5, 6, 8} <= set(ids) and not {2, 3, None} & set(ids)
    assert not any(i is not None and 100 <= i < 112 for i in ids)
    assert C.representatives(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 5, 60, 256, 257, 320, 1024, 1100, 1281, 6000])
def test_alike_sets_meet_in_an_alike_part(n):
    """Pairs at the border share a key under which sizes, places and bitmaps let them pass."""
    rng = np.random.default_rng(n)
    for _ in range(20):
        both = rng.integers(1, 1 << 64, n, np.uint64)
        extra = int(rng.integers(0, n // 4 + 1))
        left = int(rng.integers(0, extra + 1))
        a = np.unique(np.append(both, rng.integers(1, 1 << 64, left, np.uint64)))
        b = np.unique(np.append(both, rng.integers(1, 1 << 64, extra - left, np.uint64)))
        assert C.alike(a, b)
        # Any order that both sets share will do.
        level = [(x % np.uint64(7)).astype(np.int64) for x in (a, b)]
        found = []
        for x, y in zip((a, b), level):
            rows = {}
            for band in C.bands(len(x)):
                size, bits, length, keys = C.parts_of(x, y, band)
                assert size.sum() == len(x) and length.sum() == len(keys)
                start = np.cumsum(length) - length
                for k in range(len(size)):
                    for at, key in enumerate(keys[start[k] : start[k] + length[k]].tolist()):
                        rows[key] = (int(size[k]), bits[k], at)
            found.append(rows)

        def passes(key):
            (n, x, i), (m, y, j) = found[0][key], found[1][key]
            apart = int(np.bitwise_count(x ^ y).sum())
            return C.may_be_alike(n, m, i, j) and 9 * apart <= n + m

        assert any(passes(key) for key in found[0].keys() & found[1].keys())


def test_long_texts(make_docs):
    rng = random.Random(8)
    base = prose(7, 3000).split()
    pairs = [(1, " ".join(base)), (2, changed(base, 30, rng)), (3, changed(base, 500, rng))]
    pairs += [(4, " ".join(base[:2500])), (5, " ".join(base[:2000])), (6, prose(8, 3000))]
    assert sorted(r.doc_id for r in C.representatives(make_docs(pairs)).collect()) == plain_kept(pairs)


@pytest.mark.parametrize("piece", [1, 7, 50, 1 << 20])
def test_shingles_do_not_depend_on_pieces(monkeypatch, piece):
    """As many different shingles as by words, however the text is cut; words around the longest short one."""
    rng = random.Random(piece)
    signs = ["a", "B", "é", "日", "\t", "\n", " ", "\x0b", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choice([*signs, "x" * rng.randint(60, 70)]) for _ in range(rng.randint(0, 300)))
        whole = C.shingles(text)
        assert len(whole) == len(plain_shingles(text))
        with monkeypatch.context() as changed_size:
            changed_size.setattr(C, "PIECE", piece)
            assert np.array_equal(C.shingles(text.replace("B", "b")), whole)
    assert len(C.shingles("x" * 3_000_000)) == 1 and len(C.shingles(None)) == 0


def test_fingerprints_link_first_and_are_checked(make_docs, spark, monkeypatch):
    """Texts whose SimHash fingerprints are near are compared first; what these do not link is left to the search."""
    rng = random.Random(2)
    base, other = prose(1, 2000).split(), prose(2, 100).split()
    pairs = [(1, " ".join(base)), (2, changed(base, 1, rng)), (3, " ".join(other)), (4, changed(other, 2, rng)), (5, prose(3, 90))]
    far = [(simhash.fingerprint(pairs[k][1], 5) ^ simhash.fingerprint(pairs[k + 1][1], 5)).bit_count() for k in (0, 2)]
    assert far[0] <= simhash.DISTANCE < far[1]
    tried, compared = {}, C._compared

    def counted(pairs, texts, classes, name):
        tried[name] = pairs.count()
        return compared(pairs, texts, classes, name)

    monkeypatch.setattr(C, "_compared", counted)
    docs = make_docs(pairs)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3, 5] == plain_kept(pairs)
    assert tried == {"copies-first": 1, "copies-second": 1, "copies-third": 0}
    # Near fingerprints alone link nothing.
    nodes = lambda classes, limit: classes.select(F.col("node").alias("a")).crossJoin(classes.agg(F.min("node").alias("b"))).where("a <> b")
    monkeypatch.setattr(C, "_fingerprinted", nodes)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3, 5]
    assert tried["copies-first"] == 4


def test_only_texts_that_may_be_alike_are_held(make_docs, spark, monkeypatch):
    """A common passage brings texts together that differ too much to be read again."""
    passage = prose(99, 60)
    held, real = [], C._held
    monkeypatch.setattr(C, "_held", lambda texts, wanted: held.append(wanted.count()) or real(texts, wanted))
    pairs = [(k, f"{prose(100 + k, 100)} {passage} {prose(300 + k, 90)}") for k in range(40)]
    assert C.representatives(make_docs(pairs)).count() == 40 and sum(held) < 10
