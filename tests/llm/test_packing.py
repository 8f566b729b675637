import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from webloom.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Best-fit decreasing over a sorted list of remaining capacities."""
    remaining = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(remaining, length)
        room = remaining.pop(k) if k < len(remaining) else capacity
        bisect.insort(remaining, room - length)
    return Counter(remaining)


@pytest.mark.parametrize("capacity", [1, 10, 64, 1024])
def test_same_sequences_as_one_by_one(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
        plan = P.best_fit(Counter(lengths), capacity)
        used = defaultdict(list)
        for length, _, n, sequence, offset in plan.tolist():
            for k in range(n):
                used[sequence + k].append((offset, length))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
        left = Counter(capacity - sum(x for _, x in places) for places in used.values())
        assert left == one_by_one(lengths, capacity)
        assert Counter(x for places in used.values() for _, x in places) == Counter(lengths)


def test_segment_tree():
    rng = random.Random(1)
    tree, open_ = P.Capacities(100), set()
    for _ in range(2000):
        k = rng.randint(0, 100)
        on = rng.random() < 0.3
        tree.set(k, on)
        (open_.add if on else open_.discard)(k)
        want = rng.randint(0, 100)
        assert tree.tightest(want) == min((x for x in open_ if x >= want), default=-1)


def test_odd_rows(odd_docs, odd_pairs, encode):
    rows = P.packed(odd_docs, PATH).collect()
    want = Counter()
    for i, t in odd_pairs:
        ids = np.array([*encode(t), 2], "<u4")
        assert sum(n for _, n in P.cuts(len(ids))) == len(ids)
        for p, (start, n) in enumerate(P.cuts(len(ids))):
            want[i, p, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) == sum(one_by_one([r.length for r in rows], 1024).values())


def test_sequences_hold_the_ids(make_docs, encode, monkeypatch):
    monkeypatch.setattr(P, "PART", 7)
    pairs = [(k, f"document number {k} " * (k % 40)) for k in range(120)]
    packed = P.packed(make_docs(pairs), PATH, with_ids=True)
    ids = [x for r in P.sequences(packed).collect() for x in r.ids]
    assert Counter(ids) == Counter(x for _, t in pairs for x in [*encode(t), 2])
    assert max(len(r.ids) for r in P.sequences(packed).collect()) <= 1024


def test_first_piece_may_be_shorter():
    assert P.cuts(1024) == [(0, 1024)] and P.cuts(1025) == [(0, 1), (1, 1024)]
    assert P.cuts(2048) == [(0, 1024), (1024, 1024)]


def test_empty(no_docs):
    assert P.packed(no_docs, PATH).count() == 0


def test_literals_of_added_tokens(make_docs):
    t = tokenizers.Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |> <|endof", "  <|endoftext|>  "]
    found = P.pieces(make_docs(list(enumerate(texts))), PATH, with_ids=True).collect()
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}
    assert {r.doc_id: r.ids for r in found} == want and 50256 in want[0]


def test_long_runs(make_docs):
    t = tokenizers.Tokenizer.from_file(PATH)
    texts = [" " * 1_000_000 + "a", "\n" * 1_000_000 + "a <|endoftext|>", "ab" * 500_000]
    found = P.pieces(make_docs(list(enumerate(texts))), PATH).collect()
    for k, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want = [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in P.cuts(len(ids))]
        assert sorted((r.start, r.length, r.ids_crc32) for r in found if r.doc_id == k) == want
