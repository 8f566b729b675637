import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import prose
from webloom.llm import lattice_lm as M

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lattice():
    return M.lattice_of(open(PATH, "rb").read())


def segmentations(word: bytes, weight: dict) -> float:
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(
        weight[word[:k]] * segmentations(word[k:], weight)
        for k in range(1, len(word) + 1)
        if word[:k] in weight
    )


def test_forward_and_expected_counts(lattice):
    rng = np.random.default_rng(1)
    p = rng.random(len(lattice.pieces))
    p /= p.sum()
    weight = dict(zip(lattice.pieces, p))
    words = [w.encode() for w in ("the", "nation", "ééa", "x", "tation", "anatom")]
    for places, table in M.by_length(words):
        alpha = lattice.forward(table, np.log(p))[:, -1]
        for k, a in zip(places.tolist(), alpha):
            assert math.isclose(math.exp(a), segmentations(b" " + words[k], weight), rel_tol=1e-9)
        counts = lattice.expected(table, np.ones(len(table)), np.log(p))
        length = np.array([len(x) for x in lattice.pieces])
        assert math.isclose((counts * length).sum(), table.size, rel_tol=1e-9)


def test_base_scores(make_docs, odd_pairs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4000)
    pairs = odd_pairs + [(1000 + k, prose(k, 50).title()) for k in range(60)]
    rows = M.scores(make_docs(pairs), PATH).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs}
    train = Counter()
    ends = 0
    for i, t in pairs:
        if not held[i]:
            train.update((t or "").encode().lower().split())
            ends += 1
    total, distinct = sum(train.values()) + ends, len(train) + 1
    want = []
    for i, t in pairs:
        words = (t or "").encode().lower().split()
        base = math.log10((ends + 1) / (total + distinct + 1))
        base += sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words)
        want.append((i, held[i], len(words) + 1, sum(w in train for w in words) + 1, total, round(base, 6)))
    got = [
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_training_raises_the_likelihood(make_docs, monkeypatch):
    pairs = [(k, prose(k, 80)) for k in range(300)]
    docs = make_docs(pairs)

    def held_out_score(rounds):
        monkeypatch.setattr(M, "ROUNDS", rounds)
        return sum(r.score for r in M.scores(docs, PATH).where("held_out").collect())

    assert held_out_score(1) < held_out_score(3)


def test_without_training_rows(make_docs, no_docs):
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = M.scores(make_docs([(only, "two words")]), PATH).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.score < 0
    assert M.scores(no_docs, PATH).count() == 0


def test_expected_counts_are_summed_once(lattice, monkeypatch):
    """One array of all pieces for a table of words, not one for each arc."""
    calls, real = [], np.bincount
    monkeypatch.setattr(M.np, "bincount", lambda *a: calls.append(1) or real(*a))
    (_, table), = M.by_length([b"nation", b"anatom"])
    counts = lattice.expected(table, np.ones(2), np.full(len(lattice.pieces), -9.0))
    assert len(calls) == 1 and counts.shape == (len(lattice.pieces),) and counts.sum() >= 2
