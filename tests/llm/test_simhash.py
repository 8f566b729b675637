import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import prose
from webloom.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """Root of each (fingerprint) by comparing all pairs; items: {fingerprint: smallest id}."""
    keys = list(items)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    best = {}
    for k in keys:
        if items[k] is not None:
            best[find(k)] = min(items[k], best.get(find(k), items[k]))
    return {k: best.get(find(k)) for k in keys}


def expected(pairs):
    prints = [plain_fingerprint(t) for _, t in pairs]
    least = {}
    for (i, _), p in zip(pairs, prints):
        known = [x for x in (i, least.get(p)) if x is not None]
        least[p] = min(known) if known else None
    roots = plain_components(least)
    return Counter((i, f"{p:016x}", roots[p]) for (i, _), p in zip(pairs, prints))


@pytest.mark.parametrize("limit", [4096, 3])
def test_odd_rows(odd_docs, odd_pairs, limit):
    got = Counter(tuple(r) for r in S.near_duplicates(odd_docs, limit).collect())
    assert got == expected(odd_pairs)


def test_many_near_copies(make_docs):
    rng = random.Random(2)
    base = prose(7, 400).split()
    pairs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        pairs.append((i, " ".join(words)))
    pairs += [(1000 + i, prose(i, 60)) for i in range(60)]
    got = Counter(tuple(r) for r in S.near_duplicates(make_docs(pairs), 10).collect())
    assert got == expected(pairs)
    assert len({c for *_, c in got}) < 150


def test_no_pair_within_the_distance_is_pruned(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64) * 2 + rng.integers(0, 2, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    rows = [(int(x.view(np.int64)),) for x in np.concatenate((a, b))]
    found = S.links(spark.createDataFrame(rows, "fp bigint")).collect()
    pairs = {frozenset((r.a, r.b)) for r in found}
    want = {frozenset((int(x.view(np.int64)), int(y.view(np.int64)))) for x, y in zip(a, b)}
    assert want <= pairs


def test_representatives(odd_docs, odd_pairs, no_docs):
    kept = S.representatives(odd_docs).collect()
    groups = {c for _, _, c in expected(odd_pairs)}
    # Document 8 stands for two groups: it has two texts.
    assert sorted(r.doc_id for r in kept) == sorted([*groups, 8])
    assert kept[0].fp == "x" and len(kept[0]) == len(odd_docs.columns)
    assert S.representatives(no_docs).count() == 0 and S.near_duplicates(no_docs).count() == 0


def test_a_group_without_ids_keeps_one_row(make_docs):
    kept = S.representatives(make_docs([(None, "a b c"), (None, "a b c"), (None, prose(1, 90))])).collect()
    assert len(kept) == 2
