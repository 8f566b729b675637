import hashlib
import re

from webloom.llm import substring_dedup as S


def expected(pairs):
    order = [2**63 - 1 if i is None else i for i, _ in pairs]
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in pairs]
    first = {}
    for i, w in zip(order, words):
        for k in range(len(w) - S.LENGTH + 1):
            key = tuple(w[k : k + S.LENGTH])
            first[key] = min(i, first.get(key, i))
    out = []
    for (doc, _), i, w in zip(pairs, order, words):
        gone = [False] * len(w)
        for k in range(len(w) - S.LENGTH + 1):
            if first[tuple(w[k : k + S.LENGTH])] < i:
                gone[k : k + S.LENGTH] = [True] * S.LENGTH
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in S.digests(df).collect()), key=str)


def test_odd_rows(odd_docs, odd_pairs):
    assert found(odd_docs) == expected(odd_pairs)


def test_matches_in_different_surroundings(make_docs):
    import random

    rng = random.Random(3)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(40, 120))] for k in range(6)]
    pairs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [f"d{i}x{rng.random()}" for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            words += p[a : a + rng.randint(30, 100)]
        pairs.append((i % 55, " ".join(words)))
    assert found(make_docs(pairs)) == expected(pairs)


def test_texts_keep_their_layout(make_docs, odd_docs):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = make_docs([(1, passage), (2, f"Keep\n\nthis. {passage}  And\tthis.")])
    rows = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert rows[1].text == passage
    assert rows[2].text == "Keep\n\nthis.  And\tthis."
    assert rows[2].n_chars == len(rows[2].text) and rows[2].anchor == "x"
    cut = S.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()


def test_empty(no_docs):
    assert S.digests(no_docs).count() == 0
    assert S.without_repeats(no_docs).count() == 0


def test_equal_windows_have_equal_anchors():
    from tests.llm.conftest import prose

    passage = prose(9, 50).encode().split()
    places = []
    for left, right in ((0, 0), (13, 5), (70, 90)):
        words = [b"l%d" % k for k in range(left)] + passage + [b"r%d" % k for k in range(right)]
        anchor, first, count, _ = S.stretches(words)
        k = max(j for j in range(len(first)) if first[j] <= left)
        places.append(int(anchor[k]))
    assert len(set(places)) == 1
