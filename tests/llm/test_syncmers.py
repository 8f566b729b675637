import hashlib

import numpy as np

from tests.llm.conftest import prose
from webloom.llm import syncmers as S


def expected(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), p[1] is not None, p[1] or ""))
    texts = [t or "" for _, t in order]
    out = []
    for k, (i, _) in enumerate(order):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, pairs):
    rows = S.fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == expected(pairs)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    return rows


def test_odd_rows(odd_docs, odd_pairs):
    rows = check(odd_docs, odd_pairs)
    prints = {}
    for r in rows:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert prints[0] == {""}


def test_many_parts(make_docs, monkeypatch):
    monkeypatch.setattr(S, "PART", 300)
    monkeypatch.setattr(S, "MOST_PARTS", 23)
    pairs = [(k * 7 % 101, prose(k, 1 + k % 30)) for k in range(101)]
    rows = check(make_docs(pairs), pairs)
    assert np.mean([r.near_edited for r in rows if r.n_chars > 60]) > 0.4


def test_one_row_is_its_own_next(make_docs):
    row = S.fingerprints(make_docs([(1, prose(1, 40))])).first()
    assert row.near_next == 1.0


def test_closed_syncmers_by_definition():
    text = prose(3, 100)
    at, h = S.closed_syncmers(text)
    seen = dict(zip(at.tolist(), h.tolist()))

    def inner(s):
        points = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        up, _ = S._powers(len(points))
        return int(S._mixed(np.array([(points * up[: len(points)]).sum()], np.uint64))[0])

    for p in range(len(text) - S.K + 1):
        kmer = text[p : p + S.K]
        values = [inner(kmer[j : j + S.S]) for j in range(S.K - S.S + 1)]
        assert (min(values) in (values[0], values[-1])) == (p in seen)
    # Free of context: a passage has the same anchors elsewhere.
    shifted, g = S.closed_syncmers("###" + text)
    assert {(a + 3, x) for a, x in seen.items()} <= set(zip(shifted.tolist(), g.tolist()))


def test_anchor_rows(odd_docs, no_docs):
    assert S.anchors(odd_docs).where("doc_id = 4").count() == 0
    assert S.anchors(odd_docs).where("doc_id = 6").count() > 1000
    assert S.anchors(no_docs).count() == 0


def test_empty(no_docs):
    assert S.fingerprints(no_docs).count() == 0


def likeness_by_definition(a, b):
    """Dice share of the different k-mers that are anchors, as strings."""
    x, y = ({t[p : p + S.K] for p in S.closed_syncmers(t)[0].tolist()} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_likeness_of_long_texts_is_exact(make_docs):
    words = [prose(k, 20000).split() for k in range(4)]
    # The next document of 4 shares 5 % with it, that of 3 nothing, that of 2 half.
    words[2][:1000] = words[3][:1000]
    words[0][7000:17000] = words[1][:10000]
    texts = {k + 1: " ".join(w) for k, w in enumerate(words)}
    rows = {r.doc_id: r for r in S.fingerprints(make_docs(list(texts.items()))).collect()}
    for k, text in texts.items():
        following = texts[k - 1 or 4]
        edited = S.edited(text, following)
        assert rows[k].near_next == likeness_by_definition(text, following)
        assert rows[k].near_edited == likeness_by_definition(text, edited)
        # Fingerprints grow with the text and show the part that the edit has left, in place.
        at, h = S.closed_syncmers(text)
        kept = len(rows[k].fingerprint) // 16
        assert kept == np.count_nonzero(h < 2**64 // S.ONE_IN) > len(h) / S.ONE_IN / 2
        same = S.matched(rows[k].fingerprint, rows[k].edited_fingerprint)
        left = len(text) - len(text) // 3
        assert sum(i == j and i < left for i, j in same) > kept / 3


def test_matched_shows_a_moved_passage():
    passage = prose(5, 400)
    a, b = f"{prose(6, 50)} {passage}", f"{prose(7, 90)} {passage} {prose(8, 30)}"
    shift = b.index(passage) - a.index(passage)
    same = S.matched(S.written(*S.placed(a)), S.written(*S.placed(b)))
    assert len(same) > 10 and sum(j - i == shift for i, j in same) > 0.9 * len(same)


def test_fingerprint_of_short_and_plain_texts():
    assert S.written(*S.placed("")) == "" and S.matched("", "") == []
    assert len(S.written(*S.placed("ab"))) == 16
    # Ties: every k-mer of equal letters is an anchor with the same hash.
    at, h = S.placed("a" * 100)
    assert len(at) == 81 and len(S.distinct(h)) == 1 and S.matched(*[S.written(at, h)] * 2) in ([], [(0, 0)])


def test_fingerprints_hold_every_anchor(make_docs):
    """All hashes and positions can be read from them, and so can how alike two texts are."""
    texts = {k: prose(k, n) for k, n in enumerate((3, 40, 900, 6000))}
    rows = {r.doc_id: r for r in S.fingerprints(make_docs(list(texts.items()))).collect()}
    prints = {k: S.parsed(r.fingerprint) for k, r in rows.items()}
    for k, text in texts.items():
        following = (k - 1) % len(texts)
        for found, want in ((prints[k], S.placed(text)), (S.parsed(rows[k].edited_fingerprint), S.placed(S.edited(text, texts[following])))):
            assert np.array_equal(found[0], want[1]) and np.array_equal(found[1], want[0])
        assert rows[k].near_next == S.likeness(S.distinct(prints[k][0]), S.distinct(prints[following][0]))
        assert rows[k].near_edited == S.likeness(S.distinct(prints[k][0]), S.distinct(S.parsed(rows[k].edited_fingerprint)[0]))
