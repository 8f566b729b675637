import zlib
from collections import Counter, defaultdict

from webloom.llm import sharding


def test_odd_rows_and_slots(odd_docs, odd_pairs):
    rows = sharding.digests(odd_docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_pairs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_and_copies_stay_together(make_docs):
    pairs = [(k, f"text {k} " * (k % 7 + 1)) for k in range(6000)]
    pairs += [(10_000 + k, "copy") for k in range(20)]
    rows = sharding.digests(make_docs(pairs)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes.values()) < 0.01 * mean
    assert len({r.shard for r in rows if r.doc_id >= 10_000}) == 1


def test_one_text_in_most_rows(make_docs):
    rows = sharding.digests(make_docs([(k, "the same text") for k in range(3000)])).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) < 10


def test_repeated_rows_are_cut_too(make_docs):
    rows = sharding.digests(make_docs([(1, "one row")] * 1600)).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts.values()) == {100}


def test_many_parts(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 1000)
    pairs = [(k, f"text {k} " * 5) for k in range(2000)]
    rows = sharding.shard(make_docs(pairs)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == 2000 and rows[0].id == "x"


def test_few_probes_for_many_splitters(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 100)
    monkeypatch.setattr(sharding, "MOST_PARTS", 8)
    monkeypatch.setattr(sharding, "MOST_PROBES", 64)
    rows = sharding.shard(make_docs([(k, f"text {k}") for k in range(3000)])).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) < 12
    assert len({(r.shard, r.slot) for r in rows}) == 3000


def test_empty(no_docs):
    assert sharding.digests(no_docs).count() == 0
