import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from webloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LINES = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_random_texts_like_the_library(plain):
    rng = random.Random(1)
    alphabets = ["abc", "tionther ", "éñüß ", " \n\t", "0123.,-", "日本語 ", "aA' s"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 400))) for _ in range(400)]
    texts += ["a" * 30_000, "ab" * 20_000, "".join(rng.choices("étiono", k=30_000))]
    cut = regex.compile(public_tokenizers.PATTERN)
    for text, blob in zip(texts, B.id_bytes(texts, LINES, cut)):
        assert np.frombuffer(blob, "<i4").tolist() == plain.encode_ordinary(text)


def test_bitmap_finds_the_first():
    rng = random.Random(2)
    bitmap, members = B.RankBitmap(60_000), set()
    for _ in range(3000):
        r = rng.randrange(60_000)
        if r in members:
            bitmap.remove(r)
            members.discard(r)
        else:
            bitmap.add(r)
            members.add(r)
        assert bitmap.first() == min(members, default=-1)


def test_odd_rows(odd_docs, odd_pairs, plain):
    rows = B.digests(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in odd_pairs:
        ids = plain.encode_ordinary(t or "")
        text = " ".join(map(str, ids))
        want.append(
            (i, len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        )
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {bytes(r.decoded) for r in B.decode(df, PATH).collect()} == {b""}


def test_empty(no_docs):
    assert B.digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
