import hashlib
import re

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from webloom.llm import fill_middle as M


def plainly(doc_id, text):
    """The contract by findall, one unit at a time."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    marks = any(m in text for m in ("<P>", "<S>", "<M>"))
    if not text or marks or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pairs(odd_pairs):
    tricky = ["<P", "<<P> x", "a <S> b", "x<M>", "<", "<<<>>>", "é<P\n>", "a" * 300_000, " \n" * 100_000, "\x00b\x00"]
    return odd_pairs + [(1000 + k, tricky[k % len(tricky)] + "|" * (k // 10)) for k in range(60)]


def test_like_findall(make_docs, pairs):
    got = M.digests(make_docs(pairs)).collect()
    want = []
    for i, t in pairs:
        *head, out = plainly(i, t)
        want.append((i, *head, sha(out), sha(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_round_trip(make_docs, pairs):
    rows = M.transformed(make_docs(pairs)).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = rows.collect()
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in pairs)
    assert sorted(r.output for r in got) == sorted(plainly(i, t)[-1] for i, t in pairs)


def test_million_units():
    text = "ab, " * 400_000
    n, form, a, b, out = M.rearranged(text, 3, regex.compile(M.UNITS))
    assert (n, form, a, b, out) == plainly(3, text) and n == 1_200_000


def test_sql(spark, make_docs, pairs):
    rows = [(i, t) for i, t in pairs if "\x00" not in (t or "")]
    frame = make_docs(rows).select("doc_id", "text").toArrow()
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(M.SQL).fetchall()
    got = map(tuple, M.digests(make_docs(rows)).collect())
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(no_docs):
    assert M.digests(no_docs).count() == 0
