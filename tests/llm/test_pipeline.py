"""The pipeline against one that compares everything with everything."""

import random
from collections import Counter

import public_tokenizers
import tokenizers

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_near_copies import changed, plain_kept
from webloom.llm import packing
from webloom.llm import queries as Q
from webloom.llm import toxicity as T


def corpus():
    passage = prose(50, 70)
    pairs = [(k, prose(k, 40 + k % 90)) for k in range(200)]
    pairs += [(300 + k, prose(900 + k, 60) + " vermin scum " + prose(k, 30)) for k in range(60)]
    pairs += [(400 + k, pairs[k][1]) for k in range(15)]
    rng = random.Random(4)
    pairs += [(415 + k, changed(pairs[80 + k][1].split(), 1, rng)) for k in range(16)]
    pairs += [(500 + k, f"{prose(700 + k, 30)} {passage} {prose(800 + k, 20)}") for k in range(12)]
    return pairs + [(600, ""), (601, None)]


def test_stages(spark, make_docs, tmp_path):
    pairs = corpus()
    make_docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("vermin" in (t or ""))) for i, t in pairs]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)

    # The classifier itself has tests of its own: here its decisions.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = T.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r.doc_id for r in T.scored(docs, machine).where("predicted = 1").collect()}
    assert rejected == {i for i, y in labels if y}
    kept = [(i, t) for i, t in pairs if i not in rejected]

    alone = set(plain_kept(kept))
    kept = [(i, t) for i, t in kept if i in alone]
    assert 415 not in alone and 430 in alone

    first, cleaned = {}, {}
    for i, t in sorted(kept):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        cleaned[i] = [x for x, g in zip(w, gone) if not g]

    stage = docs
    for n, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage = function(spark, stage, folder)
        assert stage.columns == docs.columns
    assert {r.doc_id: (r.text or "").split() for r in stage.collect()} == cleaned

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = tokenizers.Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in stage.collect()}
    want = Counter()
    for i, t in texts.items():
        n = len(encode.encode(t, add_special_tokens=False).ids) + 1
        for p, (start, size) in enumerate(packing.cuts(n)):
            want[i, p, start, size] += 1
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == want


def test_own_columns_of_the_input_stay(spark, make_docs, tmp_path):
    rows = make_docs([(1, "a b"), (2, None), (3, "c")])
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.toxic_documents(spark, rows, str(tmp_path))
    assert stage.columns == rows.columns and sorted(stage.collect(), key=str) == sorted(rows.collect(), key=str)


def test_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(Q.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
