import random
import tracemalloc

import numpy as np

from webloom.llm import toxicity as T


def labelled(n=1500, seed=1):
    """Texts that are toxic if an insult stands beside the mention of a group; each alone is not."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text = rng.choices(words, k=30) + ["vermin"] * insult + ["people"] * group
        rng.shuffle(text)
        out.append((i, " ".join(text), int(insult and group)))
    return out


def test_pairs_are_learned():
    rows = labelled()
    lists = [np.array(sorted({T.bucket(t) for t in T.terms(x)})) for _, x, _ in rows]
    labels = np.array([y for *_, y in rows])
    train = np.array([not T.held_out(i) for i, *_ in rows])
    machine = T.fitted([x for x, k in zip(lists, train) if k], labels[train])
    kept = [machine.place[x][machine.place[x] >= 0] for x, k in zip(lists, train) if not k]
    score = T.logistic(machine.margins(*T.flat(kept), len(kept)))
    assert ((score >= 0.7) == (labels[~train] == 1)).mean() > 0.97


def test_query_columns_and_odd_rows(spark, make_docs, odd_docs):
    rows = labelled(600)
    labels = spark.createDataFrame(
        [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None), (4, 0, 7)],
        "doc_id bigint, quality int, toxic int",
    )
    docs = make_docs([(i, t) for i, t, _ in rows]).union(odd_docs)
    out = T.scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    found = out.collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == T.held_out(r.doc_id)


def test_held_out_labels_are_not_used(spark, make_docs):
    rows = labelled(300)
    docs = make_docs([(i, t) for i, t, _ in rows])
    first = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = spark.createDataFrame(
        [(i, 1 - y if T.held_out(i) else y) for i, _, y in rows], "doc_id bigint, toxic int"
    )
    assert sorted(T.scores(docs, first).collect()) == sorted(T.scores(docs, turned).collect())


def test_without_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in T.scores(odd_docs, labels).collect()} == {0.5}
    assert T.scores(no_docs, labels).count() == 0


def test_clashing_columns_stay(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = T.scored(odd_docs, T.fit(odd_docs, labels))
    assert set(out.columns) == set(odd_docs.columns) and dict(out.dtypes)["score"] == "double"


def test_a_pair_without_significant_margins_is_learned():
    """Two words in 5 % of rows each, toxic only together; a third one is toxic alone."""
    rng = random.Random(3)
    words = [f"n{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = []
    for i in range(21_000):
        text, toxic = rng.choices(words, k=20), rng.random() < 0.1
        at = rng.random()
        pair = at < 0.0055
        text += ["vermin"] * toxic
        text += ["alpha"] * (pair or (not toxic and at < 0.05))
        text += ["beta"] * (pair or (not toxic and 0.05 <= at < 0.0945))
        rows.append((i, text, int(toxic or pair)))
    lists = [np.array(sorted({T.bucket(t) for t in x})) for _, x, _ in rows]
    labels = np.array([y for *_, y in rows])
    train = np.array([not T.held_out(i) for i, *_ in rows])
    for word in ("alpha", "beta"):
        has = train & np.array([word in x for _, x, _ in rows])
        rate = labels[train].mean()
        assert abs(labels[has].mean() - rate) < 4 * np.sqrt(rate * (1 - rate) / has.sum())
    machine = T.fitted([x for x, k in zip(lists, train) if k], labels[train])
    kept = [machine.place[x][machine.place[x] >= 0] for x in lists]
    score = T.logistic(machine.margins(*T.flat(kept), len(kept)))
    alone = np.array([("alpha" in x) != ("beta" in x) and "vermin" not in x for _, x, _ in rows])
    both = np.array(["alpha" in x and "beta" in x and "vermin" not in x for _, x, _ in rows])
    print(score[both & ~train].mean(), score[alone & ~train].mean())
    assert score[both & ~train].mean() > 0.3
    assert score[alone & ~train].mean() < 0.05


def test_fit_holds_the_terms_once():
    """Terms of all rows have four bytes on the driver, besides what numpy needs for a sum over them."""
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 3000, 200)).astype(np.int32) for _ in range(4000)]
    labels = (np.arange(4000) % 3 == 0).astype(np.int64)
    terms = sum(map(len, lists))
    tracemalloc.start()
    T.fitted(lists, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 38 * terms
