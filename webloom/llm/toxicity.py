"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its lower-case words, hashed into buckets.  The machine adds a weight per bucket and,
for each pair of buckets, the inner product of their factors, so two terms that only together are toxic
(an insult and the mention of a group, say) can raise the score.  Every bucket of the training rows has a
weight and factors: a Gaussian prior on both (L2), weaker where the bucket's own toxic share says much, holds
those with little evidence near zero, so long texts do not collect noise.  A bucket that no training row has counts as zero.

The model is fitted on at most SAMPLE labelled training rows (those with the smallest hashed ids, a
bound that does not depend on the data) and scores every whole text in one pass without a shuffle.

Nulls and empty texts have no terms: their score is the one of the bias.  A null doc_id counts as a
training id and has no label.  Labels other than 0 and 1 are not used; without labels of both kinds the
score is the smoothed share of toxic labels.  Repeated rows are scored each for itself; other input
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map

BUCKETS = 1 << 18
FACTORS = 6
#: Most labelled rows that a fit reads.
SAMPLE = 20_000
#: Priors (L2) of a bucket's weight and factors: the weak one from so many standard errors of its toxic share
#: and rows on, else the strong one.  No bucket is left out.
SURE_Z, SURE_ROWS, SURE_L2, L2 = 4.0, 3, 0.01, 30.0
#: Epochs before the factors move: what single words explain would hide the pairs.
WEIGHTS_FIRST = 30
REJECT = 0.7
EPOCHS, BATCH, RATE, SEED = 100, 256, 0.1, 5
#: Different words that a worker remembers.
MEMORY = 500_000
TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def bucket(term: str) -> int:
    return xxhash.xxh32_intdigest(term) % BUCKETS


@dataclass
class Machine:
    """``place`` maps a bucket to a row of ``weight`` and ``factor``, or -1."""

    bias: float
    place: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Score before the logistic function of n texts; pairs (text, place), rows in order."""
        v = self.factor[places]
        total = np.zeros((n, self.factor.shape[1]))
        for k in range(v.shape[1]):
            total[:, k] = np.bincount(rows, v[:, k], n)
        squares = np.bincount(rows, (v**2).sum(1), n)
        linear = np.bincount(rows, self.weight[places], n)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - squares)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)


def fitted(lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit by AdaGrad on the logistic loss; ``lists`` holds the buckets of each text."""
    n, positive = len(labels), int(labels.sum())
    share = (positive + 1) / (n + 2)
    place = np.full(BUCKETS, -1, np.int64)
    machine = Machine(
        float(np.log(share / (1 - share))), place, np.zeros(0), np.zeros((0, FACTORS))
    )
    if positive == 0 or positive == n:
        return machine
    # Four bytes each: the driver holds all of them.
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in lists])
    buckets = np.concatenate([np.asarray(x, np.int32) for x in lists])
    total = np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    place[used] = np.arange(len(used))
    rng = np.random.default_rng(SEED)
    machine.weight = np.zeros(len(used))
    machine.factor = rng.normal(0, 0.05, (len(used), FACTORS))
    # The prior's part for one occurrence of a bucket: over an epoch each bucket has its prior once.
    toxic = np.bincount(buckets, labels.astype(float)[rows], BUCKETS)[used]
    count, rate = total[used], positive / n
    sure = (count >= SURE_ROWS) & (np.abs(toxic - count * rate) > SURE_Z * np.sqrt(count * rate * (1 - rate)))
    prior = np.where(sure, SURE_L2, L2) / count
    kept = np.split(place.astype(np.int32)[buckets], np.cumsum([len(x) for x in lists[:-1]]))
    del rows, buckets
    slot = np.zeros(len(used), np.int64)
    g_bias, g_weight = 1e-6, np.full(len(used), 1e-6)
    g_factor = np.full((len(used), FACTORS), 1e-4)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            part = order[a : a + BATCH]
            r, p = flat([kept[k] for k in part])
            times = np.bincount(p, minlength=len(used))
            seen = np.flatnonzero(times)
            slot[seen] = np.arange(len(seen))
            at, share = slot[p], times[seen] / len(part) * prior[seen]
            margin = machine.bias + np.bincount(r, machine.weight[p], len(part))
            if epoch >= WEIGHTS_FIRST:
                v = machine.factor[seen]
                f, sums = v[at], np.empty((len(part), FACTORS))
                for k in range(FACTORS):
                    sums[:, k] = np.bincount(r, f[:, k], len(part))
                margin += 0.5 * ((sums**2).sum(1) - np.bincount(r, (f**2).sum(1), len(part)))
            off = (logistic(margin) - labels[part]) / len(part)
            d_bias = off.sum()
            d_weight = np.bincount(at, off[r], len(seen)) + share * machine.weight[seen]
            g_bias += d_bias**2
            g_weight[seen] += d_weight**2
            machine.bias -= RATE * d_bias / np.sqrt(g_bias)
            machine.weight[seen] -= RATE * d_weight / np.sqrt(g_weight[seen])
            if epoch >= WEIGHTS_FIRST:
                rest, d_factor = off[r][:, None] * (sums[r] - f), share[:, None] * v
                for k in range(FACTORS):
                    d_factor[:, k] += np.bincount(at, rest[:, k], len(seen))
                g_factor[seen] += d_factor**2
                machine.factor[seen] -= RATE * d_factor / np.sqrt(g_factor[seen])
    return machine


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labelled rows outside the held-out third."""
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(SAMPLE)
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [sorted({bucket(t) for t in terms(x)}) for x in part.column("text").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "buckets": found}

    # At most SAMPLE rows of two numbers: the text stays where it is.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        arrow_map(joined, run, "doc_id bigint, toxic int, buckets array<int>")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("buckets"))
        .limit(SAMPLE)
        .toArrow()
    )
    column = rows["buckets"].combine_chunks()
    ends = np.cumsum(np.array(pc.list_value_length(column), np.int64))
    lists = np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    del rows
    return fitted(lists, toxic)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from REJECT on) to all columns of ``docs``."""
    kept = docs.drop("score", "predicted")
    column = F.pandas_udf(_scorer(machine), "double")(F.col("text"))
    score = kept.withColumn("score", column)
    return score.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that score below REJECT, with the columns they have."""
    return docs.where(F.pandas_udf(_scorer(machine), "double")(F.col("text")) < REJECT)


def _scorer(machine: Machine):
    import pandas as pd

    known: dict[str, int] = {}

    def score(texts: pd.Series) -> pd.Series:
        lists, margins = [], []
        for text in texts:
            found = set()
            for t in terms(text):
                at = known.get(t)
                if at is None:
                    at = known[t] = int(machine.place[bucket(t)])
                if at >= 0:
                    found.add(at)
            lists.append(np.array(sorted(found), np.int64))
            if len(known) > MEMORY:
                known.clear()
            if len(lists) == 500:
                margins.append(machine.margins(*flat(lists), len(lists)))
                lists = []
        margins.append(machine.margins(*flat(lists), len(lists)))
        return pd.Series(logistic(np.concatenate(margins)))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return score


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )
