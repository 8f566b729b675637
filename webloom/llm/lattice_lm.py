"""Document likelihood by a subword lattice under a unigram vocabulary.

The pieces of an existing vocabulary are the arcs of a lattice over each word (with the space before it).
The probability of a word is the sum over all segmentations, by the forward recursion in log space;
a text's is the product over its words and its end.  The vocabulary comes with an order only, so its
probabilities start from that order and are re-estimated on the training words by expectation
maximisation (forward-backward over the same lattice, weighted by the words' counts).

Counts of words are exact.  Documents are dealt into blocks of bounded size; a block sends its different
words, not its tokens, and gets back what it needs to know of them, so neither the vocabulary of the
corpus nor a popular word meets in one place.  What passes the driver are the counts of the pieces of the
given vocabulary.

Nulls and empty texts have no words and one end.  A null doc_id counts as training.  Without training
rows every count is zero and the scores come from the order of the vocabulary alone.  Repeated rows are
counted and scored each for itself; other input columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, stored

#: Bytes of text in a block.
BLOCK = 16 << 20
ROUNDS = 3
#: Expected count that every piece has beforehand.
PRIOR = 0.01
FOLDS, HELD_OUT = 7, 2


class Lattice:
    """Pieces of a rank file as a trie; pieces with white space inside are left out."""

    def __init__(self, lines: bytes):
        ranked = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, lines.splitlines()))
        self.pieces = [t for _, t in ranked if len(t) == 1 or t[1:].split() == [t[1:]]]
        child: dict[tuple[int, int], int] = {}
        ends = [-1]
        for k, piece in enumerate(self.pieces):
            state = 0
            for b in piece:
                following = child.get((state, b))
                if following is None:
                    following = child[state, b] = len(ends)
                    ends.append(-1)
                state = following
            ends[state] = k
        keys = np.array([s << 8 | b for s, b in child], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.following = np.append(np.array(list(child.values()), np.int64)[order], 0)
        self.ends = np.array(ends)

    def arcs(self, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of all arcs over words of one length, by start."""
        n, length = table.shape
        for i in range(length):
            rows, state = np.arange(n), np.zeros(n, np.int64)
            for j in range(i, length):
                key = state << 8 | table[rows, j]
                at = np.searchsorted(self.keys, key)
                good = self.keys[at] == key
                rows, state = rows[good], self.following[at[good]]
                if not len(rows):
                    break
                piece = self.ends[state]
                found = piece >= 0
                if found.any():
                    yield i, j + 1, rows[found], piece[found]

    def forward(self, table: np.ndarray, logp: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log of the sum over all segmentations of each prefix; ``keep`` collects the arcs."""
        alpha = np.full((len(table), table.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for i, j, rows, piece in self.arcs(table):
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + logp[piece])
            if keep is not None:
                keep.append((i, j, rows, piece))
        return alpha

    def expected(self, table: np.ndarray, counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over words with ``counts``."""
        arcs: list = []
        alpha = self.forward(table, logp, arcs)
        beta = np.full(alpha.shape, -np.inf)
        beta[:, -1] = 0
        uses = [np.zeros(0)]
        for i, j, rows, piece in reversed(arcs):
            tail = logp[piece] + beta[rows, j]
            uses.append(np.exp(alpha[rows, i] + tail - alpha[rows, -1]) * counts[rows])
            beta[rows, i] = np.logaddexp(beta[rows, i], tail)
        # Summed up once: an array of all pieces for each arc would be most of the work.
        used = [np.zeros(0, np.int64), *(piece for *_, piece in reversed(arcs))]
        return np.bincount(np.concatenate(used), np.concatenate(uses), len(logp))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with a space before them, as tables of bytes of one length: (places, table)."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts):
        for a in range(0, len(places), 20_000):
            part = places[a : a + 20_000]
            joined = b"".join(b" " + words[k] for k in part.tolist())
            yield part, np.frombuffer(joined, np.uint8).reshape(len(part), -1)


@lru_cache(2)
def lattice_of(lines: bytes) -> Lattice:
    return Lattice(lines)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, train, text), dealt by block, which holds about BLOCK bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    number = max(1, -(-total // BLOCK))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).cast("int").alias("block"),
        "doc_id",
        (fold != HELD_OUT).alias("train"),
        "text",
    )


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def block_words(dealt: DataFrame) -> DataFrame:
    """(block, word, n): the different words of each block, n of them in training rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        seen: set[bytes] = set()
        now = None

        def out():
            words = [*counts, *(seen - counts.keys())]
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield {
                    "block": np.full(len(part), now, np.int32),
                    "word": pa.array(part, pa.binary()),
                    "n": [counts.get(w, 0) for w in part],
                }
            counts.clear()
            seen.clear()

        for batch in batches:
            block, train, text = (batch.column(c) for c in ("block", "train", "text"))
            for k in range(batch.num_rows):
                if block[k].as_py() != now:
                    yield from out()
                    now = block[k].as_py()
                found = words_of(text[k].as_py())
                if train[k].as_py():
                    counts.update(found)
                else:
                    seen.update(found)
        yield from out()

    ordered = dealt.repartition("block").sortWithinPartitions("block")
    return arrow_map(ordered, run, "block int, word binary, n bigint")


def scores(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Base score and lattice score of every document; see the columns below."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        lines = spark.sparkContext.broadcast(file.read())
    dealt = blocks(docs)
    local = stored(block_words(dealt), "block-words")
    words = stored(local.groupBy("word").agg(F.sum("n").alias("c")), "words")
    row = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("bigint")).alias("v")).first()
    ends = dealt.where("train").count()
    total = (row["n"] or 0) + ends
    distinct = (row["v"] or 0) + (ends > 0)

    logp, end = estimated(words, lines, ends)

    def known(batches: Iterator[pa.RecordBatch]):
        lattice = lattice_of(lines.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                out = np.zeros(batch.num_rows)
                for places, table in by_length(batch.column("word").to_pylist()):
                    out[places] = lattice.forward(table, logp)[:, -1]
                yield {
                    "word": batch.column("word"),
                    "c": batch.column("c"),
                    "score": out / np.log(10),
                }

    table = arrow_map(words, known, "word binary, c bigint, score double")
    answers = local.select("block", "word").join(table, "word")
    below = total + distinct + 1  # N + 1 * (V + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # What is known of a different word is worked out once, and looked up by its place for each occurrence.
        place = {w: k for k, w in enumerate(right.column("word").to_pylist())}
        c, lattice = (right.column(n).to_numpy() for n in ("c", "score"))
        plain, seen = np.log10((c + 1) / below), c > 0
        end_base = float(np.log10((ends + 1) / below))
        rows = []
        for text in left.column("text"):
            words = words_of(text.as_py())
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            base = float(plain[at].sum()) + end_base
            known = int(np.count_nonzero(seen[at])) + (ends > 0)
            rows.append((len(words) + 1, known, total, base, float(lattice[at].sum()) + end))
        found = zip(*rows) if rows else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        arrays = [pa.array(x, kind) for x, kind in zip(found, kinds)]
        held = pc.invert(left.column("train"))
        return pa.Table.from_arrays([left.column("doc_id"), held, *arrays], names=names)

    names = "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            score,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        )
    )


def estimated(words: DataFrame, lines, ends: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces, and the log10 probability of an end."""
    pieces = lattice_of(lines.value).pieces
    # The order of a vocabulary is about that of its use.
    counts = 1 / (np.arange(len(pieces)) + 100.0)
    trained = words.where("c > 0")
    for _ in range(ROUNDS if ends else 0):
        logp = np.log(counts / counts.sum())
        counts = _expected(trained, lines, logp) + PRIOR
    if not ends:
        counts /= counts.sum()
    total = counts.sum() + ends + PRIOR
    return np.log(counts / total), float(np.log10((ends + PRIOR) / total))


def _expected(words: DataFrame, lines, logp: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]):
        lattice = lattice_of(lines.value)
        out = np.zeros(len(logp))
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                c = batch.column("c").to_numpy().astype(float)
                for places, table in by_length(batch.column("word").to_pylist()):
                    out += lattice.expected(table, c[places], logp)
        used = np.flatnonzero(out)
        yield {"piece": used, "n": out[used]}

    found = arrow_map(words, run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    out = np.zeros(len(logp))
    for r in found.collect():  # one row per piece of the vocabulary
        out[r["piece"]] = r["n"]
    return out
