"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit needs the lengths only, and there are at most ``capacity`` different ones.  So the driver
packs the histogram of lengths, longest first: a segment tree over remaining capacities finds the
tightest open sequences in logarithmic time, and as many pieces of one length as there are such
sequences go there at once.  That gives what packing piece by piece gives, as pieces of equal length
are interchangeable, and its work does not grow with the number of documents.  Each piece then takes its
place by its rank among the pieces of its length, which tasks number in parts.

Nulls: a null text is an empty text and, like any document, has its end token.  A null doc_id is kept;
repeated rows are packed each for itself.  Other input columns are not read.  The literal of an added token
(``<|endoftext|>``) has the id of that token, as in the tokenizers library.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm.common import arrow_map, stored

CAPACITY = 1024
END = 2
#: Pieces that a numbered part holds on average.
PART = 50_000
#: Splits a text for byte-level BPE vocabularies (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_ranks(tokenizer: bytes) -> dict[bytes, int]:
    """Ranks of a byte-level BPE ``tokenizer.json``; special tokens are left out.

    Such files write a byte as a printable character: printable Latin-1 characters stand for
    themselves, and the other bytes, in order, for the characters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    content = json.loads(tokenizer)
    special = {t["content"] for t in content["added_tokens"]}
    return {
        bytes(byte[c] for c in token): rank
        for token, rank in content["model"]["vocab"].items()
        if token not in special
    }


def added_tokens(tokenizer: bytes) -> dict[str, int]:
    """Added tokens of a ``tokenizer.json``: texts are cut at them before anything else."""
    added = json.loads(tokenizer)["added_tokens"]
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token with options: {t['content']}")
    return {t["content"]: t["id"] for t in added}


_ENCODER: dict[int, Callable[[str], list[int]]] = {}


def _encoder(tokenizer: bytes) -> Callable[[str], list[int]]:
    """Ids as the tokenizers library gives them without special tokens around the text.

    tiktoken gives the same ids in a quarter of the time; a text it fails on goes to the library itself.
    """
    key = hash(tokenizer)
    if key not in _ENCODER:
        ranks, special = byte_level_ranks(tokenizer), added_tokens(tokenizer)
        encoding = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        quick = partial(encoding.encode, allowed_special="all", disallowed_special=())

        @lru_cache(1)
        def library() -> Tokenizer:
            return Tokenizer.from_str(tokenizer.decode())

        def encode(text: str) -> list[int]:
            try:
                return quick(text)
            except ValueError:
                # Its pattern gives up on very long white space.
                return library().encode(text, add_special_tokens=False).ids

        _ENCODER[key] = encode
    return _ENCODER[key]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first one may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = range(first, n, capacity)
    return [(0, first)] * (first > 0) + [(s, capacity) for s in starts]


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents."""
    with open(tokenizer, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]):
        encode = _encoder(content.value)
        rows: dict[str, list] = {n: [] for n in ("piece", "start", "length", "ids_crc32", "ids")}
        for batch in batches:
            at: list[int] = []
            for k in range(batch.num_rows):
                ids = np.array([*encode(batch.column("text")[k].as_py() or ""), END], "<u4")
                for p, (start, length) in enumerate(cuts(len(ids))):
                    part = ids[start : start + length]
                    at.append(k)
                    rows["piece"].append(p)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        rows["ids"].append(part.astype(np.int32))
                if len(at) > 2000 or k == batch.num_rows - 1:
                    yield {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), **rows}
                    at = []
                    rows = {n: [] for n in rows}

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return arrow_map(
        docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids
    )


class Capacities:
    """Segment tree over remaining capacities: which of them has an open sequence."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        at = self.leaves + remaining
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int:
        """Smallest capacity of at least ``length`` that is open; -1 if there is none."""
        at = self.leaves + length
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for pieces, given how many there are of each length.

    Rows (length, first rank, number, first sequence, offset): pieces of a length with ranks from
    ``first rank`` on go to the sequences from ``first sequence`` on, one each, at ``offset``.
    """
    tree = Capacities(capacity)
    open_: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    plan, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, number = capacity, fresh, left
            else:
                first, number = open_[room].popleft()
            # A sequence just used is the tightest again as long as another piece fits into it.
            fits = min(room // length, left)
            n = min(number, left // fits)
            if room == capacity:
                fresh += n
            elif number > n:
                open_[room].appendleft((first + n, number - n))
            elif not open_[room]:
                tree.set(room, False)
            for k in range(fits):
                plan.append((length, rank, n, first, capacity - room + k * length))
                rank += n
            left -= n * fits
            room -= fits * length
            if room:
                open_[room].append((first, n))
                tree.set(room, True)
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (see ``pieces``)."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    parts = max(1, -(-sum(counts.values()) // PART))
    row = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    dealt = found.withColumn("_part", F.pmod(F.xxhash64(*row), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    number = F.row_number().over(W.partitionBy("length", "_part").orderBy(*row))
    ranked = (
        dealt.withColumn("_number", number)
        .join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_number") - 1 + F.col("_before"))
        .drop("_number", "_before", "_part")
    )
    # Rows are found by length and rank: one sorted number for both, within 63 bits.
    shift = np.int64(52)
    key = plan[:, 0] << shift | plan[:, 1]
    order = np.argsort(key)
    key, start, first, offset = key[order], plan[order, 1], plan[order, 3], plan[order, 4]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, length << shift | rank, "right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["sequence_id"] = first[at] + rank - start[at]
            columns["offset"] = offset[at]
            yield columns

    names = [f for f in found.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    ranked = ranked.select(*[f.name for f in names], "_rank")
    return arrow_map(ranked, run, schema + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents."""
    return pack(stored(pieces(docs, tokenizer, with_ids), "pieces"))


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces with their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids")
    )
