"""Byte-level BPE: encode texts to token ids and decode ids to bytes.

Merges are picked by a rank queue: one bucket of linked-list positions per merge rank, and a
three-level bitmap over the ranks whose first set bit is the next merge.  All pre-tokens of a batch
that are not known yet share one queue; a pre-token only needs its own merges in rank order, and a
global rank order gives every pre-token just that.  A bucket is merged as a whole; entries whose pair
has changed since they were queued are stale and skipped.  The work for one pre-token of n bytes is
O(n log n), so very long runs without a break are no special case.

Nulls: a null text is an empty text, no tokens.  Empty texts have no tokens.  Rows are independent,
so repeated rows and ids stay as they are; other input columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, slices

NONE = np.int32(2**31 - 1)
#: Known pre-tokens kept by a Python worker; the memory is emptied when it holds more.
MEMORY = 200_000
#: Bytes of text that are split into pre-tokens at once.
SLICE = 6 << 20
#: Tokens that are decoded at once.
PIECES = 1 << 20


class RankBitmap:
    """Set of ranks with find-first-set, 64 ranks to a word, three levels."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def remove(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def first(self) -> int:
        """Smallest rank in the set, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        return b << 6 | (w & -w).bit_length() - 1


def tokens(lines: bytes) -> list[bytes]:
    """Tokens of a rank file (lines of base64 token and rank) by their ids."""
    pairs = [line.split() for line in lines.splitlines() if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for t, r in pairs:
        out[int(r)] = base64.b64decode(t)
    return out


class Ranks:
    """What merging needs of a vocabulary: the ranks of tokens and of pairs of tokens."""

    def __init__(self, lines: bytes):
        self.token = tokens(lines)
        self.rank_of = {t: r for r, t in enumerate(self.token) if t}
        self.byte = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for t, r in self.rank_of.items():
            for cut in range(1, len(t)):
                a, b = self.rank_of.get(t[:cut]), self.rank_of.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair = np.append(np.array(keys, np.int64)[order], np.int64(2**63 - 1))
        self.pair_rank = np.append(np.array(ranks, np.int32)[order], NONE)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NONE)

    def merge(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of every piece; a piece that is a token itself stays whole."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        open_ = []
        for k, p in enumerate(pieces):
            whole = self.rank_of.get(p)
            if whole is None and p:
                open_.append(k)
            else:
                out[k] = np.array([] if whole is None else [whole], np.int32)
        if open_:
            ids, ends = self._merge_all([pieces[k] for k in open_])
            for k, part in zip(open_, np.split(ids, ends[:-1])):
                out[k] = part
        return out

    def _merge_all(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the end of each piece in them."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        stop = np.cumsum([len(p) for p in pieces])
        n = len(raw)
        # One position more stands for "no neighbour".
        token = np.append(self.byte[raw], np.int32(0))
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[stop - 1] = n
        before[0] = n
        before[stop[:-1]] = n
        after[n] = before[n] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = np.full(n + 1, NONE, np.int32)
        first = np.flatnonzero(after[:n] < n)
        rank[first] = self.ranks_of(token[first], token[first + 1])

        bitmap = RankBitmap(len(self.token))
        bucket: dict[int, list[np.ndarray]] = {}

        def queue(at: np.ndarray) -> None:
            r = rank[at]
            fit = r != NONE
            if not fit.any():
                return
            at, r = at[fit], r[fit]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if k in bucket:
                    bucket[k].append(part)
                else:
                    bucket[k] = [part]
                    bitmap.add(k)

        queue(first)
        while (r := bitmap.first()) >= 0:
            bitmap.remove(r)
            held = bucket.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]  # the others are stale
            if len(at) > 1:
                # Of overlapping equal pairs every second one merges, from the left.
                touch = np.append(False, after[at[:-1]] == at[1:])
                if touch.any():
                    k = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(touch, 0, k))
                    at = at[(k - start) % 2 == 0]
            elif not len(at):
                continue
            gone = after[at]
            right = after[gone]
            token[at] = r
            after[at] = right
            before[right] = at
            before[n] = n
            alive[gone] = False
            rank[gone] = NONE
            changed = np.unique(np.concatenate((at, before[at])))
            if changed[-1] == n:
                changed = changed[:-1]
            follow = after[changed]
            rank[changed] = np.where(
                follow < n, self.ranks_of(token[changed], token[follow]), NONE
            )
            queue(changed)
        count = np.cumsum(alive[:n])
        return token[:n][alive[:n]], count[stop - 1]


_KNOWN: dict[int, tuple[Ranks, dict[str, bytes]]] = {}


def _worker(lines: bytes) -> tuple[Ranks, dict[str, bytes]]:
    key = hash(lines)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = (Ranks(lines), {})
    return _KNOWN[key]


def id_bytes(texts: Sequence[str], lines: bytes, pattern) -> list[bytes]:
    """Ids of every text as little-endian 32-bit numbers."""
    ranks, known = _worker(lines)
    if len(known) > MEMORY:
        known.clear()
    split = [pattern.findall(t) for t in texts]
    new = list({p for pieces in split for p in pieces if p not in known})
    for p, ids in zip(new, ranks.merge([p.encode() for p in new])):
        known[p] = ids.astype("<i4").tobytes()
    return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens.

    ``vocabulary`` is the path of a rank file on the driver; its bytes (a vocabulary, so of a fixed
    size) travel with the function.
    """
    with open(vocabulary, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]):
        cut = regex.compile(pattern)
        for part in slices(batches, "text", SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            blobs = id_bytes(texts, lines.value, cut)
            ends = np.cumsum([0] + [len(b) // 4 for b in blobs]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
            yield {
                "doc_id": part.column("doc_id"),
                "ids": pa.ListArray.from_arrays(pa.array(ends), values),
            }

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>")


class Decoder:
    """Bytes of ids: the bytes of all tokens in a row, and where each token lies in them."""

    def __init__(self, token: Sequence[bytes]):
        self.size = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(token), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), PIECES):
            part = ids[a : a + PIECES]
            size = self.size[part]
            end = np.cumsum(size)
            at = np.arange(end[-1]) + np.repeat(self.start[part] - (end - size), size)
            out.append(self.raw[at].tobytes())
        return b"".join(out)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the tokens in ``ids``; null ids give no bytes."""
    with open(vocabulary, "rb") as file:
        lines = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]):
        bytes_of = Decoder(tokens(lines.value))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column("ids")
                out = [bytes_of(x.values.to_numpy()) if x.is_valid else b"" for x in lists]
                yield {"doc_id": part.column("doc_id"), "ids": lists, "decoded": out}

    return arrow_map(
        encoded.select("doc_id", "ids"), run, "doc_id bigint, ids array<int>, decoded binary"
    )


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    both = decode(encode(docs, vocabulary, pattern), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
