"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Every adjacent pair whose joined bytes
are in the vocabulary waits in the bucket of its merge rank.  A bitmap over
ranks, with a summary bitmap over its words and another over those, finds the
lowest waiting rank with three find-first-set steps however many pairs wait.
Entries that a neighbouring merge made stale are recognised and skipped when
they come up.  A pre-token of n bytes takes O(n log n) steps, so very long
pre-tokens cost no more per byte than short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import list_column, map_batches

#: Encoded pre-tokens a Python worker remembers, and the longest that it does.
CACHE_ENTRIES = 1_000_000
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line has a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within a rank.  Empty again after ``drain``."""

    __slots__ = ("low", "mid", "top", "buckets")

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def drain(self) -> Iterator[tuple[int, int]]:
        """Take out one entry after the other; entries may be pushed between two."""
        low, mid, buckets = self.low, self.mid, self.buckets
        while top := self.top:
            block = (top & -top).bit_length() - 1
            middle = mid[block]
            word = block << 6 | (middle & -middle).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = word << 6 | first.bit_length() - 1
            bucket = buckets[rank]
            position = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[word] = bits = bits ^ first
                if not bits:
                    mid[block] = middle = middle ^ 1 << (word & 63)
                    if not middle:
                        self.top = top ^ 1 << block
            yield rank, position


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token; ``queue`` is empty before and after."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that starts here; 0 where none does
    left = list(range(-1, n - 1))
    find = ranks.get
    waiting = [-1] * n  # rank of the pair that starts here
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            queue.push(rank, i)
    for rank, i in queue.drain():
        if waiting[i] != rank:  # stale: the pair has gone or has another rank now
            continue
        middle = ends[i]
        end = ends[i] = ends[middle]
        ends[middle] = 0
        waiting[middle] = -1
        waiting[i] = -1
        if end < n:
            left[end] = i
            joined = find(piece[i : ends[end]])
            if joined is not None:
                waiting[i] = joined
                queue.push(joined, i)
        before = left[i]
        if before >= 0:
            joined = find(piece[before:end])
            if joined is None:
                waiting[before] = -1
            elif waiting[before] != joined:
                waiting[before] = joined
                queue.push(joined, before)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Codec:
    """Encodes texts to ids and ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8"), self.ranks, self.queue), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known.get
        return b"".join([known(piece) or self._piece(piece) for piece in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, built once in a Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(documents: DataFrame, ranks: str | Callable[[], str], pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and on request its ids.

    ``ranks`` is a vocabulary file that every worker has, or a function giving
    its path there.  Ids are digested as little-endian unsigned 32-bit integers,
    and decoded again for the digest of the decoded bytes.  Null and empty texts
    have no tokens.  Repeated rows get a row each.  Other columns are ignored; no
    rows give no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks() if callable(ranks) else ranks, pattern)
        counts, encoded, decoded, kept = [], [], [], []
        for text in batch.column(1):
            ids = own.encode(text.as_py() or "")
            counts.append(len(ids) // 4)
            encoded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            if with_ids:
                kept.append(np.frombuffer(ids, "<i4"))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
        if with_ids:
            columns.append(list_column(kept, pa.int32()))
        return pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), run, schema)
