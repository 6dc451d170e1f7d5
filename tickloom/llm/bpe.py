"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of one pre-token are driven by a queue with a bucket per merge rank.
A bucket holds the positions, in a doubly linked list of the current tokens,
where a pair of that rank starts; three levels of bitmaps over the buckets give
the lowest rank by find-first-set.  A merge doesn't search the queue for the
pairs that it breaks: their entries turn stale and are skipped when they come
up.  A pre-token of n bytes so takes O(n log n) steps at worst, however long it is.

Vocabulary files hold a base64 token and its rank on each line.  The path is a
parameter; the driver reads the file and broadcasts the ranks, whose number is
the vocabulary's, whatever the data.

Defined cases: a null text counts as empty and gives no ids.  Long texts are
encoded whole.  Repeated rows each give a row; other columns are carried.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, slices, utf8

#: Bytes of ids that a worker remembers in each of two generations, the bytes that a pre-token
#: takes besides its own, and the longest such one in characters.
MEMORY, ENTRY = 48 << 20, 150
MEMORABLE = 48


BITS = [1 << i for i in range(64)]


class RankQueue:
    """Positions by rank, lowest rank first, then lowest position."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        i, j = rank >> 6, rank >> 12
        low = self.low[i]
        self.low[i] = low | BITS[rank & 63]
        if not low:  # else the levels above know it
            self.mid[j] |= BITS[i & 63]
            self.top |= 1 << j

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        j = (top & -top).bit_length() - 1
        mid = self.mid[j]
        i = (j << 6) + (mid & -mid).bit_length() - 1
        low = self.low[i]
        bit = low & -low
        rank = (i << 6) + bit.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[i] = low = low ^ bit
        if not low:
            self.mid[j] = mid = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        return rank, bucket[0]


class Encoder(dict):
    """Packed ids (little-endian unsigned 32-bit) by pre-token, worked out when first asked for.

    What it holds is the young generation.  When that is full it becomes the old one, and
    what is asked for again becomes young: rare pre-tokens go, within a bound in bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.longest = max(map(len, ranks), default=0)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.merged(piece.encode()), "<u4").tobytes()
        if len(piece) <= MEMORABLE:
            size = ENTRY + len(piece) + len(ids)
            if self.held + size > MEMORY:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += size
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, longest = len(piece), ranks.get, self.longest
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        # The rank of the pair that starts at a position now.
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair += (-1, -1)
        push, pop = self.queue.push, self.queue.pop
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (rank := get(piece[i:stop])) is not None:
                    pair[i] = rank
                    push(rank, i)
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end], -1) if end - left <= longest else -1
                if pair[left] != rank:
                    pair[left] = rank
                    if rank >= 0:
                        push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: By vocabulary broadcast, then by pattern.  A worker drops the broadcast, and so the encoders, with
#: its first task that doesn't use it: else their memory would stand beside that of other operators.
_encoders: WeakKeyDictionary = WeakKeyDictionary()


def _encoder(vocabulary, pattern: str) -> Encoder:
    own = _encoders.setdefault(vocabulary, {})
    if pattern not in own:
        own[pattern] = Encoder(vocabulary.value, pattern)
    return own[pattern]


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str], text: str = "text", decode: bool = False) -> DataFrame:
    """The columns `carry` with `ids` (binary: little-endian unsigned 32-bit) and,
    if asked for, `decoded` (binary: the bytes that the ids stand for)."""
    spark = docs.sparkSession
    ship(spark)
    ranks = read_ranks(path)
    vocabulary = spark.sparkContext.broadcast(ranks)
    names = [fresh(carry, "ids")] + [fresh(carry, "decoded")] * decode
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*plain.schema.fields[:-1], *(T.StructField(f"o{i}", T.BinaryType()) for i in range(len(names)))])
    out = plain.mapInArrow(_encoded(vocabulary, pattern, len(carry), decode), schema)
    return out.toDF(*carry, *names)


def _encoded(vocabulary, pattern: str, carried: int, decode: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(carried)
            _, bounds = utf8(texts)
            for i, j in slices(bounds):
                ids = [coder.encode(x or "") for x in texts.slice(i, j - i).to_pylist()]
                made = [pa.array(ids, pa.binary())]
                if decode:
                    made.append(pa.array(map(coder.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, j - i) for k in range(carried)] + made,
                    [f"c{k}" for k in range(carried)] + [f"o{k}" for k in range(len(made))],
                )

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    rows = encode(docs, path, pattern, ["doc_id"], decode=True)
    return rows.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
