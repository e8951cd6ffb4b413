"""Byte-level BPE by monoid tree reduction.

A piece is cut in halves down to short leaves, which are merged directly. Two encoded halves join through a window of
tokens around the seam: its bytes are merged anew, and the window grows on a side, by doubling steps, as long as the token
outside and the window's edge token are no stable pair (merging the bytes of the two gives other tokens). A token
sequence whose neighbours are all stable pairs is the one result of the merges, so tokens outside a window between
stable pairs cannot change. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import short_batches

LEAF_BYTES = 16
#: Pieces, and pairs of tokens, whose result a worker remembers; it forgets all when there are more.
CACHE_SIZE = 400_000


class BytePairCodec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.packed = _PieceCache(self)

    def merge(self, data: bytes) -> list[int]:
        """Plain merges: always the lowest rank first, the leftmost of equals."""
        if len(data) > 4 * LEAF_BYTES:
            return self.merge_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges, with a heap of candidate pairs over a linked list of parts."""
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j >= n or len(left) + len(parts[j]) != size:
                continue  # a part has grown or gone since
            parts[i], parts[j] = left + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := ranks.get(parts[k] + parts[m])) is not None:
                    heappush(heap, (r, k, len(parts[k]) + len(parts[m])))
        return [ranks[p] for p in parts if p is not None]

    def is_stable(self, left: int, right: int) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) > CACHE_SIZE:
                self.stable.clear()
            known = self.stable[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two encoded neighbours' joint bytes."""
        if not left or not right:
            return left or right
        if self.is_stable(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            grow_left = i > 0 and not self.is_stable(left[i - 1], window[0])
            grow_right = j < len(right) and not self.is_stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            i, j, step = max(0, i - step * grow_left), min(len(right), j + step * grow_right), 2 * step

    def reduce(self, data: bytes) -> list[int]:
        """The tokens of one piece's bytes, by halves."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.find(text)))

    def decode(self, ids: list[int]) -> bytes:
        parts = list(map(self.tokens.__getitem__, ids))
        while len(parts) > 64:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return b"".join(parts)


class _PieceCache(dict):
    """Packed ids by piece."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE_SIZE:
            self.clear()
        ids = np.array(self.codec.reduce(piece.encode()), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


@cache
def codec(path: str) -> BytePairCodec:
    """One codec for each worker process and file."""
    return BytePairCodec(path)


def encode_documents(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit integers), n_tokens and decoded (binary).

    The ranks file is read where the tasks run, so each machine needs it at ranks_path. A null text counts as empty and
    has no ids; empty tables stay empty; the other columns pass through (columns named ids, n_tokens or decoded are
    replaced).
    """
    docs = docs.drop("ids", "n_tokens", "decoded")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            ids = [own.encode(t.as_py() or "") for t in batch.column(at)]
            decoded = [own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), counts, pa.array(decoded, pa.binary())],
                [*batch.schema.names, "ids", "n_tokens", "decoded"],
            )

    short_batches(docs.sparkSession)
    kinds = StructType([*docs.schema, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", BinaryType())])
    return docs.mapInArrow(run, kinds)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the documents' ids."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
