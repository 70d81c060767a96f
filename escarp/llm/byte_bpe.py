"""Byte-level BPE by rank files: encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a
vocabulary entry; a pre-token that is not goes through byte pair merges with a heap over a linked
list of its bytes. Texts are cut into chunks (`texts.chunks_of`), so each task splits, looks up and
merges a spelling once and keeps its ids in a cache of bounded size.

The rank file is read on the driver and its tables are broadcast: their size is that of the
vocabulary, whatever the input. NULL and empty texts have no ids; the digest is that of no bytes.
Other columns of the input are not read, and repeated rows each give their row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.llm.texts import chunk_ids, chunks_of, gathered, slices

#: Chunk spellings, and pre-tokens, whose ids a Python worker keeps; emptied when full, so its memory is bounded.
CACHE_ENTRIES = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    entries = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [entries[rank] for rank in range(len(entries))]


class PerfectHash:
    """Minimal perfect hash by displacement: n keys on n places, two small integer tables.

    Keys of one bucket get the first displacement under which all fall on free places; buckets of
    one key simply name a free place.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.places = n
        self.buckets = max(1, n // 2)
        hashes = np.array([xxhash.xxh3_64_intdigest(key) for key in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                break
            step = 0
            while True:
                steps = np.arange(step, step + 32)
                at = self._place(hashes[members][None, :], steps[:, None])
                own = np.sort(at, axis=1)
                fits = free[at].all(axis=1) & (own[:, 1:] != own[:, :-1]).all(axis=1)
                if fits.any():
                    step += int(np.argmax(fits))
                    at = at[np.argmax(fits)]
                    break
                step += 32
            self.shift[b] = step
            self.key_at[at] = members
            free[at] = False
        spare = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            at = next(spare)
            self.shift[b] = -1 - at
            self.key_at[at] = order[starts[b]]

    def _place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes >> np.uint64(17)) ^ (hashes * np.uint64(0x9E3779B97F4A7C15))
        mixed = mixed + shift.astype(np.uint64) * ((hashes >> np.uint64(33)) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(self.places)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the one number of an entry it can be; the caller compares the bytes."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0)))
        return self.key_at[at]


class ByteBpe:
    """Encoder and decoder of one vocabulary; broadcast once, its caches live in the workers."""

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries = entries
        self.pattern = pattern
        ranks = {entry: rank for rank, entry in enumerate(entries)}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        #: Rank of two neighbours' joined bytes, by both their ranks.
        self.pairs = {
            ranks[entry[:at]] << 32 | ranks[entry[at:]]: rank
            for rank, entry in enumerate(entries)
            for at in range(1, len(entry))
            if entry[:at] in ranks and entry[at:] in ranks
        }
        self.hash = PerfectHash(entries)
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes | None] = {}
        self.split: Callable[[str], list[str]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"chunks": {}, "pieces": {}, "split": None}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging its lowest-ranked neighbours, leftmost first.

        `ids`, `left` and `right` are the linked list, `joined` has the rank of each element with
        its right neighbour (-1: none); a heap entry is rank and place in one integer.
        """
        rank_of, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        bits = n.bit_length()
        place = (1 << bits) - 1
        joined = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        joined.append(-1)
        heap = [rank << bits | i for i, rank in enumerate(joined) if rank >= 0]
        heapq.heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i, rank = entry & place, entry >> bits
            if joined[i] != rank:
                continue  # one of the two has been merged since
            j = right[i]
            k = right[i] = right[j]
            ids[i], ids[j], joined[i], joined[j] = rank, -1, -1, -1
            if k < n:
                left[k] = i
                joined[i] = after = rank_of(rank << 32 | ids[k], -1)
                if after >= 0:
                    push(heap, after << bits | i)
            h = left[i]
            if h >= 0:
                joined[h] = before = rank_of(ids[h] << 32 | rank, -1)
                if before >= 0:
                    push(heap, before << bits | h)
        return [i for i in ids if i >= 0]

    def whole(self, pieces: list[bytes]) -> list[int]:
        """Rank of each pre-token that is an entry, by the perfect hash; -1 for the others."""
        entries = self.entries
        found = zip(pieces, self.hash.candidates(pieces).tolist(), strict=True)
        return [rank if entries[rank] == piece else -1 for piece, rank in found]

    def encode_chunks(self, spellings: list[bytes]) -> list[bytes]:
        """Ids of each chunk as packed 32-bit integers; known chunks come from the cache."""
        if self.split is None:
            self.split = regex.compile(self.pattern).findall
        if len(self.chunks) >= CACHE_ENTRIES:
            self.chunks.clear()
        known, split = self.chunks, self.split
        new = [c for c in spellings if c not in known]
        pieces = [[p.encode() for p in split(c.decode())] for c in new]
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
        ids = self.pieces
        distinct = list({piece: None for row in pieces for piece in row if piece not in ids})
        for piece, rank in zip(distinct, self.whole(distinct) if distinct else [], strict=True):
            ids[piece] = pack("<I", rank) if rank >= 0 else None
        for chunk, row in zip(new, pieces, strict=True):
            packed = b""
            for piece in row:
                if (own := ids[piece]) is None:
                    merged = self.merge(piece)
                    own = ids[piece] = pack(f"<{len(merged)}I", *merged)
                packed += own
            known[chunk] = packed
        return [known[c] for c in spellings]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row starts)."""
        found = chunks_of(data, offsets)
        return chunk_ids(found, self.encode_chunks(found.spellings.to_pylist()))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids."""
        return gathered(self.flat, self.starts[ids], self.lengths[ids])


def broadcast_bpe(df: DataFrame, rank_file: str, pattern: str):
    """The tables of a rank file on the workers; bounded by the vocabulary."""
    return df.sparkSession.sparkContext.broadcast(ByteBpe(read_ranks(rank_file), pattern))


def encoded(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): the token ids of each text as an array."""
    bpe = broadcast_bpe(docs, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            ids, starts = bpe.value.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        run,
        T.StructType([source.schema["id"], T.StructField("ids", T.ArrayType(T.LongType()))]),
    ).withColumnRenamed("id", id_col)


def digests(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids (32-bit little endian) and of the decoded bytes."""
    bpe = broadcast_bpe(docs, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            ids, starts = bpe.value.encode(data, offsets)
            packed = ids.astype("<u4", copy=False)
            back = bpe.value.decode(ids)
            ends = np.concatenate(([0], np.cumsum(bpe.value.lengths[ids])))[starts]
            spans = list(zip(starts[:-1], starts[1:], strict=True))
            spans_back = list(zip(ends[:-1], ends[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in spans_back]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            source.schema["id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
