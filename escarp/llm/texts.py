"""Arrow and numpy helpers for text columns inside tasks, and shared column expressions.

Texts arrive as Arrow batches. They are cut into row ranges of bounded bytes, so one batch of very
long texts never has its working arrays in memory at once (a single text is the least unit).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: Fixed value: a word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; NULL is the empty text."""
    return F.translate(F.coalesce(column, F.lit("")), _UPPER, _UPPER.lower())


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch as strings without NULL."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batches with at most `most` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(text_column(batch, text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last


class Words(NamedTuple):
    """Words of some rows: code of each word, spelling of each code, first word of each row."""

    codes: np.ndarray
    spellings: pa.Array
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; bytes of longer UTF-8 sequences are never in that range."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8)


def _dictionary(data: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    n = len(bounds) - 1
    pieces = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
    )
    return pieces.dictionary_encode()


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of each row; a word never crosses rows."""
    data = np.ascontiguousarray(data)
    none = np.zeros(0, np.int64)
    word = ~_SPACE[data]
    if not word.any():
        return Words(none, pa.array([], pa.binary()), np.zeros(len(offsets), np.int64), none, none)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | first[:-1]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    found = _dictionary(data, bounds)
    codes = found.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    return Words(codes, found.dictionary, np.searchsorted(starts, offsets), starts, ends)


#: Bytes that follow a blank at which a text may be cut: printable ASCII and the first bytes of
#: U+00C0 to U+027F. None of them begins white space in any library's sense.
AFTER_BLANK = np.zeros(256, bool)
AFTER_BLANK[0x21:0x7F] = True
AFTER_BLANK[0xC3:0xCA] = True


class Chunks(NamedTuple):
    """Chunks of some rows: code of each chunk, spelling of each code, first chunk of each row."""

    codes: np.ndarray
    spellings: pa.Array
    rows: np.ndarray


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> Chunks:
    """Rows cut before each blank that a visible character follows.

    Byte-level pre-tokenization always has a border there: such a blank starts a token, and a run
    of white space before it ends without it. So chunks can be encoded one by one.
    """
    data = np.ascontiguousarray(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2] = (data[:-1] == 0x20) & AFTER_BLANK[data[1:]]
    cut[np.maximum(offsets[1:-1] - 1, 0)] &= False
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    if len(bounds) < 2:
        return Chunks(np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64))
    found = _dictionary(data, bounds)
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Chunks(codes, found.dictionary, np.searchsorted(bounds, offsets))


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + length] over all pairs."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return flat[np.repeat(shift, lengths) + np.arange(total)]


def chunk_ids(chunks: Chunks, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and where each row starts.

    `encoded` has for each code its ids as packed little-endian 32-bit integers.
    """
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    flat = np.frombuffer(b"".join(encoded), "<u4")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    each = lengths[chunks.codes]
    ids = gathered(flat, starts[chunks.codes], each)
    return ids, np.concatenate(([0], np.cumsum(each)))[chunks.rows]
