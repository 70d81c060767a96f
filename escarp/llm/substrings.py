"""Substring dedup: words of passages that also start earlier are removed, by suffix automata.

A passage counts from `WIDTH` words. Documents are streamed through the suffix automaton of a reference
shard, which holds texts that come earlier; where the matching statistics (the longest suffix read so
far that the shard contains) reach `WIDTH`, the window that ends there has an earlier copy. Maximal
spans of such windows go.

A shard must hold all earlier texts that can match, and no more than a task can hold, so shards are cut
by content. Each window has an anchor, the run of `GRAM` words in it with the smallest hash, leftmost
of equal ones; equal windows have equal anchors. Consecutive windows with one anchor are a segment. Only
segments whose anchor occurs again anywhere are sent on, to the shard of their anchor, in which they
are streamed in order of document and place, each before it joins the automaton. Automata are thus built
where their shard is, once, and not broadcast: the references grow with the corpus, and a shard is
needed only where its anchors are. Anchors with more than `MANY` occurrences are cut further: their
windows go one by one, each to the shard of its own words, and equal segments meet before they are
sent. So a passage that a third of all documents share is one segment a task.

Hashes only choose where texts meet; what is removed is decided on the words themselves.

Texts travel as compressed blocks of about 1 MB with the words of some documents. A text is never cut; one
longer than a block is a block of its own, and a task holds about 30 times its bytes.

Defined results: NULL and empty texts have no words. Documents are ordered by id, NULL first, then rows
of equal ids by their place in the table. Repeated rows are documents of their own: the first stays
whole. Words of shorter texts always stay. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp.llm.texts import _SPACE, slices, text_bytes, text_column
from escarp.session import materialize, scratch_dir

#: Fixed value of the contract: words of a window.
WIDTH = 20

#: Words of an anchor.
GRAM = 8

#: Text bytes of a block.
BLOCK = 1 << 20

#: Occurrences of an anchor beyond which its windows are sent one by one.
MANY = 512

#: Words of the references that one automaton holds.
SHARD = 50_000

#: Bytes of distinct segments that a task holds before it sends them on.
HELD = 16 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Segments(NamedTuple):
    """Runs of windows with one anchor: its hash, first window and number of windows of each run."""

    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray


class Block:
    """The words of some documents, each word followed by a blank."""

    def __init__(self, blob: bytes, sizes: np.ndarray):
        self.text = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        self.ends = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 0x20)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.rows = np.concatenate(([0], np.cumsum(sizes)))

    def words(self, first: int, count: int) -> bytes:
        return self.text[self.starts[first] : self.ends[first + count - 1]]

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, word, "right") - 1

    def segments(self) -> Segments:
        """All windows of the block, as runs with one anchor."""
        n = len(self.ends)
        grams = n - GRAM + 1
        none = np.zeros(0, np.int64)
        if n < WIDTH:
            return Segments(none, none, none)
        data = np.frombuffer(self.text, np.uint8).astype(np.uint64)
        powers, inverses = _powers(len(data))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        begin, end = self.starts[:grams], self.ends[GRAM - 1 :]
        value = (sums[end] - sums[begin]) * inverses[begin]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xFF51AFD7ED558CCD)
        value ^= value >> np.uint64(29)
        # the smallest gram of each window, leftmost of equal ones
        width = WIDTH - GRAM + 1
        least, where, have = value, np.arange(grams), 1
        while have < width:
            step = min(have, width - have)
            take = least[step:] < least[:-step]
            where = np.where(take, where[step:], where[:-step])
            least = np.where(take, least[step:], least[:-step])
            have += step
        windows = n - WIDTH + 1
        inside = np.repeat(self.rows[1:], np.diff(self.rows))[:windows]
        valid = np.arange(windows) + WIDTH <= inside
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (where[1:windows] != where[: windows - 1])
        starts = np.flatnonzero(first)
        stops = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True)) + 1
        return Segments(value[where[starts]].view(np.int64), starts, stops - starts)


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for blocks of the usual size."""
    if len(_POWERS[0]) >= size:
        return _POWERS[0], _POWERS[1]
    size = max(size, 2 * BLOCK)
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if size <= 4 * BLOCK:
        _POWERS[:] = out
    return out[0], out[1]


def _packed(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks: (block, ids, sizes, blob)."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    packer = zstandard.ZstdCompressor(level=5)
    for rows, _, _ in slices(batches, "text", BLOCK):
        texts = pc.binary_join_element_wise(text_column(rows, "text"), "", " ")
        data, offsets = text_bytes(texts)
        word = ~_SPACE[data]
        after = np.concatenate(([False], word[:-1]))
        kept = np.where(word, data, np.uint8(0x20))[word | after]
        sizes = np.diff(np.searchsorted(np.flatnonzero(after & ~word), offsets))
        columns = [
            pa.array([number]),
            pa.array([rows.column(0).to_pylist()], pa.list_(id_type)),
            pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([packer.compress(kept.tobytes())], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "blob"])
        number += 1


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block]]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {name: batch.column(k)[i] for k, name in enumerate(names)}
        yield row, Block(row["blob"].as_py(), row["sizes"].values.to_numpy())


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, block, n): how often each anchor occurs in a block."""
    for batch in batches:
        for row, block in _opened(batch):
            hashes, counts = np.unique(block.segments().hashes, return_counts=True)
            where = pa.array(np.full(len(hashes), row["block"].as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), where, pa.array(counts.astype(np.int32))], ["anchor", "block", "n"]
            )


def _known(row: dict, column: str) -> np.ndarray:
    value = row[column]
    return np.sort(value.values.to_numpy()) if value.is_valid else np.zeros(0, np.int64)


def _among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def _references(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Distinct segments (key, words) of a task with the first place (id, block, row, start) they are at."""
    held: dict[tuple[int, bytes], tuple] = {}
    size = 0
    names = ["key", "words", "id", "block", "row", "start"]
    kinds = (pa.int64(), pa.binary(), id_type, pa.int64(), pa.int32(), pa.int32())

    def sent() -> Iterator[pa.RecordBatch]:
        items = [(key, words, *place[1:]) for (key, words), place in held.items()]
        for at in range(0, len(items), 10_000):
            columns = zip(*items[at : at + 10_000], strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for row, block in _opened(batch):
            found = block.segments()
            many = _among(found.hashes, _known(row, "many"))
            few = _among(found.hashes, _known(row, "few"))
            ids, number = row["ids"].as_py(), row["block"].as_py()
            first, count, keys = found.first[few], found.count[few], found.hashes[few]
            if many.any():  # window by window
                each = found.count[many]
                ahead = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                first = np.concatenate((first, np.repeat(found.first[many], each) + ahead))
                count = np.concatenate((count, np.ones(len(ahead), np.int64)))
                keys = np.concatenate((keys, np.zeros(len(ahead), np.int64)))
            rows = block.row_of(first)
            starts = first - block.rows[rows]
            alone = len(found.first[few])
            for k, (key, at, windows, r, start) in enumerate(
                zip(keys.tolist(), first.tolist(), count.tolist(), rows.tolist(), starts.tolist(), strict=True)
            ):
                words = block.words(at, windows + WIDTH - 1)
                if k >= alone:
                    key = hash_of(words)
                i = ids[r]
                place = ((i is not None, i if i is not None else 0, number, r, start), i, number, r, start)
                before = held.get((key, words))
                if before is None:
                    held[key, words] = place
                    size += len(words) + 200
                elif place[0] < before[0]:
                    held[key, words] = place
            if size > HELD:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def hash_of(words: bytes) -> int:
    """A signed 64-bit hash of a window's words."""
    import xxhash

    value = xxhash.xxh64_intdigest(words)
    return value - (1 << 64) if value >> 63 else value


class Automaton:
    """Suffix automaton of word sequences, which are added one after another."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matches(self, symbols: list[int]) -> list[int]:
        """Matching statistics: at each place the longest suffix read so far that a sequence contains."""
        out = []
        state, length = 0, 0
        nexts, link, lengths = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in nexts[state]:
                state = link[state]
                length = lengths[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                length += 1
            out.append(length)
        return out

    def add(self, symbols: list[int]) -> None:
        last = 0
        for symbol in symbols:
            last = self._extended(last, symbol)

    def _extended(self, last: int, symbol: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        there = nexts[last].get(symbol)
        if there is not None:
            if length[there] == length[last] + 1:
                return there
            return self._split(last, symbol, there)
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = state
            at = link[at]
        if at >= 0:
            there = nexts[at][symbol]
            link[state] = there if length[there] == length[at] + 1 else self._split(at, symbol, there)
        return state

    def _split(self, at: int, symbol: int, there: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[there]))
        link.append(link[there])
        length.append(length[at] + 1)
        link[there] = clone
        while at >= 0 and nexts[at].get(symbol) == there:
            nexts[at][symbol] = clone
            at = link[at]
        return clone


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, row, start, count): runs of windows that no earlier segment of their shard contains.

    Rows come sorted by key and place. A shard is the segments of some keys; equal windows always have
    one key, so shards may end after any key.
    """
    shard, numbers = Automaton(), {}
    filled = 0
    key, group = None, {}  # distinct texts under one key, in order
    out: tuple[list, list, list, list] = ([], [], [], [])

    def settled() -> int:
        """Stream a key's segments through the shard, each before it is added; words added."""
        alone = len(group) == 1
        added = 0
        for words, (block, row, start) in group.items():
            spelled = words.split(b" ")
            if alone:  # nothing else can match it
                runs = [(0, len(spelled) - WIDTH + 1)]
            else:
                symbols = [numbers.setdefault(word, len(numbers)) for word in spelled]
                fresh = [n < WIDTH for n in shard.matches(symbols)[WIDTH - 1 :]]
                runs, k = [], 0
                while k < len(fresh):
                    end = k
                    while end < len(fresh) and fresh[end]:
                        end += 1
                    if end > k:
                        runs.append((k, end - k))
                    k = max(end, k + 1)
                if runs:
                    shard.add(symbols)
                    added += len(symbols)
            for at, count in runs:
                for column, value in zip(out, (block, row, start + at, count), strict=True):
                    column.append(value)
        return added

    def emitted() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "row", "start", "count"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for here, words, block, row, start in zip(*columns, strict=True):
            if here != key:
                filled += settled()
                if filled > SHARD:
                    shard, numbers, filled = Automaton(), {}, 0
                key, group = here, {}
            group.setdefault(words, (block, row, start))
        if len(out[0]) > 1 << 14:
            yield emitted()
            out = ([], [], [], [])
    settled()
    if out[0]:
        yield emitted()


def _cleaned(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept) of every document."""
    names = ["id", "n_words", "n_removed", "kept"]
    for batch in batches:
        for row, block in _opened(batch):
            found = block.segments()
            again = _among(found.hashes, np.sort(np.concatenate((_known(row, "many"), _known(row, "few")))))
            edges = np.zeros(len(block.ends) + 2, np.int64)  # +1 where repeated windows begin, -1 behind
            first, count = found.first[again], found.count[again]
            np.add.at(edges, first, 1)
            np.add.at(edges, first + count, -1)
            if row["fresh"].is_valid:
                fresh = row["fresh"].values
                at, start, size = (fresh.field(k).to_numpy().astype(np.int64) for k in range(3))
                at = block.rows[at] + start
                np.add.at(edges, at, -1)
                np.add.at(edges, at + size, 1)
            gone = np.cumsum(edges)[: len(block.ends)] > 0
            cover = np.zeros(len(block.ends) + WIDTH + 1, np.int64)
            where = np.flatnonzero(gone)
            np.add.at(cover, where, 1)
            np.add.at(cover, where + WIDTH, -1)
            removed = np.cumsum(cover)[: len(block.ends)] > 0
            before = np.concatenate(([0], np.cumsum(removed)))
            lost = np.diff(before[block.rows])
            texts = []
            for r, n in enumerate(lost.tolist()):
                a, b = int(block.rows[r]), int(block.rows[r + 1])
                if not n:
                    texts.append(block.words(a, b - a) if b > a else b"")
                    continue
                runs = np.flatnonzero(np.diff(np.concatenate(([True], removed[a:b], [True])).astype(np.int8)))
                pieces = zip(runs[0::2].tolist(), runs[1::2].tolist(), strict=True)
                texts.append(b" ".join(block.words(a + x, y - x) for x, y in pieces))
            columns = [
                pa.array(row["ids"].as_py(), id_type),
                pa.array(np.diff(block.rows)),
                pa.array(lost),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _listed(*columns: str) -> Column:
    return F.collect_list(F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every document; `kept` joins the words that stay by blanks."""
    from pyspark.sql.pandas.types import to_arrow_type

    scratch = scratch_dir(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    packed = source.mapInArrow(
        lambda batches: _packed(batches, arrow), f"block long, ids array<{name}>, sizes array<int>, blob binary"
    )
    blocks = materialize(packed, f"{scratch}/blocks")

    counted = blocks.select("block", "sizes", "blob").mapInArrow(_anchors, "anchor long, block long, n int")
    total = F.expr("sum(n) OVER (PARTITION BY anchor)")
    again = counted.select("anchor", "block", total.alias("total")).filter("total > 1")
    again = again.groupBy("block").agg(
        F.collect_list(F.when(F.col("total") <= MANY, F.col("anchor"))).alias("few"),
        F.collect_list(F.when(F.col("total") > MANY, F.col("anchor"))).alias("many"),
    )
    again = materialize(again, f"{scratch}/again")

    places = f"key long, words binary, id {name}, block long, row int, start int"
    segments = blocks.join(again, "block").mapInArrow(lambda batches: _references(batches, arrow), places)
    shards = segments.repartition("key").sortWithinPartitions("key", "id", "block", "row", "start")
    fresh = shards.drop("id").mapInArrow(_first_windows, "block long, row int, start int, count int")
    fresh = fresh.groupBy("block").agg(_listed("row", "start", "count").alias("fresh"))
    fresh = materialize(fresh, f"{scratch}/fresh")

    joined = blocks.join(again, "block", "left").join(fresh, "block", "left")
    result = f"id {name}, n_words long, n_removed long, kept string"
    return joined.mapInArrow(lambda batches: _cleaned(batches, arrow), result)
