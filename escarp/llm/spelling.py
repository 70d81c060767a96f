"""Spelling variants: words one edit apart, by dynamic programming over sorted vocabulary.

Words are counted over all texts. Each word then meets a sorted list of words: the edit matrix between
the word and the list is kept as a band of three cells a row, rows are reused up to the longest common
prefix (LCP) with the entry before, and once a whole row exceeds one edit, all entries that share that
prefix are skipped over the LCPs.

The sorted vocabulary is cut into blocks that tasks scan on their own. Of two words one edit apart, the
shorter of m code points, either the first half of m is equal or what follows it at the end is. So
each word goes to blocks by (m, first half) and (m, last half), m its length and one less. A block of more
than `BLOCK` words is cut again in the same way over the part that is still free, until one free code
point is left, which bounds a block by the alphabet. A pair is found in exactly one block. So neither a
frequent prefix nor a frequent ending gathers the vocabulary in one task.

Defined results: NULL and empty texts have no runs. A NULL id counts as the empty text. Repeated rows
count each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp.llm.texts import _dictionary, lowered, slices
from escarp.session import materialize, scratch_dir

#: Fixed values of the contract.
SHORTEST, RAREST, EVERY, TIMES = 6, 5, 199, 5

#: Words of a block that is scanned as it is.
BLOCK = 2048

#: Distinct words a task holds before it hands on their counts.
HELD = 1 << 17

#: Runs up to this many bytes get their checksum from a table.
_TABLED = 64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _crc_steps() -> np.ndarray:
    """What the checksum register becomes by one zero byte, for each low byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEPS = _crc_steps()


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; none crosses rows.

    In UTF-8 the latter are the two-byte sequences that begin with C3.
    """
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def checksums(
    prefixes: np.ndarray, rows: np.ndarray, codes: np.ndarray, spellings: list[bytes]
) -> np.ndarray:
    """crc32 of (prefix of the row + spelling) for each (row, code), from those of both parts.

    crc32(a + b) is crc32(b) xor crc32(a) after as many zero bytes as b has.
    """
    sizes = np.fromiter(map(len, spellings), np.int64, len(spellings))
    own = np.fromiter(map(zlib.crc32, spellings), np.uint32, len(spellings))
    short = np.minimum(sizes, _TABLED)
    shifted = np.empty((int(short.max()) + 1, len(prefixes)), np.uint32)
    shifted[0] = prefixes
    for size in range(1, len(shifted)):
        shifted[size] = (shifted[size - 1] >> 8) ^ _STEPS[shifted[size - 1] & 255]
    out = shifted[short[codes], rows] ^ own[codes]
    for at in np.flatnonzero(sizes[codes] > _TABLED):
        out[at] = zlib.crc32(spellings[codes[at]], int(prefixes[rows[at]]))
    return out


def _counts_of(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Table | None:
    """(word, n) of some rows, after one code point went from every run its checksum chooses."""
    data = np.ascontiguousarray(lowered(data))
    starts, ends = runs_of(data, offsets)
    if not len(starts):
        return None
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    found = _dictionary(data, bounds)
    codes = found.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    # pieces between runs are entries of the dictionary too, without a count
    spellings = found.dictionary.to_pylist()
    prefixes = [f"{'' if i is None else i}:".encode() for i in ids.to_pylist()]
    prefixes = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    rows = np.searchsorted(offsets, starts, "right") - 1
    checks = checksums(prefixes, rows, codes, spellings)
    chosen = np.flatnonzero(checks % EVERY == 0)
    changed: Counter[str] = Counter()
    for at, check in zip(chosen.tolist(), checks[chosen].tolist(), strict=True):
        word = spellings[codes[at]].decode()
        cut = check % len(word)
        changed[word[:cut] + word[cut + 1 :]] += 1
    counts = np.bincount(codes, minlength=len(spellings)) - np.bincount(codes[chosen], minlength=len(spellings))
    kept = np.flatnonzero(counts)
    words = found.dictionary.take(pa.array(kept)).cast(pa.string())
    whole = pa.table({"word": words, "n": counts[kept].astype(np.int64)})
    cuts = pa.table(
        {"word": pa.array(list(changed), pa.string()), "n": np.fromiter(changed.values(), np.int64, len(changed))}
    )
    both = pa.concat_tables([whole, cuts])
    return both.filter(pc.greater_equal(pc.utf8_length(both["word"]), SHORTEST))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least `SHORTEST` code points that occur `RAREST` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return total.rename_columns(["word", "n"]).select(["word", "n"])

        for rows, data, offsets in slices(batches, "text", 1 << 20):
            found = _counts_of(rows.column(0), data, offsets)
            if found is None:
                continue
            held.append(found)
            size += found.num_rows
            if size > HELD:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = source.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of a sorted list of distinct words that are exactly one edit apart."""
    n = len(words)
    lcp = [0] * (n + 1)
    for i in range(1, n):
        a, b = words[i - 1], words[i]
        most = min(len(a), len(b))
        k = 0
        while k < most and a[k] == b[k]:
            k += 1
        lcp[i] = k
    lcp[n] = -1
    # the next entry that shares less with its predecessor
    jump = [n] * (n + 1)
    stack: list[int] = []
    for i in range(1, n + 1):
        while stack and lcp[i] < lcp[stack[-1]]:
            jump[stack.pop()] = i
        stack.append(i)
    longest = max(map(len, words), default=0)
    # cells of row d: edits between d points of the entry and d - 1, d, d + 1 points of the word
    left, mid, right = ([2] * (longest + 2) for _ in range(3))
    mid[0], right[0] = 0, 1
    for q in range(n - 1):
        word = words[q]
        size = len(word)
        i, valid = q + 1, 0
        while i < n:
            entry = words[i]
            end = len(entry)
            depth = min(valid, lcp[i])
            while depth < end:
                point = entry[depth]
                a, b, c = left[depth], mid[depth], right[depth]
                x = b + 1
                if 0 < depth <= size and a + (word[depth - 1] != point) < x:
                    x = a + (word[depth - 1] != point)
                if depth > size:
                    x = 2
                y = min(c, x) + 1
                if depth < size:
                    y = min(y, b + (word[depth] != point))
                else:
                    y = 2
                z = y + 1
                if depth + 1 < size:
                    z = min(z, c + (word[depth + 1] != point))
                else:
                    z = 2
                depth += 1
                left[depth], mid[depth], right[depth] = x, y, z
                if x > 1 and y > 1 and z > 1:
                    break
            else:
                edits = {-1: left, 0: mid, 1: right}.get(size - end)
                if edits is not None and edits[end] == 1:
                    yield q, i
                valid = depth
                i += 1
                continue
            valid = depth - 1
            i += 1
            while lcp[i] >= depth:
                i = jump[i]


def _pairs_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) in both directions from rows that are sorted by block."""
    names = ["word", "near", "near_n"]

    def scanned(block: list[tuple[str, int]], key: tuple, out: tuple[list, list, list]) -> None:
        m, x, y, bar = key[:4]
        cores = sorted((word[x : len(word) - y], word, n) for word, n in block)
        for i, j in near_pairs([core for core, _, _ in cores]):
            (_, a, a_n), (_, b, b_n) = cores[i], cores[j]
            if min(len(a), len(b)) > m or bar and a[:bar] == b[:bar]:
                continue  # found in the blocks of its length, or of this prefix
            out[0].extend((a, b))
            out[1].extend((b, a))
            out[2].extend((b_n, a_n))

    def emitted(out: tuple[list, list, list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    last, block, out = None, [], ([], [], [])
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for word, n, m, x, y, bar, pre, suf in zip(*columns, strict=True):
            key = (m, x, y, bar, pre, suf)
            if key != last:
                if len(block) > 1:
                    scanned(block, last, out)
                last, block = key, []
            block.append((word, n))
        if len(out[0]) > 1 << 14:
            yield emitted(out)
            out = ([], [], [])
    if len(block) > 1:
        scanned(block, last, out)
    if out[0]:
        yield emitted(out)


_BLOCK = ["m", "x", "y", "bar", "pre", "suf"]


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of blocks that fix x points in front and y at the end, cut once more: each goes to two blocks."""
    free = F.col("m") - F.col("x") - F.col("y")
    middle = F.col("x") + F.expr("(m - x - y) div 2").cast("int")
    front = F.struct(middle.alias("x"), F.col("y"), F.col("bar"))
    back = F.struct(F.col("x"), (F.col("y") + free - (middle - F.col("x"))).alias("y"), middle.alias("bar"))
    cut = rows.select("word", "n", "m", F.explode(F.array(front, back)).alias("c"))
    return cut.select("word", "n", "m", "c.*", F.expr("left(word, c.x)").alias("pre"), F.expr("right(word, c.y)").alias("suf"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that are one edit apart."""
    scratch = scratch_dir(words.sparkSession)
    lengths = F.array(F.length("word"), F.length("word") - 1)
    zero = F.lit(0)
    rows = words.select(
        "word", "n", F.explode(lengths).alias("m"), zero.alias("x"), zero.alias("y"), zero.alias("bar")
    )
    rows = materialize(_halved(rows.filter(F.col("m") >= SHORTEST)), f"{scratch}/blocks0")
    found, level = None, 0
    while True:
        sizes = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = materialize(rows.join(sizes, _BLOCK), f"{scratch}/sized{level}")
        large = (F.col("size") > BLOCK) & (F.col("m") - F.col("x") - F.col("y") > 1)
        small = sized.filter(~large).select("word", "n", *_BLOCK)
        small = small.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
        pairs = small.mapInArrow(_pairs_in_blocks, "word string, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
        again = sized.filter(large)
        if again.isEmpty():
            return found
        level += 1
        rows = materialize(_halved(again.drop("pre", "suf", "size")), f"{scratch}/blocks{level}")


def _best() -> Column:
    """The near word of largest n, of equal ones the smallest."""
    return F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))


def grouped(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    scratch = scratch_dir(words.sparkSession)
    words = materialize(words, f"{scratch}/words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _best().alias("best"))
    strong = -F.col("best.less") >= TIMES * F.col("n")
    named = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    named = materialize(named, f"{scratch}/named")
    # a form has five times the count, so paths are short; each round doubles the steps taken
    paths = named.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    level = 0
    while True:
        paths = materialize(paths, f"{scratch}/paths{level}")
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if paths.join(further, "root", "left_semi").isEmpty():
            break
        paths = paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        level += 1
    return named.join(paths, "word", "left").withColumn("root", F.coalesce("root", "word"))
