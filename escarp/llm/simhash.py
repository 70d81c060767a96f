"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within a budget of differing bits are found by walking pairs of trie nodes of equal
depth together: a pair holds the bits that differ so far, children of both nodes are paired, and a
pair beyond the budget is dropped with all that hangs below it.

The walk is a few equi-joins, one level of `STRIDE` bits at a time, on node pairs of all tries at
once; no task walks a trie alone. So that the upper levels stay on the diagonal, the 64 bits are cut
into `budget + 2` blocks: two fingerprints within the budget agree on at least two blocks, so for
each choice of two blocks there is a trie over the bits with these blocks first, whose walk starts
with pairs of equal nodes below them. For budget 2 there are 6 tries. Nothing grows with the square
of a group: a node of depth d meets at most 1 + d + d(d-1)/2 others (d counted from the start of
the walk), however many fingerprints share a prefix, and copies are one leaf.

Groups are the connected components of the links. Every document gets its row; NULL and empty
texts have fingerprint zero; equal ids and repeated rows each keep their row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp.llm.exact_dedup import located
from escarp.llm.texts import gathered, lowered, slices, words_of
from escarp.operators.components import connected_nodes
from escarp.session import materialize, scratch_dir

STRIDE = 8
SEED = 42


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per row the bits set in over half of its hashes; no hashes give zero."""
    out = np.zeros(len(starts) - 1, np.uint64)
    counts = np.diff(starts)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sums = np.zeros((len(full), 64), np.int64)
    step = 1 << 18
    begin = starts[:-1][full]
    for at in range(0, len(hashes), step):  # bounds the unpacked bits to 64 bytes x step
        part = hashes[at : at + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(begin, at, "right")) - 1
        last = int(np.searchsorted(begin, at + len(part)))
        cuts = np.maximum(begin[first:last] - at, 0)
        sums[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of `width` words, first shingle of each row); short rows are one shingle."""
    data = lowered(data)
    words = words_of(data, offsets)
    lengths = words.ends - words.starts
    new_ends = np.cumsum(lengths + 1) - 1
    spaced = gathered(np.append(data, np.uint8(0x20)), words.starts, lengths + 1)
    spaced[new_ends] = 0x20
    text = spaced.tobytes()
    new_starts = new_ends - lengths
    counts = np.diff(words.rows)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(shingles)))
    row = np.repeat(np.arange(len(counts)), shingles)
    first = words.rows[:-1][row] + np.arange(len(row)) - starts[:-1][row]
    last = np.minimum(first + width, words.rows[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(text[a:b], SEED)
            for a, b in zip(new_starts[first].tolist(), new_ends[last].tolist(), strict=True)
        ),
        np.uint64,
        len(row),
    )
    return hashes, starts


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """Fingerprint of each row from its shingles of `width` words, repeats included."""
    return _majority(*shingles_of(data, offsets, width))


def fingerprinted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """(id, fp): the fingerprint of every document as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            prints = fingerprints_of(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints)], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def _blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of `count` blocks that cover 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _packed(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of some blocks, one block after another from the high end."""
    out = F.lit(0).cast("long")
    for low, width in blocks:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b), a < b: distinct fingerprints of column `fp` that differ in at most `budget` bits."""
    spark = prints.sparkSession
    scratch = scratch_dir(spark)
    blocks = _blocks(budget + 2)
    tries = []
    for number, chosen in enumerate(combinations(range(len(blocks)), 2)):
        top = [blocks[i] for i in chosen]
        rest = [block for i, block in enumerate(blocks) if i not in chosen]
        width = sum(w for _, w in rest)
        tries.append(
            F.struct(
                F.lit(number).alias("trie"),
                _packed(F.col("fp"), top).alias("top"),
                F.shiftleft(_packed(F.col("fp"), rest), 64 - width).alias("rest"),
            )
        )
    leaves = materialize(
        prints.select("fp").filter("fp IS NOT NULL").distinct().select("fp", F.explode(F.array(*tries)).alias("t")).select("fp", "t.*"),
        f"{scratch}/leaves",
    )
    # a node is (trie, top, prefix of rest): only tops with two leaves have pairs to walk
    shared = leaves.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaves = materialize(
        leaves.join(shared.drop("n"), ["trie", "top"]), f"{scratch}/shared"
    )
    deepest = max(64 - sum(w for _, w in pair) for pair in combinations(blocks, 2))
    pairs = shared.select("trie", "top", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("diff"))
    for depth in range(STRIDE, deepest + STRIDE, STRIDE):
        before = F.shiftrightunsigned("rest", 64 - depth + STRIDE) if depth > STRIDE else F.lit(0).cast("long")
        here = F.shiftrightunsigned("rest", 64 - depth)
        nodes = leaves.select("trie", "top", before.alias("parent"), here.alias("node")).distinct()
        left = nodes.select("trie", "top", F.col("parent").alias("p"), F.col("node").alias("l"))
        right = nodes.select("trie", "top", F.col("parent").alias("q"), F.col("node").alias("r"))
        diff = F.col("diff") + F.bit_count(F.col("l").bitwiseXOR(F.col("r")).bitwiseAND(F.lit((1 << STRIDE) - 1)))
        pairs = (
            pairs.join(left, ["trie", "top", "p"])
            .join(right, ["trie", "top", "q"])
            .filter((F.col("l") <= F.col("r")) | (F.col("p") < F.col("q")))
            .withColumn("diff", diff)
            .filter(F.col("diff") <= budget)
            .select("trie", "top", F.col("l").alias("p"), F.col("r").alias("q"), "diff")
        )
        pairs = materialize(pairs, f"{scratch}/pairs{depth}")
    found = F.shiftrightunsigned("rest", 64 - depth)
    left = leaves.select("trie", "top", found.alias("p"), F.col("fp").alias("a"))
    right = leaves.select("trie", "top", found.alias("q"), F.col("fp").alias("b"))
    return (
        pairs.filter("p <> q")
        .join(left, ["trie", "top", "p"])
        .join(right, ["trie", "top", "q"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2
) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links; NULL where no id of it is known.

    The longs are written once; the fingerprint classes, not the documents, are linked.
    """
    scratch = scratch_dir(docs.sparkSession)
    prints = materialize(fingerprinted(docs, id_col, text_col), f"{scratch}/prints")
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    labels = connected_nodes(links(classes, budget)).withColumnRenamed("node", "fp")
    merged = classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    merged = materialize(merged, f"{scratch}/classes")
    smallest = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    named = merged.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp")


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2
) -> DataFrame:
    """One row of each component: that of the smallest id, rows without an id last, of equal ids the
    one that comes first in the table."""
    scan, locator = located(docs, scratch_dir(docs.sparkSession))
    at_col = "at"
    while at_col in docs.columns:
        at_col += "_"
    own = F.col(f"`{id_col}`")
    key = F.struct(own.isNull().alias("unnamed"), own.alias("id"), locator.alias("at"))
    text = F.col(f"`{text_col}`").alias("text")
    groups = grouped(scan.select(key.alias("key"), text), "key", "text", budget)
    dropped = groups.filter(F.col("key") != F.col("component_id")).select(F.col("key.at").alias(at_col))
    kept = scan.withColumn(at_col, locator).join(dropped, at_col, "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])
