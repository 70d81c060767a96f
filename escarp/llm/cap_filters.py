"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: after a random rotation a vector is cut into BLOCKS
parts, each part has its own small random code, and a direction is one code word of each, joined. A
vector belongs to every direction whose inner product with it reaches a threshold. These are found
by list decoding: partial sums over the first parts are kept only while the best words of the rest
can still lift them over the threshold. Vectors that share a direction are compared exactly, in
double precision. The threshold follows the number of vectors, so that a direction holds about
BUCKET of them by chance; the number of directions follows from the exact chance that a pair at the
least cosine shares one. A vector without any direction gets its best one. How many it has differs
from vector to vector, which is why several small codes find more than a large one.

Copies of one vector are one row while comparing. A direction with many vectors (a group of
near-copies may hold a third of all) is cut into chunks, and pairs of chunks are tasks of their own,
so no group is in one task. A task gives sums, not pairs: how many links each of its vectors has, and
a spanning forest of its links. A pair that shares several directions counts in the first of them.

Defined results: vectors that are NULL, empty, zero or hold a NULL or non-finite value link with
nothing, not even with their copies; vectors of other lengths than another's never link with it; a NULL
id is reachable but never the smallest; repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.operators.components import connected_nodes
from escarp.session import materialize, scratch_dir

BLOCKS, TABLES = 2, 8
#: Vectors in a direction by chance, and vectors of a chunk.
BUCKET, CHUNK = 256.0, 512
#: Directions that a pair at exactly the least cosine shares on average, over all tables.
SHARED = 18.0
#: Least dimensions of a code of several parts.
SPLIT_DIM = 6
_STEPS = 20_000
SEED = 11


def cap_share(t: float, dim: int, turn: float = 0.0) -> float:
    """Share of the sphere whose inner product with each of two unit vectors, `turn` radians apart, is
    at least t > 0. In their plane a random direction has a uniform angle and, by the law of its
    squared length, reaches r with probability (1 - r^2)^((dim - 2) / 2)."""
    widest = np.arccos(t) - turn / 2
    if widest <= 0:
        return 0.0
    angles = (np.arange(_STEPS) + 0.5) / _STEPS * widest + turn / 2
    reach = np.clip(1 - (t / np.cos(angles)) ** 2, 0, None)
    return float(np.mean(reach ** ((dim - 2) / 2)) * widest / np.pi)


def cap_height(share: float, dim: int, most: float) -> float:
    """The inner product that this share of the sphere reaches, `most` at most."""
    low, high = 1e-9, most
    if cap_share(most, dim) >= share:
        return most
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if cap_share(middle, dim) > share else (low, middle)
    return low


class CapCode:
    """Random product code for vectors of one length; `table` tells independent codes apart.

    The threshold is the inner product at which a direction holds about BUCKET vectors, and `least` at
    most: a wider cap than the search asks for is of no use, however many vectors it holds. The number
    of directions makes a pair at exactly `least` share SHARED of them over all tables.
    Below SPLIT_DIM dimensions parts would be too short to differ, and the code is a plain one.
    """

    def __init__(self, dim: int, vectors: int, table: int = 0, least: float = 0.95, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, table])
        self.table = table
        self.blocks = BLOCKS if dim >= SPLIT_DIM else 1
        self.cuts = [dim * b // self.blocks for b in range(self.blocks + 1)]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        if dim == 1:
            self.words, self.threshold, self.codes = 2, 0.5, [np.array([[1.0], [-1.0]])]
            return
        share = min(0.02, max(BUCKET / max(vectors, 1), 1e-12))
        self.threshold = cap_height(share, dim, least)
        both = cap_share(self.threshold, dim, float(np.arccos(least)))
        self.words = max(2, int(np.ceil((SHARED / TABLES / both) ** (1 / self.blocks))))
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            code = rng.standard_normal((self.words, b - a))
            norms = np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12)
            self.codes.append(code / norms * np.sqrt((b - a) / dim))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that reach the threshold, the best one if none does."""
        turned = unit @ self.rotation
        parts = [
            turned[:, a:b] @ code.T
            for a, b, code in zip(self.cuts, self.cuts[1:], self.codes, strict=False)
        ]
        best = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]
        threshold = np.minimum(self.threshold, best[0])
        rows, names, sums = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b, part in enumerate(parts):
            rest = best[b + 1] if b + 1 < self.blocks else np.zeros(len(unit))
            total = sums[:, None] + part[rows]
            # a hair of slack: the best direction is summed in another order
            keep, word = np.nonzero(total >= (threshold - rest - 1e-12)[rows][:, None])
            rows, names, sums = rows[keep], names[keep] * self.words + word, total[keep, word]
        return rows, names * TABLES + self.table


def _valid(vector: str) -> str:
    """SQL: the vector can be compared."""
    return (
        f"{vector} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, v -> v IS NULL OR "
        f"isnan(v) OR abs(v) = CAST('Infinity' AS DOUBLE)) AND exists({vector}, v -> v <> 0)"
    )


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) form a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[i] = True
    return keep


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met_before(direction: int, lists: list[list[bytes]]) -> list[np.ndarray]:
    """Per list of vectors a matrix vector x direction of the earlier directions that two share."""
    flat = [[np.frombuffer(d, np.int64) for d in one] for one in lists]
    rows = [np.repeat(np.arange(len(one)), [len(d) for d in one]) for one in flat]
    names = [np.concatenate(one) for one in flat]
    used, counts = np.unique(np.concatenate(names), return_counts=True)
    used = used[(used < direction) & (counts > 1 if len(lists) == 1 else counts > 0)]
    out = []
    for one, row, name in zip(flat, rows, names, strict=True):
        matrix = np.zeros((len(one), len(used)), np.float32)
        if len(used):
            at = np.minimum(np.searchsorted(used, name), len(used) - 1)
            hit = used[at] == name
            matrix[row[hit], at[hit]] = 1
        out.append(matrix)
    return out


Links = tuple[np.ndarray, np.ndarray, np.ndarray]


def compare(direction: int, least: float, kind: str, one: dict, two: dict | None) -> Links | None:
    """Links between two chunks of a direction, or inside one (two is None).

    (node, links, -1) for vectors with links, then (a, 0, b) for the links of a spanning forest.
    Pairs that share an earlier direction belong to that one.
    """
    inside = two is None
    two = one if inside else two
    x = _unit(one["vector"], kind)
    y = x if inside else _unit(two["vector"], kind)
    close = x @ y.T >= least
    if inside:
        close &= np.tri(len(x), k=-1, dtype=bool).T
    if not close.any():
        return None
    left, right = close.any(axis=1), close.any(axis=0)
    if inside:
        left = right = left | right
        met = _met_before(direction, [[d for d, k in zip(one["directions"], left, strict=True) if k]]) * 2
    else:
        met = _met_before(
            direction,
            [
                [d for d, k in zip(side["directions"], some, strict=True) if k]
                for side, some in ((one, left), (two, right))
            ],
        )
    a, b = np.nonzero(close[np.ix_(left, right)] & (met[0] @ met[1].T == 0))
    if not len(a):
        return None
    a, b = np.flatnonzero(left)[a], np.flatnonzero(right)[b]
    n1, n2 = np.array(one["node"]), np.array(two["node"])
    links = np.concatenate(
        (
            np.bincount(a, np.array(two["copies"])[b], len(n1)),
            np.bincount(b, np.array(one["copies"])[a], len(n2)),
        )
    ).astype(np.int64)
    nodes, some = np.concatenate((n1, n2)), links > 0
    keep = _forest(n1[a], n2[b])
    a, b = n1[a[keep]], n2[b[keep]]
    return (
        np.concatenate((nodes[some], a)),
        np.concatenate((links[some], np.zeros(len(a), np.int64))),
        np.concatenate((np.full(int(some.sum()), -1), b)),
    )


_GROUP = ["dim", "direction", "c0", "c1"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """(group, its two sides) of rows sorted by group and side; a group has two chunks at most."""
    now, sides = None, [{}, {}]
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, key in enumerate(zip(*(columns[g] for g in _GROUP), strict=True)):
            if key != now:
                if now is not None:
                    yield now, sides
                now, sides = key, [{}, {}]
            side = sides[columns["side"][i]]
            for name in ("node", "copies", "vector", "directions"):
                side.setdefault(name, []).append(columns[name][i])
    if now is not None:
        yield now, sides


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    scratch = scratch_dir(spark)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).withColumn("valid", F.coalesce(F.expr(_valid("vector")), F.lit(False)))
    rows = rows.withColumn("vector", F.expr("transform(vector, v -> v + 0D)"))  # -0.0 is 0.0
    distinct = (
        rows.filter("valid").groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    )
    distinct = distinct.withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, f"{scratch}/distinct")
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy(F.size("vector").alias("dim")).count().collect()}
    codes = spark.sparkContext.broadcast(
        {dim: [CapCode(dim, n, table, least) for table in range(TABLES)] for dim, n in sizes.items()}
    )
    kind = "<f4" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dims = np.array([len(v) for v in part.column(2)])
                for dim in np.unique(dims):
                    some = part.take(pa.array(np.flatnonzero(dims == dim)))
                    packed = some.column(2).flatten().to_numpy().reshape(-1, dim).astype(kind)
                    vectors = [v.tobytes() for v in packed]
                    pairs = [code.decode(_unit(vectors, kind)) for code in codes.value[dim]]
                    of, names = map(np.concatenate, zip(*pairs, strict=True))
                    order = np.lexsort((names, of))
                    cuts = np.searchsorted(of[order], np.arange(len(vectors) + 1))
                    names = names[order].astype(np.int64)
                    lists = [names[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0),
                            some.column(1),
                            pa.array([int(dim)] * len(vectors), pa.int32()),
                            pa.array(vectors, pa.binary()),
                            pa.array(lists, pa.binary()),
                            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(names)),
                        ],
                        ["node", "copies", "dim", "vector", "directions", "names"],
                    )

    units = distinct.select("node", "copies", "vector").mapInArrow(
        listed,
        "node long, copies long, dim int, vector binary, directions binary, names array<long>",
    )
    units = materialize(units, f"{scratch}/units")
    narrow = units.select("node", "dim", F.explode("names").alias("direction"))
    crowd = narrow.groupBy("dim", "direction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = crowd.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    crowd = materialize(crowd.drop("n"), f"{scratch}/crowd")
    placed = (
        narrow.join(crowd, ["dim", "direction"])
        .withColumn("own", F.pmod(F.xxhash64("node", "direction"), F.col("chunks")).cast("int"))
        .withColumn("c", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select(
            "node",
            "direction",
            F.least("own", "c").alias("c0"),
            F.greatest("own", "c").alias("c1"),
            (F.col("own") > F.col("c")).cast("int").alias("side"),
        )
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, direction, c0, c1), (one, two) in _groups(batches):
            if not one or (c0 != c1 and not two):
                continue
            links = compare(direction, least, kind, one, two if c0 != c1 else None)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["node", "links", "other"])

    pairs = (
        placed.join(units.drop("names"), "node")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .select(*_GROUP, "side", "node", "copies", "vector", "directions")
        .mapInArrow(compared, "node long, links long, other long")
    )
    found = materialize(pairs, f"{scratch}/found")
    links = found.filter("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = connected_nodes(edges)
    nodes = (
        distinct.select("vector", "node", "copies", "least_id")
        .join(links, "node", "left")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    nodes = materialize(nodes, f"{scratch}/nodes")
    smallest = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = nodes.join(smallest, "component").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    good = rows.filter("valid").join(named, "vector").select("id", "n_links", "component_id")
    bad = rows.filter("NOT valid").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return good.unionByName(bad).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
