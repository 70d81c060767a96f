"""Connected regions of cells (8 neighbours), in two levels.

Cells are labelled inside each tile first; a tile holds a fixed number of cells, whatever the
data. Then only contacts across tile borders are left, a graph far smaller than the raster. It
is contracted round by round: each node points to its smallest neighbour, chains are shortened,
and edges are rewritten to the new labels until none is left. Every round is a few equi-joins
and `min` aggregates, which combine before the shuffle, so a region that spans a third of the
table has no task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.operators.terrain import TILE_CELLS, with_tile
from escarp.session import drop_path, materialize, scratch_dir


def _label_grid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index of the smallest cell of each cell's region; cells are unique."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    n = len(x)
    width = int(x.max() - x.min()) + 3
    key = (y - y.min()) * width + (x - x.min()) + 1
    a, b = [], []
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(key, key + step)
        hit = (at < n) & (key[np.minimum(at, n - 1)] == key + step)
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        if np.array_equal(low, high):
            break
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    out = np.empty(n, dtype=np.int64)
    out[order] = order[label]
    return out


def _label_tile(tile: pd.DataFrame) -> pd.DataFrame:
    x, y = tile["x"].to_numpy(), tile["y"].to_numpy()
    root = _label_grid(x, y)
    helpers = ["tx", "ty", "_rx", "_ry"]
    return tile.drop(columns=helpers, errors="ignore").assign(local_x=x[root], local_y=y[root])


def _rectangle(split_cells: int) -> list[Column]:
    """Position of the rectangle of `split_cells` x `split_cells` cells that holds a cell."""
    return [F.floor(F.col(c) / split_cells).alias(f"_r{c}") for c in ("x", "y")]


def tile_components(
    cells: DataFrame, tile_cells: int = TILE_CELLS, split_cells: int | None = None
) -> DataFrame:
    """Region of each cell within its tile, named by its smallest cell (local_x, local_y).

    With `split_cells` also within its rectangle. Cells are unique in (x, y); other columns are
    carried along.
    """
    typed = cells.withColumns({c: F.col(c).cast("bigint") for c in ("x", "y")})
    schema = T.StructType(
        [*typed.schema.fields]
        + [T.StructField("local_x", T.LongType()), T.StructField("local_y", T.LongType())]
    )
    tiled = with_tile(typed, tile_cells)
    keys = ["tx", "ty"]
    if split_cells:
        tiled = tiled.select("*", *_rectangle(split_cells))
        keys += ["_rx", "_ry"]
    return tiled.groupBy(*keys).applyInPandas(_label_tile, schema)


def border_contacts(
    labelled: DataFrame, tile_cells: int = TILE_CELLS, split_cells: int | None = None
) -> DataFrame:
    """Pairs (a, b) of tile regions that touch, once each; `inside` if in the same rectangle."""
    border = F.lit(False)
    for size in {tile_cells, split_cells or tile_cells}:
        for name in ("x", "y"):
            border |= F.pmod(F.col(name), F.lit(size)).isin(0, size - 1)
    edge_cells = labelled.filter(border).withColumn("node", _node_name())
    offsets = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1))
        ]
    )
    here = edge_cells.select("x", "y", "node", F.explode(offsets).alias("o")).select(
        (F.col("x") + F.col("o.dx")).alias("x"),
        (F.col("y") + F.col("o.dy")).alias("y"),
        F.col("node").alias("a"),
    )
    there = edge_cells.select("x", "y", F.col("node").alias("b"))
    touching = here.join(there, ["x", "y"]).filter("a <> b").select("a", "b").distinct()
    if not split_cells:
        return touching.withColumn("inside", F.lit(True))
    # a tile region lies in one rectangle: that of the cell that names it
    same = F.lit(True)
    for one, two in zip(cell_of(F.col("a")), cell_of(F.col("b")), strict=True):
        same &= F.floor(one / split_cells) == F.floor(two / split_cells)
    return touching.withColumn("inside", same)


def _node_name() -> Column:
    """A region is numbered by its smallest cell; x and y each fit into 32 bits."""
    return F.shiftleft("local_y", 32) + F.col("local_x")


def cell_of(node: Column) -> tuple[Column, Column]:
    """(x, y) of the cell that numbers a region."""
    y = F.shiftright(node + 2147483648, 32)
    return node - F.shiftleft(y, 32), y


def connected_nodes(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge list (a, b).

    Every round joins each node that is not its neighbourhood's smallest by hash to another, so the
    rounds end with the edges.
    """
    spark = edges.sparkSession
    scratch = scratch_dir(spark)
    current = materialize(edges.select("a", "b").filter("a <> b").distinct(), f"{scratch}/edges0")
    current_path = f"{scratch}/edges0"
    renames = []
    while not current.isEmpty():
        round_no = len(renames)
        both = current.select("a", "b").unionByName(
            current.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        # a new hash order each round: with plain order a chain of tiles contracts slowly; two
        # nodes of equal hash only wait for another round
        rank = F.xxhash64(F.lit(round_no), F.col("b"))
        own = F.xxhash64(F.lit(round_no), F.col("a"))
        parent = both.groupBy("a").agg(F.min_by("b", rank).alias("p"), F.min(rank).alias("r"))
        smaller = F.when(F.col("r") < own, F.col("p")).otherwise(F.col("a"))
        parent = parent.select("a", smaller.alias("p"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        rename = materialize(
            parent.join(up, "p").select("a", F.col("pp").alias("p")), f"{scratch}/rename{round_no}"
        )
        renames.append(rename)
        left = rename.select("a", F.col("p").alias("na"))
        right = rename.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        rewritten = (
            current.join(left, "a")
            .join(right, "b")
            .filter("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct()
        )
        next_path = f"{scratch}/edges{round_no + 1}"
        current = materialize(rewritten, next_path)
        drop_path(spark, current_path)
        current_path = next_path
    if not renames:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # follow the renames from the last round back to the first
    labels = renames[-1]
    for earlier in reversed(renames[:-1]):
        later = labels.select(F.col("a").alias("p"), F.col("p").alias("q"))
        labels = earlier.join(later, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    return labels.select(F.col("a").alias("node"), F.col("p").alias("component"))


def _smallest_names(edges: DataFrame, out: str) -> DataFrame:
    """(local, out): every node with the smallest node of its component."""
    labels = connected_nodes(edges)
    smallest = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(smallest, "component").select(
        F.col("node").alias("local"), F.col("least").alias(out)
    )


def connected_components(
    cells: DataFrame, tile_cells: int = TILE_CELLS, split_cells: int | None = None
) -> DataFrame:
    """Cells with `component` (whole region) and `part` (connected part within a rectangle).

    Rectangles have `split_cells` x `split_cells` cells and start at (0, 0); without them a part
    is the whole region. Both are numbered by their smallest cell (`cell_of`). `tile_cells` is
    only how much one task labels; it does not change the result. The tile labels are written
    once: they are read for the contacts and for the result.
    """
    scratch = scratch_dir(cells.sparkSession)
    labelled = materialize(tile_components(cells, tile_cells, split_cells), f"{scratch}/tiles")
    contacts = materialize(border_contacts(labelled, tile_cells, split_cells), f"{scratch}/contacts")
    named = (
        labelled.withColumn("local", _node_name())
        .drop("local_x", "local_y")
        .join(_smallest_names(contacts, "component"), "local", "left")
        .withColumn("component", F.coalesce("component", "local"))
    )
    if not split_cells:
        return named.withColumn("part", F.col("component")).drop("local")
    parts = _smallest_names(contacts.filter("inside"), "part")
    return (
        named.join(parts, "local", "left")
        .withColumn("part", F.coalesce("part", "local"))
        .drop("local")
    )
