"""Exact nearest neighbours: blocks of rows are compared only where a distance bound allows it.

Rows belong to the cell of their nearest pivot, and are cut into blocks along their distance to it.
Every block of asking rows is first compared with the training rows it lies among, which bounds the
distance of the k-th neighbour. By the triangle inequality that bound rules out most other blocks.
Blocks that are left meet in groups. In a group, one matrix product gives lower bounds of all distances,
and only pairs below the bound of their asking row are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.functions.stats import with_ordinal
from escarp.session import materialize, scratch_dir

MAX_PIVOTS = 256
SAMPLE_PER_PIVOT = 16
SALTS = 16
SLACK = 1e-9  # of a distance, against rounding
CHUNK = 64  # asking rows compared at a time
BLOCK_BITS = 32
GROUP_ROWS = 1 << 15  # rows of the blocks that are sent together; a task holds two groups
ASKED_AT_ONCE = 1024  # asking rows in one matrix product
PAIRS_AT_ONCE = 512  # pairs that are looked at together in single precision
EXACT_AT_ONCE = 4096  # and in double precision
NEAR_COLUMNS = ["_at", "_group", "_id", "x", "_r", "_bound", "d", "y"]


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n points spread over the sample: farthest points, then moved to the middle of their cells.

    Any points give right results; good ones give small cells. Straight-line distances will do.
    """

    def squares(to: np.ndarray) -> np.ndarray:
        return np.stack([((sample - one) ** 2).sum(axis=1) for one in to], axis=1)

    pivots = sample[:1]
    closest = squares(pivots)[:, 0]
    while len(pivots) < n and closest.max() > 0:
        pivots = np.vstack([pivots, sample[[closest.argmax()]]])
        closest = np.minimum(closest, squares(pivots[-1:])[:, 0])
    for _ in range(2):
        cell = squares(pivots).argmin(axis=1)
        pivots = np.stack([sample[cell == c].mean(axis=0) for c in np.unique(cell)])
    return pivots


def _task_functions(k: int, p: float, pivots: np.ndarray):
    """What runs in the tasks. All of it is local, so it travels by value."""

    def raised(gap: np.ndarray) -> np.ndarray:
        """gap ** p; whole and half powers by products and a root, which are several times faster."""
        if p < 1 or p % 0.5:
            return gap**p
        power = gap
        for _ in range(int(p) - 1):
            power = power * gap
        return power * np.sqrt(gap) if p % 1 else power

    def powers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums of |gap| ** p of all pairs; what is not a number is infinitely far."""
        total = np.zeros((len(left), len(right)))
        for a, b in zip(left.T, right.T):
            total += raised(np.abs(a[:, None] - b[None, :]))
        return np.where(np.isnan(total), np.inf, total)

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        return np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, pivots.shape[1]))

    def nearest(x_train, y_train, x_query):
        """Training rows come sorted by target: the stable sort lets the smaller target win a tie."""
        power = powers(x_query, x_train)
        at = np.argsort(power, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(power, at, axis=1), y_train[at]

    def place(batches):
        """Adds the cell of each row and its distance to the pivot; odd vectors get a cell of their own."""
        for batch in batches:
            for start in range(0, len(batch), 2048):
                rows = batch.iloc[start : start + 2048].copy()
                gaps = powers(matrix(rows), pivots) ** (1 / p)
                usable = np.isfinite(gaps).all(axis=1)
                rows["_cell"] = np.where(usable, gaps.argmin(axis=1), len(pivots)).astype(np.int32)
                rows["_r"] = np.where(usable, gaps.min(axis=1), 0.0)
                yield rows

    def widened(gaps: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound[:, None] + SLACK * (gaps + bound[:, None])

    def at_home(counts: np.ndarray, radii: np.ndarray):
        """Neighbours within a row's own block, its bound, and the cells its block still needs.

        `counts` and `radii` are the training rows of each cell and how far from the pivot they reach.
        """

        def bounded(x: np.ndarray, power: np.ndarray):
            """Distances to the pivots, and a bound on that of the k-th neighbour."""
            gaps = powers(x, pivots) ** (1 / p)
            reach = np.where(counts > 0, gaps + radii, np.inf)
            order = np.argsort(reach, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k
            reach = np.take_along_axis(reach, order, axis=1)
            bound = np.where(enough.any(axis=1), reach[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
            if power.shape[1] == k:
                bound = np.minimum(bound, power[:, -1] ** (1 / p))
            usable = np.isfinite(gaps).all(axis=1) & (p >= 1)  # below 1 it is no metric
            return gaps, np.where(usable, bound, np.inf)

        def search(rows: pd.DataFrame) -> pd.DataFrame:
            base = rows[rows["_asks"] == 0].sort_values("y")
            asked = rows[rows["_asks"] == 1]
            x_train, y_train = matrix(base), base["y"].to_numpy()
            low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
            unbounded, powers_found, targets, bounds = False, [], [], []
            for start in range(0, len(asked), CHUNK):
                x = matrix(asked.iloc[start : start + CHUNK])
                power, y = nearest(x_train, y_train, x)
                gaps, bound = bounded(x, power)
                free = np.isinf(bound)
                unbounded |= bool(free.any())
                give = widened(gaps, bound)
                # a row of another cell is at least half as far as its pivot is farther than the own one
                possible = (gaps - gaps.min(axis=1, keepdims=True)) / 2 <= give
                possible[free] = False
                low = np.minimum(low, np.where(possible, gaps - give, np.inf).min(axis=0))
                high = np.maximum(high, np.where(possible, gaps + give, -np.inf).max(axis=0))
                powers_found.extend(power.tolist())
                targets.extend(y.tolist())
                bounds.extend(bound.tolist())
            if unbounded:
                low, high = np.full(len(pivots), -np.inf), np.full(len(pivots), np.inf)
            cells = np.flatnonzero(low <= high)
            lows, highs = low[cells].tolist(), high[cells].tolist()
            if unbounded:  # only these can have infinitely far neighbours
                cells = np.append(cells, len(pivots))
                lows, highs = [*lows, -np.inf], [*highs, np.inf]
            none = [None] * (len(asked) - 1)
            columns = {
                "_at": asked["_at"], "_group": asked["_group"], "_id": asked["_id"], "x": asked["x"], "_r": asked["_r"],
                "d": powers_found, "y": targets, "_bound": bounds,
            }
            if len(asked):  # the needs of the block go with its first row
                columns |= {"_cells": [cells.tolist(), *none], "_lows": [lows, *none], "_highs": [highs, *none]}
            else:
                columns |= {"_cells": [], "_lows": [], "_highs": []}
            return pd.DataFrame(columns)

        return search

    def features(x: np.ndarray, of: str, middle: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Rows whose product is a lower bound of the sums of |gap| ** p; rows that are not finite give 0.

        With t = (gap / scale) ** 2, |gap| ** p is weight * t ** (p / 2). Below p = 2 a parabola in t through 0
        that touches it at t = 1 lies under it, from there on its tangent. Values cut off far from the middle
        only come closer. Powers of a gap of two rows are products of powers of each.
        """
        s = p / 2
        const, first, second = (0.0, 2 - s, s - 1) if s < 1 else (1 - s, s, 0.0)
        v = np.clip((x - middle) * scale, -1.3, 1.3)
        square = v * v
        alone = ((first * square + second * square * square) * weight).sum(axis=1, keepdims=True)
        one = np.ones((len(x), 1))
        if of == "asking":
            parts = [v, v * square, square, alone + const * weight.sum(), one]
        else:
            parts = [
                weight * (-2 * first * v - 4 * second * v * square), weight * (-4 * second * v),
                weight * (6 * second) * square, one, alone,
            ]
        rows = np.hstack(parts).astype(np.float32)
        rows[~np.isfinite(rows).all(axis=1) | ~np.isfinite(x).all(axis=1)] = 0
        return rows

    def mean_square(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
        x = x[:: max(1, len(x) // 128)]
        x = x[np.isfinite(x).all(axis=1)]
        return ((x - middle) ** 2).mean(axis=0) if len(x) else np.zeros(x.shape[1])

    class Bounds:
        """`features` of asking rows, kept while the blocks met are alike; any scale gives right bounds."""

        def __init__(self, x_query: np.ndarray):
            self.x, self.touch, self.rows, self.done = x_query, None, None, np.zeros(len(x_query), dtype=bool)

        def against(self, wanted: np.ndarray, x_train: np.ndarray):
            """Features of the training rows, those of the wanted rows being made; None without a scale."""
            finite = x_train[np.isfinite(x_train).all(axis=1)]
            if not len(finite):
                return None
            middle = finite.mean(axis=0)
            touch = 3 * (mean_square(self.x[wanted], middle) + mean_square(finite, middle))
            if not (np.isfinite(touch**p).all() and np.isfinite(touch).all() and touch.max(initial=0) > 0):
                return None
            fits = self.touch is not None and 0.67 < (touch.sum() / self.touch.sum()) < 1.5
            if not fits or ((middle - self.middle) ** 2).sum() > 0.1 * self.touch.sum():
                weight = touch ** (p / 2)
                self.middle, self.touch, self.factor = middle, touch, weight.max()
                self.weight = weight / self.factor
                self.scale = np.where(touch > 0, 1 / np.sqrt(np.where(touch > 0, touch, 1)), 0.0)
                self.done[:] = False
            new = wanted[~self.done[wanted]]
            made = features(self.x[new], "asking", self.middle, self.scale, self.weight)
            if self.rows is None:
                self.rows, self.lengths = np.zeros((len(self.x), made.shape[1]), np.float32), np.zeros(len(self.x))
                self.rounding = (made.shape[1] + 8) * 2.0**-23
            self.rows[new], self.done[new] = made, True
            self.lengths[new] = np.sqrt((made.astype(float) ** 2).sum(axis=1))
            return features(x_train, "known", self.middle, self.scale, self.weight)

        def below(self, asked: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
            """Places, in the matrix of asked and training rows, of the pairs whose bound is within the limit."""
            most = np.sqrt((right.astype(float) ** 2).sum(axis=1).max())
            cut = limit / self.factor * (1 + 1e-6) + self.rounding * self.lengths[asked] * most
            return np.flatnonzero(self.rows[asked] @ right.T <= cut.astype(np.float32)[:, None])

    def halved(x: np.ndarray, middle: np.ndarray, unit: float):
        """Single-precision copies, and how far each row is moved by that."""
        x = (x - middle) / unit
        short = x.astype(np.float32)
        moved = (np.abs(x - short) ** p).sum(axis=1) ** (1 / p)
        return short, np.where(np.isnan(moved), np.inf, moved)

    def maybe(short_query, short_train, row, at, limit) -> np.ndarray:
        """Which pairs may be within the limit of their asking row, by single precision."""
        out = np.ones(len(row), dtype=bool)
        left, right = np.empty((2, PAIRS_AT_ONCE, short_query.shape[1]), np.float32)
        for start in range(0, len(row), PAIRS_AT_ONCE):
            some = slice(start, start + PAIRS_AT_ONCE)
            n = len(row[some])
            gap, root = left[:n], right[:n]
            np.take(short_query, row[some], axis=0, out=gap, mode="clip")
            np.take(short_train, at[some], axis=0, out=root, mode="clip")
            np.abs(np.subtract(gap, root, out=gap), out=gap)
            if p == 1.5:
                power = np.einsum("ij,ij->i", gap, np.sqrt(gap, out=root))
            else:
                power = raised(gap).sum(axis=1)
            out[some] = ~(power > limit[row[some]])
        return out

    def merged(top, rows, d, y):
        """The k nearest of those in `top` and new ones; top has distance, target and 0 known, 1 new, 2 none."""
        at, place = np.unique(rows, return_inverse=True)
        known = [one[at].ravel() for one in top]
        of = np.concatenate([np.repeat(np.arange(len(at)), k), place])
        d, y, kind = np.append(known[0], d), np.append(known[1], y), np.append(known[2], np.ones(len(rows)))
        order = np.lexsort((kind, y, d, of))
        first = order[np.searchsorted(of[order], np.arange(len(at)))[:, None] + np.arange(k)]
        for one, new in zip(top, (d, y, kind)):
            one[at] = new[first]

    def exact(x_query, x_train, y_train, row, at, limit):
        """Those pairs that are within the limit of their asking row: (row, distance, target).

        Summed in the order of `powers`, so that equal distances are equal to the last bit.
        """
        power = np.zeros(len(row))
        for start in range(0, len(row), EXACT_AT_ONCE):
            some = slice(start, start + EXACT_AT_ONCE)
            gap = np.take(x_query.T, row[some], axis=1) - np.take(x_train.T, at[some], axis=1)
            for one in raised(np.abs(gap, out=gap)):
                power[some] += one
        power[np.isnan(power)] = np.inf
        near = power <= limit[row]
        return row[near], power[near], y_train[at[near]]

    def elsewhere(query: pd.DataFrame, base: pd.DataFrame):
        """The k nearest of the rows' own and those in `base`, blocks of training rows; as arrays like `top`."""
        top = np.full((len(query), k), np.inf), np.full((len(query), k), np.nan), np.full((len(query), k), 2.0)
        for i, (d, y) in enumerate(zip(query["d"], query["y"])):
            top[0][i, : len(d)], top[1][i, : len(y)], top[2][i, : len(d)] = d, y, 0
        x_query, own, limit = matrix(query), query["_r"].to_numpy(float), query["_bound"].to_numpy(float)
        home, free = query["_at"].to_numpy(), np.isinf(limit)
        cells = np.unique(base["_cell"].to_numpy())
        cells = cells[cells < len(pivots)]
        gaps = [powers(x_query[i : i + CHUNK], pivots[cells]) for i in range(0, len(query), CHUNK)]
        gaps = dict(zip(cells.tolist(), np.vstack(gaps).T ** (1 / p))) if gaps else {}
        bounds, x_base = Bounds(x_query), matrix(base)
        usable = x_base[np.isfinite(x_base).all(axis=1)]
        middle = usable.mean(axis=0) if len(usable) else np.zeros(pivots.shape[1])
        unit = max([np.abs(x[np.isfinite(x)]).max(initial=0) for x in (x_query - middle, x_base - middle)]) or 1.0
        with np.errstate(all="ignore"):
            short_query, moved = halved(x_query, middle, unit)
        for other, block in base.groupby("_other", sort=True):
            cell, r, x_train = int(block["_cell"].iloc[0]), block["_r"].to_numpy(), matrix(block)
            y_train = block["y"].to_numpy()
            if cell < len(pivots):
                gap = gaps[cell]
                bound = np.minimum(limit, top[0][:, -1] ** (1 / p))
                give = bound + SLACK * (gap + bound)
                low, high = gap - give, gap + give
                # a row of another cell is at least half as far as its pivot is farther than the own one
                low[(gap - own) / 2 > give] = np.inf
            else:
                low, high = np.full(len(query), np.nan), np.full(len(query), np.nan)
            low[free], high[free] = -np.inf, np.inf
            wanted = np.flatnonzero((low <= r.max()) & (high >= r.min()) & (home != other))
            wanted = wanted[np.argsort(low[wanted], kind="stable")]
            if not len(wanted):
                continue
            with np.errstate(all="ignore"):
                known = bounds.against(wanted, x_train)
                short_train, moved_train = halved(x_train, middle, unit)
            for start in range(0, len(wanted), ASKED_AT_ONCE):
                asked = wanted[start : start + ASKED_AT_ONCE]
                near = np.flatnonzero((r >= low[asked].min()) & (r <= high[asked].max()))
                if not len(near):
                    continue
                near = slice(None) if len(near) == len(r) else near
                within = np.minimum(limit[asked] ** p * (1 + SLACK), top[0][asked, -1])
                n = len(r[near])
                with np.errstate(all="ignore"):
                    pairs = np.arange(len(asked) * n) if known is None else bounds.below(asked, known[near], within)
                    row = pairs // n
                    at = pairs - row * n
                    if p >= 1:  # below, distances of moved rows say nothing
                        reach = within ** (1 / p) / unit + moved[asked] + moved_train[near].max()
                        reach = reach**p * (1 + (len(middle) + 16) * 2.0**-23)
                        some = maybe(short_query[asked], short_train[near], row, at, reach)
                        row, at = row[some], at[some]
                    row, d, y = exact(x_query[asked], x_train[near], y_train[near], row, at, within)
                if len(row):
                    merged(top, asked[row], d, y)
        return top

    def lists(query: pd.DataFrame, top, kinds: tuple[int, ...], columns: Sequence[str]) -> pd.DataFrame:
        """The columns with the found neighbours of these kinds as lists; rows without any are left out."""
        keep = np.isin(top[2], kinds)
        at = np.flatnonzero(keep.any(axis=1))
        out = query.iloc[at][list(columns)].copy()
        for name, values in (("d", top[0]), ("y", top[1])):
            out[name] = pd.Series([values[i][keep[i]].tolist() for i in at], index=out.index, dtype=object)
        return out

    def near_home(query: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        """All columns of the asking rows, with the neighbours found in blocks of their own group."""
        top = elsewhere(query, base)
        out = query.copy()
        kept = top[2] < 2
        for name, values in (("d", top[0]), ("y", top[1])):
            out[name] = pd.Series([v[f].tolist() for v, f in zip(values, kept)], index=out.index, dtype=object)
        bound = out["_bound"].to_numpy(float)
        out["_bound"] = np.where(np.isinf(bound), bound, np.minimum(bound, top[0][:, -1] ** (1 / p)))
        return out[NEAR_COLUMNS]

    def far_away(query: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        """New neighbours in blocks of one other group."""
        return lists(query, elsewhere(query, base), (1,), ["_id"])

    return place, at_home, near_home, far_away


def blocks_to_compare(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    identity: str,
    k: int,
    p: float,
    block: int,
    group: int = GROUP_ROWS,
):
    """Rows in blocks, asking rows with the neighbours of their own block, and the pairs of blocks left.

    Returns (placed, asked, pairs, functions): `pairs` has `_at`, a block of asking rows, and `_other`, one
    of training rows, with the groups of `group` rows in which they lie. All three are written tables. The
    functions compare groups. Nothing that grows with the rows is collected.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession)
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    id_type = rows.schema[identity].dataType
    known = train.select(
        F.col(identity).cast(id_type).alias("_id"), vector, F.col(target).cast("double").alias("y"), F.lit(0).alias("_asks")
    )
    asking = rows.select(
        F.col(identity).alias("_id"), vector, F.lit(None).cast("double").alias("y"), F.lit(1).alias("_asks")
    )
    n_pivots = min(MAX_PIVOTS, max(1, -(-train.count() // block)))
    sampled = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_PIVOT * n_pivots).select("x").collect()
    sample = np.array([r["x"] for r in sampled], dtype=float).reshape(-1, len(features))
    sample = sample[np.isfinite(sample).all(axis=1)]
    pivots = choose_pivots(sample, n_pivots) if len(sample) else np.zeros((1, len(features)))
    place, at_home, *functions = _task_functions(k, p, pivots)

    tagged = known.unionByName(asking)
    schema = T.StructType(list(tagged.schema.fields)).add("_cell", T.IntegerType()).add("_r", T.DoubleType())
    celled = tagged.mapInPandas(place, schema)
    placed = with_ordinal(celled, ["_cell"], "_r", ["_id", "_asks"]).withColumn(
        "_at", F.shiftleft(F.col("_cell").cast("bigint"), BLOCK_BITS) + F.floor(F.col("ordinal") / block)
    )
    placed = materialize(placed.drop("ordinal"), f"{path}/placed")

    counts, radii = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    starts = np.zeros(len(pivots) + 1, dtype=np.int64)
    known_r = F.when(F.col("_asks") == 0, F.col("_r"))
    sizes = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("all"), F.count(known_r).alias("n"), F.max(known_r).alias("r"))
    for row in sizes.collect():
        starts[row["_cell"]] = row["all"]
        if row["_cell"] < len(pivots) and row["n"]:
            counts[row["_cell"]], radii[row["_cell"]] = row["n"], row["r"]
    starts = F.array(*[F.lit(int(n)) for n in np.cumsum(starts) - starts])
    before = F.element_at(starts, F.col("_cell") + 1) + F.col("_at").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) * block
    placed = placed.withColumn("_group", F.floor(before / group).cast("bigint"))
    base = placed.filter("_asks = 0")
    home = T.StructType(
        [
            T.StructField("_at", T.LongType()),
            T.StructField("_group", T.LongType()),
            T.StructField("_id", id_type),
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("_r", T.DoubleType()),
            T.StructField("d", T.ArrayType(T.DoubleType())),
            T.StructField("y", T.ArrayType(T.DoubleType())),
            T.StructField("_bound", T.DoubleType()),
            T.StructField("_cells", T.ArrayType(T.IntegerType())),
            T.StructField("_lows", T.ArrayType(T.DoubleType())),
            T.StructField("_highs", T.ArrayType(T.DoubleType())),
        ]
    )
    asked = materialize(placed.groupBy("_at").applyInPandas(at_home(counts, radii), home), f"{path}/asked")

    needs = asked.filter(F.col("_cells").isNotNull()).select(
        "_at", "_group", F.explode(F.arrays_zip("_cells", "_lows", "_highs")).alias("n")
    )
    needs = needs.select("_at", "_group", F.col("n._cells").alias("_cell"), "n._lows", "n._highs").withColumn(
        "_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int")
    )
    other = [F.col("_at").alias("_other"), F.col("_group").alias("_other_group")]
    spans = base.groupBy("_cell", *other).agg(F.min("_r").alias("_from"), F.max("_r").alias("_to"))
    spans = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = (
        needs.join(spans, ["_cell", "_salt"])
        .filter("_from <= _highs AND _to >= _lows AND _at <> _other")
        .select("_at", "_group", "_other", "_other_group")
    )
    return placed, asked, materialize(pairs, f"{path}/pairs"), functions


def _meet(asked: DataFrame, base: DataFrame, pairs: DataFrame, function, schema: T.StructType) -> DataFrame:
    """Blocks of asking and of training rows, by pairs of their groups."""
    groups = ["_group", "_other_group"]
    asking = asked.select(*NEAR_COLUMNS).join(pairs.select("_at", *groups).distinct(), ["_at", "_group"])
    known = base.join(pairs.select("_other", *groups).distinct(), ["_other", "_other_group"])
    return asking.groupBy(*groups).cogroup(known.groupBy(*groups)).applyInPandas(function, schema)


def knn_predict(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    identity: str,
    k: int = 5,
    p: float = 2.0,
    block: int = 1_000,
    out: str = "prediction",
    group: int = GROUP_ROWS,
) -> DataFrame:
    """Mean target of the k nearest training rows (Minkowski distance), exact.

    Rows are cut into blocks of at most `block`, which meet in groups of `group` rows, so no task holds more
    than two groups, however many rows are alike. The own group comes first and gives the bound for the others. At equal distance the smaller target counts as nearer. Vectors with a missing or non-finite
    component are infinitely far from all others. Where p < 1 there are no bounds and all blocks meet.
    `identity` tells the asking rows apart.
    """
    placed, asked, pairs, functions = blocks_to_compare(train, rows, features, target, identity, k, p, block, group)
    near_home, far_away = functions
    other = [F.col("_at").alias("_other"), F.col("_group").alias("_other_group")]
    base = placed.filter("_asks = 0").select(*other, "x", "y", "_cell", "_r")
    near, path = pairs.filter("_group = _other_group"), scratch_dir(rows.sparkSession)
    kept = T.StructType([asked.schema[c] for c in NEAR_COLUMNS])
    alone = asked.select(*NEAR_COLUMNS).join(near.select("_at").distinct(), "_at", "left_anti").select(*NEAR_COLUMNS)
    asked = materialize(alone.unionByName(_meet(asked, base, near, near_home, kept)), f"{path}/near")
    found = T.StructType([asked.schema["_id"], asked.schema["d"], asked.schema["y"]])
    others = _meet(asked, base, pairs.filter("_group <> _other_group"), far_away, found)
    candidates = (
        asked.select("_id", "d", "y")
        .unionByName(others)
        .select("_id", F.explode(F.arrays_zip("d", "y")).alias("c"))
        .select("_id", "c.d", "c.y")
    )
    nearest = W.partitionBy("_id").orderBy("d", "y")
    result = (
        candidates.withColumn("_n", F.row_number().over(nearest))
        .filter(F.col("_n") <= k)
        .groupBy("_id")
        .agg(F.avg("y").alias(out))
        .withColumnRenamed("_id", identity)
    )
    return rows.join(result, identity, "left")
