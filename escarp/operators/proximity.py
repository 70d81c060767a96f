"""Distance joins between point tables.

Both sides are first reduced to one row per coordinate, so copies of a point meet only once. Each side is
a quadtree of cells with partial aggregates, and pairs of cells are walked from cells as wide as the
radius downwards. A pair whose boxes are farther apart than the radius is dropped; one that lies inside
the radius as a whole counts as a whole; one of few point pairs is left to a join of its points; of any
other pair the side with more points is opened into its cells. A nearest search also drops pairs that
cannot beat the upper bound of another pair of the same left cell. Crowds on either side are thus opened as
far as needed, by one algorithm at every size, and no task holds all points of a square.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.functions.geo import (
    CellGrid,
    box_distance_bounds,
    haversine_m,
    max_chord_squared,
    unit_vector,
)
from escarp.functions.stats import with_ordinal
from escarp.session import materialize, scratch_dir

#: Pairs of points that a pair of cells may stand for when its points are joined. Opening cells drops
#: most of them in a nearest search, but only those far from the circle in a sum.
LEAF_PAIRS, NEAREST_LEAF_PAIRS, ZONE_LEAF_PAIRS = 1 << 14, 1 << 10, 1 << 11

#: Pairs of points that one task compares: its input is so small that Spark would merge many such tasks.
TASK_PAIRS = 1 << 24

#: Pairs of cells that one task opens, into up to 16 pairs each.
TASK_OPENED = 1 << 16

# name -> ("sum" | "max" | "min", column expression); a count is the sum of 1
Aggregates = Mapping[str, tuple[str, Column]]

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_LEFT = ["_ll", "_ly", "_lx"]


def _points(df: DataFrame, aggs: Aggregates, by: Sequence[str] = ()) -> DataFrame:
    """One row per coordinate (and `by`) with the partial aggregates of its copies."""
    kept = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    columns = [_FOLD[fn](col).alias(name) for name, (fn, col) in aggs.items()]
    if not columns:
        return kept.select("lat", "lon", *by).distinct()
    return kept.groupBy("lat", "lon", *by).agg(*columns)


def _keyed(points: DataFrame, grid: CellGrid) -> DataFrame:
    return points.withColumns(
        {"_fy": grid.fine_y(F.col("lat")), "_fx": grid.fine_x(F.col("lon"))}
    )


def _cell(grid: CellGrid, level: int) -> list[Column]:
    return [
        grid.at_level(F.col("_fy"), level).alias("_cy"),
        grid.at_level(F.col("_fx"), level).alias("_cx"),
    ]


class _Side:
    """One side's points and, for each level that the walk reaches, its cells."""

    def __init__(self, points: DataFrame, grid: CellGrid, aggs: Aggregates, by: Sequence[str], path: str):
        self.points, self.grid, self.aggs, self.by, self.path = points, grid, aggs, list(by), path
        self.levels: dict[int, DataFrame] = {}

    def found(self, level: int) -> DataFrame:
        """Cells of a level: position, points, bounding box, partial aggregates."""
        lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180  # the date line has one side
        return self.points.groupBy(*_cell(self.grid, level), *self.by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("lat").alias("_south"),
            F.max("lat").alias("_north"),
            F.min(lon).alias("_west"),
            F.max(lon).alias("_east"),
            *[_FOLD[fn](name).alias(name) for name, (fn, _) in self.aggs.items()],
        )

    def cells(self, level: int) -> DataFrame:
        """The cells of a level, written once: pairs of several levels open into them."""
        if level not in self.levels:
            self.levels[level] = materialize(self.found(level), f"{self.path}{level}")
        return self.levels[level]

    def at(self, level: int) -> DataFrame:
        """The points with the cell of a level they are in."""
        return self.points.withColumns(dict(zip(["_cy", "_cx"], _cell(self.grid, level), strict=True)))


def _left_cells(cells: DataFrame, level: int, *more: Column) -> DataFrame:
    """Left cells as a centre and how far their points are from it."""
    lat, lon = (F.col("_south") + F.col("_north")) / 2, (F.col("_west") + F.col("_east")) / 2
    _, reach = box_distance_bounds(lat, lon, *[F.col(c) for c in ("_south", "_north", "_west", "_east")])
    return cells.select(
        F.lit(level).alias("_ll"),
        F.col("_cy").alias("_ly"),
        F.col("_cx").alias("_lx"),
        F.col("_n").alias("_ln"),
        lat.alias("_lat"),
        lon.alias("_lon"),
        reach.alias("_reach"),
        *more,
    )


def _right_cells(cells: DataFrame, level: int, names: Sequence[str]) -> DataFrame:
    return cells.select(
        F.lit(level).alias("_rl"),
        F.col("_cy").alias("_ry"),
        F.col("_cx").alias("_rx"),
        F.col("_n").alias("_rn"),
        *("_south", "_north", "_west", "_east"),
        *names,
    )


def _parent(column: str) -> Column:
    return F.shiftright(column, 2)


class _Walk:
    """The pairs of cells that count as a whole, and those whose points are to be joined."""

    def __init__(
        self, left: _Side, right: _Side, radii_m: Sequence[float], nearest: bool, leaf_pairs: int, scratch: str
    ):
        self.left, self.right, self.radii_m = left, right, radii_m
        self.widest, self.nearest, self.leaf_pairs = float(max(radii_m)), nearest, leaf_pairs
        self.scratch, self.finest = scratch, left.grid.FINEST
        self.carried = [*right.by, *right.aggs]
        self.whole: list[tuple[int, DataFrame]] = []
        self.small: list[tuple[int, int, DataFrame]] = []
        self.whole_tasks: list[int] = []
        self.small_tasks: list[int] = []
        pairs, rounds = self._first(), 0
        while pairs is not None:
            pairs, rounds = self._round(pairs, rounds), rounds + 1

    def _first(self) -> DataFrame:
        """Left cells of level 0 with the right cells around them."""
        grid = self.left.grid
        cells = self.left.found(0)
        # the ring widens with latitude: that of the box's edge next to a pole holds all others
        edge = F.when(F.abs("_north") >= F.abs("_south"), F.col("_north")).otherwise(F.col("_south"))
        _, columns = grid.ring(edge, F.col("_west"))
        around = (
            _left_cells(cells, 0, columns.alias("_columns"))
            .withColumn("_ry", F.explode(F.sequence(F.col("_ly") - 1, F.col("_ly") + 1)))
            .withColumn("_rx", F.explode("_columns"))
            .drop("_columns")
        )
        right = _right_cells(self.right.found(0), 0, self.carried)
        return around.join(right, ["_ry", "_rx"]).withColumn("_best", F.lit(self.widest))

    def _round(self, pairs: DataFrame, number: int) -> DataFrame | None:
        """Settle what can be settled; the opened rest, None when there is none."""
        box = [F.col(c) for c in ("_south", "_north", "_west", "_east")]
        near, far = box_distance_bounds(F.col("_lat"), F.col("_lon"), *box)
        pairs = pairs.withColumns(
            {"_low": F.greatest(near - F.col("_reach"), F.lit(0.0)), "_high": far + F.col("_reach")}
        ).filter(F.col("_low") <= self.widest + 1e-6)
        pairs, whole, rows = self._judged(pairs)
        done = (F.col("_ll") == self.finest) & (F.col("_rl") == self.finest)
        few = done | (F.col("_ln") * rows <= self.leaf_pairs)
        open_left = (F.col("_rl") == self.finest) | ((F.col("_ll") < self.finest) & (F.col("_ln") >= rows))
        state = F.when(whole, "whole").when(few, "small").when(open_left, "left").otherwise("right")
        pairs = materialize(pairs.withColumn("_state", state), f"{self.scratch}/round{number}")
        by_state = F.when(F.col("_state") == "small", F.col("_ln") * F.col("_rn"))
        work = F.sum(by_state.when(F.col("_state") == "whole", F.col("_ln")).otherwise(1))
        kinds = pairs.groupBy("_state", "_ll", "_rl").agg(work).collect()  # a few levels
        rest = None
        for kind, ll, rl, pairs_of in sorted(map(tuple, kinds)):
            of_kind = (F.col("_state") == kind) & (F.col("_ll") == ll) & (F.col("_rl") == rl)
            some = pairs.filter(of_kind).drop("_state", "_low", "_rows")
            tasks = -(-pairs_of // TASK_PAIRS)
            if kind == "whole":
                self.whole.append((ll, some.select("_ly", "_lx", "_high", *self.right.by, *self.right.aggs)))
                self.whole_tasks.append(tasks)
            elif kind == "small":
                self.small.append((ll, rl, some.select("_ly", "_lx", "_ry", "_rx", *self.right.by)))
                self.small_tasks.append(tasks)
            else:
                spread = some.drop("_high").repartition(-(-pairs_of // TASK_OPENED), "_ly", "_lx", "_ry", "_rx")
                opened = self._opened(spread, kind, ll, rl)
                rest = opened if rest is None else rest.unionByName(opened)
        return rest

    def _judged(self, pairs: DataFrame) -> tuple[DataFrame, Column, Column]:
        """Pairs that can count, whether a pair counts as a whole, and the right points it stands for."""
        whole = F.lit(not self.nearest)
        if self.nearest:
            # a hair of slack: bounds and true distances are rounded separately
            own = F.min("_high").over(W.partitionBy(*_LEFT, *self.right.by))
            pairs = pairs.withColumn("_best", F.least("_best", own * (1 + 1e-9) + 1e-6))
            pairs = pairs.filter(F.col("_low") <= F.col("_best"))
        else:
            for radius in self.radii_m:
                whole &= (F.col("_high") <= radius - 1e-6) | (F.col("_low") > radius + 1e-6)
        return pairs, whole, F.col("_rn")

    def _opened(self, pairs: DataFrame, side: str, ll: int, rl: int) -> DataFrame:
        if side == "left":
            children = _left_cells(self.left.cells(ll + 1), ll + 1)
            up = children.withColumns({"_py": _parent("_ly"), "_px": _parent("_lx")})
            own = pairs.drop("_ll", "_ln", "_lat", "_lon", "_reach")
            opened = own.withColumnsRenamed({"_ly": "_py", "_lx": "_px"}).join(up, ["_py", "_px"])
        else:
            children = _right_cells(self.right.cells(rl + 1), rl + 1, self.carried)
            up = children.withColumns({"_py": _parent("_ry"), "_px": _parent("_rx")})
            own = pairs.drop("_rl", "_rn", "_south", "_north", "_west", "_east", *self.right.aggs)
            opened = own.withColumnsRenamed({"_ry": "_py", "_rx": "_px"}).join(
                up, ["_py", "_px", *self.right.by]
            )
        return opened.drop("_py", "_px")


class _ZoneWalk(_Walk):
    """Left cells that lie within the radius of a zone as a whole, and those that may be cut by it.

    All pairs of a left cell and a zone are settled or opened at once, so a left point is counted once
    for a zone, however many cells of the zone are near it.
    """

    def _judged(self, pairs: DataFrame) -> tuple[DataFrame, Column, Column]:
        group = W.partitionBy(*_LEFT, *self.right.by)
        pairs = pairs.withColumns({"_high": F.min("_high").over(group), "_rows": F.sum("_rn").over(group)})
        return pairs, F.col("_high") <= self.widest - 1e-6, F.col("_rows")


def _meet(pairs: DataFrame, left: _Side, right: _Side, ll: int, rl: int, radius_m: float, tasks: int) -> DataFrame:
    """Pairs of points of the pairs of cells, within the radius, compared in so many tasks.

    Most pairs fail the chord test, a few multiplications on vectors made once per point and cell.
    """
    here = left.at(ll).select(
        F.col("lat").alias("l_lat"),
        F.col("lon").alias("l_lon"),
        F.col("_cy").alias("_ly"),
        F.col("_cx").alias("_lx"),
    )
    there = right.at(rl).withColumnsRenamed({"_cy": "_ry", "_cx": "_rx"}).drop("_fy", "_fx")
    there = there.withColumns(
        {f"_r{i}": c for i, c in enumerate(unit_vector(F.col("lat"), F.col("lon")))}
    )
    gaps = [F.col(f"_l{i}") - F.col(f"_r{i}") for i in range(3)]
    chord = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    distance = haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("lat"), F.col("lon"))
    meeting = ["_ry", "_rx", *right.by]
    # only the place of a left point is sent to its cells, its vector is made there
    sent = pairs.join(here, ["_ly", "_lx"]).select(*meeting, "l_lat", "l_lon").repartition(tasks, *meeting)
    vector = {f"_l{i}": c for i, c in enumerate(unit_vector(F.col("l_lat"), F.col("l_lon")))}
    return (
        sent.withColumns(vector)
        .join(there.repartition(tasks, *meeting), meeting)
        .filter(chord <= max_chord_squared(radius_m))
        .withColumn("distance_m", distance)
        .filter(F.col("distance_m") <= radius_m)
        .select("l_lat", "l_lon", "distance_m", *right.by, *right.aggs)
    )


def _matches(
    left: DataFrame,
    right: DataFrame,
    radii_m: Sequence[float],
    aggs: Aggregates,
    nearest: bool,
    leaf_pairs: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (l_lat, l_lon, distance_m, by, aggregates).

    For a nearest search only rows that can still win are produced. Otherwise a row may stand for a whole
    cell that no radius cuts.
    """
    grid = CellGrid(float(max(radii_m)))
    scratch = scratch_dir(left.sparkSession)
    one = _Side(_keyed(left, grid), grid, {}, (), f"{scratch}/left")
    two = _Side(_keyed(right, grid), grid, aggs, by, f"{scratch}/right")
    walk = _Walk(one, two, radii_m, nearest, leaf_pairs, scratch)
    parts = [
        _meet(pairs, one, two, ll, rl, walk.widest, tasks)
        for (ll, rl, pairs), tasks in zip(walk.small, walk.small_tasks, strict=True)
    ]
    for (ll, pairs), tasks in zip(walk.whole, walk.whole_tasks, strict=True):
        here = one.at(ll).select(
            F.col("lat").alias("l_lat"),
            F.col("lon").alias("l_lon"),
            F.col("_cy").alias("_ly"),
            F.col("_cx").alias("_lx"),
        )
        spread = pairs.withColumnRenamed("_high", "distance_m").repartition(tasks, "_ly", "_lx")
        inside = spread.join(here.repartition(tasks, "_ly", "_lx"), ["_ly", "_lx"])
        parts.append(inside.select("l_lat", "l_lon", "distance_m", *aggs))
    if not parts:  # no two cells are within reach
        none = one.points.limit(0).select(F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
        return none.join(two.points.limit(0).drop("lat", "lon", "_fy", "_fx"), F.lit(False)).withColumn(
            "distance_m", F.lit(0.0)
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _anchors(left: DataFrame) -> DataFrame:
    return _points(left, {})


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    right_id: str,
    radius_m: float,
    out_id: str = "nearest_id",
    out_distance: str = "distance_m",
    leaf_pairs: int = NEAREST_LEAF_PAIRS,
) -> DataFrame:
    """Each left row with the closest right row within the radius; unmatched rows are dropped.

    Both tables have `lat` and `lon`. Ties go to the smallest id.
    """
    aggs = {"_id": ("min", F.col(right_id))}
    matches = _matches(_anchors(left), _points(right, aggs), [radius_m], aggs, True, leaf_pairs)
    best = matches.groupBy("l_lat", "l_lon").agg(
        F.min(F.struct("distance_m", "_id")).alias("_best")
    )
    best = best.select(
        F.col("l_lat").alias("lat"),
        F.col("l_lon").alias("lon"),
        F.col("_best._id").alias(out_id),
        F.col("_best.distance_m").alias(out_distance),
    )
    return left.join(best, ["lat", "lon"])


def aggregate_within(
    left: DataFrame,
    right: DataFrame,
    radii: Mapping[str, float],
    aggs: Aggregates,
    leaf_pairs: int = LEAF_PAIRS,
) -> DataFrame:
    """Left outer: aggregates of the right rows around each left row, one pass for all radii.

    `radii` maps a name suffix to metres; column `<agg><suffix>` holds one aggregate for one
    radius, NULL where nothing is near.
    """
    points, values = _points(right, aggs), {}
    for name, (fn, _) in aggs.items():
        if fn != "sum" and not isinstance(points.schema[name].dataType, T.NumericType):
            points, values[name] = _numbered(points, name)
    matches = _matches(_anchors(left), points, list(radii.values()), aggs, False, leaf_pairs)
    columns = [
        _FOLD[fn](F.when(F.col("distance_m") <= radius, F.col(name))).alias(name + suffix)
        for suffix, radius in radii.items()
        for name, (fn, _) in aggs.items()
    ]
    around = (
        matches.groupBy("l_lat", "l_lon")
        .agg(*columns)
        .withColumnsRenamed({"l_lat": "lat", "l_lon": "lon"})
    )
    for name, known in values.items():
        for suffix in radii:
            of_number = known.withColumnsRenamed({"_number": "_found", name: "_value"})
            around = around.withColumnRenamed(name + suffix, "_found").join(of_number, "_found", "left")
            around = around.withColumnRenamed("_value", name + suffix).drop("_found")
    return left.join(around, ["lat", "lon"], "left")


def _numbered(points: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Points with a value's place among all values, and the values by place.

    The largest or smallest of numbers is kept in place; that of texts or structs would sort all pairs.
    """
    placed = with_ordinal(points, [], name, ["lat", "lon"], "_number")
    placed = materialize(placed, f"{scratch_dir(points.sparkSession)}/numbered")
    known = placed.filter(F.col(name).isNotNull())
    numbers = placed.withColumn(name, F.when(F.col(name).isNotNull(), F.col("_number"))).drop("_number")
    return numbers, known.select("_number", name)


def aggregate_in_zones(
    cells: DataFrame,
    zone_id: str,
    points: DataFrame,
    radius_m: float,
    aggs: Aggregates,
    leaf_pairs: int = ZONE_LEAF_PAIRS,
) -> DataFrame:
    """(zone_id, aggregates) of the points within the radius of any cell of a zone, each counted once.

    `cells` has `zone_id`, `lat` and `lon`. Cells of points that lie near a zone as a whole count by their
    partial aggregates, so no row is made for each pair of a point and a zone. Zones without a point near
    have no row; cells without a zone and rows without a coordinate are not used.
    """
    known = cells.filter(F.col(zone_id).isNotNull())
    grid, scratch = CellGrid(float(radius_m)), scratch_dir(points.sparkSession)
    one = _Side(_keyed(_points(points, aggs), grid), grid, aggs, (), f"{scratch}/left")
    two = _Side(_keyed(_points(known, {}, [zone_id]), grid), grid, {}, [zone_id], f"{scratch}/right")
    walk = _ZoneWalk(one, two, [radius_m], False, leaf_pairs, scratch)
    parts = [one.points.limit(0).crossJoin(two.points.select(zone_id).limit(0)).select(zone_id, *aggs)]
    for ll, pairs in walk.whole:
        here = one.cells(ll).select(F.col("_cy").alias("_ly"), F.col("_cx").alias("_lx"), *aggs)
        inside = pairs.select("_ly", "_lx", zone_id).distinct().join(here, ["_ly", "_lx"])
        parts.append(inside.select(zone_id, *aggs))
    for (ll, rl, pairs), tasks in zip(walk.small, walk.small_tasks, strict=True):
        parts.append(_near_zones(pairs, one, two, ll, rl, radius_m, tasks).select(zone_id, *aggs))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.groupBy(zone_id).agg(*[_FOLD[fn](name).alias(name) for name, (fn, _) in aggs.items()])


def _near_zones(
    pairs: DataFrame, left: _Side, right: _Side, ll: int, rl: int, radius_m: float, tasks: int
) -> DataFrame:
    """Left points of the pairs' cells that are near a point of the zone's cells they are paired with."""
    there = right.at(rl).withColumnsRenamed({"_cy": "_ry", "_cx": "_rx"})
    vector = [c.alias(f"v{i}") for i, c in enumerate(unit_vector(F.col("lat"), F.col("lon")))]
    group = ["_ly", "_lx", *right.by]
    # at most the leaf's number of points in a list
    lists = (
        there.join(pairs.select("_ry", "_rx", *right.by).distinct(), ["_ry", "_rx", *right.by], "left_semi")
        .groupBy("_ry", "_rx", *right.by)
        .agg(F.collect_list(F.struct("lat", "lon", *vector)).alias("_zone"))
    )
    zones = pairs.join(lists, ["_ry", "_rx", *right.by]).groupBy(*group)
    zones = zones.agg(F.flatten(F.collect_list("_zone")).alias("_zone"))
    here = left.at(ll).withColumnsRenamed({"_cy": "_ly", "_cx": "_lx"}).withColumns(
        {f"_l{i}": c for i, c in enumerate(unit_vector(F.col("lat"), F.col("lon")))}
    )
    # the cosine of the angle falls by half the squared chord; far from the circle it decides alone
    fall = max_chord_squared(radius_m) / 2
    surely, possibly = 1 - fall * (1 - 1e-6) + 2e-15, 1 - fall - 2e-15

    def within(point: Column) -> Column:
        cosine = sum((F.col(f"_l{i}") * point[f"v{i}"] for i in (1, 2)), F.col("_l0") * point["v0"])
        exact = haversine_m(F.col("lat"), F.col("lon"), point["lat"], point["lon"]) <= radius_m
        return (cosine >= surely) | ((cosine >= possibly) & exact)

    spread = zones.repartition(tasks, "_ly", "_lx")
    return spread.join(here.repartition(tasks, "_ly", "_lx"), ["_ly", "_lx"]).filter(F.exists("_zone", within))


def zones_within(
    left: DataFrame,
    cells: DataFrame,
    zone_id: str,
    radius_m: float,
    out_distance: str = "distance_m",
    leaf_pairs: int = NEAREST_LEAF_PAIRS,
) -> DataFrame:
    """Each left row with every zone that has a cell within the radius, and that zone's distance.

    `cells` has `zone_id`, `lat` and `lon`. It is a nearest search in each zone: of a large footprint
    only the cells that can be a point's nearest are looked at. Left rows without a zone are dropped,
    as are rows without a coordinate, and cells without a zone.
    """
    known = cells.filter(F.col(zone_id).isNotNull())
    points = _points(known, {}, [zone_id])
    near = _matches(_anchors(left), points, [radius_m], {}, True, leaf_pairs, [zone_id])
    zones = near.groupBy("l_lat", "l_lon", zone_id).agg(F.min("distance_m").alias(out_distance))
    return left.join(zones.withColumnsRenamed({"l_lat": "lat", "l_lon": "lon"}), ["lat", "lon"])


def densify_segments(segments: DataFrame, step_m: float) -> DataFrame:
    """Points at most `step_m` apart along segments (lat1, lon1, lat2, lon2), ends included."""
    length = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pieces = F.greatest(F.ceil(length / step_m), F.lit(1).cast("bigint"))
    return (
        segments.withColumn("_pieces", pieces)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces"))))
        .withColumn("_t", F.col("_i") / F.col("_pieces"))
        .withColumn("lat", F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("_t"))
        .withColumn("lon", F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("_t"))
        .drop("lat1", "lon1", "lat2", "lon2", "_pieces", "_i", "_t")
    )
