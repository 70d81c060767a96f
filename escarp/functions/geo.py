"""Great-circle distance and grid-cell keys on longitude / latitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METERS_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def _arc(dlat: Column, dlon: Column, cosines: Column) -> Column:
    """Haversine arc in metres from degree differences and the product of cosines."""
    half_lat = F.sin(F.radians(dlat) / 2)
    half_lon = F.sin(F.radians(dlon) / 2)
    a = half_lat * half_lat + cosines * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_RADIUS_M)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _arc(lat2 - lat1, lon2 - lon1, F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere; chords between such points need no trigonometry."""
    flat = F.cos(F.radians(lat))
    return [flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def max_chord_squared(radius_m: float) -> float:
    """Squared chord of an arc, a hair too long: for filters before the exact distance."""
    half = min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2)
    return (2 * math.sin(half) * (1 + 1e-9) + 1e-12) ** 2


def box_distance_bounds(
    lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column
) -> tuple[Column, Column]:
    """Lower and upper bound of the distance from a point to anything inside a box.

    The haversine grows with each of |dlat|, |dlon| (up to 180) and the cosine product, so
    taking the extremes of each one is a valid bound. A box that is a single point gets its
    true distance on both sides.
    """
    turn = F.round((lon - (west + east) / 2) / 360) * 360  # bring the box next to the point
    west, east = west + turn, east + turn
    near_lat = F.greatest(south - lat, lat - north, F.lit(0.0))
    far_lat = F.greatest(F.abs(lat - south), F.abs(north - lat))
    near_lon = F.greatest(west - lon, lon - east, F.lit(0.0))
    far_lon = F.least(F.greatest(F.abs(lon - west), F.abs(east - lon)), F.lit(180.0))
    cos_south, cos_north = F.cos(F.radians(south)), F.cos(F.radians(north))
    cos_min = F.least(cos_south, cos_north)
    cos_max = F.when((south < 0) & (north > 0), F.lit(1.0)).otherwise(
        F.greatest(cos_south, cos_north)
    )
    own = F.cos(F.radians(lat))
    return _arc(near_lat, near_lon, own * cos_min), _arc(far_lat, far_lon, own * cos_max)


class CellGrid:
    """Nested square degree cells: level 0 is at least `radius_m` wide, each level 4x finer."""

    FINEST = 10

    def __init__(self, radius_m: float):
        wanted = radius_m * 1.000001 / METERS_PER_DEGREE
        self.columns = max(1, math.floor(360 / wanted))
        self.size = 360 / self.columns
        self.reach = radius_m * 1.000001 / METERS_PER_DEGREE
        self._fine = self.size / 4**self.FINEST

    def fine_y(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self._fine)

    def fine_x(self, lon: Column) -> Column:
        return F.pmod(
            F.floor((lon + 180) / self._fine), F.lit(self.columns * 4**self.FINEST)
        )

    def at_level(self, fine: Column, level: int) -> Column:
        """Cell index at a level, by integer shift so that the levels nest exactly."""
        return F.shiftright(fine, 2 * (self.FINEST - level))

    def ring(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Arrays of the level-0 rows and columns that can hold anything within the radius.

        The number of columns grows with 1/cos(lat) and wraps at the date line.
        """
        y = self.at_level(self.fine_y(lat), 0)
        x = self.at_level(self.fine_x(lon), 0)
        edge = F.least(F.abs(lat) + self.reach, F.lit(90.0))
        sine = F.sin(F.radians(F.lit(self.reach / 2)))
        ratio = F.try_divide(sine, F.cos(F.radians(edge)))
        half_width = F.when(
            (edge < 89.9) & (ratio < 1),
            F.ceil(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2 / self.size),
        ).otherwise(F.lit(self.columns))
        half_width = F.least(half_width, F.lit(self.columns // 2))
        last = F.when(
            half_width * 2 + 1 > self.columns, x - half_width + self.columns - 1
        ).otherwise(x + half_width)
        columns = F.transform(
            F.sequence(x - half_width, last), lambda i: F.pmod(i, F.lit(self.columns))
        )
        return F.sequence(y - 1, y + 1), columns
