"""Geometry as column expressions: points are x and y, rings arrays of struct(x, y)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, and the equal-area projection for measuring (origin 0° N 25° E, parallels 20° and -23°).
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)
LON0, PAR1, PAR2 = math.radians(25), math.radians(20), math.radians(-23)


def _q(sin: float) -> float:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - math.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))


_M2 = [math.cos(p) ** 2 / (1 - E2 * math.sin(p) ** 2) for p in (PAR1, PAR2)]
_N = (_M2[0] - _M2[1]) / (_q(math.sin(PAR2)) - _q(math.sin(PAR1)))
_C = _M2[0] + _N * _q(math.sin(PAR1))
_RHO0 = A * math.sqrt(_C) / _N


def project(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on the equal-area projection."""
    sin = F.sin(F.radians(lat))
    q = (1 - E2) * (sin / (1 - E2 * sin * sin) - F.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))
    rho, theta = A * F.sqrt(_C - _N * q) / _N, _N * (F.radians(lon) - LON0)
    return F.struct((rho * F.sin(theta)).alias("x"), (_RHO0 - rho * F.cos(theta)).alias("y"))


@dataclass(frozen=True)
class EqualArea:
    """The conic equal-area projection on the ellipsoid; degrees and metres, two parallels that are not opposite."""

    lon0: float
    lat0: float
    parallel1: float
    parallel2: float
    x0: float = 0.0
    y0: float = 0.0

    def _constants(self) -> tuple[float, float, float]:
        p1, p2 = math.radians(self.parallel1), math.radians(self.parallel2)
        m1, m2 = (math.cos(p) ** 2 / (1 - E2 * math.sin(p) ** 2) for p in (p1, p2))
        n = math.sin(p1) if p1 == p2 else (m1 - m2) / (_q(math.sin(p2)) - _q(math.sin(p1)))
        if n == 0:
            raise ValueError("opposite parallels make no cone")
        c = m1 + n * _q(math.sin(p1))
        return n, c, A * math.sqrt(c - n * _q(math.sin(math.radians(self.lat0)))) / n

    def forward(self, lon: Column, lat: Column) -> Column:
        n, c, rho0 = self._constants()
        sin = F.sin(F.radians(lat))
        q = (1 - E2) * (sin / (1 - E2 * sin * sin) - F.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))
        rho, theta = A * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return F.struct((self.x0 + rho * F.sin(theta)).alias("x"), (self.y0 + rho0 - rho * F.cos(theta)).alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        """struct(lon, lat); the latitude from the authalic one by its series in the eccentricity."""
        n, c, rho0 = self._constants()
        east, north, side = x - self.x0, rho0 - (y - self.y0), math.copysign(1.0, n)
        q = (c - (east * east + north * north) * (n / A) ** 2) / n
        beta = F.asin(q / _q(1.0))
        # fixed values: the published coefficients of the series
        e2, e4, e6 = E2, E2**2, E2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
        return F.struct((self.lon0 + F.degrees(F.atan2(side * east, side * north)) / n).alias("lon"), F.degrees(lat).alias("lat"))


@dataclass(frozen=True)
class TransverseMercator:
    """The transverse Mercator projection on the ellipsoid by series in its third flattening, for a few thousand km about lon0."""

    lon0: float
    lat0: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    # fixed values: the published coefficients, by powers 1 to 4 of the third flattening
    _FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
    _INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
    _LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))

    @staticmethod
    def _terms(table: tuple) -> list[tuple[int, float]]:
        third = FLAT / (2 - FLAT)
        return [(2 * j, sum(k * third**p for p, k in enumerate(row, 1))) for j, row in enumerate(table, 1)]

    def _radius(self) -> float:
        third = FLAT / (2 - FLAT)
        return self.scale * A / (1 + third) * (1 + third**2 / 4 + third**4 / 64)

    def _base(self) -> float:
        """How far north of the equator lat0 lies on the central meridian."""
        lat = math.radians(self.lat0)
        chi = math.asin(math.tanh(math.atanh(math.sin(lat)) - E1 * math.atanh(E1 * math.sin(lat)))) if abs(self.lat0) < 90 else lat
        return self._radius() * (chi + sum(k * math.sin(j * chi) for j, k in self._terms(self._FORWARD)))

    def forward(self, lon: Column, lat: Column) -> Column:
        sin, away = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        tan = F.sinh(F.atanh(sin) - E1 * F.atanh(E1 * sin))
        xi, eta = F.atan2(tan, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(tan * tan + F.cos(away) * F.cos(away)))
        east = sum((k * F.cos(j * xi) * F.sinh(j * eta) for j, k in self._terms(self._FORWARD)), eta)
        north = sum((k * F.sin(j * xi) * F.cosh(j * eta) for j, k in self._terms(self._FORWARD)), xi)
        return F.struct((self.x0 + self._radius() * east).alias("x"), (self.y0 - self._base() + self._radius() * north).alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        """struct(lon, lat)."""
        xi0, eta0 = (y - self.y0 + self._base()) / self._radius(), (x - self.x0) / self._radius()
        xi = xi0 - sum((k * F.sin(j * xi0) * F.cosh(j * eta0) for j, k in self._terms(self._INVERSE)), F.lit(0.0))
        eta = eta0 - sum((k * F.cos(j * xi0) * F.sinh(j * eta0) for j, k in self._terms(self._INVERSE)), F.lit(0.0))
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi + sum((k * F.sin(j * chi) for j, k in self._terms(self._LATITUDE)), F.lit(0.0))
        return F.struct((self.lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"), F.degrees(lat).alias("lat"))


#: The codes of datums that stand for the ellipsoid above, and of units, in a pair's header.
_DATUMS, _UNITS = {"104": "WGS 84", "33": "GRS 80"}, {"m": 1.0, "km": 1000.0}


def header_system(line: str) -> tuple[EqualArea | TransverseMercator | None, float]:
    """The projection and metres per unit that a CoordSys line names, as `Earth Projection 8, 104, "m", 9, 0, 0.9996, 500000, 0`.

    No projection means degrees. A system of another kind or datum is an error, never taken for degrees.
    """
    found = line.strip().split(None, 2)
    parts = [p.strip().strip('"') for p in found[2].split(",")] if len(found) == 3 and [f.lower() for f in found[:2]] == ["earth", "projection"] else []
    if len(parts) < 2 or parts[1] not in _DATUMS:
        raise ValueError(f"cannot read the system {line!r}")
    if parts[0] == "1":
        return None, 1.0
    kinds = {"8": (TransverseMercator, 5), "9": (EqualArea, 6)}
    if parts[0] not in kinds or len(parts) < 3 or parts[2] not in _UNITS or len(parts) != 3 + kinds[parts[0]][1]:
        raise ValueError(f"cannot read the system {line!r}")
    unit, numbers = _UNITS[parts[2]], [float(p) for p in parts[3:]]
    return kinds[parts[0]][0](*numbers[:-2], numbers[-2] * unit, numbers[-1] * unit), unit


def edges(ring: Column) -> Column:
    """array of struct(x1, y1, x2, y2), the last back to the first."""
    n = F.size(ring)
    side = lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2"))
    return F.transform(ring, side)


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies strictly inside, by counting crossings; the boundary is either."""

    def cross(odd: Column, e: Column) -> Column:
        hit = F.when((e["y1"] > y) != (e["y2"] > y), x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(F.lit(False))
        return odd != hit

    return F.aggregate(sides, F.lit(False), cross)


def on_edge(sides: Column, x: Column, y: Column) -> Column:
    def on(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (turn == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(sides, on)


def edge_distance(sides: Column, x: Column, y: Column) -> Column:
    """How far (x, y) is from the nearest side."""

    def apart(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (e["x1"] + t * dx), y - (e["y1"] + t * dy))

    return F.array_min(F.transform(sides, apart))


def intersects(sides: Column, x: Column, y: Column) -> Column:
    return inside(sides, x, y) | on_edge(sides, x, y)


def within(sides: Column, x: Column, y: Column) -> Column:
    return inside(sides, x, y) & ~on_edge(sides, x, y)


def ring_area(ring: Column) -> Column:
    """The signed area by the shoelace formula."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def centroid(ring: Column) -> Column:
    six = 6 * ring_area(ring)
    moment = lambda a, b: F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e[a] + e[b]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / six
    return F.struct(moment("x1", "x2").alias("x"), moment("y1", "y2").alias("y"))


def representative_point(ring: Column) -> Column:
    """A point surely inside: the middle of the widest stretch of a scan line between two levels of corners.

    The line runs halfway between the two neighbouring levels of corners that stand nearest to the middle of the box.
    """
    sides, ys = edges(ring), F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2

    def levels(v: Column) -> Column:
        halves = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (F.get(v, i - 1) + F.get(v, i)) / 2)
        return F.array_min(F.transform(halves, lambda h: F.struct(F.abs(h - middle).alias("off"), h.alias("y"))))["y"]

    def on_line(y: Column) -> Column:
        hit = F.filter(sides, lambda e: (e["y1"] > y) != (e["y2"] > y))
        xs = F.array_sort(F.transform(hit, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))

        def widest(v: Column) -> Column:
            spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda k: F.struct((F.get(v, 2 * k + 1) - F.get(v, 2 * k)).alias("wide"), (-(F.get(v, 2 * k) + F.get(v, 2 * k + 1)) / 2).alias("x")))
            return -F.array_max(spans)["x"]

        return F.struct(F.get(F.transform(F.array(xs), widest), 0).alias("x"), y.alias("y"))

    flat = F.struct(F.get(ring, 0)["x"].cast("double").alias("x"), F.get(ring, 0)["y"].cast("double").alias("y"))
    return F.when(F.size(ys) < 2, flat).otherwise(F.get(F.transform(F.array(levels(ys)), on_line), 0))


def segments(line: Column) -> Column:
    """Of an open line its sides from corner to corner: array of struct(x1, y1, x2, y2)."""
    return F.slice(edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))


def assert_crs(found: str | None, wanted: str) -> None:
    """An error if a layer's reference system, as its file names it, is not the one wanted."""
    if (found or "").strip().upper() != wanted.strip().upper():
        raise ValueError(f"the layer is in {found!r}, not in {wanted!r}")


def line_length(line: Column) -> Column:
    """Of an open line the sum of its segments."""
    return F.aggregate(F.slice(edges(line), 1, F.size(line) - 1), F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def valid_ring(ring: Column) -> Column:
    """At least three corners and some area."""
    return (F.size(ring) >= 3) & (F.abs(ring_area(ring)) > 0)


def crosses_itself(ring: Column) -> Column:
    """Whether two sides that are not neighbours cross; touching corners do not count."""
    sides = F.filter(edges(ring), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    turn = lambda e, x, y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))
    parted = lambda a, b: turn(a, b["x1"], b["y1"]) * turn(a, b["x2"], b["y2"]) < 0
    return F.exists(sides, lambda a: F.exists(sides, lambda b: parted(a, b) & parted(b, a)))


def bbox(ring: Column) -> Column:
    end = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(end(F.array_min, "x").alias("minx"), end(F.array_min, "y").alias("miny"), end(F.array_max, "x").alias("maxx"), end(F.array_max, "y").alias("maxy"))


def travel_minutes(metres: Column, kmh: float | Column) -> Column:
    return metres / 1000 / kmh * 60
