"""Planar geometry as Column functions over rings: arrays of (x, y) structs, first vertex not repeated.

All but the edge-by-edge comparisons in ``kernels`` runs inside Spark expressions. Rings are taken counter-clockwise (see ``ccw``) and in
metres; ``to_utm`` and ``from_utm`` convert from and to degrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from . import kernels


def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it; so expressions stay as small as they are written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2) structs around the ring."""

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(ring, edge)


def line_edges(line: Column) -> Column:
    """Edges of an open line: one fewer than its vertices; a single vertex is an edge of length 0."""

    def edge(p: Column, i: Column) -> Column:
        q = F.get(line, F.least(i + 1, F.size(line) - 1))
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(1))), edge)


def total(array: Column, of) -> Column:
    """Sum of ``of(element)``."""
    return F.aggregate(array, zero(), lambda acc, e: acc + of(e))


def signed_area(ring: Column) -> Column:
    return total(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ccw(ring: Column) -> Column:
    """The ring counter-clockwise."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def centroid(ring: Column) -> Column:
    """(x, y) of the centroid, from shoelace moments about the first vertex."""

    def about(r: Column) -> Column:
        x0, y0 = F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]
        cross = lambda e: (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)
        sums = lambda es: F.struct(total(es, cross).alias("w"), total(es, lambda e: (e["x1"] + e["x2"] - 2 * x0) * cross(e)).alias("x"), total(es, lambda e: (e["y1"] + e["y2"] - 2 * y0) * cross(e)).alias("y"))
        return let(let(edges(r), sums), lambda m: point(x0 + F.try_divide(m["x"], 3 * m["w"]), y0 + F.try_divide(m["y"], 3 * m["w"])))

    return let(ring, about)


def perimeter(ring: Column) -> Column:
    return total(edges(ring), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def compactness(ring: Column) -> Column:
    """4 pi A / P^2; 0 for a ring without length."""
    return let(perimeter(ring), lambda p: F.when(p > 0, 4 * math.pi * area(ring) / (p * p)).otherwise(0.0))


def bbox(points: Column, by: float = 0.0) -> Column:
    """(minx, miny, maxx, maxy), widened by ``by``."""

    def corners(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        return F.struct((F.array_min(xs) - by).alias("minx"), (F.array_min(ys) - by).alias("miny"), (F.array_max(xs) + by).alias("maxx"), (F.array_max(ys) + by).alias("maxy"))

    return let(points, corners)


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def flat(ring: Column) -> Column:
    """The ring as x, y, x, y, ..., which Arrow hands over as plain numbers."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def _hinted(kernel, columns: int):
    """The kernel with the types that tell Spark how to call it."""
    kernel.__annotations__ = {"batches": Iterator[tuple[(pa.Array,) * columns]], "return": Iterator[pa.Array]}
    return kernel


def intersection_area(a: Column, b: Column) -> Column:
    """Area shared by two rings, whichever way they run (an Arrow kernel, see ``kernels``)."""
    return F.arrow_udf(_hinted(kernels.pairwise(kernels.overlap), 2), DoubleType())(flat(a), flat(b))


def hausdorff(a: Column, b: Column) -> Column:
    """Vertex-sampled Hausdorff distance of two boundaries (an Arrow kernel)."""
    return flat_hausdorff(flat(a), flat(b))


def flat_hausdorff(a: Column, b: Column) -> Column:
    """``hausdorff`` of rings that are plain numbers already (``flat``)."""
    return F.arrow_udf(_hinted(kernels.pairwise(kernels.hausdorff), 2), DoubleType())(a, b)


def contains_within(ring: Column, px: Column, py: Column, margin: float) -> Column:
    """Whether the point is inside the ring grown by ``margin`` (an Arrow kernel)."""
    return F.arrow_udf(_hinted(kernels.inside_kernel(margin), 3), BooleanType())(flat(ring), px, py)


def contains_point(ring: Column, px: Column, py: Column) -> Column:
    """Whether the point is inside, by the parity of edges crossed to its right."""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > py) != (e["y2"] > py)
        x = e["x1"] + F.try_divide((py - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return F.when(spans & (px < x), 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + crossed(e)) % 2 == 1


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(e: Column, f: Column) -> Column:
    """Whether two segments share a point (touching counts, as do collinear overlaps)."""
    d1 = turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"])
    d2 = turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    d3 = turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"])
    d4 = turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    boxes = (
        (F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"]))
        & (F.least(f["x1"], f["x2"]) <= F.greatest(e["x1"], e["x2"]))
        & (F.least(e["y1"], e["y2"]) <= F.greatest(f["y1"], f["y2"]))
        & (F.least(f["y1"], f["y2"]) <= F.greatest(e["y1"], e["y2"]))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def vertex_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger vertex count, each ring counted closed."""
    n, m = F.size(a) + 1, F.size(b) + 1
    return F.least(n, m) / F.greatest(n, m)


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that aren't neighbours meet (an Arrow kernel)."""
    return any_crosses_itself(F.array(ring))


def any_crosses_itself(rings: Column) -> Column:
    """Whether any of the rings crosses itself; null where one is null (an Arrow kernel)."""
    return F.arrow_udf(_hinted(kernels.crossing_kernel, 2), BooleanType())(F.flatten(F.transform(rings, flat)), F.transform(rings, lambda r: F.coalesce(F.size(r), F.lit(0))))


def largest_part(parts: Column) -> Column:
    """The part (a ring) of largest area; the first of equals."""
    sized = F.transform(parts, lambda r, i: F.struct(area(r).alias("a"), (-i).alias("i"), r.alias("ring")))
    return F.array_max(sized)["ring"]


def wkt(ring: Column) -> Column:
    """Well-known text of a polygon."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, pair), ", "), F.lit("))"))


def lod1(ring: Column, base: Column, height: Column) -> Column:
    """Block model of a footprint: base and roof rings (x, y, z), roof elevation and volume."""
    lift = lambda z: F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))
    return F.struct(lift(base).alias("base"), lift(base + height).alias("roof"), (base + height).alias("roof_elevation"), (area(ring) * height).alias("volume"))


# The WGS 84 ellipsoid and the UTM scale.
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon)).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """(x, y) in metres of a position in degrees, by the Krueger series."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(500000.0 + K0 * _RADIUS * x, F.when(lat >= 0, 0.0).otherwise(10000000.0) + K0 * _RADIUS * y)


def from_utm(x: Column, y: Column, zone: Column, north: bool = True) -> Column:
    """(x: longitude, y: latitude) in degrees of a position in metres."""
    xi, eta = (y - (0.0 if north else 10000000.0)) / (K0 * _RADIUS), (x - 500000.0) / (K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return point(F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(lat))
