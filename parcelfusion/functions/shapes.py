"""Typed geometry: a struct of ``kind`` (point, line or polygon) and ``parts``, arrays of (x, y) structs.

The parts of a polygon are its rings, first vertex not repeated: outer rings counter-clockwise, holes clockwise, whatever part they belong to. So signed
sums over all edges give areas, moments and overlaps of shapes with holes and several parts just as of one ring. The parts of a line are
its lines, those of a point its points. A shape without a readable vertex is null, and what is computed from it is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from . import geometry as G
from . import kernels

RING = "array<struct<x:double,y:double>>"
SHAPE = f"struct<kind:string,parts:array<{RING}>>"


def shape(kind: Column, parts: Column) -> Column:
    """The shape, or null where it has no vertex or a vertex lacks a coordinate."""
    lost = lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
    fine = lambda ps: F.exists(ps, lambda r: F.size(r) > 0) & ~F.exists(ps, lambda r: F.exists(r, lost))
    return G.let(parts, lambda ps: F.when(fine(ps), F.struct(kind.alias("kind"), ps.alias("parts"))).cast(SHAPE))


def oriented(rings: Column) -> Column:
    """Rings of one part, the outer one first: it runs counter-clockwise, the holes clockwise; rings of under three vertices are left out."""

    def turned(rs: Column) -> Column:
        holes = F.transform(F.slice(rs, 2, F.greatest(F.size(rs), F.lit(1))), lambda r: F.when(G.signed_area(r) > 0, F.reverse(r)).otherwise(r))
        return F.filter(F.concat(F.transform(F.slice(rs, 1, 1), G.ccw), holes), lambda r: F.size(r) >= 3)

    return G.let(rings, turned)


def of_ring(ring: Column) -> Column:
    """A polygon of one ring."""
    fine = lambda r: (F.size(r) >= 3) & ~F.exists(r, lambda p: F.isnull(p["x"] + p["y"]) | F.isnan(p["x"] + p["y"]))
    return G.let(ring, lambda r: F.when(fine(r), F.struct(F.lit("polygon").alias("kind"), F.array(G.ccw(r)).alias("parts"))))


def of_rings(rings: Column) -> Column:
    """A polygon of an outer ring and holes."""
    return shape(F.lit("polygon"), oriented(rings))


def of_line(line: Column) -> Column:
    return shape(F.lit("line"), F.array(line))


def of_point(x: Column, y: Column) -> Column:
    return shape(F.lit("point"), F.array(F.array(G.point(x, y))))


def _polygons(geom_type: Column, coordinates: Column) -> Column:
    """The parts of a Polygon or MultiPolygon, each an array of rings as read, without the repeated last vertex."""
    opened = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    read = lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    text = F.when(geom_type == "Polygon", one).when(geom_type == "MultiPolygon", many)
    return F.transform(text, lambda part: F.transform(part, lambda r: G.let(F.transform(r, read), opened)))


def of_geojson(geom_type: Column, coordinates: Column) -> Column:
    """The shape of a GeoJSON geometry, coordinates as JSON text; null for other types and unreadable text."""
    level = lambda n: F.from_json(coordinates, "array<" * n + "double" + ">" * n)
    read = lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    polygon = F.flatten(F.transform(_polygons(geom_type, coordinates), oriented))
    parts = F.when(geom_type == "LineString", F.array(level(2))).when(geom_type == "MultiLineString", level(3)).when(geom_type == "Point", F.array(F.array(level(1)))).when(geom_type == "MultiPoint", F.transform(level(2), lambda p: F.array(p)))
    others = F.filter(F.transform(parts, lambda r: F.transform(r, read)), lambda r: F.size(r) > 0)
    area = geom_type.isin("Polygon", "MultiPolygon")
    kind = F.when(area, "polygon").when(geom_type.isin("LineString", "MultiLineString"), "line").otherwise("point")
    return shape(kind, F.when(area, polygon).otherwise(others))


def exterior_of_geojson(geom_type: Column, coordinates: Column) -> Column:
    """Outer ring, as it runs in the text, of the largest part (holes taken off; the first of equals)."""
    part = lambda rings, i: F.struct(G.total(oriented(rings), G.signed_area).alias("area"), (-i).alias("i"), F.get(rings, F.lit(0)).alias("ring"))
    sized = F.transform(_polygons(geom_type, coordinates), part)
    return F.array_max(F.filter(sized, lambda p: F.size(p["ring"]) > 0))["ring"]


def polygons(s: Column) -> Column:
    """The parts of a polygon as arrays of rings, the outer one first."""
    empty = F.array().cast(f"array<array<{RING}>>")
    put = lambda acc, r: F.when((G.signed_area(r) > 0) | (F.size(acc) == 0), F.concat(acc, F.array(F.array(r)))).otherwise(
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(r))))
    )
    return F.aggregate(s["parts"], empty, put)


def moved(s: Column, to) -> Column:
    """The shape with each vertex replaced by ``to(vertex)``, an (x, y) struct."""
    return G.let(s, lambda v: F.when(v.isNotNull(), F.struct(v["kind"].alias("kind"), F.transform(v["parts"], lambda r: F.transform(r, to)).alias("parts"))))


def vertices(s: Column) -> Column:
    return F.flatten(s["parts"])


def bbox(s: Column, by: float = 0.0) -> Column:
    """(minx, miny, maxx, maxy), widened by ``by``; null for a null shape."""
    return G.let(s, lambda v: F.when(v.isNotNull(), G.bbox(vertices(v), by)))


def outermost(s: Column) -> Column:
    """The vertices farthest to each side, four at most."""
    turned = lambda ps: F.transform(ps, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    ends = lambda ps: G.let(turned(ps), lambda ts: F.array(F.array_min(ps), F.array_max(ps), *[G.point(e["x"], e["y"]) for e in (F.array_min(ts), F.array_max(ts))]))
    return G.let(vertices(s), lambda ps: F.when(F.size(ps) > 0, F.array_distinct(ends(ps))))


def area(s: Column) -> Column:
    """Area inside, holes taken off; 0 for points and lines."""
    return G.let(s, lambda v: F.when(v["kind"] == "polygon", F.abs(G.total(v["parts"], G.signed_area))).when(v.isNotNull(), 0.0))


def perimeter(s: Column) -> Column:
    """Length of all rings or lines."""
    length = lambda es: G.total(es, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    around = lambda v: F.when(v["kind"] == "polygon", G.total(v["parts"], G.perimeter)).when(v.isNotNull(), G.total(v["parts"], lambda r: length(G.line_edges(r))))
    return G.let(s, around)


def compactness(s: Column) -> Column:
    """4 pi A / P^2; 0 for a shape without length."""
    return G.let(s, lambda v: G.let(perimeter(v), lambda p: F.when(p > 0, 4 * G.math.pi * area(v) / (p * p)).when(v.isNotNull(), 0.0)))


def centroid(s: Column) -> Column:
    """(x, y): of the inside for polygons, by length for lines, the mean for points; of the next lower kind where that has no size."""

    def about(v: Column) -> Column:
        first = F.get(F.get(F.filter(v["parts"], lambda r: F.size(r) > 0), F.lit(0)), F.lit(0))
        return G.let(first, lambda o: G.let(F.struct(_moments(v, o["x"], o["y"]).alias("m"), o["x"].alias("x0"), o["y"].alias("y0")), _mean))

    return G.let(s, lambda v: F.when(v.isNotNull(), about(v)))


def _moments(s: Column, x0: Column, y0: Column) -> Column:
    """Sums over edges and vertices about (x0, y0): w, x, y by area, l, lx, ly by length, n, px, py by vertex."""
    cross = lambda e: (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)
    length = lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
    x, y = lambda e: e["x1"] + e["x2"] - 2 * x0, lambda e: e["y1"] + e["y2"] - 2 * y0
    polygon = s["kind"] == "polygon"
    around = F.when(polygon, F.flatten(F.transform(s["parts"], G.edges))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    along = F.flatten(F.transform(s["parts"], lambda r: F.when(polygon, G.edges(r)).otherwise(G.line_edges(r))))
    by_area = G.let(around, lambda es: F.struct(G.total(es, cross).alias("w"), G.total(es, lambda e: x(e) * cross(e)).alias("x"), G.total(es, lambda e: y(e) * cross(e)).alias("y")))
    by_length = G.let(along, lambda es: F.struct(G.total(es, length).alias("w"), G.total(es, lambda e: x(e) * length(e)).alias("x"), G.total(es, lambda e: y(e) * length(e)).alias("y")))
    by_vertex = G.let(F.flatten(s["parts"]), lambda ps: F.struct(F.size(ps).cast("double").alias("w"), G.total(ps, lambda p: p["x"] - x0).alias("x"), G.total(ps, lambda p: p["y"] - y0).alias("y")))
    return F.struct(by_area.alias("area"), by_length.alias("length"), by_vertex.alias("vertex"))


def _mean(v: Column) -> Column:
    of = lambda c: F.coalesce(F.try_divide(v["m"]["area"][c], 3 * v["m"]["area"]["w"]), F.try_divide(v["m"]["length"][c], 2 * v["m"]["length"]["w"]), F.try_divide(v["m"]["vertex"][c], v["m"]["vertex"]["w"]))
    return G.point(v["x0"] + of("x"), v["y0"] + of("y"))


def flat(s: Column) -> list[Column]:
    """The shape as plain numbers for Arrow: coordinates, vertices of each part, kind."""
    return [G.flat(vertices(s)), F.transform(s["parts"], lambda r: F.size(r)), F.when(s["kind"] == "polygon", 2).when(s["kind"] == "line", 1).otherwise(0)]


def _pairwise(work, kind, a: Column, b: Column) -> Column:
    return F.arrow_udf(G._hinted(kernels.shape_pairs(work), 6), kind)(*flat(a), *flat(b))


def intersection_area(a: Column, b: Column) -> Column:
    """Area that two polygons share, holes left out (an Arrow kernel)."""
    return flat_intersection_area(flat(a), flat(b))


def flat_intersection_area(a: list[Column], b: list[Column]) -> Column:
    """``intersection_area`` of shapes that are plain numbers already (``flat``)."""
    return F.arrow_udf(G._hinted(kernels.shape_pairs(kernels.overlap), 6), DoubleType())(*a, *b)


def meets(a: Column, b: Column) -> Column:
    """Whether two shapes share a point: a boundary meets, or one holds the other (an Arrow kernel)."""
    return _pairwise(kernels.meet, DoubleType(), a, b) == 1.0


def distance(a: Column, b: Column) -> Column:
    """Least distance of two shapes, 0 where they share a point (an Arrow kernel)."""
    return _pairwise(kernels.apart, DoubleType(), a, b)


def contains_within(s: Column, px: Column, py: Column, margin: float) -> Column:
    """Whether the point is inside the polygon grown by ``margin`` (an Arrow kernel)."""
    return flat_contains_within(flat(s), px, py, margin)


def flat_contains_within(numbers: list[Column], px: Column, py: Column, margin: float) -> Column:
    """``contains_within`` of a shape that is plain numbers already (``flat``), as one that is tested against many points."""
    return F.arrow_udf(G._hinted(kernels.shape_holds(margin), 5), BooleanType())(*numbers, px, py)


def crosses_itself(s: Column) -> Column:
    """Whether a ring crosses itself (an Arrow kernel)."""
    return G.any_crosses_itself(s["parts"])


def wkt(s: Column) -> Column:
    """Well-known text; the rings of a polygon are taken as one part."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    text = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    closed = F.transform(s["parts"], lambda r: F.when(s["kind"] == "polygon", F.concat(r, F.slice(r, 1, 1))).otherwise(r))
    name = F.when(s["kind"] == "polygon", "POLYGON").when(s["kind"] == "line", "MULTILINESTRING").otherwise("MULTIPOINT")
    return F.concat(name, F.lit(" ("), F.array_join(F.transform(closed, text), ", "), F.lit(")"))
