"""Validation and topology: invalid rings, slivers, overlaps, duplicates, shared-boundary proposals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes as S
from ..functions.numbers import rounded
from ..scratch import dealt, stored
from .spatial_join import shaped

SLIVER_RATIO, SLIVER_AREA = 0.005, 5.0


def validation_issues(parcels: DataFrame, overlaps: DataFrame, gnss: DataFrame) -> DataFrame:
    """Issue rows: source, feature_id, issue, severity, auto_fixed, description. Self-intersections are repaired (``repaired``), so they weigh less than overlaps.

    ``parcels``: parcel_id, shape or ring; ``gnss``: point_id, longitude, latitude; ``overlaps``: a, b, overlap. Slivers are told by their outline for their
    area, or by the area alone; rings that cross themselves are not judged by it.
    """
    out = None

    def put(df: DataFrame, source: str, fid: Column, issue: str, severity: str, text: Column, fixed: bool = False) -> None:
        nonlocal out
        one = df.select(F.lit(source).alias("source"), fid.cast("string").alias("feature_id"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(fixed).alias("auto_fixed"), text.alias("description"))
        out = one if out is None else out.unionByName(one)

    pid, shape = F.col("parcel_id"), F.col("shape")
    judged = shaped(parcels).select("parcel_id", shape.isNull().alias("lost"), S.area(shape).alias("area"), S.perimeter(shape).alias("length"), F.coalesce(S.crosses_itself(shape), F.lit(False)).alias("crossed"))
    # Written, so that a parcel is judged once; and Spark can't run a kernel inside a filter that also builds the shapes which the kernel reads.
    judged = stored(judged, "judged-parcels")
    put(judged.where("lost"), "legacy", pid, "Missing Geometry", "High", F.lit("No readable geometry"))
    put(judged.where("crossed"), "legacy", pid, "Self-Intersection", "Medium", F.lit("Ring crosses itself; its largest loop is kept"), True)
    thin = F.col("area") / (F.col("length") * F.col("length")) < SLIVER_RATIO
    put(judged.where((F.col("length") > 0) & (thin | (F.col("area") < SLIVER_AREA)) & ~F.col("crossed")), "legacy", pid, "Sliver", "Low", F.lit("Narrow or tiny polygon; verify its boundary"))
    put(overlaps, "legacy", F.concat_ws(" & ", "a", "b"), "Overlap", "High", F.format_string("Parcels %s and %s overlap by %.1f m2", F.col("a").cast("string"), F.col("b").cast("string"), rounded(F.col("overlap"), 1)))
    lost = (F.abs("latitude") > 90) | (F.abs("longitude") > 180) | F.col("latitude").isNull() | F.col("longitude").isNull()
    put(gnss.where(lost), "gnss", F.col("point_id"), "GNSS Out Of Range", "Medium", F.lit("Position outside the range of degrees"))
    return out


def source_counts(**sources: DataFrame) -> DataFrame:
    """source, n: row counts of the sources, one aggregate each."""
    out = None
    for name, df in sorted(sources.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def duplicates(parcels: DataFrame) -> DataFrame:
    """Geometries that several parcels share: geom_hash, first_id, n. Rings that start elsewhere are equal."""
    low = F.array_position(F.col("ring"), F.array_min(F.col("ring"))).cast("int")
    turned = F.concat(F.slice("ring", low, F.size("ring")), F.slice("ring", F.lit(1), low - 1))
    return parcels.select("parcel_id", F.sha2(F.to_json(turned), 256).alias("geom_hash")).groupBy("geom_hash").agg(F.min("parcel_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def half_overlap(pairs: DataFrame) -> DataFrame:
    """Adds what part of the overlap lies on the lower side of the common box's mid-line (across its longer side).

    The lower half-plane is a large rectangle, so the part is the overlap of a ring clipped to it with the other ring.
    """
    a, b = G.bbox(F.col("ring_a")), G.bbox(F.col("ring_b"))
    box = pairs.withColumns({"_w": F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"]), "_h": F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])})
    wide = F.col("_w") >= F.col("_h")
    mid = F.when(wide, (F.greatest(a["minx"], b["minx"]) + F.least(a["maxx"], b["maxx"])) / 2).otherwise((F.greatest(a["miny"], b["miny"]) + F.least(a["maxy"], b["maxy"])) / 2)
    clipped = box.withColumns({"axis": F.when(wide, "x").otherwise("y"), "mid_line": mid})
    lower = clip_lower(F.col("ring_a"), F.col("axis"), F.col("mid_line"))
    part = F.when(F.size(lower) >= 3, G.intersection_area(lower, F.col("ring_b"))).otherwise(0.0)
    return clipped.withColumn("lower_overlap", part).drop("_w", "_h")


def clip_lower(ring, axis, at):
    """Vertices of the ring's part at or under ``at`` on the axis, in order (one half-plane of Sutherland-Hodgman)."""
    value = lambda p: F.when(axis == "x", p["x"]).otherwise(p["y"])

    def step(p, i):
        q = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
        t = F.try_divide(at - value(p), value(q) - value(p))
        cut = G.point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        inside, after = value(p) <= at, value(q) <= at
        return F.filter(F.array(F.when(inside, p), F.when(inside != after, cut)), lambda v: v.isNotNull())

    return F.flatten(F.transform(ring, step))


def shared_boundary(pairs: DataFrame, least: float = 0.001) -> DataFrame:
    """Proposals for overlapping pairs: areas before and after for each way to settle the overlap.

    ``A`` keeps the overlap in a, ``B`` in b, ``BISECT`` gives each the half on its side of the mid-line.
    """
    df = half_overlap(pairs.where(F.col("overlap") > least)).withColumns({"area_a": G.area(F.col("ring_a")), "area_b": G.area(F.col("ring_b"))})
    a_low = F.when(F.col("axis") == "x", G.centroid(F.col("ring_a"))["x"] <= G.centroid(F.col("ring_b"))["x"]).otherwise(G.centroid(F.col("ring_a"))["y"] <= G.centroid(F.col("ring_b"))["y"])
    mine = F.when(a_low, F.col("overlap") - F.col("lower_overlap")).otherwise(F.col("lower_overlap"))
    way = lambda name, lost_a, lost_b: F.struct(F.lit(name).alias("strategy"), lost_a.cast("double").alias("lost_a"), lost_b.cast("double").alias("lost_b"))
    ways = F.explode(F.array(way("PRIORITIZE_A", F.lit(0.0), F.col("overlap")), way("PRIORITIZE_B", F.col("overlap"), F.lit(0.0)), way("BISECT", mine, F.col("overlap") - mine)))
    df = df.withColumn("way", ways)
    two = lambda c: rounded(c, 2)
    return df.select(
        "a", "b", F.col("way.strategy").alias("strategy"), two(F.col("overlap")).alias("overlap"), two(F.col("area_a")).alias("a_before"), two(F.col("area_b")).alias("b_before"),
        two(F.col("area_a") - F.col("way.lost_a")).alias("a_after"), two(F.col("area_b") - F.col("way.lost_b")).alias("b_after"),
    )


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with their decision; only APPROVED and REJECTED count, others leave them PENDING."""
    valid = decisions.where(F.col("decision").isin("APPROVED", "REJECTED"))
    return proposals.join(valid.hint("merge"), ["a", "b"], "left").withColumn("decision", F.coalesce("decision", F.lit("PENDING")))


def loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The loops of a ring that crosses or touches itself, each of which does neither; none if edges run along each other.

    Every edge is cut where another meets it. Along the cut ring, a point that is met again closes a loop, which is taken out.
    """
    n = len(ring)
    cuts: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1 and j not in (i + 1, i + n - 1):
                    at = ring[i] if t == 0 else ring[(i + 1) % n] if t == 1 else ring[j] if u == 0 else ring[(j + 1) % n] if u == 1 else (ax + t * (bx - ax), ay + t * (by - ay))
                    cuts[i].append((t, at))
                    cuts[j].append((u, at))
            elif (bx - ax) * (cy - ay) == (by - ay) * (cx - ax):
                along = lambda x, y: (x - ax) * (bx - ax) + (y - ay) * (by - ay)
                if max(min(along(cx, cy), along(dx, dy)), 0.0) < min(max(along(cx, cy), along(dx, dy)), along(bx, by)):
                    return []
    path: list[tuple[float, float]] = []
    place: dict[tuple[float, float], int] = {}
    found = []
    for i in range(n):
        for at in [ring[i], *(p for _, p in sorted(cuts[i]))]:
            if path and at == path[-1]:
                continue
            if at in place:
                loop = path[place[at] :]
                for p in loop[1:]:
                    del place[p]
                del path[place[at] + 1 :]
                if len(loop) >= 3:
                    found.append(loop)
            else:
                place[at] = len(path)
                path.append(at)
    return [*found, path] if len(path) >= 3 else found


def signed(ring: list[tuple[float, float]]) -> float:
    """Area, negative for a clockwise ring; about the first vertex, so that large coordinates cost no digits."""
    x0, y0 = ring[0]
    return math.fsum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def largest_loop(ring: list[tuple[float, float]]) -> list[tuple[float, float]] | None:
    """The loop of largest area, the first of equals; None for degenerate rings."""
    found = [loop for loop in loops(ring) if signed(loop)]
    return max(found, key=lambda loop: abs(signed(loop))) if found else None


def _fixed(flat: np.ndarray) -> list[float] | None:
    """The largest loop of a ring given as x, y, x, y, ..., in the same form."""
    xs = flat.tolist()
    best = largest_loop(list(zip(xs[::2], xs[1::2], strict=True)))
    return [c for p in best for c in p] if best else None


def _ring(flat: Column) -> Column:
    """The ring of x, y, x, y, ...; null for null."""
    at = F.when(flat.isNotNull(), F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1))
    return F.transform(at, lambda i: G.point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))


def repaired(parcels: DataFrame) -> DataFrame:
    """Rows of rings that cross or touch themselves with the largest of their loops; rings whose edges run along each other, or without any area, are quarantined.

    Rows are dealt out first, as they are small in bytes; only flagged ones are cut into loops.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [_fixed(flat) for flat in batch["flat"]]
            yield pd.DataFrame({"parcel_id": batch["parcel_id"], "flat": batch["flat"], "best": best, "outcome": ["REPAIRED" if b else "QUARANTINED" for b in best]})

    rows = dealt(parcels.select(F.col("parcel_id").cast("long"), "ring"), "parcel_id").where(G.crosses_itself(F.col("ring")))
    found = rows.select("parcel_id", G.flat(F.col("ring")).alias("flat")).mapInPandas(run, "parcel_id long, flat array<double>, best array<double>, outcome string")
    return found.select("parcel_id", G.wkt(_ring(F.col("flat"))).alias("original_wkt"), _ring(F.col("best")).cast(S.RING).alias("repaired"), "outcome")


def repaired_polygons(flagged: DataFrame, key: str) -> DataFrame:
    """key, original_wkt, repaired (shape), outcome: each ring of a shape that crosses itself becomes its largest loop; a shape with a ring that can't be repaired is quarantined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [[_fixed(flat) for flat in rings] for rings in batch["rings"]]
            best = [b if all(b) else None for b in best]
            yield pd.DataFrame({key: batch[key], "wkt": batch["wkt"], "rings": best, "outcome": ["REPAIRED" if b else "QUARANTINED" for b in best]})

    kind = dict(flagged.dtypes)[key]
    rows = flagged.select(key, F.transform("shape.parts", G.flat).alias("rings"), S.wkt(F.col("shape")).alias("wkt"))
    fixed = rows.mapInPandas(run, f"{key} {kind}, wkt string, rings array<array<double>>, outcome string")
    return fixed.select(key, F.col("wkt").alias("original_wkt"), F.when(F.col("rings").isNotNull(), S.of_rings(F.transform("rings", _ring).cast(f"array<{S.RING}>"))).alias("repaired"), "outcome")
