"""Spatial joins as equi-joins on the cells of a grid with several levels.

A bounding-box condition alone would be planned as a nested loop over all pairs. Each box has the level whose cells are at least twice its
size, so it touches four of them at most, also when grown by as much as a box of that level or a finer one. The larger box of a pair goes
to the cells that it touches so grown, the smaller one to the one cell of its lower corner on that level: a pair meets in one cell, so no ``distinct`` is
needed, and a box over a whole district takes no more rows than a small one. A cell with very many boxes is split by adaptive execution like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.geometry import boxes_meet
from ..scratch import dealt, stored


def shaped(df: DataFrame) -> DataFrame:
    """The table with the ``shape`` of its rows, made from ``ring`` or ``line`` where it has none."""
    if "shape" in df.columns:
        return df
    return df.withColumn("shape", S.of_ring(F.col("ring")) if "ring" in df.columns else S.of_line(F.col("line")))


def level_of(box: Column, cell: float) -> Column:
    """Level of the grid, from 0, whose cells (``cell`` * 2^level wide) are at least twice as wide as the box; null for a null box."""
    size = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(2.0 * size / cell, F.lit(1.0))))).cast("int")


def wide_cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    """A row for each cell of its level that the box, grown to the lower sides by half a cell, touches; four at most."""
    b, level = F.col(box), level_of(F.col(box), cell)
    width = cell * F.pow(F.lit(2.0), level)
    span = lambda low, high: F.sequence(F.floor((b[low] - width / 2) / width), F.floor(b[high] / width))
    return df.withColumns({"level": level, "cx": F.explode(span("minx", "maxx"))}).withColumn("cy", F.explode(span("miny", "maxy")))


def corner_cells(df: DataFrame, box: str, cell: float, levels: list[int], own: bool) -> DataFrame:
    """A row for the cell of the box's lower corner on each of the ``levels`` that are coarser than its own, or its own too."""
    b, level = F.col(box), level_of(F.col(box), cell)
    some = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= level if own else v > level)
    out = df.withColumn("level", F.explode(some))
    width = cell * F.pow(F.lit(2.0), F.col("level"))
    return out.withColumns({"cx": F.floor(b["minx"] / width), "cy": F.floor(b["miny"] / width)})


def levels_of(sides: dict[str, tuple[DataFrame, str]], cell: float) -> dict[str, list[int]]:
    """The levels that occur on each side, a few, by one job."""
    each = [df.select(F.lit(n).alias("side"), level_of(F.col(box), cell).alias("level")) for n, (df, box) in sides.items()]
    found = each[0].unionByName(each[1]).where("level is not null").distinct().collect()
    return {n: sorted(r["level"] for r in found if r["side"] == n) for n in sides}


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float = 64.0, on: list[str] | None = None) -> DataFrame:
    """Pairs whose boxes meet, each once; rows without a box have none. ``on``: further columns that must be equal.

    A row takes four rows at most as the larger box, and one for each level of the other side as the smaller.
    """
    keys = [*(on or []), "level", "cx", "cy"]
    met = boxes_meet(F.col(left_box), F.col(right_box))
    levels = levels_of({"left": (left, left_box), "right": (right, right_box)}, cell)
    above, below = levels["left"], levels["right"]
    pairs = wide_cells(left, left_box, cell).join(corner_cells(right, right_box, cell, above, True).hint("merge"), keys).where(met).drop(*keys[-3:])
    if not above or not below or below[-1] <= above[0]:
        return pairs  # no right box is larger than a left one
    return pairs.unionByName(corner_cells(left, left_box, cell, below, False).join(wide_cells(right, right_box, cell).hint("merge"), keys).where(met).drop(*keys[-3:]))


#: Cells of the nearest search are split into 4 x 4 so often at most; so many rows are broadcast at most.
DEPTH, FEW = 20, 5_000


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _kept(pairs: DataFrame, rows: int, right_box: str, spots: str, farthest: float | None) -> DataFrame:
    """Pairs of a cell and a right row that may be the nearest one of a left row in it.

    Five spots compete in each cell: the nearest one to its middle and those to its corners. A right row goes if one of them is nearer to every corner than the row's box is: then it is nearer to
    all points of the cell too, as points nearer to one of two places lie in a half-plane. A row never goes by its own spot, and what goes by a margin cannot tie.
    """
    high = lambda c: F.greatest(F.lit(0.0), c)
    b, a = F.col(right_box), {c: F.col(f"_{c}") for c in ("minx", "miny", "maxx", "maxy")}
    if farthest is not None:
        pairs = pairs.where(F.hypot(high(F.greatest(b["minx"] - a["maxx"], a["minx"] - b["maxx"])), high(F.greatest(b["miny"] - a["maxy"], a["miny"] - b["maxy"]))) <= farthest)
    corners = [(a[x], a[y]) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    from_spot = lambda x, y: F.array_min(F.transform(spots, lambda p: F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
    middle = ((a["minx"] + a["maxx"]) / 2, (a["miny"] + a["maxy"]) / 2)
    best = pairs.groupBy("_cx", "_cy").agg(*[F.min(from_spot(x, y)).alias(f"_g{i}") for i, (x, y) in enumerate([*corners, middle])])
    gap = lambda x, y: F.hypot(high(F.greatest(b["minx"] - x, x - b["maxx"])), high(F.greatest(b["miny"] - y, y - b["maxy"])))
    met = pairs.join(_hinted(best, rows), ["_cx", "_cy"]).withColumns({f"_d{i}": gap(x, y) for i, (x, y) in enumerate(corners)})
    beaten = F.lit(False)
    for g in range(5):
        nearer = F.lit(True)
        for i, (x, y) in enumerate(corners):
            nearer = nearer & (F.hypot(x - F.col(f"_g{g}.x"), y - F.col(f"_g{g}.y")) * (1 + 1e-12) < F.col(f"_d{i}"))
        beaten = beaten | nearer
    return met.where(~beaten).select(*pairs.columns)


def nearest(left: DataFrame, right: DataFrame, key: str, distance: Column, left_box: str, right_box: str, spots: str, farthest: float | None = None) -> DataFrame:
    """key, distance of the nearest row of ``right``, however far or up to ``farthest``; rows without a box, or with none in reach, get no row.

    ``distance`` is that of a pair, never less than that of the boxes and never more than that of the left shape and one of the ``spots``, a few points of the right one.
    Cells of left rows are split into 4 x 4, round by round, and each passes on only those right rows that may be the nearest one in it. A cell far from everything keeps a few of them, however many
    there are and however large it is; so left rows are compared with few, near or far. Equal right rows count once.
    """
    b = lambda c: F.col(f"{left_box}.{c}")
    left = stored(dealt(left.where(F.col(left_box).isNotNull()), key), "near-left")
    right = stored(dealt(right.where(F.col(right_box).isNotNull()).distinct()).withColumn("_id", F.monotonically_increasing_id()), "near-right")  # ids are written, too
    found = left.select(key, F.lit(None).cast("double").alias("distance")).limit(0)
    e = left.agg(F.min(b("minx")).alias("x0"), F.min(b("miny")).alias("y0"), F.max(b("minx")).alias("x1"), F.max(b("miny")).alias("y1")).first()
    if e["x0"] is None or right.isEmpty():
        return found
    width, cells_across = max(e["x1"] - e["x0"], e["y1"] - e["y0"]) or 1.0, 1 << 2 * DEPTH
    place = lambda c, zero: F.least(F.floor((b(c) - zero) / width * cells_across), F.lit(cells_across - 1)).cast("long")
    left = left.withColumns({"_x": place("minx", e["x0"]), "_y": place("miny", e["y0"])})
    pairs = right.select("_id", right_box, spots)
    for level in range(DEPTH + 1):
        left = left.withColumns({c: F.shiftright(f, 2 * (DEPTH - level)) for c, f in (("_cx", "_x"), ("_cy", "_y"))})
        cells = left.groupBy("_cx", "_cy").agg(
            F.count("*").alias("_n"), *[of(b(c)).alias(f"_{c}") for c, of in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))],
            F.greatest(F.max(b("minx")) - F.min(b("minx")), F.max(b("miny")) - F.min(b("miny"))).alias("_spread"),
        )
        cells = stored(cells, "near-cells")
        rows = cells.count()
        if level == 0:
            pairs = pairs.crossJoin(F.broadcast(cells))  # one cell
        else:
            inner = cells.withColumns({"_px": F.shiftright("_cx", 2), "_py": F.shiftright("_cy", 2)})
            pairs = pairs.join(_hinted(inner, rows), ["_px", "_py"]).drop("_px", "_py")
        pairs = stored(_kept(pairs, rows, right_box, spots, farthest), "near-pairs")
        size = F.greatest(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny"))
        work = F.col("_n") * F.col("_m")
        # Few pairs, or few candidates a row; or left rows so much in one place that smaller cells are hardly smaller.
        done = (F.col("_n") <= 16) | (work <= 2048) | ((F.col("_m") <= 4) & (work <= 65536)) | (F.col("_spread") <= size / 4) | F.lit(level == DEPTH)
        state = stored(pairs.groupBy("_cx", "_cy", "_n", "_minx", "_miny", "_maxx", "_maxy", "_spread").agg(F.count("*").alias("_m")).select("_cx", "_cy", done.alias("_done")), "near-state")
        mine = left.join(_hinted(state, rows), ["_cx", "_cy"])
        some = stored(pairs.join(_hinted(state.where("_done"), rows), ["_cx", "_cy"], "left_semi").select("_cx", "_cy", "_id").join(right.drop(spots).hint("merge"), "_id"), "near-some")
        met = mine.where("_done").join(_hinted(some, some.count()), ["_cx", "_cy"]).withColumn("distance", distance)
        met = met if farthest is None else met.where(F.col("distance") <= farthest)
        found = found.unionByName(stored(met.groupBy(key).agg(F.min("distance").alias("distance")), "near-found"))
        if state.where("not _done").isEmpty():
            return found
        left = stored(mine.where("not _done").drop("_done", "_cx", "_cy"), "near-left")
        pairs = pairs.join(_hinted(state.where("not _done"), rows), ["_cx", "_cy"], "left_semi").select("_id", right_box, spots, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    return found


def candidates(parcels: DataFrame, drone: DataFrame, radius: float = 35.0, cell: float = 64.0) -> DataFrame:
    """Parcel and drone polygons whose boxes, the parcel's grown by ``radius``, meet.

    ``parcels``: parcel_id, ring (or shape too) and others; ``drone``: feature_id, ring (or shape too) and others, which get the prefix d_.
    """
    left = shaped(parcels).withColumn("p_box", S.bbox(F.col("shape"), radius))
    right = shaped(drone)
    right = right.select(*[F.col(c).alias(c if c == "feature_id" else f"d_{c}") for c in right.columns]).withColumn("d_box", S.bbox(F.col("d_shape")))
    return box_join(left, right, "p_box", "d_box", cell)


def self_overlaps(parcels: DataFrame, least: float = 2.0, cell: float = 64.0) -> DataFrame:
    """Pairs a < b of parcels that share more than ``least`` square metres: a, b, overlap, and the shape and ring of each."""
    parcels = shaped(parcels)
    parcels = parcels if "ring" in parcels.columns else parcels.withColumn("ring", F.get("shape.parts", F.lit(0)))
    side = lambda n: parcels.select(F.col("parcel_id").alias(n), F.col("ring").alias(f"ring_{n}"), F.col("shape").alias(f"shape_{n}"), S.bbox(F.col("shape")).alias(f"box_{n}"))
    pairs = box_join(side("a"), side("b"), "box_a", "box_b", cell).where("a < b")
    return pairs.withColumn("overlap", S.intersection_area(F.col("shape_a"), F.col("shape_b"))).where(F.col("overlap") > least).drop("box_a", "box_b")
