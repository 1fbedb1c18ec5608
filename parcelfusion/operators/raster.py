"""Raster work over pixel tables: statistics, zones, differences, morphology, regions, tiles.

A raster is a table of pixels (px_row, px_col, values), so every step is a join or an aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import kernels as K
from ..functions import shapes as S
from ..functions.numbers import rounded
from ..scratch import stored
from .spatial_join import box_join, shaped

NODATA = -9999.0
#: Luminance weights of the three bands.
LUMINANCE = (0.299, 0.587, 0.114)


def valid(value: Column) -> Column:
    return (value != NODATA) & ~F.isnan(value)


def raster_stats(pixels: DataFrame) -> DataFrame:
    """raster_id, n, low, high, mean of the valid pixels."""
    return pixels.where(valid(F.col("elev"))).groupBy("raster_id").agg(F.count("*").alias("n"), F.min("elev").alias("low"), F.max("elev").alias("high"), rounded(F.avg("elev"), 4).alias("mean"))


def registered(headers: DataFrame) -> DataFrame:
    """Headers (raster_id, width, height, bands, res_x, unit) with ground sample distance in cm and band names."""
    gsd = F.when(F.col("unit") == "degree", F.col("res_x") * 11113900.0).otherwise(F.col("res_x") * 100.0)
    names = F.when(F.col("bands") == 4, "Red,Green,Blue,Near-Infrared (NIR)").when(F.col("bands") == 1, "Panchromatic/Grayscale").otherwise("Red,Green,Blue")
    return headers.select("raster_id", "width", "height", rounded(gsd, 1).alias("gsd_cm"), names.alias("band_names"))


def window(pixels: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels inside a box: a filter on x and y that reaches the scan."""
    return pixels.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def write_tiles(pixels: DataFrame, path: str, size: float) -> None:
    """Pixels (x, y, ...) in folders tile_y and tile_x, squares of ``size``. Ranges split a crowded tile over tasks and keep its files few.

    Pixels without a place stand in the folder of no tile, which no window reads.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    dealt = pixels.withColumns({"tile_y": at("y"), "tile_x": at("x")}).repartitionByRange("tile_y", "tile_x", "y")
    dealt.write.partitionBy("tile_y", "tile_x").parquet(path)


def tile_window(tiled: DataFrame, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """``window`` of pixels read from ``write_tiles``: only the folders that the box meets are scanned."""
    of = lambda c, low, high: F.col(c).between(math.floor(low / size), math.floor(high / size))
    return window(tiled.where(of("tile_x", box[0], box[2]) & of("tile_y", box[1], box[3])), box).drop("tile_y", "tile_x")


def zonal(parcels: DataFrame, pixels: DataFrame, cell: float = 64.0) -> DataFrame:
    """parcel_id, n, low, high, mean, relief, slope (degrees) of the valid pixels in each parcel's bounding box."""
    zones = shaped(parcels).select("parcel_id", S.bbox(F.col("shape")).alias("box"))
    spot = F.struct(F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    return zone_stats(box_join(zones, pixels.where(valid(F.col("elev"))).select("elev", spot.alias("spot")), "box", "spot", cell))


def zone_stats(met: DataFrame) -> DataFrame:
    found = met.groupBy("parcel_id").agg(F.count("*").alias("n"), F.min("elev").alias("low"), F.max("elev").alias("high"), rounded(F.avg("elev"), 4).alias("mean"))
    return found.withColumn("relief", F.col("high") - F.col("low")).withColumn("slope", rounded(F.degrees(F.atan2(F.col("relief"), F.lit(35.0))), 4))


def scanlines(parcels: DataFrame, pitch: float, span: int = 64) -> DataFrame:
    """parcel_id, row, cell, x0, x1: where each row of pixels (y a multiple of ``pitch``) runs inside a polygon, a row for each ``span`` pixels that it touches."""
    flat, sizes, _ = S.flat(F.col("shape"))
    rings = shaped(parcels).where("shape.kind = 'polygon'").select("parcel_id", flat.alias("flat"), sizes.alias("sizes"))
    width, names = pitch * span, ["parcel_id", "row", "cell", "x0", "x1"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = K.Lists.of(batch.column("flat")), K.Lists.of(batch.column("sizes"))
            # Rows that a polygon's edges cross, so that a batch of large ones is cut.
            edges = K.Shapes(x, n, np.full(len(x), 2))
            rows = np.bincount(edges.of, np.abs(edges.to[:, 1] - edges.at[:, 1]) / pitch + 2, len(x))
            ends = np.flatnonzero(np.diff(np.cumsum(rows) // K.RUN)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(x)], strict=True):
                of, row, x0, x1 = K.scanned(K.Shapes(x[i:j], n[i:j], np.full(j - i, 2)), pitch)
                first = np.floor(x0 / width).astype(np.int64)
                m = np.floor(x1 / width).astype(np.int64) - first + 1
                of, row, x0, x1, cell = (np.repeat(c, m) for c in (of, row, x0, x1, first))
                cell += np.arange(len(cell)) - np.repeat(np.cumsum(m) - m, m)
                yield pa.RecordBatch.from_arrays([batch.column("parcel_id").take(pa.array(of + i)), *map(pa.array, (row, cell, x0, x1))], names)

    return rings.mapInArrow(scan, StructType([rings.schema["parcel_id"], *[StructField(c, LongType()) for c in names[1:3]], *[StructField(c, DoubleType()) for c in names[3:]]]))


def zonal_masked(parcels: DataFrame, pixels: DataFrame, pitch: float, span: int = 64) -> DataFrame:
    """parcel_id, n, low, high, mean, relief, slope of the valid pixels inside each polygon, holes left out; pixels stand at multiples of ``pitch`` in y.

    Polygons are cut into the intervals that rows of pixels run inside them, which pixels are joined to by row and cell: no pixel is tested against a polygon.
    """
    width = pitch * span
    points = pixels.where(valid(F.col("elev"))).select("x", "elev", F.round(F.col("y") / pitch).cast("long").alias("row"), F.floor(F.col("x") / width).alias("cell"))
    met = points.join(scanlines(parcels, pitch, span).hint("merge"), ["row", "cell"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return zone_stats(met)


def luminance(prefix: str) -> Column:
    return sum((w * F.col(f"{prefix}b{i}") for i, w in enumerate(LUMINANCE, 1)), F.lit(0.0))


def epoch_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """px_row, px_col, g1, g2, diff of the pixels that both epochs have."""
    side = lambda df, g: df.select("px_row", "px_col", rounded(luminance(""), 6).alias(g))
    both = side(first, "g1").join(side(second, "g2").hint("merge"), ["px_row", "px_col"])
    return both.withColumn("diff", F.floor(F.abs(F.col("g1") - F.col("g2"))).cast("int"))


def mask(difference: DataFrame, threshold: int = 25) -> DataFrame:
    return difference.where(F.col("diff") > threshold).select("px_row", "px_col")


#: Pixels that an opening and a closing look beyond a tile: two steps each.
HALO = 4


def _shifted(grid: np.ndarray, keep) -> np.ndarray:
    """``keep`` (all or any) over the 3 x 3 neighbourhood of each cell; outside the grid nothing is set."""
    wide = np.pad(grid, 1)
    n, m = grid.shape
    return keep([wide[i : i + n, j : j + m] for i in range(3) for j in range(3)])


def opened_closed(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """Morphological opening, then closing, of set pixels: tile by tile, each with the rim of its neighbours, in one exchange.

    A pixel goes to its tile and to those whose rim it is in, four at most, so a group has (tile + 2 * HALO)^2 pixels at most. Pixels that are set
    only beyond the data (a closing may reach there) come out as well, in the tile where they lie. Repeated rows count once; rows without a place are left out.
    """
    every, some = (lambda xs: np.logical_and.reduce(xs)), (lambda xs: np.logical_or.reduce(xs))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(group["tile_row"].iloc[0]) * tile - HALO, int(group["tile_col"].iloc[0]) * tile - HALO
        grid = np.zeros((tile + 2 * HALO, tile + 2 * HALO), bool)
        grid[group["px_row"].to_numpy(np.int64) - row0, group["px_col"].to_numpy(np.int64) - col0] = True
        for keep in (every, some, some, every):
            grid = _shifted(grid, keep)
        rows, cols = np.nonzero(grid[HALO:-HALO, HALO:-HALO])
        return pd.DataFrame({"px_row": rows + row0 + HALO, "px_col": cols + col0 + HALO})

    tiles_of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - HALO) / tile), F.floor((F.col(c) + HALO) / tile)))
    place = pixels.select(F.col("px_row").cast("long").alias("px_row"), F.col("px_col").cast("long").alias("px_col")).where("px_row is not null and px_col is not null")
    dealt = place.withColumn("tile_row", tiles_of("px_row")).withColumn("tile_col", tiles_of("px_col"))
    return dealt.groupBy("tile_row", "tile_col").applyInPandas(run, "px_row long, px_col long")


def _runs_labelled(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For pixels in order of row and column, none twice: the position of the first pixel of each one's 8-connected region.

    Pixels side by side form runs; a run joins those of the row above that it touches, corners included.
    """
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1] + 1)
    first = np.flatnonzero(new)
    row, low, high = rows[first], cols[first], cols[np.append(first[1:], len(rows)) - 1]
    top = list(range(len(first)))

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    above = 0
    for k in range(len(first)):
        while row[above] < row[k] - 1 or (row[above] == row[k] - 1 and high[above] < low[k] - 1):
            above += 1
        j = above
        while row[j] == row[k] - 1 and low[j] <= high[k] + 1:
            x, y = root(j), root(k)
            top[max(x, y)] = min(x, y)
            j += 1
    return first[[root(k) for k in range(len(first))]][np.cumsum(new) - 1]


def tile_regions(pixels: DataFrame, tile: int) -> DataFrame:
    """px_row, px_col, tile_row, tile_col, part: regions inside each tile alone, named by their smallest pixel. A group has tile^2 pixels at most."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["px_row", "px_col"], ignore_index=True)
        rows, cols = group["px_row"].to_numpy(np.int64), group["px_col"].to_numpy(np.int64)
        at = _runs_labelled(rows, cols)
        return group.assign(part_row=rows[at], part_col=cols[at])

    place = pixels.select(F.col("px_row").cast("long").alias("px_row"), F.col("px_col").cast("long").alias("px_col")).where("px_row is not null and px_col is not null")
    dealt = place.withColumns({"tile_row": F.floor(F.col("px_row") / tile), "tile_col": F.floor(F.col("px_col") / tile)})
    once = dealt.repartition("tile_row", "tile_col").dropDuplicates(["tile_row", "tile_col", "px_row", "px_col"])
    found = once.groupBy("tile_row", "tile_col").applyInPandas(run, "px_row long, px_col long, tile_row long, tile_col long, part_row long, part_col long")
    return found.select("px_row", "px_col", "tile_row", "tile_col", F.struct(F.col("part_row").alias("px_row"), F.col("part_col").alias("px_col")).alias("part"))


def merged(links: DataFrame) -> DataFrame:
    """part, region: the smallest part of each group of parts that links (a, b), in either order, hold together.

    Each round every part hangs on its smallest neighbour if that is smaller, the chains are followed to their ends by doubling, and links
    between ends go on. Each round's table is written, which cuts the lineage.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left, found = stored(both, "links"), None
    while not left.isEmpty():
        up = stored(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("part"), F.least("a", "b").alias("region")), "links-up")
        while True:
            next_ = up.select(F.col("part").alias("region"), F.col("region").alias("end"))
            up = stored(up.join(next_.hint("merge"), "region").select("part", F.col("end").alias("region"), F.col("region").alias("was")), "links-up")
            if up.where("region <> was").isEmpty():
                break
        up = up.drop("was")
        if found is None:
            found = up
        else:
            step = up.select(F.col("part").alias("region"), F.col("region").alias("end"))
            found = stored(found.join(step.hint("merge"), "region", "left").select("part", F.coalesce("end", "region").alias("region")), "links-found")
        end = lambda c: up.select(F.col("part").alias(c), F.col("region").alias(f"{c}_end"))
        ends = left.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))
        left = stored(ends.where("a <> b").distinct(), "links")
    return found if found is not None else left.select(F.col("a").alias("part"), F.col("b").alias("region"))


def regions(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """px_row, px_col, region: 8-connected regions named by their smallest pixel, a struct of row and column.

    Two levels: first the regions inside each tile, in one pass, then the groups of those that touch across a tile's border, for which only
    pixels along borders are joined. Repeated rows count once; rows without a place are left out.
    """
    parts = stored(tile_regions(pixels, tile), "regions")
    last = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = parts.where(last("px_row") | last("px_col"))
    # A pair meets once: from the pixel above, or on its left.
    ahead = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    here = rim.withColumn("d", F.explode(ahead)).select((F.col("px_row") + F.col("d.r")).alias("px_row"), (F.col("px_col") + F.col("d.c")).alias("px_col"), F.col("part").alias("a"))
    links = here.join(rim.select("px_row", "px_col", F.col("part").alias("b")).hint("merge"), ["px_row", "px_col"]).where("a <> b").select("a", "b")
    out = parts.join(merged(links).hint("merge"), "part", "left")
    return out.select("px_row", "px_col", F.coalesce("region", "part").alias("region"))


def region_report(labels: DataFrame, difference: DataFrame, pixel_area: float = 0.25, least: int = 20) -> DataFrame:
    """region, pixels, area, box, mean luminances, class of regions with at least ``least`` pixels."""
    both = labels.join(difference.hint("merge"), ["px_row", "px_col"])
    found = both.groupBy("region").agg(
        F.count("*").alias("pixels"), F.min("px_row").alias("row_min"), F.max("px_row").alias("row_max"), F.min("px_col").alias("col_min"), F.max("px_col").alias("col_max"),
        rounded(F.avg("g1") + 1e-9, 3).alias("mean_1"), rounded(F.avg("g2") + 1e-9, 3).alias("mean_2"),  # ties go up, whatever the order of the sum
    )
    found = found.where(F.col("pixels") >= least).withColumn("area", F.col("pixels") * pixel_area)
    return found.withColumn("class", region_class(F.col("mean_2") - F.col("mean_1"), F.col("pixels"), F.col("area"))).select("*", "class.*").drop("class")


def region_class(delta: Column, pixels: Column, area: Column) -> Column:
    """kind, confidence and description of a region by its change in luminance and its size."""
    as_ = lambda kind, sure, text: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.format_string(text, rounded(area, 1)).alias("description"))
    return (
        F.when(delta > 35, as_("BUILDING_ADDED", 93.5, "New structure on open ground (%.1f m2)")).when(delta < -35, as_("BUILDING_REMOVED", 91.0, "Structure removed (%.1f m2)"))
        .when((F.abs(delta) > 15) & (pixels < 1500), as_("BUILDING_EXPANSION", 89.5, "Structure extended (%.1f m2)")).otherwise(as_("SIGNIFICANT_LAND_COVER_CHANGE", 88.0, "Ground cover changed (%.1f m2)"))
    )


def tiles(headers: DataFrame, size: int = 640, overlap: int = 64) -> DataFrame:
    """Tile windows over rasters (raster_id, width, height): raster_id, x0, y0, w, h, the last of a row or column cut to fit."""
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    out = headers.withColumn("x0", starts("width")).withColumn("y0", starts("height"))
    return out.select("raster_id", "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"))


def comparable(headers: DataFrame) -> DataFrame:
    """Pairs a < b of rasters of one CRS whose extents overlap: a, b. Joined on the CRS and grid cells."""
    side = lambda p: headers.select(F.col("raster_id").alias(p), "crs", F.struct("minx", "miny", "maxx", "maxy").alias(f"{p}_box"))
    return box_join(side("a"), side("b"), "a_box", "b_box", 4096.0, on=["crs"]).where("a < b").select("a", "b", "crs")
