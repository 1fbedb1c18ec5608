"""Scans: GeoJSON (collections or one feature a line), CSV registers, layers.

Features are read with a fixed outer schema and their properties as a map of strings, so any header is
accepted. For large inputs keep one feature a line: a FeatureCollection is one JSON value and can't be split.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.numbers import padded
from ..functions.text import crs_code
from ..scratch import stored

FEATURE = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
COLLECTION = f"type string, crs struct<properties:struct<name:string>>, features array<{FEATURE}>"
LINE = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
DEFAULT_CRS = "EPSG:4326"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, value, file of every line under ``path``: its number, over all files in the order of their paths, from 0.

    Inside a block of a file, ids that grow by one give the place; the blocks, a row each, give what comes before.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    lines = stored(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), *place), "lines")  # ids once and for all
    blocks = lines.groupBy("path", "block").agg(F.min("row").alias("first"), (F.max("row") - F.min("row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(blocks.select("path", "block", (before - F.col("first")).alias("shift")), "blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= 300_000 else blocks.hint("merge")
    return lines.join(blocks, ["path", "block"]).select((F.col("row") + F.col("shift")).alias("pos"), "value", "file")


def features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """pos, id, props, geom_type, coordinates (JSON text), crs, epsg, file of every feature under ``path``."""
    if lines:
        rows = numbered_lines(spark, path).where(F.trim("value") != "").select("pos", F.from_json("value", LINE).alias("f"), F.lit(DEFAULT_CRS).alias("crs"), "file")
    else:
        rows = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
        rows = rows.select(F.coalesce("crs.properties.name", F.lit(DEFAULT_CRS)).alias("crs"), F.posexplode("features").alias("pos", "f"), F.col("_metadata.file_name").alias("file"))
    return rows.select("pos", F.col("f.id").alias("id"), F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), "crs", crs_code(F.col("crs")).alias("epsg"), "file")


def read_shape(f: DataFrame) -> DataFrame:
    """Features with their shape (see ``functions.shapes``) and, for polygons, ring: the outer ring of the largest part."""
    geometry = F.col("geom_type"), F.col("coordinates")
    return f.withColumns({"shape": S.of_geojson(*geometry), "ring": S.exterior_of_geojson(*geometry)})


def prop(name: str) -> Column:
    return F.try_element_at("props", F.lit(name))


def legacy_parcels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cadastral parcels: ids, survey numbers and area filled in where they are missing."""
    f = read_shape(features(spark, path, lines))
    n = F.col("pos") + 1
    survey = F.coalesce(prop("survey_no"), (F.col("pos") + 101).cast("string"))
    sub = F.coalesce(prop("subdivision_no"), F.lit("1"))
    return f.select(
        F.coalesce(prop("parcel_id"), F.concat(F.lit("P"), padded(n, 3))).alias("parcel_id"), survey.alias("survey_no"), sub.alias("subdivision_no"),
        F.coalesce(prop("full_survey"), F.concat_ws("/", survey, sub)).alias("full_survey"), F.coalesce(prop("area").try_cast("double"), S.area(F.col("shape"))).alias("area"), prop("land_use").alias("land_use"), "shape", "ring", "props", "crs", "epsg",
    )


def drone_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Drone polygons: feature_id from the parcel id or position, candidate survey number, type, area."""
    f = read_shape(features(spark, path, lines))
    fid = F.coalesce(prop("feature_id"), F.col("id"), prop("parcel_id"), F.concat(F.lit("FE_"), padded(F.col("pos") + 1, 3)))
    return f.select(fid.alias("feature_id"), prop("survey_candidate").alias("survey_candidate"), prop("feature_type").alias("feature_type"), F.coalesce(prop("area").try_cast("double"), S.area(F.col("shape"))).alias("area"), "shape", "ring", "props", "crs", "epsg")


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that exists and has a value."""
    found = {c.strip().lower(): c for c in df.columns}
    return F.coalesce(*[F.col(f"`{found[n]}`") for n in names if n in found], F.lit(None).cast("string"))


def place() -> Column:
    """Where a row stands: file, block of the file, place in the block. Write it before it is used twice."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def gnss_points(spark: SparkSession, path: str) -> DataFrame:
    """Survey points; rows whose position does not parse are dropped, accuracy defaults to 0.03. ``seq`` orders them as they stand in the files."""
    df = csv(spark, path)
    points = df.select(
        first_column(df, "point_id", "id").alias("point_id"), F.trim(first_column(df, "survey_no")).alias("survey_no"), first_column(df, "latitude", "lat", "y").try_cast("double").alias("latitude"),
        first_column(df, "longitude", "lon", "lng", "x").try_cast("double").alias("longitude"), F.coalesce(first_column(df, "accuracy_m", "accuracy").try_cast("double"), F.lit(0.03)).alias("accuracy_m"), place().alias("seq"),
    )
    return points.dropna(subset=["latitude", "longitude"])


def revenue_rows(spark: SparkSession, path: str) -> DataFrame:
    """Register rows; an area that does not parse becomes 1000, land use and status have defaults. ``seq`` orders them as they stand in the files."""
    df = csv(spark, path)
    text = lambda name, default: F.trim(F.coalesce(first_column(df, name), F.lit(default))).alias(name)
    return df.select(
        text("survey_no", ""), text("subdivision_no", ""), text("owner_ref", ""), F.coalesce(first_column(df, "area").try_cast("double"), F.lit(1000.0)).alias("area"), text("land_use", "Residential"), text("status", "Active"), place().alias("seq")
    )


def utilities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Utility features with id, type and status defaults, and their shape: points, lines or polygons."""
    f = read_shape(features(spark, path, lines))
    return f.select(
        F.coalesce(prop("utility_id"), F.col("id"), F.concat(F.lit("UTIL_"), padded(F.col("pos") + 1, 3))).alias("utility_id"), F.coalesce(prop("utility_type"), F.lit("UNKNOWN")).alias("utility_type"),
        F.coalesce(prop("status"), F.lit("ACTIVE")).alias("status"), "shape", "geom_type", "coordinates",
    )


def layers(spark: SparkSession, paths: dict[str, str], lines: bool = False) -> DataFrame:
    """One table of several layers: layer, feature_id, props, shape, geom_type, coordinates, pos and file, minx, miny, maxx, maxy.

    ``writers.write_layers`` stores it partitioned by layer, so that ``layer`` reads that one alone; the box columns prune by range.
    """
    out = None
    for layer, path in sorted(paths.items()):
        f = features(spark, path, lines).withColumn("shape", S.of_geojson(F.col("geom_type"), F.col("coordinates"))).withColumn("box", S.bbox(F.col("shape")))
        one = f.select(F.lit(layer).alias("layer"), F.coalesce("id", prop("feature_id"), F.concat(F.lit(f"{layer}_"), F.col("pos").cast("string"))).alias("feature_id"), "props", "shape", "geom_type", "coordinates", "pos", "file", "box.*")
        out = one if out is None else out.unionByName(one)
    return out


def layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The features of one layer of a stored layer table: a partition filter, so other layers are not read."""
    return spark.read.parquet(path).where(F.col("layer") == name)


def inside_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box columns meet ``box``; the comparisons reach Parquet's row-group statistics."""
    return df.where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))


def layer_catalogue(layers: DataFrame, metadata: DataFrame) -> DataFrame:
    """layer, n, geom_type, files, title: features per layer and the type of the first one by file and position, beside its metadata.

    ``files`` maps each file of a layer to its number of features. ``layers``: layer, geom_type and, as read, file and pos.
    """
    place = [c for c in ("file", "pos", "feature_id") if c in layers.columns]
    file = F.col("file") if "file" in layers.columns else F.lit(None).cast("string")
    each = layers.groupBy("layer", file.alias("file")).agg(F.count("*").alias("n"), F.min(F.struct(*place, "geom_type")).alias("first"))
    entry = F.when(F.col("file").isNotNull(), F.struct(F.col("file").alias("key"), F.col("n").alias("value")))
    counts = each.groupBy("layer").agg(F.sum("n").alias("n"), F.min("first")["geom_type"].alias("geom_type"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))
    return metadata.join(counts.hint("merge"), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"), "geom_type", F.coalesce("files", F.create_map().cast("map<string,bigint>")).alias("files"), "title")


#: A comma outside quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
ROADS = ["city_name", "zone_name", "ward_name", "ward_no", "total_length_km", "tar_roads_km", "concrete_roads_km", "footpath_both_sides_km", "footpath_one_side_km"]


def road_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Road rows: the first nine fields, trimmed, of rows with nine or more and a city; lengths such as "420.5 km" also as numbers.

    Rows are ragged, so their own number of fields counts, not that of the header, which is the first line of every file.
    """
    lines = numbered_lines(spark, path)
    header = lines.groupBy("file").agg(F.min("pos").alias("pos"))
    rows = lines.join(F.broadcast(header), ["file", "pos"], "left_anti").select(F.split("value", COMMA).alias("f"))
    bare = lambda i: F.trim(F.regexp_replace(F.trim(F.get("f", F.lit(i))), '^"|"$', ""))
    rows = rows.where((F.size("f") >= 9) & (bare(0) != ""))
    number = lambda n: F.regexp_extract(n, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias(n.removesuffix("_km") + "_number")
    return rows.select(*[bare(i).alias(n) for i, n in enumerate(ROADS)]).select("*", *[number(n) for n in ROADS if n.endswith("_km")])


def districts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """District rows out of GeoJSON properties; a missing text is "", a missing number 0."""
    text = lambda n: F.coalesce(prop(n), F.lit("")).alias(n)
    number = lambda n, source=None: F.coalesce(prop(source or n).try_cast("double"), F.lit(0.0)).alias(n)
    whole = ["total_population", "sc_population", "sc_percentage", "st_population", "st_percentage"]
    return features(spark, path, lines).select(
        text("district_code"), text("district_name"), text("headquarters"), *map(number, whole), number("combined_sc_st_population", "sc_st_combined_population"), number("combined_percentage", "sc_st_combined_percentage"), number("literacy_rate"), number("taluks_count"),
    )


def as_json_text(features_list: list[dict]) -> str:
    """A FeatureCollection's text, for small hand-made inputs."""
    return json.dumps({"type": "FeatureCollection", "features": features_list})
