"""Sinks: CSV and GeoJSON exports, result tables, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.geometry import centroid
from ..operators.sync import upsert

EXPORT = ["parcel_id", "survey_no", "full_survey", "land_use", "status", "legacy_area", "recommended_area", "geometry_source", "confidence", "conflict_type"]


def export_rows(parcels: DataFrame, status: str | None = None) -> DataFrame:
    """The ten export columns; the legacy area stands in for a missing recommendation."""
    rows = parcels if status is None else parcels.where(F.col("status") == status)
    return rows.withColumn("recommended_area", F.coalesce("recommended_area", "legacy_area")).select(*EXPORT)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("errorifexists").csv(path)


def geojson_feature(ring: Column, feature_id: Column, props: list[Column]) -> Column:
    """A feature as one line of JSON."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    pairs = F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"])))
    geometry = F.when(ring.isNotNull(), F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), feature_id.cast("string").alias("id"), F.struct(*props).alias("properties"), geometry.alias("geometry")))


def shape_feature(shape: Column, feature_id: Column, props: list[Column]) -> Column:
    """A feature of any shape, several parts and holes included, as one line of JSON."""
    pair = lambda p: F.array(p["x"], p["y"])
    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), pair)
    rings = F.transform(S.polygons(shape), lambda part: F.transform(part, closed))
    lines = F.transform(shape["parts"], lambda r: F.transform(r, pair))
    text = lambda kind, value: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(value), F.lit("}"))
    geometry = F.when(shape["kind"] == "polygon", text("MultiPolygon", rings)).when(shape["kind"] == "line", text("MultiLineString", lines)).when(shape["kind"] == "point", text("MultiPoint", F.flatten(lines)))
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), feature_id.cast("string").alias("id"), F.struct(*props).alias("properties")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def line_feature(line: Column, feature_id: Column, props: list[Column]) -> Column:
    """A line feature as one line of JSON; nulls are left out."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), feature_id.cast("string").alias("id"), F.struct(*props).alias("properties"), geometry.alias("geometry")))


def export_features(features: DataFrame, path: str, *order: str) -> None:
    """Features (``value``: their JSON) one a line, in files that stand in the order of the columns named."""
    features.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def write_layers(layers: DataFrame, path: str) -> None:
    """A layer table, in a folder for each layer."""
    layers.write.partitionBy("layer").parquet(path)


def export_geojson(parcels: DataFrame, path: str, props: list[str]) -> None:
    """One feature a line, which splits and streams; ``parcels``: parcel_id, ring and the properties."""
    parcels.select(geojson_feature(F.col("ring"), F.col("parcel_id"), [F.col(p) for p in props]).alias("value")).write.text(path)


def map_rows(parcels: DataFrame) -> DataFrame:
    """parcel_id, vertices, centroid x and y, feature: what a map shows of a parcel."""
    c = centroid(F.col("ring"))
    feature = geojson_feature(F.col("ring"), F.col("parcel_id"), [F.col("full_survey"), F.col("land_use")])
    return parcels.select("parcel_id", (F.size("ring") + 1).alias("vertices"), c["x"].alias("cx"), c["y"].alias("cy"), feature.alias("feature"))


def write_results(path: str, **tables: DataFrame) -> None:
    """Replace the stored result tables; each is a Parquet folder under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_audit(rows: DataFrame, path: str) -> None:
    """Add rows to the audit trail at ``path``."""
    rows.write.mode("append").parquet(path)


def upsert_table(spark: SparkSession, path: str, new_path: str, batch: DataFrame, key: str, order: str) -> None:
    """The table at ``path`` with the batch's rows put in by key, written to ``new_path`` (Parquet has no merge)."""
    upsert(spark.read.parquet(path), batch, key, order).write.parquet(new_path)
