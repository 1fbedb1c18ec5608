"""Registered queries of stored-table reads, file round trips and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bbox
from ..functions.numbers import rounded
from ..operators import relational as N
from ..operators.sync import newest, versions
from ..scratch import shared_path
from ..sources import readers as I
from ..sources import writers as O
from ..streaming import features as S
from .fixtures import derived
from .match_queries import centroid_cte, check, edge_rows, rnd


def parcel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "parcels")
    return N.search(p, "3/2", ["parcel_id", "full_survey", "survey_no"], "parcel_id", land_use="Commercial").select("parcel_id", "full_survey", "area")


def parcel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 400).cast("string").alias("key"))
    return N.lookups(keys, derived(spark, sf_dir, "parcels"))


def parcel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "parcels").select("parcel_id", "survey_no", "subdivision_no", "full_survey", "area", "land_use").orderBy("parcel_id")


def _disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, "revenue")
    return r.select(F.col("seq").alias("parcel_id"), "owner_ref", "land_use", "status").where("status = 'Disputed'")


def parcel_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.search(derived(spark, sf_dir, "parcels"), "1_3/%2", ["parcel_id", "full_survey", "survey_no"], "parcel_id", wildcards=True).select("parcel_id", "full_survey")


def conflict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.search(_disputed(spark, sf_dir), "AGRI", ["owner_ref", "land_use", "status"], "parcel_id").select("parcel_id", "owner_ref", "land_use")


def reviewed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    decisions = e.select((F.col("user_id") * 3).alias("parcel_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "APPROVE").when(F.col("event_id") % 3 == 1, "REJECT").otherwise("COMMENT").alias("action"))
    return N.reviewed(_disputed(spark, sf_dir), decisions).select("parcel_id", "state", "parcel_status")


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(derived(spark, sf_dir, "reviews").select("event_id", "ts", "action", "target"), 100, "ts", "event_id")


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 100).alias("dataset"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"))
    return versions(o.where("dataset = 7")).select("id", "version", "active").orderBy("version")


def dataset_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["parcels", "drone", "gnss", "revenue", "layers"]
    out = None
    for n in names:
        one = derived(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("dataset"), "n", F.lit("GNSS" if n == "gnss" else "REGISTER" if n == "revenue" else "VECTOR").alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def line_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.abs(F.col("x2") - F.col("x1"))
    s = N.shares(derived(spark, sf_dir, "layers").withColumn("metres", length), "layer", "metres")
    return s.select("layer", "metres", rounded(F.col("percent"), 2).alias("percent"))


def layer_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = derived(spark, sf_dir, "layers").select("layer", "feature_id", F.lit("LineString").alias("geom_type"))
    metadata = layers.select("layer").distinct().withColumn("title", F.concat(F.lit("Layer "), F.upper("layer")))
    return I.layer_catalogue(layers, metadata).select("layer", "n", "geom_type", "title")


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of layers read from files: their first geometry by position, and how many files hold them."""
    found = I.layers(spark, _layer_files(spark, sf_dir), lines=True)
    out = I.layer_catalogue(found, found.select("layer", F.lit("a layer").alias("title")).distinct())
    counted = F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda a, n: a + n)
    return out.select("layer", "n", "geom_type", (counted == F.col("n")).alias("all_files"))


def _layer_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The derived layers written as line features, a folder for each; features of every third key have no id of their own."""
    path = shared_path(spark, "layers-geojson")
    k = F.col("feature_id")
    props = [F.when(k % 3 != 0, F.concat(F.lit("U"), k)).alias("utility_id"), F.when(k % 5 != 0, F.col("utility_type")).alias("utility_type"), F.when(k % 7 == 0, "PLANNED").alias("status")]
    rows = derived(spark, sf_dir, "layers").withColumn("value", O.line_feature(F.col("line"), F.when(k % 6 != 0, F.concat(F.lit("F"), k)), props))
    names = ["building", "power", "road", "water"]
    for n in names:
        O.export_features(rows.where(F.col("layer") == n), f"{path}/{n}", "feature_id")
    return {n: f"{path}/{n}" for n in names}


def utilities_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.utilities(spark, _layer_files(spark, sf_dir)["water"], lines=True).select("utility_id", "utility_type", "status", "geom_type")


def layers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.layers(spark, _layer_files(spark, sf_dir), lines=True).select("layer", "feature_id", "geom_type", "minx", "miny", "maxx", "maxy")


def _layer_table(spark: SparkSession, sf_dir: str) -> str:
    path, b = shared_path(spark, "layer-table"), bbox(F.col("line"))
    O.write_layers(derived(spark, sf_dir, "layers").select("feature_id", "layer", *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")]), path)
    return path


def single_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.layer(spark, _layer_table(spark, sf_dir), "road").select("feature_id", "layer", "minx")


def layers_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inside_box(spark.read.parquet(_layer_table(spark, sf_dir)), (500.0, 100.0, 2500.0, 600.0)).select("feature_id", "layer")


def road_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows written as text: some short, some with blank cities, some with fields behind the ninth."""
    path, k = shared_path(spark, "roads-csv"), F.col("c_custkey")
    fields = [F.when(k % 8 == 0, " ").otherwise(F.concat(F.lit(" City "), k % 10)), F.concat(F.lit("Z"), k % 4), F.concat(F.lit('"Ward, '), k % 20, F.lit('"')), k.cast("string"), F.concat((k % 500).cast("string"), F.lit(".5 km")), F.concat((k % 90).cast("string"), F.lit(" km")), F.lit("n/a")]
    tail = F.when(k % 6 == 0, "7 km").when(k % 6 == 1, "7 km,8.25 km").otherwise("7 km,8.25 km,,")
    row = F.concat_ws(",", *fields, tail)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", row.alias("value"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("City,Zone,Ward,Ward No,Total,Tar,Concrete,Both,One").alias("value"))
    c.select(F.col("c_custkey").cast("long"), "value").unionByName(header).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(path)
    return I.road_inventory(spark, path)


def district_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = shared_path(spark, "districts-geojson"), F.col("c_custkey")
    props = [F.concat(F.lit("D"), k).alias("district_code"), F.when(k % 4 != 0, F.col("c_name")).alias("district_name"), (k * 1000).alias("total_population"), F.when(k % 3 != 0, k * 10).alias("sc_population"), (k % 100 / 8).alias("literacy_rate")]
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", O.line_feature(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), k, props).alias("value"))
    O.export_features(rows, path, "c_custkey")
    return I.districts(spark, path, lines=True).select("district_code", "district_name", "headquarters", "total_population", "sc_population", "st_population", "literacy_rate")


def filled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without ids get them from their position in the files."""
    path = shared_path(spark, "parcels-geojson")
    rows = derived(spark, sf_dir, "parcels").withColumn("value", O.geojson_feature(F.col("ring"), F.lit(None), [F.col("area")]))
    O.export_features(rows, path, "parcel_id")
    p, d = I.legacy_parcels(spark, path, lines=True), I.drone_features(spark, path, lines=True)
    corner = F.get("ring", F.lit(2))
    both = p.select("parcel_id", "full_survey", "epsg", corner["x"].alias("x3"), corner["y"].alias("y3"))
    return both.join(d.select("feature_id", corner["x"].alias("x3"), corner["y"].alias("y3")).hint("merge"), ["x3", "y3"])


def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, r = shared_path(spark, "audit"), derived(spark, sf_dir, "reviews").select("event_id", "ts", "action", "target")
    for k in range(2):
        O.append_audit(r.where(F.col("event_id") % 2 == k), path)
    return newest(spark.read.parquet(path), 100, "ts", "event_id").select("event_id", "ts", "action", "target")


def parcel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.map_rows(derived(spark, sf_dir, "parcels")).select("parcel_id", "vertices", rounded(F.col("cx"), 3).alias("cx"), rounded(F.col("cy"), 3).alias("cy"))


def parcel_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "parcels")
    k = F.col("parcel_id")
    named = {"legacy_area": F.col("area"), "recommended_area": F.when(k % 3 == 0, F.col("area") + 1), "status": F.when(k % 2 == 0, "Matched").otherwise("Review"), "geometry_source": F.lit("Legacy"), "confidence": (k % 101).cast("double"), "conflict_type": F.lit(None).cast("string")}
    return O.export_rows(p.select("parcel_id", "survey_no", "full_survey", "land_use", *[c.alias(n) for n, c in named.items()]), "Matched")


def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "parcels-geojson")
    O.export_geojson(derived(spark, sf_dir, "parcels"), path, ["parcel_id", "survey_no", "subdivision_no", "full_survey", "area", "land_use"])
    p = I.legacy_parcels(spark, path, lines=True)
    return p.select("parcel_id", "full_survey", "area", "land_use", F.get("ring", F.lit(2))["x"].alias("x3"), F.get("ring", F.lit(2))["y"].alias("y3"))


def drone_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "drone-geojson")
    O.export_geojson(derived(spark, sf_dir, "drone").withColumn("parcel_id", F.col("feature_id")), path, ["survey_candidate", "feature_type", "area"])
    return I.drone_features(spark, path, lines=True).select("feature_id", "survey_candidate", "feature_type", "area")


def gnss_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "gnss-csv")
    g = derived(spark, sf_dir, "gnss")
    bad = F.col("point_id") % 13 == 0
    O.write_csv(g.select("point_id", "survey_no", F.when(bad, "n/a").otherwise((F.col("y") / 64).cast("string")).alias("lat"), (F.col("x") / 64).alias("lng"), F.when(F.col("point_id") % 5 != 0, F.col("accuracy_m")).alias("accuracy_m")), path)
    return I.gnss_points(spark, path).groupBy("survey_no").agg(F.count("*").alias("n"), F.sum("latitude").alias("latitude"), F.sum("longitude").alias("longitude"), rounded(F.sum("accuracy_m"), 4).alias("accuracy"))


def revenue_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "revenue-csv")
    r = derived(spark, sf_dir, "revenue")
    O.write_csv(r.select("seq", "survey_no", "subdivision_no", "owner_ref", F.coalesce(F.col("area").cast("string"), F.lit("unknown")).alias("area"), F.when(F.col("seq") % 10 != 0, F.concat(F.lit(" "), "land_use")).alias("land_use"), "status"), path)
    return I.revenue_rows(spark, path).groupBy("survey_no", "subdivision_no", "land_use", "status").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "results")
    p = derived(spark, sf_dir, "parcels").select("parcel_id", "area")
    O.write_results(path, parcels=p, totals=p.agg(F.count("*").alias("n")))
    O.upsert_table(spark, f"{path}/parcels", f"{path}/parcels-2", p.where("parcel_id % 5 = 0").select("parcel_id", (F.col("area") + 1000).alias("area")), "parcel_id", "area")
    return spark.read.parquet(f"{path}/parcels-2")


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "stream")
    p = derived(spark, sf_dir, "parcels").withColumn("ring", F.when(F.col("parcel_id") % 7 != 0, F.col("ring"))).repartition(6, "parcel_id")
    O.export_geojson(p, f"{path}/in", ["full_survey", "land_use"])
    S.load_with_progress(S.feature_stream(spark, f"{path}/in", 2), f"{path}/table", f"{path}/progress", f"{path}/checkpoint").awaitTermination()
    table, progress = spark.read.parquet(f"{path}/table"), spark.read.parquet(f"{path}/progress")
    return progress.agg(F.sum("rows").alias("rows"), F.sum("valid").alias("valid")).crossJoin(table.agg(F.countDistinct("id").alias("ids")))


def stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "stream")
    O.write_csv(derived(spark, sf_dir, "revenue").select("seq", "survey_no", "status").repartition(4, "seq"), f"{path}/in")
    s = S.csv_stream(spark, f"{path}/in", "seq long, survey_no string, status string", 2)
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("status").agg(F.count("*").alias("n"))


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "stream")
    new, old = derived(spark, sf_dir, "snapshot_new"), derived(spark, sf_dir, "snapshot_old")
    new.repartition(4, "feature_id").write.parquet(f"{path}/in")
    s = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    S.sync_stream(s, old, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("feature_id", "parcel_id", "change")


_DISPUTED = "d AS (SELECT o_orderkey AS parcel_id, 'H' || o_custkey AS owner_ref, CASE (o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'Residential' WHEN 1 THEN 'Agricultural' WHEN 2 THEN 'Commercial' ELSE 'Industrial' END AS land_use FROM orders WHERE o_orderstatus = 'P')"
_NEW = """c AS (SELECT feature_id, n.parcel_id, CASE WHEN o.parcel_id IS NULL THEN 'ADDED' WHEN o.geom_key <> n.geom_key THEN 'GEOMETRY_CHANGED' WHEN o.area <> n.area THEN 'AREA_CHANGED' WHEN o.owner <> n.owner THEN 'ATTRIBUTE_CHANGED' END AS change
  FROM snapshot_new n LEFT JOIN snapshot_old o USING (feature_id))"""
_KINDS = {"parcels": "VECTOR", "drone": "VECTOR", "gnss": "GNSS", "revenue": "REGISTER", "layers": "VECTOR"}

QUERIES = {
    "parcel_search": (parcel_search, check("", "SELECT parcel_id, full_survey, area FROM parcels WHERE land_use = 'Commercial' AND (contains(full_survey, '3/2') OR contains(survey_no, '3/2'))", "parcels")),
    "parcel_like": (parcel_like, check("", "SELECT parcel_id, full_survey FROM parcels WHERE full_survey LIKE '%1_3/%2%' OR survey_no LIKE '%1_3/%2%'", "parcels")),
    "parcel_lookup": (parcel_lookup, check("n AS (SELECT parcel_id, parcel_id::VARCHAR AS key FROM parcels UNION ALL SELECT parcel_id, full_survey FROM parcels UNION ALL SELECT parcel_id, survey_no FROM parcels)", "SELECT k.key, min(parcel_id) AS parcel_id FROM (SELECT DISTINCT (user_id % 400)::VARCHAR AS key FROM events) k LEFT JOIN n ON n.key = k.key GROUP BY k.key", "parcels")),
    "parcel_list": (parcel_list, check("", "SELECT parcel_id, survey_no, subdivision_no, full_survey, area, land_use FROM parcels", "parcels")),
    "conflict_search": (conflict_search, f"WITH {_DISPUTED} SELECT * FROM d WHERE contains(lower(land_use), 'agri') OR contains(lower(owner_ref), 'agri')"),
    "reviewed_conflicts": (reviewed_conflicts, f"WITH {_DISPUTED}, e AS (SELECT user_id * 3 AS parcel_id, arg_max(event_id % 3, event_id) AS a FROM events GROUP BY user_id) SELECT parcel_id, CASE a WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Dismissed' ELSE 'Pending' END AS state, CASE WHEN a = 0 THEN 'Matched' ELSE 'Conflict' END AS parcel_status FROM d LEFT JOIN e USING (parcel_id)"),
    "audit_trail": (audit_trail, "SELECT event_id, ts, event_type AS action, 'P' || user_id AS target FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "version_history": (version_history, "SELECT o_orderkey AS id, row_number() OVER w AS version, lead(o_orderdate) OVER w IS NULL AS active FROM orders WHERE o_custkey % 100 = 7 WINDOW w AS (ORDER BY o_orderdate, o_orderkey)"),
    "dataset_catalogue": (dataset_catalogue, check("", " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n, '{k}' AS kind FROM {n}" for n, k in _KINDS.items()), *_KINDS)),
    "line_shares": (line_shares, check("", f"SELECT layer, metres, {rnd('metres / sum(metres) OVER () * 100.0', 2)} AS percent FROM (SELECT layer, sum(abs(x2 - x1)) AS metres FROM layers GROUP BY layer)", "layers")),
    "layer_files": (layer_files, check("", "SELECT layer, count(*) AS n, 'LineString' AS geom_type, true AS all_files FROM layers GROUP BY layer", "layers")),
    "layer_catalogue": (layer_catalogue, check("", "SELECT layer, count(*) AS n, 'LineString' AS geom_type, 'Layer ' || upper(layer) AS title FROM layers GROUP BY layer", "layers")),
    "layers_in_box": (layers_in_box, check("", "SELECT feature_id, layer FROM layers WHERE least(x1, x2) <= 2500 AND greatest(x1, x2) >= 500 AND least(y1, y2) <= 600 AND greatest(y1, y2) >= 100", "layers")),
    "single_layer": (single_layer, check("", "SELECT feature_id, layer, least(x1, x2) AS minx FROM layers WHERE layer = 'road'", "layers")),
    "utilities_round_trip": (utilities_round_trip, check("n AS (SELECT *, row_number() OVER (ORDER BY feature_id) AS n FROM layers WHERE layer = 'water')", "SELECT CASE WHEN feature_id % 3 <> 0 THEN 'U' || feature_id WHEN feature_id % 6 <> 0 THEN 'F' || feature_id ELSE 'UTIL_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END END AS utility_id, CASE WHEN feature_id % 5 <> 0 THEN utility_type ELSE 'UNKNOWN' END AS utility_type, CASE WHEN feature_id % 7 = 0 THEN 'PLANNED' ELSE 'ACTIVE' END AS status, 'LineString' AS geom_type FROM n", "layers")),
    "layers_round_trip": (layers_round_trip, check("n AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY feature_id) - 1 AS n FROM layers)", "SELECT layer, CASE WHEN feature_id % 6 <> 0 THEN 'F' || feature_id ELSE layer || '_' || n END AS feature_id, 'LineString' AS geom_type, least(x1, x2) AS minx, least(y1, y2) AS miny, greatest(x1, x2) AS maxx, greatest(y1, y2) AS maxy FROM n", "layers")),
    "road_inventory": (road_inventory, "SELECT 'City ' || (c_custkey % 10) AS city_name, 'Z' || (c_custkey % 4) AS zone_name, 'Ward, ' || (c_custkey % 20) AS ward_name, c_custkey::VARCHAR AS ward_no, (c_custkey % 500) || '.5 km' AS total_length_km, (c_custkey % 90) || ' km' AS tar_roads_km, 'n/a' AS concrete_roads_km, '7 km' AS footpath_both_sides_km, '8.25 km' AS footpath_one_side_km, c_custkey % 500 + 0.5::DOUBLE AS total_length_number, (c_custkey % 90)::DOUBLE AS tar_roads_number, NULL::DOUBLE AS concrete_roads_number, 7.0::DOUBLE AS footpath_both_sides_number, 8.25::DOUBLE AS footpath_one_side_number FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey % 6 <> 0"),
    "district_rows": (district_rows, "SELECT 'D' || c_custkey AS district_code, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END AS district_name, '' AS headquarters, (c_custkey * 1000)::DOUBLE AS total_population, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 ELSE 0 END::DOUBLE AS sc_population, 0.0::DOUBLE AS st_population, c_custkey % 100 / 8 AS literacy_rate FROM customer"),
    "filled_ids": (filled_ids, check("n AS (SELECT *, row_number() OVER (ORDER BY parcel_id) AS n FROM parcels), t AS (SELECT *, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id FROM n)", "SELECT 'P' || id AS parcel_id, (n + 100) || '/1' AS full_survey, 4326 AS epsg, x3, y3, 'FE_' || id AS feature_id FROM t", "parcels")),
    "audit_append": (audit_append, "SELECT event_id, ts, event_type AS action, 'P' || user_id AS target FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "parcel_map": (parcel_map, check(f"pe AS MATERIALIZED ({edge_rows('parcels', 'parcel_id')}), {centroid_cte('pc', 'pe')}", f"SELECT id AS parcel_id, 5 AS vertices, {rnd('gx', 3)} AS cx, {rnd('gy', 3)} AS cy FROM pc", "parcels")),
    "parcel_export": (parcel_export, check("", "SELECT parcel_id, survey_no, full_survey, land_use, 'Matched' AS status, area AS legacy_area, CASE WHEN parcel_id % 3 = 0 THEN area + 1 ELSE area END AS recommended_area, 'Legacy' AS geometry_source, (parcel_id % 101)::DOUBLE AS confidence, NULL::VARCHAR AS conflict_type FROM parcels WHERE parcel_id % 2 = 0", "parcels")),
    "geojson_round_trip": (geojson_round_trip, check("", "SELECT parcel_id::VARCHAR AS parcel_id, full_survey, area, land_use, x3, y3 FROM parcels", "parcels")),
    "drone_round_trip": (drone_round_trip, check("", "SELECT feature_id, survey_candidate, feature_type, area FROM drone", "drone")),
    "gnss_csv_round_trip": (gnss_csv_round_trip, check("", f"SELECT survey_no, count(*) AS n, sum(y / 64) AS latitude, sum(x / 64) AS longitude, {rnd('sum(CASE WHEN point_id % 5 <> 0 THEN accuracy_m ELSE 0.03 END::DOUBLE)', 4)} AS accuracy FROM gnss WHERE point_id % 13 <> 0 GROUP BY survey_no", "gnss")),
    "revenue_csv_round_trip": (revenue_csv_round_trip, check("", "SELECT survey_no, subdivision_no, CASE WHEN seq % 10 <> 0 THEN land_use ELSE 'Residential' END AS land_use, status, count(*) AS n, sum(coalesce(area, 1000)) AS area FROM revenue GROUP BY ALL", "revenue")),
    "stored_results": (stored_results, check("", "SELECT parcel_id, CASE WHEN parcel_id % 5 = 0 THEN area + 1000 ELSE area END AS area FROM parcels", "parcels")),
    "stream_load": (stream_load, check("", "SELECT count(*) AS rows, count(*) AS valid, count(*) AS ids FROM parcels WHERE parcel_id % 7 <> 0", "parcels")),
    "stream_csv": (stream_csv, check("", "SELECT status, count(*) AS n FROM revenue GROUP BY status", "revenue")),
    "stream_sync": (stream_sync, check(_NEW, "SELECT * FROM c WHERE change IS NOT NULL", "snapshot_old", "snapshot_new")),
}
