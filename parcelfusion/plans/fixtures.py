"""Parcel tables derived from the star-schema tables.

The tables hold no geometry, so parcels, survey points, registers, layers and pixels are computed from
their integer keys, by SQL text that Spark and the checking engine both run. Coordinates are metres in
multiples of 1/8, so they are exact in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point
from ..scratch import dealt

#: Parcels in a row of the fabric, and the width of its cells.
ROW, CELL = 100, 40


def _div(a: str, b: int) -> str:
    """Whole-number division of a non-negative expression."""
    return f"CAST((({a}) - ({a}) % {b}) / {b} AS BIGINT)"


def _node(col: str, row: str) -> tuple[str, str]:
    """Coordinates of the corner that neighbouring parcels share."""
    x = f"(({col}) * {CELL}.0 + CAST((({col}) * 7 + ({row}) * 13) % 9 - 4 AS DOUBLE) / 2)"
    y = f"(({row}) * {CELL}.0 + CAST((({col}) * 5 + ({row}) * 11) % 9 - 4 AS DOUBLE) / 4)"
    return f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"


def _corners() -> str:
    out = []
    for i, (dc, dr) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)], 1):
        x, y = _node(f"c + {dc}", f"r + {dr}")
        out += [f"{x} AS x{i}", f"{y} AS y{i}"]
    return ", ".join(out)


SHOELACE = "((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2"
USES = "CASE WHEN {k} % 4 = 0 THEN 'Residential' WHEN {k} % 4 = 1 THEN 'Agricultural' WHEN {k} % 4 = 2 THEN 'Commercial' ELSE 'Industrial' END"
SHIFT = ", ".join(f"x{i} + dx AS x{i}, y{i} + dy AS y{i}" for i in range(1, 5))

#: name -> SQL over {table} placeholders and the derived tables before it.
TABLES: dict[str, str] = {
    "parcels": f"""
SELECT *, floor({SHOELACE} * 10 + 0.5) / 10 AS area FROM (
  SELECT k AS parcel_id, CAST(100 + {_div("k", 5)} AS VARCHAR(20)) AS survey_no, CAST(1 + k % 5 AS VARCHAR(20)) AS subdivision_no,
         CAST(100 + {_div("k", 5)} AS VARCHAR(20)) || '/' || CAST(1 + k % 5 AS VARCHAR(20)) AS full_survey, {USES.format(k="k")} AS land_use, {_corners()}
  FROM (SELECT p_partkey AS k, p_partkey % {ROW} AS c, {_div("p_partkey", ROW)} AS r FROM {{part}}) p0) p1""",
    "drone": f"""
SELECT feature_id, parcel_key, survey_candidate, feature_type, {", ".join(f"x{i}, y{i}" for i in range(1, 5))}, floor({SHOELACE} * 10 + 0.5) / 10 AS area FROM (
  SELECT 'FE_' || CAST(parcel_id AS VARCHAR(20)) AS feature_id, parcel_id AS parcel_key,
         CASE WHEN parcel_id % 13 = 1 THEN '9' || full_survey WHEN parcel_id % 13 = 2 THEN survey_no || '/9' ELSE '0' || full_survey END AS survey_candidate,
         CASE WHEN parcel_id % 29 = 7 THEN 'Plot Division A' WHEN parcel_id % 31 = 9 THEN 'Consolidated Compound' ELSE 'Parcel Boundary' END AS feature_type, {SHIFT}
  FROM (
    SELECT parcel_id, survey_no, full_survey, x1, y1, y2, y4, x4,
           CASE WHEN parcel_id % 19 = 4 THEN x2 + 3 ELSE x2 END AS x2, CASE WHEN parcel_id % 19 = 4 THEN x3 + 3 ELSE x3 END AS x3, y3,
           CASE WHEN parcel_id % 23 = 5 THEN 14.0 ELSE CAST(parcel_id % 5 - 2 AS DOUBLE) / 4 END AS dx, CAST(parcel_id % 7 - 3 AS DOUBLE) / 4 AS dy
    FROM parcels WHERE parcel_id % 17 <> 3) d0) d1""",
    "gnss": f"""
SELECT point_id, parcel_key, survey_no, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, accuracy_m FROM (
  SELECT l_orderkey * 8 + l_linenumber AS point_id, l_partkey AS parcel_key,
         CASE WHEN l_partkey % 6 = 0 THEN CAST(100 + {_div("l_partkey", 5)} AS VARCHAR(20)) ELSE CAST(100 + {_div("l_partkey", 5)} AS VARCHAR(20)) || '/' || CAST(1 + l_partkey % 5 AS VARCHAR(20)) END AS survey_no,
         l_orderkey * 8 + l_linenumber AS seq,
         l_partkey % {ROW} * {CELL}.0 + 4 + (l_orderkey % 32) + CASE WHEN l_orderkey % 41 = 0 THEN 60 ELSE 0 END AS x,
         {_div("l_partkey", ROW)} * {CELL}.0 + 4 + (l_orderkey % 29) AS y, CAST(l_linenumber AS DOUBLE) / 64 AS accuracy_m
  FROM {{lineitem}}) g0""",
    "revenue": f"""
SELECT o_orderkey AS seq, CAST(100 + {_div("o_custkey", 5)} AS VARCHAR(20)) AS survey_no, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(1 + o_custkey % 5 AS VARCHAR(20)) END AS subdivision_no,
       'H' || CAST(o_custkey AS VARCHAR(20)) AS owner_ref, CAST(CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 1600.0 + (o_orderkey % 25 - 12) * 20.0 END AS DOUBLE) AS area,
       {USES.format(k="(o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END)")} AS land_use, CASE WHEN o_orderstatus = 'P' THEN 'Disputed' ELSE 'Active' END AS status
FROM {{orders}}""",
    "buildings": f"""
SELECT building_id, x1, y1, x1 + w AS x2, y1 AS y2, x1 + w AS x3, y1 + h AS y3, x1 AS x4, y1 + h AS y4 FROM (
  SELECT c_custkey AS building_id, CAST((c_custkey * 7 % 1000) * {CELL} / 10.0 + c_custkey % 11 AS DOUBLE) AS x1, CAST({_div("c_custkey", 10)} * 5.0 + c_custkey % 13 AS DOUBLE) AS y1,
         CAST(6 + c_custkey % 9 AS DOUBLE) AS w, CAST(5 + c_custkey % 8 AS DOUBLE) AS h FROM {{customer}}) b0""",
    # Some too small, too large, too long, too narrow, and some darts with much outline for their area.
    "detections": """
SELECT building_id, x1, y1, x1 + w AS x2, y1 AS y2, CASE WHEN kind = 5 THEN x1 + 1 ELSE x1 + w END AS x3, CASE WHEN kind = 5 THEN y1 + 1 ELSE y1 + h END AS y3, x1 AS x4, y1 + h AS y4 FROM (
  SELECT building_id, x1, y1, kind, CAST(CASE kind WHEN 1 THEN 2 WHEN 2 THEN 75 WHEN 3 THEN 50 WHEN 4 THEN 60 WHEN 5 THEN 40 ELSE x2 - x1 END AS DOUBLE) AS w, CAST(CASE kind WHEN 1 THEN 3 WHEN 2 THEN 20 WHEN 3 THEN 6 WHEN 4 THEN 40 WHEN 5 THEN 40 ELSE y4 - y1 END AS DOUBLE) AS h
  FROM (SELECT building_id, x1, y1, x2, y4, building_id % 9 AS kind FROM buildings) t0) t1""",
    "reference_buildings": """
SELECT building_id AS ref_id, x1 + d AS x1, y1 AS y1, x2 + d AS x2, y2 AS y2, x3 + d AS x3, y3 AS y3, x4 + d AS x4, y4 AS y4 FROM (
  SELECT *, CAST(building_id % 6 AS DOUBLE) AS d FROM buildings WHERE building_id % 4 <> 1) r0""",
    "layers": f"""
SELECT s_suppkey AS feature_id, CASE WHEN s_suppkey % 4 = 0 THEN 'building' WHEN s_suppkey % 4 = 1 THEN 'road' WHEN s_suppkey % 4 = 2 THEN 'water' ELSE 'power' END AS layer,
       CASE WHEN s_suppkey % 3 = 0 THEN 'WATER' WHEN s_suppkey % 3 = 1 THEN 'POWER' ELSE 'SEWER' END AS utility_type,
       CAST(s_suppkey * 37 % {ROW * CELL} AS DOUBLE) AS x1, CAST(s_suppkey * 11 % 800 AS DOUBLE) + 0.5 AS y1,
       CAST(s_suppkey * 37 % {ROW * CELL} + 30 + s_suppkey % 50 AS DOUBLE) AS x2, CAST(s_suppkey * 11 % 800 + s_suppkey % 17 AS DOUBLE) + 0.5 AS y2
FROM {{supplier}}""",
    # Five usual types, one other and none; lines and points, and some without coordinates.
    "utilities": f"""
SELECT feature_id, CASE WHEN feature_id % 7 = 0 THEN 'Electricity' WHEN feature_id % 7 = 1 THEN 'Water' WHEN feature_id % 7 = 2 THEN 'Sewer' WHEN feature_id % 7 = 3 THEN 'Gas' WHEN feature_id % 7 = 4 THEN 'Telecom' WHEN feature_id % 7 = 5 THEN 'Steam' END AS utility_type,
       CASE WHEN feature_id % 5 = 0 THEN 'point' ELSE 'line' END AS kind, x1, y1, CASE WHEN feature_id % 5 = 0 THEN x1 ELSE x1 + 30 + feature_id % 50 END AS x2, CASE WHEN feature_id % 5 = 0 THEN y1 ELSE y1 + feature_id % 17 END AS y2
FROM (SELECT s_suppkey AS feature_id, CAST(CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE s_suppkey * 53 % {ROW * CELL} END AS DOUBLE) AS x1, CAST(s_suppkey * 17 % 900 AS DOUBLE) + 0.5 AS y1 FROM {{supplier}}) u0""",
    # Squares with a square hole in them: some smaller than a parcel, some over many, some whose hole holds parcels.
    "lakes": f"""
SELECT feature_id, CASE WHEN feature_id % 4 = 0 THEN 'building' WHEN feature_id % 4 = 1 THEN 'water' WHEN feature_id % 4 = 2 THEN 'power' ELSE 'road' END AS layer, CASE WHEN feature_id % 13 = 5 THEN NULL ELSE x END AS x, y, w
FROM (SELECT s_suppkey AS feature_id, CAST(s_suppkey * 131 % {ROW * CELL} AS DOUBLE) + 0.5 AS x, CAST(s_suppkey * 71 % 800 AS DOUBLE) + 0.25 AS y, CAST(12 + s_suppkey % 6 * 64 AS DOUBLE) AS w FROM {{supplier}}) k0""",
    "snapshot_old": """
SELECT o_orderkey AS feature_id, CAST(o_custkey AS BIGINT) AS parcel_id, CAST(floor(o_totalprice) AS DOUBLE) AS area, o_orderpriority AS owner, o_orderkey % 1000 AS geom_key FROM {orders} WHERE o_orderkey % 11 <> 0""",
    "snapshot_new": """
SELECT o_orderkey AS feature_id, CAST(o_custkey AS BIGINT) AS parcel_id, CAST(CASE WHEN o_orderkey % 7 = 2 THEN floor(o_totalprice) + 28 ELSE floor(o_totalprice) END AS DOUBLE) AS area,
       CASE WHEN o_orderkey % 5 = 3 THEN 'NEW ' || o_orderpriority ELSE o_orderpriority END AS owner, CASE WHEN o_orderkey % 19 = 6 THEN o_orderkey % 1000 + 1 ELSE o_orderkey % 1000 END AS geom_key
FROM {orders} WHERE o_orderkey % 13 <> 0""",
    "pixels_1": f"""
SELECT {_div("l_partkey", 64)} AS px_row, l_partkey % 64 AS px_col, CAST(90 + max(l_quantity) % 8 AS DOUBLE) AS b1, CAST(80 + min(l_quantity) % 8 AS DOUBLE) AS b2, CAST(70 + count(*) % 8 AS DOUBLE) AS b3
FROM {{lineitem}} WHERE l_linenumber % 2 = 1 GROUP BY l_partkey""",
    # Blocks of 8 x 8 pixels that are brighter, darker or a little brighter, with holes in them and spots beside them.
    "pixels_2": f"""
SELECT px_row, px_col, b1 + d AS b1, b2 + d AS b2, b3 + d AS b3 FROM (
  SELECT px_row, px_col, b1, b2, b3, CAST(CASE WHEN (px_row * 64 + px_col) % 37 = 5 THEN 90 * in_gap WHEN in_gap = 1 THEN 0 WHEN kind = 0 THEN 70 WHEN kind = 1 THEN -60 ELSE 30 END AS DOUBLE) AS d FROM (
    SELECT px_row, px_col, b1, b2, b3, CASE WHEN px_row % 16 < 8 AND px_col % 16 < 8 THEN 0 ELSE 1 END AS in_gap, (CAST((px_row - px_row % 16) / 16 AS BIGINT) + CAST((px_col - px_col % 16) / 16 AS BIGINT)) % 3 AS kind FROM (
      SELECT {_div("l_partkey", 64)} AS px_row, l_partkey % 64 AS px_col, CAST(90 + max(l_quantity) % 8 AS DOUBLE) AS b1, CAST(80 + min(l_quantity) % 8 AS DOUBLE) AS b2, CAST(70 + count(*) % 8 AS DOUBLE) AS b3
      FROM {{lineitem}} WHERE l_linenumber % 2 = 0 GROUP BY l_partkey) q0) q1) q2""",
    "dem": f"""
SELECT l_suppkey % 5 AS raster_id, l_orderkey * 8 + l_linenumber AS px, CAST(l_partkey % {ROW} * {CELL} + l_orderkey % {CELL} AS DOUBLE) AS x, CAST({_div("l_partkey", ROW)} * {CELL} + l_suppkey % {CELL} AS DOUBLE) AS y,
       CASE WHEN l_quantity = 50 THEN -9999.0 ELSE CAST(400 + l_quantity + l_linenumber AS DOUBLE) END AS elev FROM {{lineitem}}""",
    "control_points": """
SELECT s_nationkey AS sheet_id, s_suppkey AS point_id, CAST(s_suppkey * 13 % 97 AS DOUBLE) AS img_x, CAST(s_suppkey * 29 % 89 AS DOUBLE) AS img_y,
       CAST(2.0 * (s_suppkey * 13 % 97) + 0.5 * (s_suppkey * 29 % 89) + 700.0 + CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey % 7 ELSE 0 END AS DOUBLE) AS map_x,
       CAST(-0.5 * (s_suppkey * 13 % 97) + 1.5 * (s_suppkey * 29 % 89) + 1200.0 AS DOUBLE) AS map_y FROM {supplier}""",
    "reviews": """
SELECT event_id, ts, user_id, event_type AS action, 'P' || CAST(user_id AS VARCHAR(20)) AS target, value FROM {events}""",
    "register_text": """
SELECT o_orderkey AS doc_id, 'Survey No: ' || CAST(o_custkey AS VARCHAR(20)) || '/' || CAST(o_orderkey % 4 AS VARCHAR(20)) || ', Owner: Holder ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Anand' ELSE 'Meera' END
       || ', Area: ' || CAST(1000 + o_orderkey % 900 AS VARCHAR(20)) || '.5 sqm, ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Land Use: Residential, ' ELSE '' END
       || CASE WHEN o_orderkey % 5 = 0 THEN 'Village: Kovil Patti, Taluk: North, District: East, ' ELSE '' END || 'Patta No: ' || CAST(o_orderkey AS VARCHAR(20)) || ', Status: ' || CASE WHEN o_orderstatus = 'P' THEN 'Disputed' ELSE 'Active' END AS text
FROM {orders}""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_for(*names: str) -> str:
    """``WITH`` clause text that defines the derived tables over plain table names."""
    plain = {b: b for b in BASE}
    needed, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in TABLES if f"FROM {m}" in TABLES[n]]
    return ",\n".join(f"{n} AS ({sql.format(**plain)})" for n, sql in TABLES.items() if n in needed)


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table without its geometry."""
    given = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if f"{{{b}}}" in TABLES[name]}
    given |= {m: _rows(spark, sf_dir, m) for m in TABLES if f"FROM {m}" in TABLES[name]}
    text = TABLES[name]
    for m in given:
        text = text.replace(f"FROM {m}", f"FROM {{{m}}}")
    return spark.sql(text, **given)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; quadrilaterals also get their ``ring``, lines their ``line``.

    These are dealt out first: a million keys are a file of a few MB, so a task or two, but each costs the geometry that follows.
    """
    df = _rows(spark, sf_dir, name)
    if "x4" in df.columns:
        return dealt(df, df.columns[0]).withColumn("ring", F.array(*[point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(1, 5)]))
    if "x2" in df.columns:
        return dealt(df, df.columns[0]).withColumn("line", F.array(*[point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(1, 3)]))
    return df
