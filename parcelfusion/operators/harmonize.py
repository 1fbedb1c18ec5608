"""Schema harmonization of datasets and records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geometry import utm_epsg, utm_zone
from ..functions.numbers import rounded


def header_mapping(headers: DataFrame) -> DataFrame:
    """header, canonical (null if unmapped), confidence, method for each distinct header.

    Exact names come before synonyms and those before similar ones. The synonyms are a fixed short list,
    so each header meets them in its own row; only headers without a match are compared by similarity.
    """
    entries = [{"canonical": c, "synonym": s, "place": i} for i, (c, s) in enumerate((c, s) for c, ss in X.SYNONYMS.items() for s in ss)]
    keys = F.from_json(F.lit(json.dumps(entries)), "array<struct<canonical:string,synonym:string,place:int>>")
    rows = headers.select("header").distinct().withColumn("k", X.clean_key(F.col("header")))
    rows = rows.select("header", "k", F.explode(keys).alias("s")).withColumn("syn", X.clean_key(F.col("s.synonym")))
    exact, synonym = F.col("k") == X.clean_key(F.col("s.canonical")), F.col("k") == F.col("syn")
    ratio = F.when(exact | synonym, 1.0).otherwise(X.similarity_ratio(F.col("k"), F.col("syn")))
    stage = F.when(exact, 3).when(synonym, 2).when(ratio >= X.FUZZY_LEAST, 1).otherwise(0)
    best = rows.withColumns({"ratio": ratio}).groupBy("header").agg(F.max(F.struct(stage.alias("stage"), F.col("ratio"), (-F.col("s.place")).alias("minus"), F.col("s.canonical").alias("canonical"))).alias("b"))
    of = lambda a, b, c, d: F.when(F.col("b.stage") == 3, a).when(F.col("b.stage") == 2, b).when(F.col("b.stage") == 1, c).otherwise(d)
    return best.select(
        "header", F.when(F.col("b.stage") > 0, F.col("b.canonical")).alias("canonical"), of(F.lit(100.0), F.lit(96.0), rounded(F.col("b.ratio") * 100.0, 1), F.lit(0.0)).alias("confidence"),
        of(F.lit("Exact Match"), F.lit("Synonym Dictionary"), F.lit("Fuzzy Match"), F.lit("Unmapped")).alias("method"),
    )


def canonical_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Adds each canonical column that is missing from the first of its headers (in column order), and full_survey."""
    out = df
    for header in df.columns:
        name = mapping.get(header)
        if name and name not in out.columns:
            out = out.withColumn(name, F.col(f"`{header}`"))
    if "survey_no" in out.columns:
        sub = F.col("subdivision_no").cast("string") if "subdivision_no" in out.columns else F.lit("")
        out = out.withColumn("full_survey", X.full_survey(F.col("survey_no").cast("string"), sub))
    return out


def harmonized_record(props: Column) -> Column:
    """Canonical attributes, provenance, confidence and the unmapped rest of a property map."""
    A = X.ALIASES
    survey = F.trim(X.first_alias(props, A["survey_number"]))
    numeric = lambda v: v.try_cast("double").isNotNull()
    filled = lambda v: F.coalesce(v != "", F.lit(False))
    area = F.coalesce(*[F.try_element_at(props, F.lit(a)).try_cast("double") for a in A["area_m2"]], F.lit(1000.0))
    nonblank = lambda key: F.coalesce(*[F.when(filled(F.try_element_at(props, F.lit(a))), F.try_element_at(props, F.lit(a))) for a in A[key]])
    names = {
        "survey_number": X.first_alias_name(props, A["survey_number"]), "subdivision_number": X.first_alias_name(props, A["subdivision_number"]),
        "area_m2": X.first_alias_name(props, A["area_m2"], numeric), "land_use": X.first_alias_name(props, A["land_use"], filled),
    }
    owner_name = X.first_alias_name(props, A["owner_ref"], filled)
    used = F.filter(F.array(*names.values(), owner_name), lambda x: x.isNotNull())
    steps = F.filter(F.array(*[F.when(v.isNotNull(), F.concat(v, F.lit(" -> "), F.lit(k))) for k, v in names.items()]), lambda x: x.isNotNull())
    blank = F.coalesce(survey, F.lit("")) == ""
    subdivision = F.coalesce(F.trim(X.first_alias(props, A["subdivision_number"])), F.lit("1"))
    number = F.when(blank, "100").otherwise(survey)
    return F.struct(
        number.alias("survey_number"), subdivision.alias("subdivision_number"), F.coalesce(F.try_element_at(props, F.lit("full_survey")), F.concat_ws("/", number, subdivision)).alias("full_survey"), area.alias("area_m2"),
        X.standard_land_use(F.coalesce(nonblank("land_use"), F.lit("Residential"))).alias("land_use"), F.trim(nonblank("owner_ref")).alias("owner_ref"),
        F.trim(nonblank("village")).alias("village"), F.trim(nonblank("ward")).alias("ward"),
        F.greatest(F.lit(40.0), F.when(blank, 80.0).otherwise(100.0)).alias("attribute_confidence"), steps.alias("provenance"), F.map_filter(props, lambda k, v: ~F.array_contains(used, k)).alias("extension"),
    )


def corrected_fields(extracted: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id, field, value, verified: extracted values, replaced where a reviewer has corrected them."""
    both = extracted.join(corrections.withColumnRenamed("value", "corrected").hint("merge"), ["doc_id", "field"], "left")
    return both.select("doc_id", "field", F.coalesce("corrected", "value").alias("value"), F.col("corrected").isNotNull().alias("verified"))


def crs_check(points: DataFrame) -> DataFrame:
    """dataset, zones, epsg, warnings: UTM zones of a dataset's positions (dataset, lon, lat), the lowest recommended."""
    lon, lat = F.col("lon"), F.col("lat")
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    found = points.groupBy("dataset").agg(
        F.array_sort(F.collect_set(F.when(ok, utm_zone(lon)))).alias("zones"), F.min(F.when(ok, utm_epsg(lon, lat))).alias("epsg"), F.sum(F.when(ok, 0).otherwise(1)).alias("outside")
    )
    warns = F.concat_ws("; ", F.when(F.size("zones") > 1, F.lit("spans several zones")), F.when(F.col("outside") > 0, F.lit("positions out of range")))
    return found.select("dataset", F.array_join(F.col("zones").cast("array<string>"), ",").alias("zones"), "epsg", "outside", warns.alias("warnings"))
