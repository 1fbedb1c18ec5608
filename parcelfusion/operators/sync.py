"""Snapshots: fingerprints, change classes, versions, upserts and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feature_key(columns: list[str], names: tuple[str, ...] = ("parcel_id", "survey_no", "id")) -> Column:
    """The first of the usual id columns that has a value and isn't blank."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in columns])


def keyed(snapshot: DataFrame) -> DataFrame:
    """A snapshot with its feature_id, chosen where it has none."""
    return snapshot if "feature_id" in snapshot.columns else snapshot.withColumn("feature_id", feature_key(snapshot.columns))


def properties(columns: list[str]) -> Column:
    """All properties of a row as a map of text: ``props``, a map of its own if there is one, and every other column; nulls are left out."""
    own = F.map_from_arrays(F.array(*[F.lit(c) for c in columns if c != "props"]).cast("array<string>"), F.array(*[F.col(f"`{c}`").cast("string") for c in columns if c != "props"]).cast("array<string>"))
    every = own
    if "props" in columns:
        named = F.array(*[F.lit(c) for c in columns if c != "props"]).cast("array<string>")
        every = F.map_concat(F.map_filter("props", lambda k, _: ~F.array_contains(named, k)), own)
    return F.map_filter(every, lambda _, v: v.isNotNull())


def fingerprint(geometry: Column, props: Column) -> Column:
    """SHA-256 of the geometry and all properties by name order; equal records have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(geometry.alias("geometry"), F.array_sort(F.map_entries(props)).alias("properties")), {"ignoreNullFields": "false"}), 256)


def records(snapshot: DataFrame, geometry: str = "geom_key", order: str | None = None) -> DataFrame:
    """feature_id, key, parcel_id, geometry, props, print: one row a feature, the last by ``order`` where an id is repeated (ties, or no order: by fingerprint).

    A row without an id is known by its content alone: equal ones are one feature, and it can only be added or removed.
    """
    df = keyed(snapshot)
    props = properties([c for c in df.columns if c not in ("feature_id", geometry, order)])
    at = F.col(geometry).cast("string") if geometry in df.columns else F.lit(None).cast("string")
    df = df.select("feature_id", (F.col(order) if order else F.lit(0)).alias("seq"), at.alias("geometry"), props.alias("props")).withColumn("print", fingerprint(F.col("geometry"), F.col("props")))
    key = F.when(F.col("feature_id").isNotNull(), F.concat(F.lit("i"), F.col("feature_id").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("print")))
    # Maps have no order, so the last row is picked by its fingerprint and its entries.
    row = F.struct("seq", "print", "feature_id", "geometry", F.array_sort(F.map_entries("props")).alias("entries"))
    last = df.groupBy(key.alias("key")).agg(F.max(row).alias("last")).select("key", "last.*").withColumn("props", F.map_from_entries("entries"))
    return last.select("key", "feature_id", F.try_element_at("props", F.lit("parcel_id")).alias("parcel_id"), "geometry", "props", "print")


def changes(old: DataFrame, new: DataFrame, geometry: str = "geom_key", area: str = "area", order: str | None = None) -> DataFrame:
    """feature_id, parcel_id, change, changed, previous_hash, current_hash of features that differ in their geometry or any property.

    Both sides: feature_id or what it is chosen from, a ``geometry`` column, and any others, in which ``props`` may be a map of more. ``change``: ADDED, REMOVED, else geometry before
    area before attributes; ``changed``: the names of the properties that differ. A property that is null counts as absent. For ids that are repeated or null see ``records``. One full outer join of the two.
    """
    kind = dict(keyed(new).dtypes)["feature_id"]
    parcel = dict(new.dtypes).get("parcel_id", "string")
    side = lambda df, p: records(df, geometry, order).select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("feature_id", "parcel_id", "geometry", "props", "print")])
    both = side(old, "o").join(side(new, "n").hint("merge"), "key", "full_outer").where(~F.equal_null("o_print", "n_print"))
    value = lambda p, k: F.try_element_at(f"{p}_props", k)
    names = F.array_union(F.coalesce(F.map_keys("o_props"), F.array().cast("array<string>")), F.coalesce(F.map_keys("n_props"), F.array().cast("array<string>")))
    changed = F.array_sort(F.filter(names, lambda k: ~F.equal_null(value("o", k), value("n", k))))
    moved = ~F.equal_null("o_geometry", "n_geometry")
    sort = (
        F.when(F.col("o_print").isNull(), "ADDED").when(F.col("n_print").isNull(), "REMOVED").when(moved, "GEOMETRY_CHANGED")
        .when(~F.equal_null(value("o", F.lit(area)), value("n", F.lit(area))), "AREA_CHANGED").otherwise("ATTRIBUTE_CHANGED")
    )
    feature = F.coalesce("n_feature_id", "o_feature_id")
    pid = F.coalesce("n_parcel_id", "o_parcel_id", feature.cast("string"))
    both_sides = F.col("o_print").isNotNull() & F.col("n_print").isNotNull()
    return both.select(
        feature.cast(kind).alias("feature_id"), (pid if parcel == "string" else pid.try_cast(parcel)).alias("parcel_id"), sort.alias("change"), F.when(both_sides, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
        F.col("o_print").alias("previous_hash"), F.col("n_print").alias("current_hash"),
    )


def change_summary(found: DataFrame) -> DataFrame:
    """change, features, parcels (distinct)."""
    return found.groupBy("change").agg(F.count("*").alias("features"), F.countDistinct("parcel_id").alias("parcels"))


def marked(parcels: DataFrame, found: DataFrame, status: str = "REVIEW_REQUIRED") -> DataFrame:
    """Parcels with their status replaced where a change affects them."""
    hit = found.select("parcel_id").distinct().withColumn("hit", F.lit(True))
    return parcels.join(hit.hint("merge"), "parcel_id", "left").withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).drop("hit")


def transitions(runs: DataFrame) -> DataFrame:
    """Next status of sync runs (status, n_changes, approved): required, then review, then approved with one version more."""
    nxt = (
        F.when((F.col("status") == "SYNC_REQUIRED") & (F.col("n_changes") > 0), "REVIEW_REQUIRED")
        .when((F.col("status") == "REVIEW_REQUIRED") & F.col("approved"), "APPROVED")
        .otherwise(F.col("status"))
    )
    return runs.withColumn("next_status", nxt).withColumn("next_version", F.col("version") + F.when((nxt == "APPROVED") & (F.col("status") != "APPROVED"), 1).otherwise(0))


def approvals(runs: DataFrame) -> DataFrame:
    """A version row with its provenance for every run that its transition approves: run_id, version, description, decision, steps."""
    new = transitions(runs).where("next_status = 'APPROVED' and status <> 'APPROVED'")
    text = F.concat(F.lit("Harmonized version "), F.col("next_version"), F.lit(" after run "), F.col("run_id"))
    steps = F.array(F.lit("detect changes"), F.concat(F.lit("review "), F.col("n_changes"), F.lit(" changes")), F.lit("approve synchronization"))
    return new.select("run_id", F.col("next_version").alias("version"), text.alias("description"), F.lit("APPROVED").alias("decision"), steps.alias("steps"))


def versions(registered: DataFrame) -> DataFrame:
    """Adds version (1, 2, ... by time) and active (the newest of each dataset). ``registered``: dataset, created, id.

    A dataset's versions are few; the window is per dataset.
    """
    w = W.partitionBy("dataset").orderBy("created", "id")
    return registered.withColumn("version", F.row_number().over(w)).withColumn("active", F.lead("created").over(w).isNull())


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows without those in the batch, and the batch's last row of each key; rows without a key count as one key."""
    others = [c for c in batch.columns if c not in (key, order)]
    last = batch.groupBy(key).agg(F.max(F.struct(order, *others)).alias("last")).select(key, F.col(f"last.{order}").alias(order), *[F.col(f"last.{c}").alias(c) for c in others])
    new = last.select(F.col(key).alias("_key")).hint("merge")
    kept = current.join(new, (F.isnull(key) == F.isnull("_key")) & F.coalesce(F.col(key).eqNullSafe(F.col("_key")), F.lit(False)), "left_anti")
    return kept.unionByName(last.select(*current.columns))


def newest(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows: a top-k, not a sort of the table."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)
