"""Feature streams: incremental GeoJSON lines and CSV, load progress, and snapshot sync by arriving batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import changes, keyed
from ..functions import shapes as S
from ..sources.readers import LINE


def feature_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Features of one-a-line GeoJSON files as they arrive; those without a geometry are skipped."""
    geometry = F.col("geometry.type"), F.col("geometry.coordinates")
    rows = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).json(path).where("geometry is not null")
    return rows.select("id", F.col("properties").alias("props"), S.of_geojson(*geometry).alias("shape"), S.exterior_of_geojson(*geometry).alias("ring"))


def csv_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Rows of CSV files as they arrive."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def load_with_progress(stream: DataFrame, table: str, progress: str, checkpoint: str) -> StreamingQuery:
    """Write a feature stream to Parquet and, per batch, its counts of rows and of valid rings to a progress table.

    A batch writes to folders named by its number, so a batch that runs again replaces its own rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        valid = F.sum(F.when(F.size("ring") >= 3, 1).otherwise(0)).alias("valid")
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.agg(F.count("*").alias("rows"), F.coalesce(valid, F.lit(0)).alias("valid")).write.mode("overwrite").parquet(f"{progress}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_stream(stream: DataFrame, snapshot: DataFrame, out: str, checkpoint: str, state: str | None = None, geometry: str = "geom_key", order: str | None = None) -> StreamingQuery:
    """Classify each arriving batch of features against the snapshot as the batches before have left it; removals need a whole snapshot and are left out.

    ``snapshot`` is version 1 of each feature. What a batch adds or changes is put down under ``state`` in a folder named by its number, with the feature's next version; a batch reads the
    folders of those before it alone, so one that runs again finds the same snapshot and replaces its own rows. Results have ``previous_version`` (null if added) and ``version``. Features
    without an id and repeated ids go by the rules of ``changes``.
    """
    state = state or f"{out}-state"
    spark = stream.sparkSession
    columns = [c for c in keyed(snapshot).columns]

    def before(number: int) -> DataFrame:
        """Last version of each feature ahead of a batch."""
        first = keyed(snapshot).withColumns({"version": F.lit(1).cast("long"), "batch": F.lit(-1).cast("long")})
        root = spark._jvm.org.apache.hadoop.fs.Path(state)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(root)] if files.exists(root) else []
        paths = [f"{state}/batch={n}" for n in sorted(numbers) if n < number]
        return first if not paths else first.unionByName(spark.read.schema(first.schema).option("basePath", state).parquet(*paths))

    def put(batch: DataFrame, number: int) -> None:
        batch = keyed(batch).persist()
        met = batch.select("feature_id").where("feature_id is not null").distinct().hint("merge")
        known = before(number).join(met, "feature_id", "left_semi")
        others = [c for c in known.columns if c not in ("feature_id", "batch")]
        last = known.groupBy("feature_id").agg(F.max_by(F.struct(*others), "batch").alias("last")).select("feature_id", "last.*")
        found = changes(last.drop("version"), batch, geometry, order=order).where("change <> 'REMOVED'")
        found = found.join(last.select("feature_id", F.col("version").alias("previous_version")).hint("merge"), "feature_id", "left")
        found = found.withColumn("version", F.coalesce(F.col("previous_version") + 1, F.lit(1).cast("long"))).persist()
        rows = batch if order is None else batch.join(batch.groupBy("feature_id").agg(F.max(order).alias(order)).hint("merge"), ["feature_id", order])
        rows = rows.dropDuplicates(["feature_id"]).join(found.select("feature_id", "version").hint("merge"), "feature_id")
        rows.select(*columns, "version").write.mode("overwrite").parquet(f"{state}/batch={number}")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        found.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
