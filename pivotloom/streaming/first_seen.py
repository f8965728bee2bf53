"""First-seen novelty over an appended feed, as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files or folders of one name under a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)


def first_seen(rows: DataFrame, key: list[str], at: str, delay: str, window: str) -> DataFrame:
    """First and last sighting of each key in each window; late rows within `delay` count.

    State is one row per key and open window, and goes when the watermark passes it.
    """
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, window), *key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def deduplicated(rows: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """The feed without replays that come within `delay`."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def run_once(result: DataFrame, folder: str) -> DataFrame:
    """Work off all that is there and return the finished windows."""
    spark = result.sparkSession
    query = result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
