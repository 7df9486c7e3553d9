"""Incremental runs: map files are picked up as a stream, and each batch works the crystals anew that it adds to.

A crystal's maps may come in any number of batches.  Every batch is first added, under its number, to a table of
all maps so far, partitioned by batch and crystal; the crystals it touches are then worked on with all their maps and
replace what was written of them.  A batch that is replayed after a failure overwrites its own part of the table
and then the same results, so the outcome is that of one run over all files, however they are dealt to batches.
``expected`` holds a crystal back until all its maps are there, so that nothing half-done is ever read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from densika.operators import ensemble

MAPS = "crystal string, i int, j int, k int, map_id int, value float"
KEYS = ["crystal", "i", "j", "k"]


def ensemble_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet of ``(crystal, i, j, k, map_id, value)`` as it arrives."""
    return spark.readStream.schema(MAPS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("crystal").distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def complete(maps: DataFrame, expected: DataFrame) -> DataFrame:
    """The crystals of ``expected`` (crystal, n_maps) that have as many distinct maps or more."""
    there = maps.select("crystal", "map_id").distinct().groupBy("crystal").agg(F.count("*").alias("there"))
    return there.join(expected.select("crystal", "n_maps"), "crystal").where("there >= n_maps").select("crystal")


def run_stream(
    source: DataFrame, out: str, checkpoint: str, n_maps: int = 50, work: Callable[[DataFrame], DataFrame] | None = None, expected: DataFrame | None = None, held: str | None = None
) -> StreamingQuery:
    """Signal to noise by crystal of all maps that came so far; the maps are kept in ``held``, beside the checkpoint."""
    make = work or (lambda rows: ensemble.stats(ensemble.packed(rows, KEYS, n_maps), KEYS))
    kept = held or f"{checkpoint.rstrip('/')}-maps"

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").partitionBy("crystal").parquet(f"{kept}/batch={batch}")
        # A batch that failed before may have left parts of later numbers than the one that is replayed.
        every = spark.read.schema(f"{MAPS}, batch long").parquet(kept).where(F.col("batch") <= batch)
        touched = every.where(F.col("batch") == batch).select("crystal").distinct()
        maps = every.drop("batch").join(touched, "crystal", "left_semi")
        if expected is not None:
            maps = maps.join(complete(maps, expected), "crystal", "left_semi")
        make(maps).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crystal").parquet(out)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and time window, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
