"""Images as they arrive: files in a folder become feature rows (an engine extra; the batch jobs are the pipeline)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import imaging
from ..sources.images import decoded

FILES = "path string, modificationTime timestamp, length long, content binary"
NAME = r"/([^/]+)_(phase|actin|mt|nuc)\.png$"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new PNG files."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def append_features(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's samples (files <sample>_<channel>.png that came in it) as feature rows appended to `out`. A batch that is
    run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = decoded(batch.select("path", "content")).select(F.regexp_extract("path", NAME, 1).alias("sample_id"), F.regexp_extract("path", NAME, 2).alias("channel"), "image").where("sample_id <> ''")
        wide = imaging.wide(rows, "sample_id").select("*", F.regexp_extract("sample_id", "^([^_]+)", 1).alias("parent_id"), F.when(F.lower("sample_id").contains("original"), "original").otherwise(F.regexp_extract("sample_id", "_(alg[0-9]+)_", 1)).alias("algorithm"))
        imaging.features(wide).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window of a stream of events, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
