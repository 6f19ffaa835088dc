"""Inventory files as they arrive: totals per snapshot and changes of late corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of rows of ``entries_core`` from Parquet files put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _per_window(arrivals: DataFrame, window: str) -> DataFrame:
    return (
        arrivals.groupBy(F.window("loaded_at", window), "snapshot_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_dir") == 0).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
        .select(F.col("window.start").alias("start"), "snapshot_id", "n_rows", "n_files", "n_bytes")
    )


def load_totals(arrivals: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Rows, files and bytes loaded per snapshot and window of ``loaded_at``.

    Rows that come more than ``late`` behind the newest are dropped from the
    totals, as the watermark closes their windows. :func:`arriving_totals` keeps
    them. Over a batch of the same files there is no watermark: that is a recount.
    """
    return _per_window(arrivals.withWatermark("loaded_at", late), window)


def arriving_totals(arrivals: DataFrame, totals: str, checkpoint: str, window: str = "1 hour", **trigger) -> StreamingQuery:
    """Keeps a table of totals per snapshot and window up to date, however late a row comes.

    Each micro-batch adds its own totals under its number, replacing what a failed try
    of the same batch left; nothing is held in memory between batches, so no window
    closes. :func:`read_totals` sums them up.
    """

    def add(batch: DataFrame, number: int) -> None:
        _per_window(batch, window).write.mode("overwrite").parquet(f"{totals.rstrip('/')}/batch={number}")

    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_totals(spark: SparkSession, totals: str) -> DataFrame:
    """The totals that :func:`arriving_totals` has written, one row per snapshot and window."""
    parts = spark.read.parquet(totals)
    return parts.groupBy("start", "snapshot_id").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_files", "n_bytes")])


def first_deliveries(arrivals: DataFrame, late: str = "7 days") -> DataFrame:
    """Each row once, however often it is delivered within ``late``; a row delivered again after that comes again."""
    return arrivals.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["id"])
