"""Coverage accounting: page ledger, byte partitions and linked bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger(pages: DataFrame, by: list[str]) -> DataFrame:
    """Totals of pages with and without text; pages: (*by, text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(size == 0).alias("pages_without_text"), F.sum(size).cast("long").alias("text_bytes"))


def partition_faults(segments: DataFrame, by: list[str]) -> DataFrame:
    """Pages whose segments (start, stop, size) aren't an exact partition of their bytes."""
    here = Window.partitionBy(*by).orderBy("start", "stop")
    gap = F.col("start") != F.lag("stop", 1, 0).over(here)
    faults = segments.withColumn("bad", gap | (F.col("stop") <= F.col("start")))
    return faults.groupBy(*by).agg(F.count_if("bad").alias("n_faults"), (F.max("stop") == F.max("size")).alias("reaches_end"), F.count(F.lit(1)).alias("n_segments"))


def linked_bytes(spans: DataFrame, by: list[str]) -> DataFrame:
    """The length of the union of overlapping spans (start, stop) of each page."""
    before = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.lit(0))
    added = F.greatest(F.lit(0), F.col("stop") - F.greatest(reach, F.col("start")))
    return spans.withColumn("added", added).groupBy(*by).agg(F.sum("added").cast("long").alias("linked_bytes"))
