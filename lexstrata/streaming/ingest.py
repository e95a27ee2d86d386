"""Incremental ingest: new files of documents become record rows, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def record_lines(documents: DataFrame) -> DataFrame:
    """The adapted records of a batch or stream of documents; no state and no shuffle."""
    edition = F.concat(F.lit("fam:"), "source", F.lit(":"), "lang")
    kept = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    lines = documents.select(F.sha2(edition, 256).alias("package_digest"), "doc_id", F.posexplode(kept).alias("pos", "text"))
    return lines.withColumn("record_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-l"), F.col("pos").cast("string")))


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Process what files there are and stop; the checkpoint resumes after the last finished batch.

    A batch that is run again after a failure overwrites its own folder, so
    every file's rows are in the target once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        record_lines(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
