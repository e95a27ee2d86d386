"""Tables in the folder that the cluster shares, and joins that hot keys don't slow down."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used on a local master whose session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/lexstrata"
#: Keys with more than 1 / HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 512

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master without one, a local default that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FOLDER
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the written table.

    Cuts the lineage: what reads the result never recomputes df, and an
    executor that is lost takes no part of it along.  The table stays until
    ``remove_stored`` is called.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for remove_stored."""
    return len(_written)


def remove_stored(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables that this driver has stored after a mark, except the last ``but``.

    DataFrames that read them can't be run any more.
    """
    gone = _written[since : len(_written) - but]
    del _written[since : len(_written) - but]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(rows: DataFrame, values: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with the one row of values for their key; size says how many rows a key has.

    A key of more than 1 / HOT_SHARE of all rows is one of fewer than HOT_SHARE
    such keys, so their values are broadcast and their rows aren't dealt by
    key.  Both tables are read twice: pass stored ones.
    """
    total = values.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    large, small = values.where(hot).drop(size), values.where(~hot).drop(size)
    spread = rows.join(F.broadcast(large), key)
    dealt = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
    return spread.unionByName(dealt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The vocabulary file of a public tokenizer that op8 and the pipeline use.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed tokenizer files have this one."""
    import public_tokenizers

    return public_tokenizers.path(name)
