"""Compiles that can break off anywhere and be taken up again, with a ledger of what became of each unit.

A compile is given units (unit, digest and what the work needs) and work that
makes rows of them, or an error instead.  Units are dealt into slices; each
slice's rows are written first and its ledger rows last, so a unit is compiled
when its ledger row is there: rows without one are never read.  A run leaves out
units that have been compiled from the same digest, and tries failed ones again.
One unit's failure is a row of the ledger and touches no other unit.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexstrata.errors import error
from lexstrata.sources.folder import removed

LEDGER = "unit string, digest string, error string, n_rows long, rows_sum decimal(38,0), finished_at timestamp, run string, slice int"
#: unit and digest in, rows out: (unit, error, ...), at least one row a unit; rows with an error hold nothing else.
Work = Callable[[DataFrame], DataFrame]


class Compile:
    """Tables below a path: rows and ledger, by run and slice."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    @property
    def ledger(self) -> DataFrame:
        """Every outcome of every run."""
        rows = self._there("ledger", LEDGER)
        return self.spark.createDataFrame([], LEDGER) if rows is None else rows

    @property
    def outcomes(self) -> DataFrame:
        """The last outcome of each unit, and how often it was tried."""
        mine = Window.partitionBy("unit")
        latest = self.ledger.withColumns({"attempts": F.count(F.lit(1)).over(mine), "n": F.row_number().over(mine.orderBy(F.desc("finished_at"), F.desc("run")))})
        return latest.where("n = 1").drop("n")

    def results(self) -> DataFrame:
        """The rows of all units whose last outcome is no error, without those of runs that a later one replaced."""
        good = self.outcomes.where("error is null").select("unit", "run", "slice")
        rows = self._there("rows")
        if rows is None:
            raise error("not_found", "Nothing has been compiled.", path=self.path)
        return rows.join(good, ["unit", "run", "slice"], "left_semi").drop("run", "slice", "error")

    def damaged(self) -> DataFrame:
        """(unit) whose stored rows aren't those that its ledger row counts."""
        good = self.outcomes.where("error is null")
        rows = self._there("rows")
        if rows is None:
            return good.select("unit")
        stored = rows.groupBy("unit", "run", "slice").agg(F.count(F.lit(1)).alias("stored"), _sum(rows).alias("stored_sum"))
        both = good.join(stored, ["unit", "run", "slice"], "left")
        return both.where(~(F.col("n_rows").eqNullSafe(F.col("stored")) & F.col("rows_sum").eqNullSafe(F.col("stored_sum")))).select("unit")

    def pending(self, units: DataFrame, check: bool = False) -> DataFrame:
        """Units not yet compiled from their digest; with check also those whose rows are damaged."""
        done = self.outcomes.where("error is null")
        if check:
            done = done.join(self.damaged(), "unit", "left_anti")
        return units.join(done.select("unit", "digest"), ["unit", "digest"], "left_anti")

    def run(self, units: DataFrame, work: Work, slices: int = 16, check: bool = False) -> str:
        """Compile what is pending; returns the run's name.  Units are unique by unit.

        Units are written once, by slice, so that each slice reads its own.
        """
        run = "r" + uuid4().hex  # never read as a number
        staged = f"{self.path}/staged/{run}"
        dealt = self.pending(units, check).withColumn("slice", F.pmod(F.xxhash64("unit"), F.lit(slices)).cast("int"))
        dealt.repartition("slice", F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(_tasks(self.spark, slices)))).write.partitionBy("slice").parquet(staged)
        todo = self.spark.read.schema(dealt.schema).parquet(staged)
        try:
            for n in sorted(r[0] for r in todo.select("slice").distinct().collect()):  # at most slices rows
                self._slice(todo.where(F.col("slice") == n).drop("slice"), work, run, n)
        finally:
            removed(self.spark, staged)
        return run

    def _slice(self, units: DataFrame, work: Work, run: str, n: int) -> None:
        at = f"{self.path}/rows/run={run}/slice={n}"
        work(units).write.parquet(at)
        rows = self.spark.read.parquet(at)
        made = rows.groupBy("unit").agg(F.min("error").alias("error"), F.count(F.lit(1)).alias("n_rows"), _sum(rows).alias("rows_sum"))
        told = units.select("unit", "digest").join(made, "unit", "left")
        # Work that says nothing of a unit hasn't compiled it.
        said = F.when(F.col("n_rows").isNull(), "no_result").otherwise(F.col("error"))
        columns = [said.alias("error"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.col("rows_sum").cast("decimal(38,0)").alias("rows_sum"), F.current_timestamp().alias("finished_at")]
        told.select("unit", "digest", *columns, F.lit(run).alias("run"), F.lit(n).alias("slice")).write.mode("append").parquet(f"{self.path}/ledger")

    def finished(self, units: DataFrame) -> None:
        """An error with the first failures if some of the units aren't compiled."""
        left = self.pending(units).join(self.outcomes.select("unit", "error"), "unit", "left")
        first = left.select("unit", F.coalesce("error", F.lit("not_run")).alias("error")).orderBy("unit").limit(10).collect()
        if first:
            raise error("corpus_compile_incomplete", "Some units aren't compiled.", first={r["unit"]: r["error"] for r in first})

    def remove(self) -> None:
        removed(self.spark, self.path)


def _sum(rows: DataFrame) -> Column:
    """A sum over rows that changes with any of them, whatever their order."""
    return F.sum(F.xxhash64(*(c for c in sorted(rows.columns) if c not in ("run", "slice"))).cast("decimal(38,0)")).cast("decimal(38,0)")


def _tasks(spark: SparkSession, slices: int) -> int:
    """Files that a slice is staged in, so that all slices have about as many as a shuffle has parts."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // slices)
