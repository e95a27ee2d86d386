"""Comparing two editions: keyed status, alignment candidates and edge deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARED = ("kind", "clause_reference", "heading", "text")
LOCATION = ("start_byte",)
STATUSES = ("added", "removed", "modified", "moved", "unchanged")


def _sides(rows: DataFrame) -> tuple[list[Column], list[Column]]:
    """(what a change of is a modification, what a change of is a move) of records with or without roles, derivation and structure.

    Structure counts without its physical spans; these only tell a move.
    """
    compared = [F.col(c) for c in (*COMPARED, *(c for c in ("statement_role", "derivation") if c in rows.columns))]
    location = [F.col(c) for c in LOCATION]
    if "structure" in rows.columns:
        bare = F.transform("structure.relationships", lambda r: r.dropFields("evidence_spans"))
        compared.append(F.when(F.col("structure").isNotNull(), F.col("structure").dropFields("source_spans", "relationships").withField("relationships", bare)).alias("structure"))
        location += [F.col("structure.source_spans").alias("source_spans"), F.transform("structure.relationships", lambda r: r["evidence_spans"]).alias("evidence_spans")]
    return compared, location


def status(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package_digest, record_id, status, ...): one full outer join by record; identity is the id alone.

    Texts are compared by their digests, so they aren't moved.
    """

    def packed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.withColumn("text", F.unhex(F.sha2("text", 256)))
        compared, location = _sides(rows)
        return rows.select("package_digest", "record_id", F.struct(F.struct(*compared).alias("said"), F.struct(*location).alias("place")).alias(side))

    both = packed(before, "b").join(packed(after, "a"), ["package_digest", "record_id"], "full_outer")
    differs = lambda part: ~F.col(f"b.{part}").eqNullSafe(F.col(f"a.{part}"))
    what = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(differs("said"), "modified").when(differs("place"), "moved").otherwise("unchanged")
    return both.select("package_digest", "record_id", what.alias("status"), F.lower(F.hex("b.said.text")).alias("before_text_sha256"), F.lower(F.hex("a.said.text")).alias("after_text_sha256"))


def counts(found: DataFrame) -> DataFrame:
    """One row per package, the five statuses with their zeros."""
    return found.groupBy("package_digest").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def alignment(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Ids of one side only whose key is unique among those of both sides; a candidate, never an identity."""
    keys = ["package_digest", *by]

    def alone(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        rows = mine.join(other.select("package_digest", "record_id"), ["package_digest", "record_id"], "left_anti")
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias(name)).where("n = 1").drop("n")

    return alone(before, after, "before_record_id").join(alone(after, before, "after_record_id"), keys)


def edge_delta(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Edges of mine that other lacks; the required flag is part of an edge."""
    names = ["package_digest", "source_record_id", "relationship", "target_record_id", "required"]
    return mine.select(*names).distinct().join(other.select(*names).distinct(), names, "left_anti")
