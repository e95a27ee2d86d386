"""Document inventory: listing, resolution, near matches and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("identifier", "family_id", "edition_id", "representation", "package_digest")
CANDIDATES = 20


def inventory(packages: DataFrame, records: DataFrame) -> DataFrame:
    """Each package with its number of records; packages without any have 0."""
    counts = records.groupBy("package_digest").agg(F.count(F.lit(1)).alias("record_count"))
    return packages.join(counts, "package_digest", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))


def listing(packages: DataFrame, prefix: str | None = None, after: dict[str, str] | None = None, limit: int | None = 50) -> DataFrame:
    """A keyset page in key order; ``after`` is the key of the row before it."""
    rows = packages if prefix is None else packages.where(F.col("identifier").startswith(prefix))
    if after is not None:
        rows = rows.where(F.struct(*KEY) > F.struct(*(F.lit(after[k]).alias(k) for k in KEY)))
    return rows.orderBy(*KEY) if limit is None else rows.orderBy(*KEY).limit(limit)


def resolved(packages: DataFrame, identifier: str, edition: str | None = None, representation: str | None = None) -> DataFrame:
    rows = packages.where(F.col("identifier") == identifier)
    if edition is not None:
        rows = rows.where(F.col("edition_id") == edition)
    return rows if representation is None else rows.where(F.col("representation") == representation)


def near_matches(packages: DataFrame, identifier: str, limit: int = CANDIDATES) -> DataFrame:
    """Rows of the exact identifier or else with it as prefix, and their families; with the basis of each."""
    exact = packages.where(F.col("identifier") == identifier)
    seeds = packages.where(F.col("identifier").startswith(identifier))
    only = exact.select(F.lit(True).alias("found")).limit(1)
    seeds = seeds.join(F.broadcast(only), how="left").where(F.col("found").isNull() | (F.col("identifier") == identifier)).select("family_id").distinct()
    basis = F.when(F.col("identifier") == identifier, "exact_identifier").when(F.col("identifier").startswith(identifier), "identifier_prefix").otherwise("same_family")
    rows = packages.join(seeds, "family_id", "left_semi").withColumn("match_basis", basis)
    order = F.when(F.col("match_basis") == "exact_identifier", 0).when(F.col("match_basis") == "identifier_prefix", 1).otherwise(2)
    return rows.orderBy(order, "identifier", "edition_id", "representation", "package_digest").limit(limit)


def set_digest(rows: DataFrame, item: Column, by: list[str]) -> DataFrame:
    """SHA-256 of the sorted items of each group, written as a JSON array."""
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]"))
    return rows.groupBy(*by).agg(F.sha2(listed, 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_items"))


def coverage_status(value: Column) -> Column:
    """complete, incomplete or unknown, by the declared words."""
    incomplete = value.isin("not_derived", "not_evaluated", "unclassified", "unknown")
    for start in ("incomplete", "partial_", "text_layer_extracted_", "automated_outline_"):
        incomplete = incomplete | value.startswith(start)
    return F.when(value.isin("complete", "complete_for_fixture"), "complete").when(incomplete, "incomplete").otherwise("unknown")


def source_status(edition: Column, parsing: Column) -> Column:
    a, b = coverage_status(edition), coverage_status(parsing)
    return F.when((a == "incomplete") | (b == "incomplete"), "incomplete").when((a == "complete") & (b == "complete"), "complete").otherwise("unknown")
