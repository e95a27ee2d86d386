"""Administration over sets: reviews, source sets, compiles, grants and reports, as joins of what is and what should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_reviews(drafts: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """A closed set of drafts with one decision each: status accepted, rejected, undecided, unknown_draft or stale."""
    d = decisions.groupBy(*key).agg(F.max("decision").alias("decision"), F.max("content_sha256").alias("decided_sha256"), F.count(F.lit(1)).alias("n"))
    both = drafts.join(d, key, "full_outer")
    status = (
        F.when(F.col("content_sha256").isNull(), "unknown_draft")
        .when(F.col("decision").isNull(), "undecided")
        .when(F.col("n") > 1, "repeated_decision")
        .when(F.col("decided_sha256") != F.col("content_sha256"), "stale")
        .otherwise(F.col("decision"))
    )
    return both.select(*key, status.alias("status"))


def source_set(catalog: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """A catalogue against the files there are: missing, untracked, wrong size, wrong hash or verified."""
    c = catalog.select(key, F.col("bytes").alias("said_bytes"), F.col("sha256").alias("said_sha256"))
    both = c.join(files.select(key, "bytes", "sha256"), key, "full_outer")
    status = (
        F.when(F.col("bytes").isNull(), "source_file_missing")
        .when(F.col("said_bytes").isNull(), "source_set_mismatch")
        .when(F.col("bytes") != F.col("said_bytes"), "source_size_mismatch")
        .when(F.col("sha256") != F.col("said_sha256"), "source_hash_mismatch")
        .otherwise("verified")
    )
    return both.select(key, status.alias("status"))


def to_compile(inputs: DataFrame, compiled: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed compile has still to do: inputs without a result of the same digest."""
    return inputs.join(compiled, key, "left_anti")


def compile_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums by group; any failure makes a group incomplete."""
    failed = F.count_if(F.col("error").isNotNull())
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("inputs"), failed.alias("failed"), F.sum("pages").cast("long").alias("pages"), F.when(failed > 0, "corpus_compile_incomplete").otherwise("complete").alias("status"))


def obsolete_grants(grants: DataFrame, index: DataFrame) -> DataFrame:
    """Active grants on another digest of a pack than the compiled index has."""
    now = index.select("pack_id", F.col("package_digest").alias("current_digest"))
    return grants.where("can_serve").join(now, "pack_id").where("package_digest <> current_digest").select("principal_id", "pack_id", "package_digest", "current_digest")


def grant_faults(grants: DataFrame, packages: DataFrame, policies: DataFrame) -> DataFrame:
    """Grants that no policy or package backs: one row and code each."""
    rows = grants.where("can_serve").join(packages.select("package_digest", F.lit(True).alias("installed")), "package_digest", "left")
    rows = rows.join(policies.select("principal_id", F.col("policy_fingerprint").alias("current_fingerprint")), "principal_id", "left")
    code = F.when(F.col("installed").isNull(), "package_missing").when(F.col("current_fingerprint").isNull(), "policy_missing").when(F.col("current_fingerprint") != F.col("policy_fingerprint"), "policy_changed")
    return rows.select("principal_id", "package_digest", code.alias("code")).where("code is not null")


def page_sequence_faults(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages that aren't numbered 1..n, or that are neither blank nor have text."""
    here = Window.partitionBy(*by).orderBy("physical_page")
    bad = (F.row_number().over(here) != F.col("physical_page")) | (F.col("blank") == (F.length(F.coalesce("text", F.lit(""))) > 0))
    return pages.withColumn("bad", bad).where("bad").drop("bad")


def smallest_profile(rows: DataFrame, sizes: dict[str, Column], most: int) -> DataFrame:
    """The profile of least bytes that fits, or none; ties go to the first name."""
    options = F.array_sort(F.array(*(F.struct(size.cast("long").alias("bytes"), F.lit(name).alias("profile")) for name, size in sizes.items())))
    fits = F.filter(options, lambda o: o["bytes"] <= most)
    return rows.withColumn("best", F.try_element_at(fits, F.lit(1))).withColumns({"profile": F.coalesce(F.col("best.profile"), F.lit("budget_too_small")), "bytes": F.col("best.bytes")}).drop("best")


def scored_cases(cases: DataFrame, by: list[str]) -> DataFrame:
    """Case pass rate, recall, forbidden hits and wrong citations; ratios are null where nothing is measured."""
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 6)
    found = F.size(F.array_intersect("returned", "relevant"))
    forbidden = F.size(F.array_intersect("returned", "forbidden"))
    passed = (F.size(F.array_except("relevant", "returned")) == 0) & (forbidden == 0)
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(passed).alias("passed"), ratio(found, F.size("relevant")).alias("recall"), F.sum(forbidden).cast("long").alias("forbidden_hits"), ratio(found, F.size("returned")).alias("precision"))
