"""Reviewed structure: records put together from source spans, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.operators.verify import slices


def assembled(spans: DataFrame, sources: DataFrame, by: list[str], source_key: str) -> DataFrame:
    """One text per record: its spans (start_byte, end_byte, place) of the source joined by line feeds.

    Only spans and the cut pieces are grouped, never the sources.  A record with
    a span that cuts a character has no text.
    """
    cut = slices(spans, sources.select(source_key, F.col("text").alias("source_text")), source_key)
    cut = cut.select(*by, F.struct("place", "said").alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["said"]), "\n")
    text = F.when(F.bool_and(F.col("s.said").isNotNull()), text)
    return cut.groupBy(*by).agg(text.alias("text")).withColumn("content_sha256", F.sha2("text", 256))


def span_faults(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans that don't grow, overlap the one before, or are more than 64 in a record."""
    here = Window.partitionBy(*by).orderBy("place")
    bad = (F.col("start_byte") >= F.col("end_byte")) | (F.col("start_byte") < F.lag("end_byte", 1, 0).over(here)) | (F.row_number().over(here) > 64)
    return spans.withColumn("bad", bad).where("bad").drop("bad")


def dependencies_of(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Required, resolved relationships as edges between records."""
    target = nodes.select("package_digest", F.col("logical_id").alias("target_logical_id"), F.col("record_id").alias("target_record_id"))
    wanted = relationships.where("required and target_status = 'resolved'")
    return wanted.join(target, ["package_digest", "target_logical_id"]).select("package_digest", "source_record_id", "relationship", "target_record_id").distinct()


def semantic_faults(exact_text: Column, cited: Column, modality: Column, subject: Column) -> Column:
    """Which rules a statement breaks, as an array of codes: its text must be cited, its subject and modality be in it."""
    fault = lambda bad, code: F.when(bad, F.lit(code))
    found = F.array(
        fault(~F.contains(cited, exact_text), "text_not_cited"),
        fault(~F.contains(F.lower(exact_text), F.lower(subject)), "subject_not_in_text"),
        fault(~F.array_contains(F.split(F.lower(exact_text), r"\s+"), F.lower(modality)), "modality_not_in_text"),
    )
    return F.array_compact(found)


def issues(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The distinct issues of each group, sorted, as one string."""
    each = rows.select(*by, F.explode(column).alias("issue")).distinct()
    return each.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("issue")), ",").alias("issues"), F.count(F.lit(1)).alias("n_issues"))
