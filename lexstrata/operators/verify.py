"""Source verification and data-quality violations, as rows to be looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    """The bytes [start, stop) of a text's UTF-8, as text; null where they cut a character."""
    return _text(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (stop - start).cast("int")))


def _text(raw: Column) -> Column:
    return F.try_validate_utf8(raw.cast("string"))


def spans_of_lines(lines: DataFrame) -> DataFrame:
    """Byte offsets of a document's parts joined by line feeds: (doc_id, pos, start_byte, end_byte)."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text") + 1
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    return lines.withColumn("start_byte", start.cast("long")).withColumn("end_byte", (start + F.octet_length("text")).cast("long"))


def slices(spans: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """The spans (start_byte, end_byte, any others) with ``said``, what the source (key, source_text) has there; null where a span cuts a character."""
    return _cut(spans, sources, key).withColumn("said", _text(F.col("said")))


def _cut(spans: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``slices`` with the bytes.

    All spans of a source are cut in one row, so its bytes are carried and
    encoded once and not once a span.  Spans without a source are left out.
    """
    others = [c for c in spans.columns if c != key]
    listed = spans.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("spans"))
    raw = sources.select(key, F.encode("source_text", "UTF-8").alias("raw"))
    cut = lambda s: F.substring(F.col("raw"), (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int"))
    # The bytes come out of a generator of one row; a projection would be put into the lambda and encode for each span.
    once = listed.join(raw, key).select(key, "spans", F.inline(F.array(F.struct("raw"))))
    return once.select(key, F.inline(F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in others), cut(s).alias("said")))))


def quote_faults(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Records whose span of the source isn't their text, or whose quote digest isn't theirs."""
    # Bytes are compared, as a wrong span may cut a character.
    both = _cut(records, sources, key)
    faults = both.where(~F.col("said").eqNullSafe(F.encode("text", "UTF-8")) | ~F.sha2("text", 256).eqNullSafe(F.col("quote_sha256")))
    return faults.withColumn("said", _text(F.col("said")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_edges(edges: DataFrame, records: DataFrame) -> DataFrame:
    there = records.select("package_digest", F.col("record_id").alias("target_record_id"))
    return edges.join(there, ["package_digest", "target_record_id"], "left_anti")


def still_there() -> Column:
    """Whether a record's file (now: its digest, content) is the one cited and holds the text at its bytes, or anywhere if it has none."""
    start, stop = F.col("source.text_start_byte"), F.col("source.text_end_byte")
    cited = F.coalesce(F.when(F.col("source.text_path").isNotNull(), F.col("source.text_sha256")), F.col("source.sha256"))
    at_place = F.substring("content", (start + 1).cast("int"), (stop - start).cast("int")) == F.encode("text", "UTF-8")
    return (F.col("now") == cited) & F.when(start.isNotNull(), at_place).otherwise(F.contains(F.col("content"), F.encode("text", "UTF-8")))
