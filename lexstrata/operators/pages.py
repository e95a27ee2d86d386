"""Pages of documents: compiling them into page records, and what is checked about compositions and totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.scalars import page_text
from lexstrata.operators.graph import checkpointed

MARK = "[[PAGE_%04d]]"
#: Pages whose offsets one task adds up, bytes of a part of an extracted text, and of a bin that spans are found by.
PAGE_RANGE = 1024
PART_BYTES = 1 << 20
BIN_BYTES = 1 << 12


def _texts(pages: DataFrame) -> DataFrame:
    """document, page and the text layer's text; a generator of one row, so that it is made once."""
    return pages.select("document", "page", F.inline(F.array(F.struct(page_text(F.col("text")).alias("text")))))


def placed(pages: DataFrame) -> DataFrame:
    """document, page, status, text_sha256, start_byte and end_byte of page records, without their texts.

    The extracted text has each page after a line with its mark, one blank line
    apart.  Pages without text aren't part of it and have status empty; nothing
    is passed over in silence.  Sizes alone are sorted: within ranges of
    PAGE_RANGE page numbers, whose sums are added up by document, so a document
    may have any number of pages.
    """
    there = F.coalesce(F.col("text"), F.lit("")) != ""
    mark = F.octet_length(F.format_string(MARK, F.col("page"))) + 1
    sizes = _texts(pages).select("document", "page", there.alias("there"), mark.cast("long").alias("mark"), F.octet_length("text").cast("long").alias("bytes"), F.when(there, F.sha2("text", 256)).alias("text_sha256"))
    sizes = checkpointed(sizes.withColumn("range", F.expr(f"page div {PAGE_RANGE}")))
    # Between two pages stand the line feed that ends one and a blank line.
    size = F.when(F.col("there"), F.col("mark") + F.col("bytes") + 2).otherwise(0)
    sums = sizes.groupBy("document", "range").agg(F.sum(size).alias("size"))
    earlier = Window.partitionBy("document").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("document", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("document", "range").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("within", F.coalesce(F.sum(size).over(here), F.lit(0))).join(sums, ["document", "range"])
    start = F.when(F.col("there"), F.col("before") + F.col("within") + F.col("mark"))
    rows = rows.withColumns({"status": F.when(F.col("there"), "extracted").otherwise("empty"), "start_byte": start, "end_byte": start + F.col("bytes")})
    return rows.select("document", "page", "status", "text_sha256", "start_byte", "end_byte")


def compiled(pages: DataFrame) -> DataFrame:
    """Page records (document, page, text) with what ``placed`` says of them."""
    return _texts(pages).join(placed(pages), ["document", "page"])


def text_parts(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """document, part, start_byte, text: the extracted texts that ``placed`` places pages in, as parts in their order.

    A part is the pages, with marks, that start in the same stretch of
    part_bytes; joined by a blank line the parts are the whole.
    """
    rows = compiled(pages).where("status = 'extracted'").withColumn("part", F.expr(f"start_byte div {part_bytes}"))
    mark = F.format_string(MARK, F.col("page"))
    piece = F.struct("page", F.concat(mark, F.lit("\n"), F.col("text")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "\n\n")
    return rows.groupBy("document", "part").agg(F.min(F.col("start_byte") - F.octet_length(mark) - 1).alias("start_byte"), joined.alias("text"))


def extracted_text(records: DataFrame) -> DataFrame:
    """document, text: whole extracted texts of page records, each in a row; for documents that fit one (``text_parts`` for any)."""
    piece = F.concat(F.format_string(MARK, F.col("page")), F.lit("\n"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", piece.alias("piece")))), lambda x: x["piece"]), "\n\n")
    return records.where("status = 'extracted'").groupBy("document").agg(joined.alias("text"))


def text_digests(parts: DataFrame) -> DataFrame:
    """document, bytes and text_sha256 of whole extracted texts, from their parts one after the other: a task holds one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, sha = None, 0, hashlib.sha256()
        done: list[tuple[str, int, str]] = []
        for b in batches:
            for document, text in zip(b.column("document").to_pylist(), b.column("text"), strict=True):
                if document != now:
                    if now is not None:
                        done.append((now, size, sha.hexdigest()))
                    now, size, sha = document, 0, hashlib.sha256()
                raw = text.as_buffer()
                if size:
                    sha.update(b"\n\n")
                    size += 2
                sha.update(raw)
                size += raw.size
        if now is not None:
            done.append((now, size, sha.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("document", "bytes", "text_sha256"), d, strict=True)) for d in done], pa.schema([("document", pa.string()), ("bytes", pa.int64()), ("text_sha256", pa.string())]))

    ordered = parts.select("document", "part", "text").repartition("document").sortWithinPartitions("document", "part")
    return ordered.mapInArrow(run, "document string, bytes long, text_sha256 string")


def in_pages(spans: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans with their place in the one page that holds them, and whether it does.

    A page that holds a span holds its first byte, so spans meet the pages in
    the bin of BIN_BYTES of that byte: the join is on the keys and the bin.  Adds
    page, page_start, page_end (offsets in the page) and held.
    """
    bins = F.sequence(F.expr(f"start_byte div {BIN_BYTES}"), F.expr(f"greatest(start_byte, end_byte - 1) div {BIN_BYTES}"))
    there = pages.where("start_byte is not null and end_byte >= start_byte")
    inside = there.select(*keys, F.col("page").alias("in_page"), F.col("start_byte").alias("from_byte"), F.col("end_byte").alias("to_byte"), F.explode(bins).alias("bin"))
    holds = (F.col("start_byte") >= F.col("from_byte")) & (F.col("end_byte") <= F.col("to_byte")) & (F.col("start_byte") < F.col("end_byte"))
    names = spans.columns
    found = spans.withColumn("bin", F.expr(f"start_byte div {BIN_BYTES}")).join(inside, [*keys, "bin"], "left").withColumn("holds", F.coalesce(holds, F.lit(False)))
    one = found.groupBy(*names).agg(F.min(F.when(F.col("holds"), F.struct("in_page", "from_byte"))).alias("at"), F.count_if("holds").alias("n"))
    held = F.col("n") == 1
    return one.select(*names, F.when(held, F.col("at.in_page")).alias("page"), F.when(held, F.col("start_byte") - F.col("at.from_byte")).alias("page_start"), F.when(held, F.col("end_byte") - F.col("at.from_byte")).alias("page_end"), held.alias("held"))


def composition(components: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """by, n_components and composition_sha256: SHA-256 over the components' fields in the order of ordinal."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(f).cast("string"), F.lit("\\N")) for f in fields))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return components.groupBy(by).agg(F.count(F.lit(1)).alias("n_components"), F.sha2(F.array_join(listed, "\n"), 256).alias("composition_sha256"))


def unequal_totals(components: DataFrame, status: Column, totals: DataFrame) -> DataFrame:
    """Statuses whose count of components isn't what the summary (status, n) says; none if all is accounted for."""
    counted = components.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("counted"))
    return counted.join(totals, "status", "full_outer").where(~F.col("counted").eqNullSafe(F.col("n"))).select("status", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("n", F.lit(0)).alias("said"))


#: Keys that claim a decision, and the values that don't.
CLAIMS = ("approved", "approval", "compliant", "compliance")
NO_CLAIM = (False, None, "not_decided", "not_applicable")


def claims_in(packet: Any) -> int:
    """How many keys of a packet, at any depth, claim a decision that evidence can't make."""
    todo, n = [packet], 0
    while todo:
        now = todo.pop()
        if isinstance(now, dict):
            for key, value in now.items():
                n += key.lower() in CLAIMS and value not in NO_CLAIM
                n += key.lower() == "project_applicability" and value != "not_decided"
            todo += now.values()
        elif isinstance(now, list):
            todo += now
    return n
