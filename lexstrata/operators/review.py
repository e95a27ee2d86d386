"""Reviews of outline candidates: drafts bound to their bytes, and decisions promoted to annotations.

A draft is the canonical JSON of one candidate with its spans as offsets within
pages, known by its SHA-256.  A decision names the digest of the draft that the
reviewer saw.  Promotion makes each draft again from the candidates and pages of
now, and compares digests: what has changed since is stale.  Nothing is accepted
in silence; every draft and every decision has a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions import closed
from lexstrata.functions.closed import SHA256, Closed, Items, Null, Text, Whole
from lexstrata.operators.graph import checkpointed
from lexstrata.operators.pages import in_pages

MAX_SPANS = 64
# What a draft says of itself, and what may be reviewed.
STATE = "proposed_unreviewed"
OFFSETS = "half_open_utf8_byte_offsets_per_physical_page"
PENDING = r"ambiguous-numbered-[1-9][0-9]*$"
NODE_KINDS = ("document", "section", "clause", "paragraph", "list", "list_item", "table", "table_row", "table_cell", "definition", "note", "figure")
REVIEWERS = ("agent", "human")

SPANS = "array<struct<physical_page bigint, page_text_sha256 string, start_byte bigint, end_byte bigint>>"
NODE = f"struct<logical_id string, kind string, clause_reference string, heading string, exact_text string, source_spans {SPANS}>"
DRAFT_SHAPE = Closed(
    dict.fromkeys(("candidate_record_id", "document_id"), Text())
    | {
        "candidate_content_sha256": SHA256, "candidate_parent_logical_id": Null(Text()), "offset_convention": Text(choices=(OFFSETS,)), "source_page_pack_digest": SHA256, "state": Text(choices=(STATE,)), "text_encoding": Text(choices=("UTF-8",)),
        "proposed_node": Closed(
            dict.fromkeys(("logical_id", "kind", "clause_reference", "heading", "exact_text"), Text())
            | {"source_spans": Items(Closed({"physical_page": Whole(), "page_text_sha256": SHA256, "start_byte": Whole(), "end_byte": Whole(1)}), least=1, most=MAX_SPANS)}
        ),
    }
)


def _json(**fields: Column) -> Column:
    """Canonical JSON: keys in order, nulls written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def _cut(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans (document, page, page_start, page_end, ...) with page_text_sha256 and ``said``, null where they leave the page or split a character."""
    raw = pages.select("document", "page", F.col("text").cast("binary").alias("raw"), F.sha2("text", 256).alias("page_text_sha256"))
    start, stop = F.col("page_start"), F.col("page_end")
    inside = (start >= 0) & (start < stop) & (stop <= F.octet_length("raw"))
    piece = F.substring("raw", (start + 1).cast("int"), (stop - start).cast("int"))
    said = F.when(inside, F.try_validate_utf8(piece.cast("string")))
    return spans.join(raw, ["document", "page"], "left").withColumn("said", said).drop("raw")


def drafts(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """record_id, status, draft and draft_sha256 of each candidate.

    Candidates: document, record_id, logical_id, kind, clause_reference, heading,
    parent_logical_id, text, package_digest (of the pages) and spans
    (array<struct<start_byte, end_byte>> in the document's extracted text).
    Pages: document, page, text, start_byte, end_byte.  Without a draft are
    candidates whose spans don't give their text (outline_source_mismatch) or
    whose kind can't be reviewed (outline_candidate_unsupported).
    """
    some = F.coalesce(F.size("spans").between(1, MAX_SPANS), F.lit(False))
    c = candidates.select("document", "record_id", "logical_id", "kind", "clause_reference", "heading", "parent_logical_id", "text", "package_digest", F.when(some, F.col("spans")).alias("spans"))
    spans = c.select("document", "record_id", F.posexplode("spans").alias("place", "s")).select("document", "record_id", "place", "s.start_byte", "s.end_byte")
    found = _cut(in_pages(spans, pages, ["document"]), pages)
    span = F.struct(F.col("page").cast("long").alias("physical_page"), "page_text_sha256", F.col("page_start").cast("long").alias("start_byte"), F.col("page_end").cast("long").alias("end_byte"))
    listed = F.array_sort(F.collect_list(F.struct("place", span.alias("span"), "said")))
    whole = found.groupBy("document", "record_id").agg(listed.alias("l"), F.bool_and(F.col("held") & F.col("said").isNotNull()).alias("sound"))
    whole = whole.select("document", "record_id", "sound", F.transform("l", lambda x: x["span"]).cast(SPANS).alias("source_spans"), F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("exact_text"))
    rows = c.join(whole, ["document", "record_id"], "left")
    sha = F.sha2("text", 256)
    node = F.struct("logical_id", "kind", "clause_reference", "heading", "exact_text", "source_spans")
    draft = _json(
        candidate_record_id=F.col("record_id"), candidate_content_sha256=sha, candidate_parent_logical_id=F.col("parent_logical_id"), document_id=F.col("document"), offset_convention=F.lit(OFFSETS),
        proposed_node=node, source_page_pack_digest=F.col("package_digest"), state=F.lit(STATE), text_encoding=F.lit("UTF-8"),
    )
    known = F.coalesce(F.col("kind").isin(*NODE_KINDS) | (F.col("kind") == "unsupported_region") & F.col("clause_reference").rlike(PENDING), F.lit(False))
    same = F.coalesce(F.col("sound") & (F.col("exact_text") == F.col("text")), F.lit(False))
    status = F.when(~known, "outline_candidate_unsupported").when(~same, "outline_source_mismatch").otherwise(STATE)
    rows = rows.select("record_id", status.alias("status"), F.when(status == STATE, draft).alias("draft"))
    return rows.withColumn("draft_sha256", F.sha2("draft", 256))


def promoted(submitted: DataFrame, decisions: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """draft_sha256, record_id, status, annotation and annotation_sha256 of each submitted draft and each decision.

    Submitted: draft.  Decisions: draft_sha256, accepted, node (as NODE) and
    review (struct<reviewer_id, reviewer_type, reviewed_at>).  A status is
    undecided, rejected, repeated_decision, invalid_outline_review (a draft of
    another shape, a node that can't be reviewed so, or spans that leave their
    page or split a character), outline_review_stale (no such draft, another
    candidate, page or text now) or reviewed_annotation_written.
    """
    given = checkpointed(submitted.select("draft", F.sha2("draft", 256).alias("draft_sha256")).distinct())
    wrong = closed.json_faults(given, F.col("draft"), DRAFT_SHAPE, ["draft_sha256"]).select("draft_sha256").distinct().withColumn("misshapen", F.lit(True))
    decided = decisions.groupBy("draft_sha256").agg(F.first("accepted").alias("accepted"), F.first("node").cast(NODE).alias("node"), F.first("review").alias("review"), F.count(F.lit(1)).alias("n"))
    told = given.join(wrong, "draft_sha256", "left").join(decided, "draft_sha256", "full_outer").withColumn("record_id", F.get_json_object("draft", "$.candidate_record_id"))
    again = drafts(candidates, pages).where("draft is not null").select("record_id", F.col("draft_sha256").alias("replayed"))
    rows = told.join(again, "record_id", "left").withColumns({"proposed": F.from_json(F.get_json_object("draft", "$.proposed_node"), NODE), "document": F.get_json_object("draft", "$.document_id")})
    rows = checkpointed(rows)
    spans = rows.where(F.size("node.source_spans") <= MAX_SPANS).select("draft_sha256", "document", F.posexplode("node.source_spans").alias("place", "s"))
    spans = spans.select("draft_sha256", "document", "place", F.col("s.physical_page").alias("page"), F.col("s.start_byte").alias("page_start"), F.col("s.end_byte").alias("page_end"), F.col("s.page_text_sha256").alias("said_sha256"))
    cut = _cut(spans, pages)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "\n")
    same_page = F.bool_and(F.col("page_text_sha256").eqNullSafe(F.col("said_sha256")))
    cited = cut.groupBy("draft_sha256").agg(same_page.alias("same_pages"), F.bool_and(F.col("said").isNotNull()).alias("inside"), said.alias("cited"))
    rows = rows.join(cited, "draft_sha256", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    pending = F.col("proposed.kind") == "unsupported_region"
    provenance = F.col("review.reviewer_type").isin(*REVIEWERS) & (F.col("review.reviewer_id") != "") & (F.col("review.reviewed_at") != "")
    renamed = ~pending | (F.col("node.clause_reference") != F.col("proposed.clause_reference"))
    named = (F.col("node.clause_reference") != "") & (F.col("node.heading") != "")
    status = (
        F.when(F.col("draft").isNull(), "outline_review_stale")
        .when(F.col("misshapen"), "invalid_outline_review")
        .when(F.col("n").isNull(), "undecided")
        .when(F.col("n") > 1, "repeated_decision")
        .when(no(F.col("draft_sha256") == F.col("replayed")), "outline_review_stale")
        .when(no(F.col("accepted")), "rejected")
        .when(no(F.col("node.logical_id") == F.col("proposed.logical_id")), "outline_review_stale")
        .when(no(F.col("node.kind").isin(*NODE_KINDS) & renamed & named & provenance), "invalid_outline_review")
        .when(no(F.col("same_pages")), "outline_review_stale")
        .when(no(F.col("inside")), "invalid_outline_review")
        .when(no(F.col("cited") == F.col("node.exact_text")), "outline_review_stale")
        .otherwise("reviewed_annotation_written")
    )
    header = {k: F.get_json_object("draft", f"$.{k}") for k in ("candidate_record_id", "candidate_content_sha256", "document_id", "offset_convention", "source_page_pack_digest", "text_encoding")}
    annotation = _json(**header, node=F.col("node"), review=F.col("review"), proposal_sha256=F.col("draft_sha256"))
    out = rows.select("draft_sha256", "record_id", status.alias("status"), F.when(status == "reviewed_annotation_written", annotation).alias("annotation"))
    return out.withColumn("annotation_sha256", F.sha2("annotation", 256))


def altered(annotations: DataFrame, promoted: DataFrame) -> DataFrame:
    """Annotations (annotation, ...) that aren't byte for byte what promotion makes now."""
    good = promoted.where("annotation is not null").select("annotation_sha256").distinct()
    return annotations.withColumn("annotation_sha256", F.sha2("annotation", 256)).join(good, "annotation_sha256", "left_anti")
