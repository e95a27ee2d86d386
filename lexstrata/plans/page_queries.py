"""Registered queries over scalar functions, compiled pages, compositions and structural edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.functions import scalars
from lexstrata.operators import graph, pages, review
from lexstrata.operators.graph import checkpointed
from lexstrata.plans.oracles import CORPUS
from lexstrata.plans.queries import _edition_edges, _status, query
from lexstrata.sources.adapter import Corpus, read


@query
def url_quoted_paths(c: Corpus) -> DataFrame:
    raw = F.concat_ws("/", "source", F.upper("lang"), F.concat(F.lit("~* é+"), F.col("doc_id").cast("string")))
    return c.documents.select("doc_id", scalars.url_quoted(raw).alias("quoted"))


@query
def html_escaped_texts(c: Corpus) -> DataFrame:
    raw = F.concat(F.lit("<a href=\"x\" id='y'>&amp; "), "text")
    return c.documents.select("doc_id", F.sha2(scalars.html_escaped(raw), 256).alias("escaped_sha256"))


@query
def safe_file_names(c: Corpus) -> DataFrame:
    return read(c.spark, c.sf_dir, "pages").select("page_id", scalars.safe_file_name(F.col("url")).alias("name"))


@query
def json_pointer_values(c: Corpus) -> DataFrame:
    events = read(c.spark, c.sf_dir, "events")
    value = scalars.at_pointer(F.col("props"), "/k")
    return events.groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count(scalars.at_pointer(F.col("props"), "/none/0")).alias("n_none"))


@query
def checked_dates(c: Corpus) -> DataFrame:
    """Order days written in two forms, every seventh as a day that isn't one."""
    orders = read(c.spark, c.sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 7 == 0, F.lit("2025-02-30")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.groupBy(F.date_format(scalars.checked_date(said), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def distribution_gate(c: Corpus) -> DataFrame:
    statement = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 5 == 1, "D").otherwise("A")
    token = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string"))
    return c.documents.groupBy(scalars.distribution(statement, token).alias("status")).agg(F.count(F.lit(1)).alias("components"))


def _as_pages(c: Corpus) -> DataFrame:
    """Documents as pages of one file for each source and language; every ninth is blank and every fourth has Windows lines."""
    text = F.when(F.col("doc_id") % 9 == 0, F.lit(" \n ")).when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit(" \r\n")))).otherwise(F.col("text"))
    return c.documents.select(F.concat_ws("/", "source", "lang").alias("document"), F.col("doc_id").alias("page"), text.alias("text"))


@query
def compiled_pages(c: Corpus) -> DataFrame:
    return pages.placed(_as_pages(c)).select("document", "page", "status", "text_sha256", "start_byte", "end_byte")


@query
def compiled_texts(c: Corpus) -> DataFrame:
    return pages.text_digests(pages.text_parts(_as_pages(c)))


@query
def compiled_parts(c: Corpus) -> DataFrame:
    """The extracted texts as ordered parts, here of 16 KB."""
    found = pages.text_parts(_as_pages(c), 1 << 14)
    return found.select("document", "part", "start_byte", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("text_sha256"))


@query
def spans_in_pages(c: Corpus) -> DataFrame:
    """The middle third of each page, moved out of it for every eleventh, found again by its bytes in the extracted text."""
    made = pages.placed(_as_pages(c)).where("status = 'extracted'")
    third = F.floor((F.col("end_byte") - F.col("start_byte")) / 3)
    moved = F.when(F.col("page") % 11 == 0, F.col("end_byte") - F.col("start_byte")).otherwise(0)
    spans = made.select(F.concat_ws("/", "document", F.col("page").cast("string")).alias("span"), "document", (F.col("start_byte") + third + moved).cast("long").alias("start_byte"), (F.col("end_byte") - third + moved).cast("long").alias("end_byte"))
    return pages.in_pages(spans, made, ["document"]).select("span", "page", "page_start", "page_end", "held")


@query
def composition_identity(c: Corpus) -> DataFrame:
    parts = c.documents.select(F.concat_ws("/", "source", "lang").alias("ident"), F.col("doc_id").alias("ordinal"), "n_chars", F.when(F.col("doc_id") % 6 == 0, F.lit(None).cast("string")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return pages.composition(parts, "ident", ["ordinal", "n_chars", "sha256"])


@query
def unequal_totals(c: Corpus) -> DataFrame:
    """Counts of components by status against a summary that is wrong for one language and names another."""
    said = c.documents.groupBy(F.col("lang").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("status") == "fr", F.col("n") + 1).otherwise(F.col("n")))
    more = c.spark.createDataFrame([("it", 2)], "status string, n long")
    return pages.unequal_totals(c.documents, F.col("lang"), said.union(more)).select("status", F.col("counted").cast("long").alias("counted"), F.col("said").cast("long").alias("said"))


@query
def impacted_records(c: Corpus) -> DataFrame:
    """Records whose evidence is changed by another's change, each once."""
    found = graph.impact(_status(c), _edition_edges(c, "before"), _edition_edges(c, "after"), c.edition("before"), c.edition("after"))
    return found.select("package_digest", "record_id").distinct()


@query
def coverage_once(c: Corpus) -> DataFrame:
    """The packages of all hits, each with its coverage once."""
    hits = c.unnumbered.where(F.contains(F.lower("text"), F.lit("the"))).select("package_digest")
    return hits.join(c.packages.select("package_digest", "identifier", "representation"), "package_digest").dropDuplicates(["package_digest"])


@query
def edges_with_structure(c: Corpus) -> DataFrame:
    """Stored edges and resolved structural relationships as one set: each line is also part of its document's section."""
    part = c.unnumbered.where("parent_record_id is not null").select("package_digest", F.col("record_id").alias("source_record_id"), F.lit("part_of").alias("relationship"), F.col("parent_record_id").alias("target_record_id"), (F.col("pos") % 2 == 0).alias("required"))
    return graph.with_structure(c.dependencies, part).groupBy("package_digest", "relationship").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("required").alias("n_required"))


@query
def outline_review(c: Corpus) -> DataFrame:
    """The first and last line of each page as a candidate; drafts and decisions on them, some changed, missing or twice."""
    made = checkpointed(pages.compiled(_as_pages(c)).where("status = 'extracted'"))
    p, lines = F.col("page"), F.split("text", "\n", -1)
    first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    one = F.size(lines) == 1
    span = lambda a, b: F.struct(a.cast("long").alias("start_byte"), b.cast("long").alias("end_byte"))
    head = span(F.col("start_byte"), F.col("start_byte") + F.octet_length(first) + F.when(p % 13 == 3, 1).otherwise(0))
    spans = F.when(one, F.array(head)).otherwise(F.array(head, span(F.col("end_byte") - F.octet_length(last), F.col("end_byte"))))
    text = F.when(one, first).otherwise(F.concat(first, F.lit("\n"), last))
    name = F.concat(F.lit("page-"), p.cast("string"))
    kind = F.when(p % 14 == 6, "unsupported_region").otherwise("paragraph")
    reference = F.when(p % 28 == 6, F.concat(name, F.lit("-ambiguous-numbered-1"))).otherwise(name)
    candidates = made.select("document", name.alias("record_id"), F.concat(F.lit("log:"), name).alias("logical_id"), kind.alias("kind"), reference.alias("clause_reference"), F.lit("Lines").alias("heading"), F.lit(None).cast("string").alias("parent_logical_id"), text.alias("text"), F.sha2("document", 256).alias("package_digest"), spans.alias("spans"))
    proposed = checkpointed(review.drafts(candidates, made))
    number = F.substring_index("record_id", "-", -1).cast("long")
    given = proposed.where("draft is not null").withColumn("doc_id", number)
    d = F.col("doc_id")
    draft = F.when(d % 11 == 4, F.replace("draft", F.lit(review.STATE), F.lit("approved"))).when(d % 15 == 7, F.concat("draft", F.lit(" "))).otherwise(F.col("draft"))
    given = given.withColumn("draft", draft).withColumn("draft_sha256", F.sha2("draft", 256))
    node = F.from_json(F.get_json_object("draft", "$.proposed_node"), review.NODE)
    shifted = F.transform("n.source_spans", lambda s: F.struct(s["physical_page"].alias("physical_page"), F.when(d % 29 == 8, F.sha2(F.lit("other"), 256)).otherwise(s["page_text_sha256"]).alias("page_text_sha256"), s["start_byte"].alias("start_byte"), (s["end_byte"] + F.when(d % 19 == 5, 1 << 30).otherwise(0)).alias("end_byte")))
    decided = given.withColumn("n", node).where("doc_id % 5 <> 0").select(
        "doc_id",
        F.when(d % 17 == 2, F.sha2(F.lit("none"), 256)).otherwise(F.col("draft_sha256")).alias("draft_sha256"),
        (d % 7 != 1).alias("accepted"),
        F.struct(F.col("n.logical_id").alias("logical_id"), F.lit("clause").alias("kind"), F.concat(F.lit("c-"), "n.clause_reference").alias("clause_reference"), F.col("n.heading").alias("heading"), F.when(d % 23 == 6, "other").otherwise(F.col("n.exact_text")).alias("exact_text"), shifted.alias("source_spans")).alias("node"),
        F.struct(F.lit("r1").alias("reviewer_id"), F.when(d % 31 == 9, "nobody").otherwise("human").alias("reviewer_type"), F.lit("2025-01-01").alias("reviewed_at")).alias("review"),
    )
    decided = decided.union(decided.where("doc_id % 37 = 10 and doc_id % 17 <> 2"))
    found = review.promoted(given, decided, candidates, made)
    at = lambda column, pointer: F.get_json_object(column, pointer)
    result = found.select("record_id", "status", F.sha2(at("annotation", "$.node.exact_text"), 256).alias("content_sha256"), at("annotation", "$.node.source_spans[0].end_byte").cast("long").alias("end_byte"))
    refused = proposed.where("draft is null").select("record_id", "status", F.lit(None).cast("string"), F.lit(None).cast("long"))
    return result.union(refused)


_PAGES = r""", p AS (SELECT source || '/' || lang AS document, doc_id AS page, CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) || ' ' WHEN doc_id % 4 = 0 THEN chr(13) || chr(10) || replace(text, chr(10), ' ' || chr(13) || chr(10)) ELSE text END AS text FROM documents),
n AS (SELECT document, page, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '^\n+|\n+$', '', 'g') AS text FROM p),
m AS (SELECT document, page, coalesce(text, '') <> '' AS there, text, printf('[[PAGE_%04d]]', page) AS mark FROM n),
s AS (SELECT *, coalesce(sum(CASE WHEN there THEN strlen(mark) + 3 + strlen(text) END) OVER (PARTITION BY document ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(mark) + 1 AS first FROM m),
compiled AS (SELECT document, page, CASE WHEN there THEN 'extracted' ELSE 'empty' END AS status, CASE WHEN there THEN sha256(text) END AS text_sha256,
             CASE WHEN there THEN first END::BIGINT AS start_byte, CASE WHEN there THEN first + strlen(text) END::BIGINT AS end_byte FROM s)
"""

_SQL = {
    "url_quoted_paths": "SELECT doc_id, url_encode(source || '/' || upper(lang) || '/~* é+' || doc_id) AS quoted FROM documents",
    "html_escaped_texts": "SELECT doc_id, sha256(replace(replace(replace(replace(replace('<a href=\"x\" id=''y''>&amp; ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM documents",
    "safe_file_names": "SELECT page_id, substr(coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'document'), 1, 72) AS name FROM pages",
    "json_pointer_values": "SELECT json_extract_string(props, '/k') AS k, count(*) AS n, count(json_extract_string(props, '/none/0')) AS n_none FROM events GROUP BY ALL",
    "checked_dates": "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, count(*) AS n FROM orders GROUP BY ALL",
    "distribution_gate": "SELECT CASE WHEN doc_id % 5 < 2 THEN 'restricted_distribution' WHEN doc_id % 3 = 0 THEN 'not_publicly_exposed' ELSE 'pending' END AS status, count(*) AS components FROM documents GROUP BY ALL",
    "compiled_pages": _PAGES + "SELECT * FROM compiled",
    "compiled_texts": _PAGES + "SELECT document, strlen(t) AS bytes, sha256(t) AS text_sha256 FROM (SELECT document, string_agg(mark || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS t FROM m WHERE there GROUP BY document)",
    "compiled_parts": _PAGES + "SELECT document, first // 16384 AS part, min(first - strlen(mark) - 1)::BIGINT AS start_byte, strlen(string_agg(mark || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS bytes, sha256(string_agg(mark || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS text_sha256 FROM s WHERE there GROUP BY document, first // 16384",
    "spans_in_pages": _PAGES + """, x AS (SELECT document, page, start_byte + third + moved AS a, end_byte - third + moved AS b FROM (SELECT *, (end_byte - start_byte) // 3 AS third, CASE WHEN page % 11 = 0 THEN end_byte - start_byte ELSE 0 END AS moved FROM compiled WHERE status = 'extracted'))
SELECT x.document || '/' || x.page AS span, c.page, a - c.start_byte AS page_start, b - c.start_byte AS page_end, c.page IS NOT NULL AS held
FROM x LEFT JOIN compiled c ON c.document = x.document AND a >= c.start_byte AND b <= c.end_byte AND a < b""",
    "outline_review": _PAGES + """, l AS (SELECT page AS d, string_split(text, chr(10)) AS w FROM m WHERE there),
x AS (SELECT d, strlen(w[1]) AS first_bytes, CASE WHEN len(w) = 1 THEN w[1] ELSE w[1] || chr(10) || w[-1] END AS said FROM l),
y AS (SELECT *, CASE WHEN d % 14 = 6 AND d % 28 <> 6 THEN 'outline_candidate_unsupported' WHEN d % 13 = 3 THEN 'outline_source_mismatch' WHEN d % 11 = 4 THEN 'invalid_outline_review' WHEN d % 5 = 0 OR d % 17 = 2 THEN 'undecided'
  WHEN d % 37 = 10 THEN 'repeated_decision' WHEN d % 15 = 7 THEN 'outline_review_stale' WHEN d % 7 = 1 THEN 'rejected' WHEN d % 31 = 9 THEN 'invalid_outline_review' WHEN d % 29 = 8 THEN 'outline_review_stale'
  WHEN d % 19 = 5 THEN 'invalid_outline_review' WHEN d % 23 = 6 THEN 'outline_review_stale' ELSE 'reviewed_annotation_written' END AS status FROM x)
SELECT 'page-' || d AS record_id, status, CASE WHEN status LIKE 'reviewed%' THEN sha256(said) END AS content_sha256, CASE WHEN status LIKE 'reviewed%' THEN first_bytes END::BIGINT AS end_byte FROM y
UNION ALL SELECT DISTINCT NULL, 'outline_review_stale', NULL, NULL::BIGINT FROM y WHERE d % 17 = 2 AND d % 5 <> 0 AND status NOT IN ('outline_candidate_unsupported', 'outline_source_mismatch')""",
    "composition_identity": r"SELECT source || '/' || lang AS ident, count(*) AS n_components, sha256(string_agg(doc_id || chr(9) || n_chars || chr(9) || CASE WHEN doc_id % 6 = 0 THEN '\N' ELSE sha256(text) END, chr(10) ORDER BY doc_id)) AS composition_sha256 FROM documents GROUP BY ALL",
    "unequal_totals": "SELECT * FROM (SELECT lang AS status, count(*) AS counted, count(*) + 1 AS said FROM documents WHERE lang = 'fr' GROUP BY ALL) UNION ALL SELECT 'it', 0, 2",
    "coverage_once": "SELECT package_digest, identifier, representation FROM pkg WHERE package_digest IN (SELECT package_digest FROM rec WHERE contains(lower(text), 'the'))",
    "edges_with_structure": "SELECT package_digest, relationship, count(*) AS n_edges, count(*) FILTER (required) AS n_required FROM (SELECT DISTINCT package_digest, source_record_id, relationship, target_record_id, required FROM dep UNION SELECT package_digest, record_id, 'part_of', parent_record_id, pos % 2 = 0 FROM rec WHERE parent_record_id IS NOT NULL) GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    from lexstrata.plans.oracles import SQL

    impact = SQL["diff_impact_paths"]
    cut = impact.index(" SELECT side, package_digest, record_id")
    _SQL["impacted_records"] = impact[:cut] + "SELECT DISTINCT package_digest, record_id FROM (" + impact[cut:] + ")"
    return {name: CORPUS + sql for name, sql in _SQL.items()}
