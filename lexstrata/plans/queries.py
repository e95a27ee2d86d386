"""The registered queries of the evidence engine, over the adapted corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import normalized_identifier, parse, tokens
from lexstrata.operators import catalog, coverage, diff, graph, outline, postings, verify
from lexstrata.operators import search as lexical
from lexstrata.sources.adapter import Corpus, read
from lexstrata.sources.html_tables import table_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EN_PACKAGE = "fam:src0:en"


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
    return f


def digest_of(edition: str):
    return F.sha2(F.lit(edition), 256)


# Scans -------------------------------------------------------------------------------------------


@query
def adapter_records(c: Corpus) -> DataFrame:
    return c.records.groupBy("package_digest").agg(F.count(F.lit(1)).alias("n_records"), F.sum("ordinal").alias("ordinals"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.min("record_id").alias("first_id"), F.max("clause_reference").alias("last_clause"))


@query
def adapter_packages(c: Corpus) -> DataFrame:
    return c.packages.drop("lang")


@query
def adapter_dependencies(c: Corpus) -> DataFrame:
    return c.dependencies.groupBy("package_digest").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("required").alias("n_required"), F.min("source_record_id").alias("first_source"), F.max("target_record_id").alias("last_target"))


@query
def records_of_package(c: Corpus) -> DataFrame:
    return c.records.where(F.col("package_digest") == digest_of(EN_PACKAGE)).select("record_id", "clause_reference", "kind", "heading", "ordinal")


@query
def records_by_ids(c: Corpus) -> DataFrame:
    wanted = c.spark.createDataFrame([(0, "d20-l0"), (1, "d0-l1"), (2, "missing"), (3, "d0-l0")], "place long, record_id string")
    return c.unnumbered.join(F.broadcast(wanted), "record_id").select("place", "record_id", "clause_reference", "heading")


# Catalog -----------------------------------------------------------------------------------------


@query
def authorized_packages(c: Corpus) -> DataFrame:
    return c.authorized().select("package_digest", "edition_id", "identifier", "policy_fingerprint")


@query
def authorized_inventory_counts(c: Corpus) -> DataFrame:
    return catalog.inventory(c.authorized(), c.unnumbered).select("package_digest", "identifier", "record_count")


@query
def list_documents_page1(c: Corpus) -> DataFrame:
    return catalog.listing(c.authorized(), limit=5).select("identifier", "edition_id", "representation", "package_digest")


@query
def list_documents_after_key(c: Corpus) -> DataFrame:
    after = {"identifier": "SRC12-EN", "family_id": "fam:src12", "edition_id": "fam:src12:en", "representation": "page_text", "package_digest": ""}
    return catalog.listing(c.authorized(), after=after, limit=5).select("identifier", "edition_id", "representation", "package_digest")


@query
def list_documents_prefix(c: Corpus) -> DataFrame:
    return catalog.listing(c.authorized(), prefix="SRC1", limit=None).select("identifier", "edition_id", "representation", "package_digest")


@query
def resolve_exact(c: Corpus) -> DataFrame:
    return catalog.resolved(c.authorized(), "SRC3-EN").select("package_digest", "edition_id", "representation")


@query
def resolve_ambiguous(c: Corpus) -> DataFrame:
    """A family is ambiguous where it has more than one authorised edition."""
    return c.authorized().groupBy("family_id").agg(F.count(F.lit(1)).alias("n_editions"), F.when(F.count(F.lit(1)) > 1, "ambiguous_document").otherwise("resolved").alias("outcome"))


@query
def resolve_candidates(c: Corpus) -> DataFrame:
    return catalog.near_matches(c.authorized(), "SRC1").select("identifier", "edition_id", "match_basis")


@query
def normalize_identifier_ascii(c: Corpus) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("source"), F.lit("  - "), F.col("lang"), F.lit(" /  x "))
    return c.documents.select("doc_id", normalized_identifier(raw).alias("identifier"))


@query
def visibility_fingerprint(c: Corpus) -> DataFrame:
    item = F.concat(F.lit('["'), "package_digest", F.lit('","'), "policy_fingerprint", F.lit('"]'))
    return catalog.set_digest(c.authorized().withColumn("principal_id", F.lit("local-user")), item, ["principal_id"])


@query
def package_digest_rollup(c: Corpus) -> DataFrame:
    item = F.concat(F.lit('["d'), F.col("doc_id").cast("string"), F.lit('","'), F.sha2("text", 256), F.lit('"]'))
    return catalog.set_digest(c.documents, item, ["source", "lang"])


@query
def grants_latest(c: Corpus) -> DataFrame:
    """Grant and revoke events, the latest of each key; kept as one aggregate by package."""
    granted = c.grants.select("principal_id", "package_digest", F.lit(1).alias("generation"), F.lit(True).alias("can_serve"))
    revoked = c.grants.where("not can_serve").select("principal_id", "package_digest", F.lit(2).alias("generation"), F.lit(False).alias("can_serve"))
    latest = F.max_by("can_serve", "generation").alias("can_serve")
    return granted.union(revoked).groupBy("principal_id", "package_digest").agg(latest, F.max("generation").cast("long").alias("generation"))


@query
def coverage_status_dimensions(c: Corpus) -> DataFrame:
    edition = F.when(F.col("lang") == "en", "complete").when(F.col("lang") == "fr", "partial_pages").otherwise("declared_elsewhere")
    parsing = F.when(F.col("lang") == "es", "text_layer_extracted_all").otherwise("complete_for_fixture")
    return c.packages.select("package_digest", catalog.coverage_status(edition).alias("edition_status"), catalog.coverage_status(parsing).alias("parsing_status"), catalog.source_status(edition, parsing).alias("source_status"))


# Search ------------------------------------------------------------------------------------------


@query
def tokenize_counts(c: Corpus) -> DataFrame:
    # A generator of one row, so that texts are tokenized once for both columns.
    listed = c.documents.select("doc_id", F.inline(F.array(F.struct(tokens(F.col("text")).alias("listed")))))
    return listed.select("doc_id", F.size("listed").cast("long").alias("n_tokens"), F.size(F.array_distinct("listed")).cast("long").alias("n_distinct"))


@query
def token_postings_topn(c: Corpus) -> DataFrame:
    listed = c.documents.select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    counts = listed.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_documents"))
    return counts.orderBy(F.desc("n_occurrences"), "token").limit(50)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("package_digest", "record_id", "clause_reference", "ordinal", "score")


@query
def search_index(c: Corpus) -> DataFrame:
    """The stored index, built by the first query of an application that needs it: its size by column."""
    begins = F.concat(F.array(F.lit(0)), "ends").alias("begins")  # one more than there are postings
    words = c.index.where("kind = 'posting'").select("token", F.inline(F.arrays_zip("places", "ends", begins))).where("places is not null")
    return words.groupBy(F.col("places").cast("long").alias("place")).agg(F.count(F.lit(1)).alias("n_postings"), F.sum(F.col("ends") - F.col("begins")).cast("long").alias("n_tokens"), F.min("token").alias("first_token"))


def _search(c: Corpus, text: str, mode: str, **narrowed: str) -> tuple[DataFrame, bool]:
    return postings.search(c.postings, c.authorized(), text, mode, **narrowed, blocks=c.promises)


@query
def search_all_terms(c: Corpus) -> DataFrame:
    return _hits(_search(c, "that with", "all_terms")[0])


@query
def search_pruned(c: Corpus) -> DataFrame:
    """The same search by what the index's blocks promise, whatever the size of the index."""
    return _hits(postings.pruned(c.postings, c.blocks, c.authorized(), parse("that with", "all_terms")))


@query
def search_any_terms(c: Corpus) -> DataFrame:
    return _hits(_search(c, "Avec pour which", "any_terms")[0])


@query
def search_exact_phrase(c: Corpus) -> DataFrame:
    return _hits(_search(c, "to the", "exact_phrase")[0])


@query
def search_pinned_scoped(c: Corpus) -> DataFrame:
    from hashlib import sha256

    return _hits(_search(c, "the of", "all_terms", package_digest=sha256(b"fam:src1:en").hexdigest(), scope="1")[0])


@query
def search_natural(c: Corpus) -> DataFrame:
    return _hits(_search(c, "What is the nation of heats?", "natural_language")[0])


@query
def search_natural_relaxed(c: Corpus) -> DataFrame:
    found, relaxed = _search(c, "nonexistenttopic avec", "natural_language")
    return _hits(found).withColumn("relaxed", F.lit(relaxed))


@query
def search_concept(c: Corpus) -> DataFrame:
    return _hits(_search(c, "time avec", "concept_language")[0])


@query
def search_scan_all_terms(c: Corpus) -> DataFrame:
    """The same search without an index: texts are tokenized in the scan."""
    return _hits(lexical.search(c.records, c.authorized(), "that with", "all_terms")[0])


@query
def search_snippets(c: Corpus) -> DataFrame:
    found = graph.checkpointed(_search(c, "that with", "all_terms")[0])
    return lexical.snippets(postings.with_text(found, c.around(found).unnumbered, 20), parse("that with", "all_terms")).select("record_id", "matched_snippet", "score")


@query
def search_many(c: Corpus) -> DataFrame:
    """A batch of queries, each from the postings of its own tokens."""
    words = {"q1": "that", "q2": "avec", "q3": "from", "q4": "pour"}
    found = postings.many(c.postings, c.authorized(), {k: parse(v, "all_terms") for k, v in words.items()}, 10, c.promises)
    return found.select("query", "package_digest", "record_id", "score", F.col("place").cast("long").alias("place"))


@query
def search_heading_ancestry(c: Corpus) -> DataFrame:
    found = graph.checkpointed(_search(c, "that with", "all_terms")[0])
    above = graph.ancestry(c.around(found).unnumbered)
    return found.join(above, ["package_digest", "record_id"]).select("record_id", F.concat_ws("/", "path").alias("ancestors"), "score")


@query
def scope_filter(c: Corpus) -> DataFrame:
    return c.unnumbered.where(lexical.in_scope(F.col("clause_reference"), "1")).select("record_id", "clause_reference")


# Obligations, closures, navigation ------------------------------------------------------------------


@query
def obligations_page(c: Corpus) -> DataFrame:
    rows = c.with_roles(c.records.where(F.col("package_digest") == digest_of(EN_PACKAGE))).where("statement_role = 'obligation' and ordinal > 5")
    return rows.orderBy("ordinal", "record_id").limit(21).select("record_id", "clause_reference", "ordinal")


@query
def obligations_total_by_package(c: Corpus) -> DataFrame:
    return c.with_roles(c.unnumbered).groupBy("package_digest").agg(F.count_if(F.col("statement_role") == "obligation").alias("obligations"), F.count_if(F.col("statement_role") == "informative").alias("informative"), F.count(F.lit(1)).alias("records"))



@query
def closure_required(c: Corpus) -> DataFrame:
    return graph.closure(c.unnumbered, c.dependencies).select("package_digest", "record_id")


@query
def closure_multi_root(c: Corpus) -> DataFrame:
    return graph.reach_summary(c.unnumbered, c.dependencies)


@query
def closure_depth_histogram(c: Corpus) -> DataFrame:
    _, sets = graph.reaches(c.unnumbered, c.dependencies)
    return sets.groupBy("depth").agg(F.sum(F.size("members")).cast("long").alias("n"))


@query
def closure_ordered(c: Corpus) -> DataFrame:
    """A request for each document: the last of its lines, then the others from the first on."""
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    roots = c.unnumbered.select("package_digest", F.col("doc_id").cast("string").alias("request"), "record_id", F.when(F.col("pos") == last, 0).otherwise(F.col("pos") + 1).cast("long").alias("root_pos"))
    return graph.ordered_closure(roots, c.dependencies).select("package_digest", "request", "root_pos", "level", "record_id", "place")


@query
def nav_all(c: Corpus) -> DataFrame:
    return c.records.where(F.col("package_digest") == digest_of(EN_PACKAGE)).orderBy("ordinal", "record_id").limit(51).select("record_id", "kind", "ordinal")


@query
def nav_roots(c: Corpus) -> DataFrame:
    return c.unnumbered.where("parent_record_id is null").select("package_digest", "record_id", "heading")


@query
def nav_children(c: Corpus) -> DataFrame:
    return c.unnumbered.where("parent_record_id = 'd0-l0'").select("record_id", "clause_reference", "heading")


@query
def nav_parent(c: Corpus) -> DataFrame:
    return c.unnumbered.where("parent_record_id is not null").groupBy("parent_record_id").agg(F.count(F.lit(1)).alias("n_children"))


@query
def nav_adjacent(c: Corpus) -> DataFrame:
    return graph.neighbours(c.records)


@query
def nav_outgoing(c: Corpus) -> DataFrame:
    return graph.edges_of(c.dependencies, c.unnumbered, "outgoing").select("anchor_id", "relationship", "record_id", "required")


@query
def nav_incoming(c: Corpus) -> DataFrame:
    return graph.edges_of(c.dependencies, c.unnumbered, "incoming").select("anchor_id", "relationship", "record_id", "required")


@query
def ancestor_paths(c: Corpus) -> DataFrame:
    return graph.ancestry(c.unnumbered).select("package_digest", "record_id", F.concat_ws("/", "path").alias("ancestors"))


@query
def enumerate_obligations_with_context(c: Corpus) -> DataFrame:
    page = c.with_roles(c.records.where(F.col("package_digest") == digest_of(EN_PACKAGE))).where("statement_role = 'obligation'").orderBy("ordinal", "record_id").limit(50)
    found = graph.closure(page, c.dependencies.where(F.col("package_digest") == digest_of(EN_PACKAGE)), by_root=True)
    return found.select("root_id", "record_id", "depth")


# Editions -------------------------------------------------------------------------------------------


def _status(c: Corpus) -> DataFrame:
    return diff.status(c.edition("before"), c.edition("after"))


@query
def diff_status(c: Corpus) -> DataFrame:
    return _status(c)


@query
def diff_counts(c: Corpus) -> DataFrame:
    return diff.counts(_status(c))


@query
def diff_alignment(c: Corpus) -> DataFrame:
    return diff.alignment(c.edition("before"), c.edition("after"), ["kind", "clause_reference"])


def _edition_edges(c: Corpus, side: str) -> DataFrame:
    doc = F.regexp_extract("source_record_id", r"^d(\d+)-", 1).try_cast("long")  # filters may be tried on other ids
    gone = 0 if side == "before" else 1
    edges = c.dependencies.where(doc % 10 != gone)
    if side == "after":
        edges = edges.where(~((doc % 10 == 4) & F.col("source_record_id").endswith("-l3"))).withColumn("required", F.when(doc % 10 == 5, True).otherwise(F.col("required")))
    return edges


@query
def diff_edges_added(c: Corpus) -> DataFrame:
    return diff.edge_delta(_edition_edges(c, "after"), _edition_edges(c, "before"))


@query
def diff_edges_removed(c: Corpus) -> DataFrame:
    return diff.edge_delta(_edition_edges(c, "before"), _edition_edges(c, "after"))


@query
def diff_impact_paths(c: Corpus) -> DataFrame:
    b, a = c.edition("before"), c.edition("after")
    found = graph.impact(_status(c), _edition_edges(c, "before"), _edition_edges(c, "after"), b, a)
    return found.groupBy("side", "package_digest", "record_id", "cause_type", "cause_record_id").agg(F.min("depth").alias("depth"))


# Verification ---------------------------------------------------------------------------------------


def _with_spans(c: Corpus) -> DataFrame:
    every = c.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    spans = verify.spans_of_lines(every)
    return spans.withColumn("quote_sha256", F.sha2("text", 256))


@query
def verify_spans(c: Corpus) -> DataFrame:
    return _with_spans(c).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("end_byte").alias("end_byte"), F.sum("start_byte").alias("starts"))


@query
def verify_quotes(c: Corpus) -> DataFrame:
    """Spans checked against their source; every 100th document's spans are moved to show violations."""
    moved = _with_spans(c).withColumn("end_byte", F.when((F.col("doc_id") % 100 == 3) & (F.col("end_byte") > F.col("start_byte")), F.col("end_byte") - 1).otherwise(F.col("end_byte")))
    faults = verify.quote_faults(moved, c.documents.select("doc_id", F.col("text").alias("source_text")), "doc_id")
    return faults.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_faults"))


@query
def dq_duplicate_keys(c: Corpus) -> DataFrame:
    return verify.duplicate_keys(c.unnumbered.select("package_digest", "heading"), ["package_digest", "heading"])


@query
def dq_dangling_edges(c: Corpus) -> DataFrame:
    return verify.dangling_edges(c.dependencies, c.unnumbered.where("pos <> 5")).select("package_digest", "source_record_id", "target_record_id")


def _looped(c: Corpus) -> DataFrame:
    """Records whose parent is their line's half, but in every seventh document line 1 hangs on line 3 and line 0 on itself."""
    doc, pos = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-l")), F.col("pos")
    half = F.concat(doc, F.expr("pos div 2").cast("string"))
    looped = F.col("doc_id") % 7 == 0
    parent = F.when(looped & (pos == 0), F.col("record_id")).when(looped & (pos == 1), F.concat(doc, F.lit("3"))).when(pos > 0, half)
    return c.unnumbered.select("package_digest", "record_id", parent.alias("parent_record_id"))


@query
def dq_cycles(c: Corpus) -> DataFrame:
    """The members of each cycle of parents."""
    return graph.cycles(_looped(c))


@query
def dq_depths(c: Corpus) -> DataFrame:
    """How many records stand how deep, those above which a cycle stands apart."""
    return graph.depths(_looped(c)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query
def dq_required_edge_parity(c: Corpus) -> DataFrame:
    """Required edges against those that the lines' structure asks for, both ways."""
    stored = c.dependencies.where("required").select("package_digest", "source_record_id", "target_record_id")
    doc = F.regexp_extract("record_id", r"^(d\d+-l)", 1)
    asked = c.unnumbered.where("pos > 0 and pos % 2 = 1").select("package_digest", F.col("record_id").alias("source_record_id"), F.concat(doc, F.expr("pos div 2").cast("string")).alias("target_record_id"))
    return stored.exceptAll(asked).withColumn("fault", F.lit("not_asked")).union(asked.exceptAll(stored).withColumn("fault", F.lit("not_stored")))


# Coverage -------------------------------------------------------------------------------------------


@query
def coverage_ledger(c: Corpus) -> DataFrame:
    return coverage.ledger(c.documents, ["source", "lang"])


@query
def coverage_partition_check(c: Corpus) -> DataFrame:
    lines = _with_spans(c)
    size = c.documents.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    stop = F.least(F.col("end_byte") + 1, F.col("size"))
    shifted = lines.join(size, "doc_id").select("doc_id", (F.col("start_byte") + F.when((F.col("doc_id") % 50 == 7) & (F.col("pos") == 1), 1).otherwise(0)).alias("start"), stop.alias("stop"), "size")
    return coverage.partition_faults(shifted.where("stop > start or start = 0"), ["doc_id"])


@query
def coverage_interval_union(c: Corpus) -> DataFrame:
    lines = _with_spans(c)
    spans = lines.select("doc_id", F.greatest(F.lit(0), F.col("start_byte") - F.col("pos") % 7).alias("start"), (F.col("end_byte") + F.col("pos") % 5).alias("stop")).where("start < stop")
    return coverage.linked_bytes(spans, ["doc_id"])


# Outlines, sources, bundles --------------------------------------------------------------------------


def _pages(c: Corpus) -> DataFrame:
    """Documents as pages: each fourth line becomes a numbered heading, each seventh a note."""
    def marked(x, i):
        number = ((i + 1) / 4).cast("int").cast("string")
        return F.when(i % 28 == 27, F.concat(F.lit("TABLE "), number, F.lit(". "), x)).when(i % 4 == 3, F.concat(number, F.lit(".1  "), x)).when(i % 7 == 6, F.concat(F.lit("NOTE "), x)).otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n")
    return c.documents.select(F.concat_ws("/", "source", "lang").alias("component"), F.col("doc_id").alias("page"), text.alias("text"))


@query
def outline_candidates(c: Corpus) -> DataFrame:
    return outline.page_candidates(_pages(c)).groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def outline_numbered_lines(c: Corpus) -> DataFrame:
    """Numbered-heading lines by the pattern that both engines' regular expressions can say."""
    lines = _pages(c).select("component", "page", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    found = lines.select("component", "page", F.regexp_extract("line", r"^[ \t]*(\d+(\.\d+)+)[ \t]{2,}[^ \t\r\n]", 1).alias("label")).where("label <> ''")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"))


@query
def outline_kind_counts(c: Corpus) -> DataFrame:
    return outline.compile_outline(_pages(c)).groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def outline_parent_tree(c: Corpus) -> DataFrame:
    rows = outline.compile_outline(_pages(c))
    up = rows.select("component", F.col("seq").alias("parent_seq"), F.col("reference").alias("parent_reference"))
    return rows.join(up, ["component", "parent_seq"]).groupBy("component", "parent_reference").agg(F.count(F.lit(1)).alias("n_children"))


@query
def outline_occurrences(c: Corpus) -> DataFrame:
    lines = _pages(c).select("component", "page", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    found = lines.select("component", "page", "pos", F.regexp_extract("line", r"^[ \t]*(\d+(\.\d+)+)[ \t]{2,}[^ \t\r\n]", 1).alias("label")).where("label <> ''")
    return outline.occurrences(found, ["component", "label"], ["page", "pos"]).groupBy("component", "label").agg(F.max("occurrence").alias("occurrences"))


@query
def html_table_rows(c: Corpus) -> DataFrame:
    rows = table_rows(read(c.spark, c.sf_dir, "pages"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).cast("long").alias("n_cells"))


@query
def html_list_items(c: Corpus) -> DataFrame:
    """List items by expression alone, without a parser."""
    pages = read(c.spark, c.sf_dir, "pages")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("n_items"))


@query
def acquisition_summary(c: Corpus) -> DataFrame:
    status = F.when(F.col("lang") == "es", "restricted").when(F.col("n_chars") < 500, "not_exposed").otherwise("downloadable")
    return c.documents.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("components"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query
def bundle_dedup_stats(c: Corpus) -> DataFrame:
    blobs = c.documents.groupBy("source", F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).cast("long").alias("bytes"))
    return blobs.groupBy("source").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("blobs"), F.sum(F.col("n") * F.col("bytes")).alias("logical_bytes"), F.sum("bytes").alias("unique_bytes"))


@query
def follow_references(c: Corpus) -> DataFrame:
    """One hop over reviewed bindings: section n of a source refers to section n + 1 of another language."""
    heads = c.unnumbered.where("pos = 0").select("record_id", "doc_id", "package_digest", F.sha2("text", 256).alias("text_sha256"))
    bound = heads.select(F.col("record_id").alias("source_record_id"), F.col("package_digest").alias("source_package"), (F.col("doc_id") + 1).alias("doc_id"))
    served = c.authorized().select("package_digest")
    target = heads.join(served, "package_digest", "left_semi")
    ok = bound.join(target, "doc_id", "left").join(served.withColumnRenamed("package_digest", "source_package"), "source_package", "left_semi")
    return ok.select("source_record_id", F.col("record_id").alias("target_record_id"), "text_sha256", F.when(F.col("record_id").isNull(), "unresolved").otherwise("resolved").alias("status"))


@query
def concise_relationships(c: Corpus) -> DataFrame:
    """Edges merged by (source target, relationship) with their sources as one sorted list."""
    return c.dependencies.groupBy("package_digest", "target_record_id", "relationship").agg(F.array_join(F.array_sort(F.collect_set("source_record_id")), ",").alias("sources"), F.bool_or("required").alias("any_required"))


# Evaluation -----------------------------------------------------------------------------------------


@query
def eval_metrics(c: Corpus) -> DataFrame:
    """Recall of a search against expected records, with a null ratio where nothing was expected."""
    rows = lexical.token_columns(c.records.join(c.authorized().select("package_digest"), "package_digest", "left_semi"), False)
    expected = F.array_contains("text_tokens", "that") & F.array_contains("text_tokens", "with")
    found = F.array_contains("heading_tokens", "that") & F.array_contains("text_tokens", "with")
    sums = rows.groupBy("package_digest").agg(F.count_if(expected).alias("relevant"), F.count_if(expected & found).alias("retrieved"))
    return sums.select("package_digest", "relevant", "retrieved", F.round(F.try_divide(F.col("retrieved").cast("double"), F.col("relevant").cast("double")), 6).alias("recall"))


@query
def answer_adjudication(c: Corpus) -> DataFrame:
    """An answer passes if it is supported, all its citations exist and all criteria pass."""
    labels = read(c.spark, c.sf_dir, "labels")
    cited = labels.select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    there = c.unnumbered.select("doc_id", F.col("pos").cast("int").alias("pos"), F.lit(True).alias("present"))
    checked = cited.join(there, ["doc_id", "pos"], "left").groupBy("doc_id", "quality", "toxic").agg(F.bool_and(F.coalesce("present", F.lit(False))).alias("all_cited"))
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("all_cited"), "pass").otherwise("fail")
    return checked.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if("all_cited").alias("fully_cited"))


@query
def budget_bytes(c: Corpus) -> DataFrame:
    """Bytes of each record's compact packet, its own count included."""
    body = F.concat(F.lit('{"record_id":"'), "record_id", F.lit('","text":"'), "text", F.lit('","used":'))
    base = F.octet_length(body) + 1
    used = base + F.char_length((base + F.char_length(base.cast("string"))).cast("string"))
    used = base + F.char_length(used.cast("string"))
    return c.unnumbered.groupBy("package_digest").agg(F.sum(used).cast("long").alias("bytes"), F.max(used).cast("long").alias("largest"))


@query
def event_rollup(c: Corpus) -> DataFrame:
    """Hourly counts by type of the driver's event table."""
    events = read(c.spark, c.sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
