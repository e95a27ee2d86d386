"""Registered queries over structure, reviews, source sets, compiles, grants and cases, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.functions import closed
from lexstrata.functions.closed import Closed, Items, Text, Whole
from lexstrata.operators import admin, structure
from lexstrata.operators.graph import checkpointed
from lexstrata.plans.oracles import CORPUS
from lexstrata.plans.queries import _with_spans, query
from lexstrata.sources.adapter import Corpus, read
from lexstrata.sources.folder import shared_folder
from lexstrata.sources.ledger import Compile
from lexstrata.sources.packs import bundle, bundle_faults


@query
def structure_assemble(c: Corpus) -> DataFrame:
    """Every line of each document, put together again from byte spans."""
    spans = _with_spans(c).select("doc_id", F.col("pos").alias("place"), "start_byte", "end_byte")
    out = structure.assembled(spans, c.documents, ["doc_id"], "doc_id")
    return out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "content_sha256")


@query
def structure_span_faults(c: Corpus) -> DataFrame:
    spans = _with_spans(c).select("doc_id", F.col("pos").alias("place"), (F.col("start_byte") - F.when((F.col("doc_id") % 40 == 9) & (F.col("pos") == 1), 3).otherwise(0)).alias("start_byte"), "end_byte")
    return structure.span_faults(spans, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_faults"))


@query
def structure_dependencies(c: Corpus) -> DataFrame:
    nodes = c.unnumbered.select("package_digest", F.concat(F.lit("log:"), "record_id").alias("logical_id"), "record_id")
    status = F.when(F.col("pos") % 5 == 4, "ambiguous").otherwise("resolved")
    linked = c.unnumbered.where("pos > 0").select("package_digest", F.col("record_id").alias("source_record_id"), F.lit("governed_by").alias("relationship"), F.concat(F.lit("log:"), "parent_record_id").alias("target_logical_id"), status.alias("target_status"), (F.col("pos") % 2 == 1).alias("required"))
    found = structure.dependencies_of(linked, nodes)
    return found.groupBy("package_digest").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("target_record_id").alias("n_targets"))


@query
def semantic_checks(c: Corpus) -> DataFrame:
    """Whole lines as statements; those of every tenth document cite a text without their first character."""
    cited = F.when(F.col("doc_id") % 10 == 3, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    faults = structure.semantic_faults(F.col("text"), cited, F.lit("the"), F.lit("with"))
    return c.unnumbered.select(F.explode(faults).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def unresolved_issues(c: Corpus) -> DataFrame:
    raised = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("doc_id") % 3 == 0, "unreviewed")))
    rows = read(c.spark, c.sf_dir, "labels").select((F.col("doc_id") % 25).alias("part"), raised.alias("raised"))
    return structure.issues(rows, "raised", ["part"])


@query
def review_merge(c: Corpus) -> DataFrame:
    """Drafts from documents against decisions from labels, some of them stale, repeated or for no draft."""
    labels = read(c.spark, c.sf_dir, "labels").select("doc_id", "quality")
    drafts = c.documents.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    decided = labels.join(c.documents.select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id")
    sha = F.when(F.col("doc_id") % 13 == 0, F.lit("old")).otherwise(F.col("sha"))
    decisions = decided.select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), sha.alias("content_sha256"))
    decisions = decisions.union(decisions.where("doc_id % 17 = 0"))
    return admin.merged_reviews(drafts, decisions, ["doc_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def source_set_verify(c: Corpus) -> DataFrame:
    files = c.documents.where("doc_id % 19 <> 0").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    size = F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 23 == 0, 1).otherwise(0)
    sha = F.when(F.col("doc_id") % 29 == 0, F.lit("other")).otherwise(F.sha2("text", 256))
    catalog = c.documents.where("doc_id % 17 <> 0").select("doc_id", size.alias("bytes"), sha.alias("sha256"))
    return admin.source_set(catalog, files, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def compile_resume(c: Corpus) -> DataFrame:
    """What is left after an interrupted compile of the first two thirds, summed by language."""
    inputs = c.documents.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), F.size(F.split("text", "\n", -1)).alias("pages"))
    done = c.documents.where("doc_id % 3 <> 2").select("doc_id", F.sha2("text", 256).alias("sha256"))
    left = admin.to_compile(inputs, done, ["doc_id", "sha256"])
    return admin.compile_summary(left.withColumn("error", F.when(F.col("doc_id") % 50 == 5, "pdf_text_layer_empty")), ["lang"])


@query
def grants_obsolete(c: Corpus) -> DataFrame:
    grants = c.packages.select(F.lit("local-user").alias("principal_id"), F.col("edition_id").alias("pack_id"), "package_digest", (F.col("lang") != "de").alias("can_serve"))
    index = c.packages.select(F.col("edition_id").alias("pack_id"), F.when(F.col("lang") == "fr", F.sha2(F.concat("edition_id", F.lit(":2")), 256)).otherwise(F.col("package_digest")).alias("package_digest"))
    return admin.obsolete_grants(grants, index)


@query
def doctor_grants(c: Corpus) -> DataFrame:
    """Grants against packages and policies: English packages are gone, the policy of French ones has changed."""
    installed = c.packages.where("lang <> 'en'")
    policies = c.spark.createDataFrame([("local-user", "")], "principal_id string, current string").select("principal_id", F.sha2(F.lit("policy:es"), 256).alias("policy_fingerprint"))
    return admin.grant_faults(c.grants, installed, policies).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def transcription_pages(c: Corpus) -> DataFrame:
    pages = c.lines.select("doc_id", (F.col("pos") + 1 + F.when((F.col("doc_id") % 30 == 4) & (F.col("pos") > 1), 1).otherwise(0)).alias("physical_page"), "text", F.lit(False).alias("blank"))
    return admin.page_sequence_faults(pages, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_faults"))


@query
def profile_selection(c: Corpus) -> DataFrame:
    n = F.octet_length("text")
    rows = admin.smallest_profile(c.unnumbered, {"detailed": n * 3 + 400, "compact": n + F.octet_length("heading") + 120, "concise": n + F.char_length("record_id") * 9}, 1500)
    return rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query
def benchmark_cases(c: Corpus) -> DataFrame:
    """One case a document: the sections that hold a word are returned, those with two words are relevant."""
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    pick = lambda keep: F.collect_list(F.when(keep, F.col("record_id")))
    cases = c.unnumbered.groupBy("edition_id", "doc_id").agg(pick(has("the")).alias("returned"), pick(has("the") & has("with")).alias("relevant"), pick(has("zz")).alias("forbidden"))
    return admin.scored_cases(cases, ["edition_id"])


LINED = Closed({"doc_id": Whole(), "n_chars": Whole(), "lang": Text(choices=("en", "de", "fr")), "lines": Items(Closed({"chars": Whole(1)}), least=2)})


@query
def closed_schema_faults(c: Corpus) -> DataFrame:
    """Every document as JSON with a number for each line, some with a string for a number, a field too many or too few."""
    d = F.col("doc_id")
    lines = F.to_json(F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.char_length(x).alias("chars"))))
    size = F.when(d % 13 == 0, F.format_string('"%d"', "n_chars")).otherwise(F.col("n_chars").cast("string"))
    lang = F.when(d % 19 == 0, "").otherwise(F.format_string(',"lang":"%s"', "lang"))
    more = F.when(d % 17 == 0, ',"a/b":[{}]').otherwise("")
    cut = F.when(d % 31 == 0, "").otherwise("}")
    text = F.concat(F.lit('{"doc_id":'), d.cast("string"), F.lit(',"n_chars":'), size, lang, more, F.lit(',"lines":'), lines, cut)
    return closed.json_faults(c.documents.select("doc_id", text.alias("json")), F.col("json"), LINED, ["doc_id"])


@query
def compile_ledger(c: Corpus) -> DataFrame:
    """Lines counted for each document: a run over two thirds, a run over all of which some documents have changed since."""
    units = c.documents.select(F.col("doc_id").cast("string").alias("unit"), F.sha2("text", 256).alias("digest"), "doc_id", "text")

    def work(rows: DataFrame) -> DataFrame:
        bad = F.when(F.col("doc_id") % 50 == 5, "pdf_text_layer_empty")
        return rows.select("unit", bad.alias("error"), F.explode(F.when(bad.isNull(), F.split("text", "\n", -1)).otherwise(F.array(F.lit(None).cast("string")))).alias("line")).withColumn("n_chars", F.char_length("line")).drop("line")

    compiled = Compile(c.spark, f"{shared_folder(c.spark)}/compiles/{uuid4().hex}")
    compiled.run(units.where("doc_id % 3 <> 2").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("digest"))), work, slices=2)
    compiled.run(units, work, slices=2)
    made = compiled.results().groupBy("unit").agg(F.sum("n_chars").cast("long").alias("n_chars"))
    out = checkpointed(compiled.outcomes.select("unit", "error", "n_rows", "attempts").join(made, "unit", "left"))
    compiled.remove()
    return out


@query
def bundle_verify(c: Corpus) -> DataFrame:
    """Documents as files of a bundle; some blobs are changed or gone, some members have an unsafe path or another size."""
    d, text = F.col("doc_id"), F.encode("text", "UTF-8")
    files = c.documents.select(F.concat_ws("/", "source", "lang").alias("pack"), F.format_string("sources/%d.txt", d).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), text.alias("content"), "doc_id")
    blobs, _ = bundle(files)
    kept = blobs.where("sha256 not like '2%'").withColumn("content", F.when(F.col("sha256").startswith("1"), F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")))
    path = F.when(d % 41 == 3, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    members = files.select("pack", path.alias("path"), "sha256", (F.col("bytes") + F.when(d % 43 == 4, 1).otherwise(0)).alias("bytes"))
    return bundle_faults(kept, members).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha256").alias("n_blobs"))


SQL = {
    "bundle_verify": """, f AS (SELECT doc_id, sha256(text) AS h FROM documents),
b AS (SELECT 'blob_hash_mismatch' AS code, h FROM f WHERE h LIKE '1%' GROUP BY h UNION ALL SELECT 'blob_size_mismatch', h FROM f WHERE h LIKE '1%' GROUP BY h UNION ALL SELECT 'blob_missing', h FROM f WHERE h LIKE '2%'
UNION ALL SELECT 'invalid_pack_path', h FROM f WHERE doc_id % 41 = 3 UNION ALL SELECT 'member_size_mismatch', h FROM f WHERE doc_id % 43 = 4 AND h NOT LIKE '2%')
SELECT code, count(*) AS n, count(DISTINCT h) AS n_blobs FROM b GROUP BY code""",
    "closed_schema_faults": """, d AS (SELECT *, string_split(text, chr(10)) AS parts, doc_id % 31 <> 0 AS whole FROM documents)
SELECT doc_id, '' AS path, 'invalid_json' AS fault FROM d WHERE NOT whole
UNION ALL SELECT doc_id, '/n_chars', 'wrong_type' FROM d WHERE whole AND doc_id % 13 = 0
UNION ALL SELECT doc_id, '/a~1b', 'unknown_field' FROM d WHERE whole AND doc_id % 17 = 0
UNION ALL SELECT doc_id, '/lang', CASE WHEN doc_id % 19 = 0 THEN 'missing_field' ELSE 'not_allowed' END FROM d WHERE whole AND (doc_id % 19 = 0 OR lang NOT IN ('en', 'de', 'fr'))
UNION ALL SELECT doc_id, '/lines', 'out_of_range' FROM d WHERE whole AND len(parts) < 2
UNION ALL SELECT doc_id, '/lines/' || i || '/chars', 'out_of_range' FROM (SELECT doc_id, parts, whole, unnest(range(len(parts))) AS i FROM d) WHERE whole AND parts[i + 1] = ''""",
    "compile_ledger": """, d AS (SELECT *, doc_id % 50 = 5 AS bad, string_split(text, chr(10)) AS parts FROM documents)
SELECT '' || doc_id AS unit, CASE WHEN bad THEN 'pdf_text_layer_empty' END AS error, CASE WHEN bad THEN 1 ELSE len(parts) END::BIGINT AS n_rows, CASE WHEN doc_id % 3 <> 2 AND (bad OR doc_id % 7 = 0) THEN 2 ELSE 1 END::BIGINT AS attempts,
CASE WHEN NOT bad THEN length(text) - len(parts) + 1 END::BIGINT AS n_chars FROM d""",
    "structure_assemble": "SELECT doc_id, length(t) AS n_chars, sha256(t) AS content_sha256 FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM span GROUP BY doc_id)",
    "structure_span_faults": """, s AS (SELECT doc_id, pos, start_byte - CASE WHEN doc_id % 40 = 9 AND pos = 1 THEN 3 ELSE 0 END AS b, end_byte AS e FROM span),
f AS (SELECT *, b >= e OR b < lag(e, 1, 0) OVER w OR row_number() OVER w > 64 AS bad FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS n_faults FROM f WHERE bad GROUP BY doc_id""",
    "structure_dependencies": "SELECT package_digest, count(*) AS n_edges, count(DISTINCT parent_record_id) AS n_targets FROM rec WHERE pos > 0 AND pos % 2 = 1 AND pos % 5 <> 4 GROUP BY ALL",
    "semantic_checks": """, y AS (SELECT unnest([CASE WHEN doc_id % 10 = 3 THEN 'text_not_cited' END, CASE WHEN NOT contains(lower(text), 'with') THEN 'subject_not_in_text' END,
  CASE WHEN NOT list_contains(regexp_split_to_array(lower(text), '\\s+'), 'the') THEN 'modality_not_in_text' END]) AS code FROM rec)
SELECT code, count(*) AS n FROM y WHERE code IS NOT NULL GROUP BY code""",
    "unresolved_issues": """, x AS (SELECT DISTINCT doc_id % 25 AS part, unnest([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 3 = 0 THEN 'unreviewed' END]) AS issue FROM labels)
SELECT part, string_agg(issue, ',' ORDER BY issue) AS issues, count(*) AS n_issues FROM x WHERE issue IS NOT NULL GROUP BY part""",
    "review_merge": """, d AS (SELECT doc_id, quality FROM labels SEMI JOIN documents USING (doc_id)), r AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)
SELECT CASE WHEN r.doc_id IS NULL THEN 'unknown_draft' WHEN d.doc_id IS NULL THEN 'undecided' WHEN d.doc_id % 17 = 0 THEN 'repeated_decision' WHEN d.doc_id % 13 = 0 THEN 'stale' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n
FROM r FULL JOIN d USING (doc_id) GROUP BY ALL""",
    "source_set_verify": """SELECT CASE WHEN doc_id % 19 = 0 THEN 'source_file_missing' WHEN doc_id % 17 = 0 THEN 'source_set_mismatch' WHEN doc_id % 23 = 0 THEN 'source_size_mismatch' WHEN doc_id % 29 = 0 THEN 'source_hash_mismatch' ELSE 'verified' END AS status, count(*) AS n
FROM documents WHERE NOT (doc_id % 19 = 0 AND doc_id % 17 = 0) GROUP BY ALL""",
    "compile_resume": """SELECT lang, count(*) AS inputs, count(*) FILTER (doc_id % 50 = 5) AS failed, sum(len(string_split(text, chr(10))))::BIGINT AS pages, CASE WHEN count(*) FILTER (doc_id % 50 = 5) > 0 THEN 'corpus_compile_incomplete' ELSE 'complete' END AS status
FROM documents WHERE doc_id % 3 = 2 GROUP BY lang""",
    "grants_obsolete": "SELECT 'local-user' AS principal_id, edition_id AS pack_id, package_digest, sha256(edition_id || ':2') AS current_digest FROM pkg WHERE lang = 'fr'",
    "doctor_grants": "SELECT CASE WHEN lang = 'en' THEN 'package_missing' ELSE 'policy_changed' END AS code, count(*) AS n FROM pkg WHERE lang IN ('en', 'fr') GROUP BY ALL",
    "transcription_pages": "SELECT doc_id, count(*) AS n_faults FROM lines WHERE doc_id % 30 = 4 AND pos > 1 GROUP BY doc_id",
    "profile_selection": """, s AS (SELECT strlen(text) * 3 + 400 AS d, strlen(text) + strlen(heading) + 120 AS m, strlen(text) + length(record_id) * 9 AS k FROM rec),
p AS (SELECT least(d, m, k) AS bytes, CASE WHEN least(d, m, k) > 1500 THEN 'budget_too_small' WHEN m = least(d, m, k) THEN 'compact' WHEN k = least(d, m, k) THEN 'concise' ELSE 'detailed' END AS profile FROM s)
SELECT profile, count(*) AS n, sum(CASE WHEN profile <> 'budget_too_small' THEN bytes END)::BIGINT AS bytes FROM p GROUP BY profile""",
    "benchmark_cases": """, x AS (SELECT edition_id, doc_id, contains(lower(text), 'the') AS t, contains(lower(text), 'with') AS w, contains(lower(text), 'zz') AS z FROM rec),
c AS (SELECT edition_id, doc_id, count(*) FILTER (t) AS ret, count(*) FILTER (t AND w) AS rel, count(*) FILTER (t AND z) AS bad FROM x GROUP BY ALL)
SELECT edition_id, count(*) AS n_cases, count(*) FILTER (bad = 0) AS passed, round(sum(rel)::DOUBLE / nullif(sum(rel), 0), 6) AS recall, sum(bad)::BIGINT AS forbidden_hits, round(sum(rel)::DOUBLE / nullif(sum(ret), 0), 6) AS precision FROM c GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    return {name: CORPUS + sql for name, sql in SQL.items()}
