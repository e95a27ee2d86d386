"""DuckDB SQL of the registered queries, over the same Parquet tables.

The adapted corpus is written once as common table expressions and put before
each statement; DuckDB drops those that a statement doesn't use.
"""

from __future__ import annotations

from lexstrata.functions.text import FOLD_FROM, FOLD_TO

TOKENS = "regexp_extract_all(lower(translate({}, '" + FOLD_FROM + "', '" + FOLD_TO + r"')), '[\p{L}\p{N}\p{Co}]+')"


def tokens(column: str) -> str:
    return TOKENS.replace("{}", column)


CORPUS = """
WITH RECURSIVE
ed AS (SELECT *, 'fam:' || source || ':' || lang AS edition_id, sha256('fam:' || source || ':' || lang) AS package_digest FROM documents),
pkg AS (SELECT DISTINCT package_digest, 'fam:' || source AS family_id, edition_id, upper(source || '-' || lang) AS identifier, lang,
               CASE WHEN lang = 'en' THEN 'page_text' ELSE 'curated_records' END AS representation FROM ed),
kept AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS w FROM ed),
lines AS (SELECT package_digest, edition_id, doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS text FROM kept),
rec AS (SELECT package_digest, edition_id, 'd' || doc_id || '-l' || pos AS record_id,
               CASE WHEN pos = 0 THEN '' || doc_id ELSE doc_id || '.' || pos END AS clause_reference,
               substr(text, 1, 60) AS heading, CASE WHEN pos = 0 THEN 'section' ELSE 'clause' END AS kind, text, doc_id, pos,
               CASE WHEN pos > 0 THEN 'd' || doc_id || '-l0' END AS parent_record_id,
               row_number() OVER (PARTITION BY package_digest ORDER BY doc_id, pos) - 1 AS ordinal FROM lines),
dep AS (SELECT package_digest, 'd' || doc_id || '-l' || pos AS source_record_id, 'governed_by' AS relationship,
               'd' || doc_id || '-l' || (pos // 2) AS target_record_id, pos % 3 <> 0 AS required, doc_id FROM lines WHERE pos > 0),
grants AS (SELECT 'local-user' AS principal_id, package_digest, lang <> 'de' AS can_serve, sha256('policy:' || lang) AS policy_fingerprint FROM pkg WHERE lang IN ('en', 'fr', 'de')),
auth AS (SELECT pkg.*, policy_fingerprint FROM pkg JOIN grants USING (package_digest) WHERE can_serve),
role AS (SELECT rec.*, CASE WHEN quality = 1 THEN 'obligation' WHEN quality IS NOT NULL THEN 'informative' ELSE 'unclassified' END AS statement_role FROM rec LEFT JOIN labels USING (doc_id)),
before AS (SELECT *, 0 AS start_byte FROM rec WHERE doc_id % 10 <> 0),
after AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 2 THEN text || ' (amended)' ELSE text END AS text, CASE WHEN doc_id % 10 = 6 THEN 'e' || substr(record_id, 2) ELSE record_id END AS record_id), CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS start_byte FROM rec WHERE doc_id % 10 <> 1),
status AS (SELECT coalesce(b.package_digest, a.package_digest) AS package_digest, coalesce(b.record_id, a.record_id) AS record_id,
    CASE WHEN b.record_id IS NULL THEN 'added' WHEN a.record_id IS NULL THEN 'removed'
         WHEN b.kind <> a.kind OR b.clause_reference <> a.clause_reference OR b.heading <> a.heading OR b.text <> a.text THEN 'modified'
         WHEN b.start_byte <> a.start_byte THEN 'moved' ELSE 'unchanged' END AS status, sha256(b.text) AS before_text_sha256, sha256(a.text) AS after_text_sha256
    FROM before b FULL JOIN after a ON b.package_digest = a.package_digest AND b.record_id = a.record_id),
bdep AS (SELECT * FROM dep WHERE doc_id % 10 <> 0),
adep AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 5 THEN TRUE ELSE required END AS required) FROM dep WHERE doc_id % 10 <> 1 AND NOT (doc_id % 10 = 4 AND source_record_id LIKE '%-l3')),
every AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)),
span AS (SELECT doc_id, pos, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte,
         (coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(text))::BIGINT AS end_byte FROM every),
tree AS (SELECT package_digest, record_id, pos, parent_record_id FROM rec),
mlines AS (SELECT source || '/' || lang AS component, doc_id AS page, i AS pos,
    CASE WHEN i % 28 = 27 THEN 'TABLE ' || ((i + 1) // 4) || '. ' || x WHEN i % 4 = 3 THEN ((i + 1) // 4) || '.1  ' || x WHEN i % 7 = 6 THEN 'NOTE ' || x ELSE x END AS line
    FROM (SELECT source, lang, doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM (SELECT *, string_split(text, chr(10)) AS w FROM documents))),
label AS (SELECT component, page, pos, regexp_extract(line, '^[ \\t]*(\\d+(\\.\\d+)+)[ \\t]{2,}[^ \\t\\r\\n]', 1) AS label FROM mlines)
"""

_HEAD = tokens("heading")
_TEXT = tokens("text")
_CLAUSE = tokens("clause_reference")


def _count(tok: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({tok}, lambda x: list_contains([{listed}], x)))"


def _has(word: str) -> str:
    return f"(list_contains(c, '{word}') OR list_contains(h, '{word}') OR list_contains(t, '{word}'))"


def _search(words: list[str], every: bool, more: str = "TRUE", limit: int = 20) -> str:
    rank = f"-(0.25 * {_count('c', words)} + 2.0 * {_count('h', words)} + {_count('t', words)}) / (1.0 + length(heading) / 200.0 + length(text) / 1000.0)"
    where = (" AND " if every else " OR ").join(_has(w) for w in words)
    return f""", tok AS (SELECT rec.*, {_CLAUSE} AS c, {_HEAD} AS h, {_TEXT} AS t FROM rec SEMI JOIN auth USING (package_digest) WHERE {more})
SELECT package_digest, record_id, clause_reference, ordinal, round({rank}, 6) AS score FROM tok WHERE {where} ORDER BY score, package_digest, ordinal LIMIT {limit}"""


_PHRASE = "len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'to' AND {0}[i + 1] = 'the'))"
_CLOSURE = """, walk AS (SELECT package_digest, record_id AS root_id, record_id, 0 AS depth FROM rec WHERE {0}
  UNION SELECT w.package_digest, w.root_id, d.target_record_id, w.depth + 1 FROM walk w JOIN dep d ON w.package_digest = d.package_digest AND w.record_id = d.source_record_id WHERE d.required),
near AS (SELECT package_digest, root_id, record_id, min(depth) AS depth FROM walk GROUP BY ALL)
"""
_LOOPED = """, loops AS (SELECT package_digest, doc_id, pos, CASE WHEN doc_id % 7 = 0 AND pos = 0 THEN 0 WHEN doc_id % 7 = 0 AND pos = 1 THEN CASE WHEN n > 3 THEN 3 END WHEN pos > 0 THEN pos // 2 END AS parent
  FROM lines JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) USING (doc_id)),
up AS (SELECT doc_id, pos, parent AS here, 0 AS depth, parent IS NULL AS ended FROM loops
  UNION ALL SELECT u.doc_id, u.pos, l.parent, u.depth + 1, l.parent IS NULL FROM up u JOIN loops l ON l.doc_id = u.doc_id AND l.pos = u.here WHERE u.depth < 40)
"""
_EDGE = "package_digest, source_record_id, relationship, target_record_id, required"


def _impact(side: str, mine: str, other: str, rows: str, gone: str, changed: str) -> str:
    return f"""SELECT '{side}' AS side, w.package_digest, w.start AS record_id, e.cause_type, e.target_record_id AS cause_record_id, min(w.depth + 1) AS depth
FROM walk_{side} w JOIN edge_{side} e ON w.package_digest = e.package_digest AND w.node = e.source_record_id WHERE e.cause_type IS NOT NULL GROUP BY ALL"""


def _impact_cte(side: str, mine: str, other: str, rows: str, gone: str, changed: str) -> str:
    return f""", edge_{side} AS (SELECT DISTINCT m.package_digest, m.source_record_id, m.relationship, m.target_record_id,
    CASE WHEN o.source_record_id IS NULL THEN '{gone}' WHEN s.status IN ({changed}) THEN 'target_record_changed' END AS cause_type
    FROM {mine} m LEFT JOIN (SELECT * FROM {other} WHERE required) o USING (package_digest, source_record_id, relationship, target_record_id)
    LEFT JOIN status s ON s.package_digest = m.package_digest AND s.record_id = m.target_record_id WHERE m.required),
walk_{side} AS (SELECT package_digest, record_id AS start, record_id AS node, 0 AS depth FROM {rows}
    UNION SELECT w.package_digest, w.start, e.target_record_id, w.depth + 1 FROM walk_{side} w JOIN edge_{side} e ON w.package_digest = e.package_digest AND w.node = e.source_record_id WHERE e.cause_type IS NULL)"""


_SIDES = (
    ("before", "bdep", "adep", "before", "dependency_edge_removed", "'removed', 'modified', 'moved'"),
    ("after", "adep", "bdep", "after", "dependency_edge_added", "'added', 'modified', 'moved'"),
)
EN = "sha256('fam:src0:en')"

SQL: dict[str, str] = {
    "adapter_records": "SELECT package_digest, count(*) AS n_records, sum(ordinal)::BIGINT AS ordinals, sum(length(text))::BIGINT AS chars, min(record_id) AS first_id, max(clause_reference) AS last_clause FROM rec GROUP BY ALL",
    "adapter_packages": "SELECT package_digest, family_id, edition_id, identifier, representation FROM pkg",
    "adapter_dependencies": "SELECT package_digest, count(*) AS n_edges, count(*) FILTER (required) AS n_required, min(source_record_id) AS first_source, max(target_record_id) AS last_target FROM dep GROUP BY ALL",
    "records_of_package": f"SELECT record_id, clause_reference, kind, heading, ordinal FROM rec WHERE package_digest = {EN}",
    "records_by_ids": "SELECT v.place, record_id, clause_reference, heading FROM rec JOIN (VALUES (0::BIGINT, 'd20-l0'), (1, 'd0-l1'), (2, 'missing'), (3, 'd0-l0')) v(place, record_id) USING (record_id)",
    "authorized_packages": "SELECT package_digest, edition_id, identifier, policy_fingerprint FROM auth",
    "authorized_inventory_counts": "SELECT a.package_digest, identifier, count(r.record_id) AS record_count FROM auth a LEFT JOIN rec r USING (package_digest) GROUP BY ALL",
    "list_documents_page1": "SELECT identifier, edition_id, representation, package_digest FROM auth ORDER BY identifier, family_id, edition_id, representation, package_digest LIMIT 5",
    "list_documents_after_key": "SELECT identifier, edition_id, representation, package_digest FROM auth WHERE (identifier, family_id, edition_id, representation, package_digest) > ('SRC12-EN', 'fam:src12', 'fam:src12:en', 'page_text', '') ORDER BY identifier, family_id, edition_id, representation, package_digest LIMIT 5",
    "list_documents_prefix": "SELECT identifier, edition_id, representation, package_digest FROM auth WHERE starts_with(identifier, 'SRC1')",
    "resolve_exact": "SELECT package_digest, edition_id, representation FROM auth WHERE identifier = 'SRC3-EN'",
    "resolve_ambiguous": "SELECT family_id, count(*) AS n_editions, CASE WHEN count(*) > 1 THEN 'ambiguous_document' ELSE 'resolved' END AS outcome FROM auth GROUP BY family_id",
    "resolve_candidates": ", seed AS (SELECT DISTINCT family_id FROM auth WHERE starts_with(identifier, 'SRC1')) SELECT identifier, edition_id, CASE WHEN starts_with(identifier, 'SRC1') THEN 'identifier_prefix' ELSE 'same_family' END AS match_basis FROM auth SEMI JOIN seed USING (family_id) ORDER BY match_basis <> 'identifier_prefix', identifier, edition_id, representation, package_digest LIMIT 20",
    "normalize_identifier_ascii": "SELECT doc_id, upper(source) || '-' || upper(lang) || '/X' AS identifier FROM documents",
    "visibility_fingerprint": """SELECT 'local-user' AS principal_id, sha256('[' || string_agg('["' || package_digest || '","' || policy_fingerprint || '"]', ',' ORDER BY package_digest, policy_fingerprint) || ']') AS fingerprint, count(*) AS n_items FROM auth""",
    "package_digest_rollup": """SELECT source, lang, sha256('[' || string_agg(i, ',' ORDER BY i) || ']') AS fingerprint, count(*) AS n_items FROM (SELECT source, lang, '["d' || doc_id || '","' || sha256(text) || '"]' AS i FROM documents) GROUP BY source, lang""",
    "grants_latest": "SELECT principal_id, package_digest, can_serve, CASE WHEN can_serve THEN 1 ELSE 2 END::BIGINT AS generation FROM grants",
    "coverage_status_dimensions": """SELECT package_digest, e AS edition_status, p AS parsing_status, CASE WHEN e = 'incomplete' OR p = 'incomplete' THEN 'incomplete' WHEN e = 'complete' AND p = 'complete' THEN 'complete' ELSE 'unknown' END AS source_status
FROM (SELECT package_digest, CASE lang WHEN 'en' THEN 'complete' WHEN 'fr' THEN 'incomplete' ELSE 'unknown' END AS e, CASE lang WHEN 'es' THEN 'incomplete' ELSE 'complete' END AS p FROM pkg)""",
    "tokenize_counts": f"SELECT doc_id, len({_TEXT}) AS n_tokens, len(list_distinct({_TEXT})) AS n_distinct FROM documents",
    "token_postings_topn": f"SELECT token, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest({_TEXT}) AS token FROM documents) GROUP BY token ORDER BY n_occurrences DESC, token LIMIT 50",
    "search_all_terms": _search(["that", "with"], True),
    "search_pruned": _search(["that", "with"], True),
    "search_any_terms": _search(["avec", "pour", "which"], False),
    "search_exact_phrase": f""", tok AS (SELECT rec.*, {_CLAUSE} AS c, {_HEAD} AS h, {_TEXT} AS t FROM rec SEMI JOIN auth USING (package_digest)), n AS (SELECT *, {_PHRASE.format('c')} AS nc, {_PHRASE.format('h')} AS nh, {_PHRASE.format('t')} AS nt FROM tok)
SELECT package_digest, record_id, clause_reference, ordinal, round(-(0.25 * nc + 2.0 * nh + nt) / (1.0 + length(heading) / 200.0 + length(text) / 1000.0), 6) AS score FROM n WHERE nc + nh + nt > 0 ORDER BY score, package_digest, ordinal LIMIT 20""",
    "search_pinned_scoped": _search(["the", "of"], True, "package_digest = sha256('fam:src1:en') AND (clause_reference = '1' OR starts_with(clause_reference, '1.'))"),
    "search_many": f""", tok AS (SELECT rec.*, {_CLAUSE} AS c, {_HEAD} AS h, {_TEXT} AS t FROM rec SEMI JOIN auth USING (package_digest)),
s AS (SELECT q.query, package_digest, record_id, ordinal, round(-(0.25 * len(list_filter(c, lambda x: x = q.word)) + 2.0 * len(list_filter(h, lambda x: x = q.word)) + len(list_filter(t, lambda x: x = q.word))) / (1.0 + length(heading) / 200.0 + length(text) / 1000.0), 6) AS score
  FROM tok, (VALUES ('q1', 'that'), ('q2', 'avec'), ('q3', 'from'), ('q4', 'pour')) q(query, word) WHERE list_contains(c, q.word) OR list_contains(h, q.word) OR list_contains(t, q.word))
SELECT query, package_digest, record_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, package_digest, ordinal) AS place FROM s) WHERE place <= 10""",
    "scope_filter": "SELECT record_id, clause_reference FROM rec WHERE clause_reference = '1' OR starts_with(clause_reference, '1.')",
    "obligations_page": f"SELECT record_id, clause_reference, ordinal FROM role WHERE package_digest = {EN} AND statement_role = 'obligation' AND ordinal > 5 ORDER BY ordinal, record_id LIMIT 21",
    "obligations_total_by_package": "SELECT package_digest, count(*) FILTER (statement_role = 'obligation') AS obligations, count(*) FILTER (statement_role = 'informative') AS informative, count(*) AS records FROM role GROUP BY ALL",
    "closure_required": _CLOSURE.format("true") + "SELECT DISTINCT package_digest, record_id FROM near",
    "closure_multi_root": _CLOSURE.format("true") + "SELECT package_digest, root_id, count(*) AS n_records, max(depth)::BIGINT AS depth, min(record_id) AS first_id FROM near GROUP BY ALL",
    "closure_depth_histogram": _CLOSURE.format("true") + "SELECT depth::BIGINT AS depth, count(*) AS n FROM near GROUP BY ALL",
    "nav_all": f"SELECT record_id, kind, ordinal FROM rec WHERE package_digest = {EN} ORDER BY ordinal, record_id LIMIT 51",
    "nav_roots": "SELECT package_digest, record_id, heading FROM rec WHERE parent_record_id IS NULL",
    "nav_children": "SELECT record_id, clause_reference, heading FROM rec WHERE parent_record_id = 'd0-l0'",
    "nav_parent": "SELECT parent_record_id, count(*) AS n_children FROM rec WHERE parent_record_id IS NOT NULL GROUP BY ALL",
    "nav_adjacent": "SELECT package_digest, record_id, lag(record_id) OVER w AS previous_id, lead(record_id) OVER w AS next_id FROM rec WINDOW w AS (PARTITION BY package_digest ORDER BY ordinal)",
    "nav_outgoing": "SELECT DISTINCT source_record_id AS anchor_id, relationship, target_record_id AS record_id, required FROM dep SEMI JOIN (SELECT package_digest, record_id AS source_record_id FROM rec) USING (package_digest, source_record_id)",
    "nav_incoming": "SELECT DISTINCT target_record_id AS anchor_id, relationship, source_record_id AS record_id, required FROM dep SEMI JOIN (SELECT package_digest, record_id AS target_record_id FROM rec) USING (package_digest, target_record_id)",
    "ancestor_paths": "SELECT package_digest, record_id, coalesce(parent_record_id, '') AS ancestors FROM tree",
    "enumerate_obligations_with_context": _CLOSURE.format(f"(package_digest, record_id) IN (SELECT package_digest, record_id FROM role WHERE package_digest = {EN} AND statement_role = 'obligation' ORDER BY ordinal, record_id LIMIT 50)") + "SELECT root_id, record_id, depth::BIGINT AS depth FROM near",
    "diff_status": "SELECT * FROM status",
    "diff_counts": "SELECT package_digest, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "removed", "modified", "moved", "unchanged")) + " FROM status GROUP BY ALL",
    "diff_alignment": """, b AS (SELECT package_digest, kind, clause_reference, min(record_id) AS before_record_id FROM before ANTI JOIN after USING (package_digest, record_id) GROUP BY ALL HAVING count(*) = 1),
a AS (SELECT package_digest, kind, clause_reference, min(record_id) AS after_record_id FROM after ANTI JOIN before USING (package_digest, record_id) GROUP BY ALL HAVING count(*) = 1)
SELECT * FROM b JOIN a USING (package_digest, kind, clause_reference)""",
    "diff_edges_added": f"SELECT DISTINCT {_EDGE} FROM adep ANTI JOIN bdep USING ({_EDGE})",
    "diff_edges_removed": f"SELECT DISTINCT {_EDGE} FROM bdep ANTI JOIN adep USING ({_EDGE})",
    "diff_impact_paths": "".join(_impact_cte(*s) for s in _SIDES) + " SELECT side, package_digest, record_id, cause_type, cause_record_id, depth::BIGINT AS depth FROM (" + " UNION ALL ".join(_impact(*s) for s in _SIDES) + ")",
    "verify_spans": "SELECT doc_id, count(*) AS n_lines, max(end_byte) AS end_byte, sum(start_byte)::BIGINT AS starts FROM span GROUP BY doc_id",
    "verify_quotes": "SELECT doc_id, count(*) AS n_faults FROM span WHERE doc_id % 100 = 3 AND end_byte > start_byte GROUP BY doc_id",
    "dq_duplicate_keys": "SELECT package_digest, heading, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1",
    "dq_dangling_edges": "SELECT package_digest, source_record_id, target_record_id FROM dep ANTI JOIN (SELECT package_digest, record_id AS target_record_id FROM rec WHERE pos <> 5) USING (package_digest, target_record_id)",
    "dq_cycles": _LOOPED + "SELECT package_digest, 'd' || doc_id || '-l' || cycle AS cycle, 'd' || doc_id || '-l' || pos AS record_id FROM (SELECT package_digest, doc_id, 0 AS pos, 0 AS cycle FROM lines WHERE pos = 0 AND doc_id % 7 = 0 UNION ALL SELECT l.package_digest, l.doc_id, m, 1 FROM lines l, (VALUES (1), (3)) v(m) WHERE l.pos = 3 AND l.doc_id % 7 = 0)",
    "dq_depths": _LOOPED + "SELECT depth, count(*) AS n FROM (SELECT l.package_digest, l.doc_id, l.pos, max(up.depth)::BIGINT AS depth FROM loops l LEFT JOIN up ON up.doc_id = l.doc_id AND up.pos = l.pos AND up.ended GROUP BY ALL) GROUP BY ALL",
    "closure_ordered": """, last AS (SELECT doc_id, max(pos) AS final FROM lines GROUP BY doc_id),
ask AS (SELECT package_digest, doc_id, pos, CASE WHEN pos = final THEN 0 ELSE pos + 1 END AS root_pos FROM lines JOIN last USING (doc_id)),
chain AS (SELECT package_digest, doc_id, root_pos, pos, 0 AS level FROM ask UNION ALL SELECT package_digest, doc_id, root_pos, pos // 2, level + 1 FROM chain WHERE pos > 0 AND pos % 3 <> 0),
one AS (SELECT package_digest, doc_id, pos, min({'r': root_pos, 'l': level}) AS at FROM chain GROUP BY ALL)
SELECT package_digest, '' || doc_id AS request, at.r AS root_pos, at.l::BIGINT AS level, 'd' || doc_id || '-l' || pos AS record_id, row_number() OVER (PARTITION BY package_digest, doc_id ORDER BY at) - 1 AS place FROM one""",
    "dq_required_edge_parity": """, s AS (SELECT package_digest, source_record_id, target_record_id FROM dep WHERE required),
a AS (SELECT package_digest, record_id AS source_record_id, 'd' || doc_id || '-l' || (pos // 2) AS target_record_id FROM rec WHERE pos > 0 AND pos % 2 = 1)
SELECT *, 'not_asked' AS fault FROM (FROM s EXCEPT ALL FROM a) UNION ALL SELECT *, 'not_stored' AS fault FROM (FROM a EXCEPT ALL FROM s)""",
    "coverage_ledger": "SELECT source, lang, count(*) AS pages, count(*) FILTER (strlen(coalesce(text, '')) = 0) AS pages_without_text, sum(strlen(text))::BIGINT AS text_bytes FROM documents GROUP BY ALL",
    "coverage_partition_check": """, seg AS (SELECT span.doc_id, start_byte + CASE WHEN span.doc_id % 50 = 7 AND pos = 1 THEN 1 ELSE 0 END AS start, least(end_byte + 1, strlen(d.text)) AS stop, strlen(d.text) AS size FROM span JOIN documents d USING (doc_id)),
f AS (SELECT *, start <> lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start, stop) OR stop <= start AS bad FROM seg WHERE stop > start OR start = 0)
SELECT doc_id, count(*) FILTER (bad) AS n_faults, max(stop) = max(size) AS reaches_end, count(*) AS n_segments FROM f GROUP BY doc_id""",
    "coverage_interval_union": """, s AS (SELECT doc_id, greatest(0, start_byte - pos % 7) AS start, end_byte + pos % 5 AS stop FROM span WHERE greatest(0, start_byte - pos % 7) < end_byte + pos % 5),
r AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s)
SELECT doc_id, sum(greatest(0, stop - greatest(reach, start)))::BIGINT AS linked_bytes FROM r GROUP BY doc_id""",
    "outline_numbered_lines": "SELECT component, count(*) AS n, count(DISTINCT label) AS n_labels FROM label WHERE label <> '' GROUP BY component",
    "outline_occurrences": "SELECT component, label, count(*) AS occurrences FROM label WHERE label <> '' GROUP BY ALL",
    "html_list_items": "SELECT page_id, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_items FROM pages",
    "acquisition_summary": "SELECT CASE WHEN lang = 'es' THEN 'restricted' WHEN n_chars < 500 THEN 'not_exposed' ELSE 'downloadable' END AS status, count(*) AS components, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY ALL",
    "bundle_dedup_stats": "SELECT source, sum(n)::BIGINT AS members, count(*) AS blobs, sum(n * bytes)::BIGINT AS logical_bytes, sum(bytes)::BIGINT AS unique_bytes FROM (SELECT source, text, count(*) AS n, strlen(text) AS bytes FROM documents GROUP BY ALL) GROUP BY source",
    "follow_references": """, head AS (SELECT * FROM rec WHERE pos = 0), goal AS (SELECT head.* FROM head SEMI JOIN auth USING (package_digest))
SELECT s.record_id AS source_record_id, g.record_id AS target_record_id, sha256(g.text) AS text_sha256, CASE WHEN g.record_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM (SELECT head.* FROM head SEMI JOIN auth USING (package_digest)) s LEFT JOIN goal g ON g.doc_id = s.doc_id + 1""",
    "concise_relationships": "SELECT package_digest, target_record_id, relationship, string_agg(DISTINCT source_record_id, ',' ORDER BY source_record_id) AS sources, bool_or(required) AS any_required FROM dep GROUP BY ALL",
    "eval_metrics": f""", t AS (SELECT package_digest, list_contains({_HEAD}, 'that') AS h, list_contains({_TEXT}, 'that') AS a, list_contains({_TEXT}, 'with') AS b FROM rec SEMI JOIN auth USING (package_digest)),
s AS (SELECT package_digest, count(*) FILTER (a AND b) AS relevant, count(*) FILTER (a AND b AND h) AS retrieved FROM t GROUP BY ALL)
SELECT package_digest, relevant, retrieved, CASE WHEN relevant > 0 THEN round(retrieved::DOUBLE / relevant, 6) END AS recall FROM s""",
    "answer_adjudication": """, c AS (SELECT doc_id, quality, toxic, count(rec.record_id) = 3 AS all_cited FROM (SELECT *, unnest([0, 1, 2]) AS pos FROM labels) LEFT JOIN rec USING (doc_id, pos) GROUP BY ALL)
SELECT CASE WHEN quality = 1 AND toxic = 0 AND all_cited THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n, count(*) FILTER (all_cited) AS fully_cited FROM c GROUP BY ALL""",
    "budget_bytes": """, b AS (SELECT package_digest, strlen('{"record_id":"' || record_id || '","text":"' || text || '","used":') + 1 AS base FROM rec),
u AS (SELECT package_digest, base, base + length('' || (base + length('' || base))) AS used FROM b)
SELECT package_digest, sum(base + length('' || used))::BIGINT AS bytes, max(base + length('' || used))::BIGINT AS largest FROM u GROUP BY ALL""",
    "event_rollup": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
_BEST = SQL["search_all_terms"]
_CUT = _BEST.rindex("SELECT package_digest")
SQL["search_scan_all_terms"] = _BEST
SQL["search_index"] = f""", tok AS (SELECT unnest([0, 1, 2]) AS place, unnest([{_CLAUSE}, {_HEAD}, {_TEXT}]) AS w FROM rec)
SELECT place::BIGINT AS place, sum(len(list_distinct(w)))::BIGINT AS n_postings, sum(len(w))::BIGINT AS n_tokens, min(list_min(w)) AS first_token FROM tok GROUP BY place"""
SQL["search_heading_ancestry"] = _BEST[:_CUT].rstrip() + ", hit AS (" + _BEST[_CUT:] + ") SELECT record_id, CASE WHEN record_id LIKE '%-l0' THEN '' ELSE regexp_extract(record_id, '^(d\\d+)', 1) || '-l0' END AS ancestors, score FROM hit"


def oracle_sql() -> dict[str, str]:
    return {name: CORPUS + sql for name, sql in SQL.items()}
