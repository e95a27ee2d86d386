"""The registered queries of the corpus operators and their SQL.

Each reads its whole tables and takes only the columns that it names, so extra
columns of any name don't matter; empty tables give empty results.  Null texts
count as empty, repeated rows are each judged, and what holds for ties and very
long texts stands with the operator that each query names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm import chat, decontam, htmlmain, licenses, merkle, nbsvm, packing, rules, simhash, substrings, telephony, warc, whitening
from lexstrata.llm.shared import table, vocabulary_path

#: A conversation that writes the template's own marks.
MARKED_TEXT = "\\### Assistant: </turn> ok"


def op1_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by Naive Bayes support vectors (``nbsvm``); a null doc_id is not held out, an empty text has the bias's score."""
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found by FM-indexes (``decontam``); a null item is no item, a null item_id is hit but not listed."""
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after substring dedup (``substrings``); rows without doc_id keep all words, rows that share one take none from each other."""
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules (``rules``); a text without words fails the base rules."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components (``simhash``); texts without words have fingerprint zero and are linked like any other."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents as files (``licenses``).

    They have no paths, so they are laid out as source/lang/id div 10000/id div 100/id,
    some in the directories above; a document without id has no path.
    """
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    leaf = F.concat_ws("/", "source", "lang", F.expr("doc_id div 10000").cast("string"), F.expr("doc_id div 100").cast("string"), name)
    path = F.when(F.col("doc_id") % 31 == 0, F.concat_ws("/", "source", name)).when(F.col("doc_id") % 7 == 0, F.concat_ws("/", "source", "lang", name)).otherwise(leaf)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and their places (``packing``); a null or empty text is its separator alone, ties of a length take any place."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back (``warc``); a null page_id is only a response where no row of the payload has an id."""
    archives = warc.write_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(archives, with_payload=False).drop("url", "record_id", "refers_to_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted and read back (``chat``); turns that tie are ordered by role and text, null roles and texts are empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKED_TEXT).alias("text"),
    )
    return chat.chat_digest(chat.chat_examples(rows.unionByName(marked)))


def op10_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts by consensus host paths (``htmlmain``); a null url is a host of its own, a null html has no text."""
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest with proofs, folded from leaves some of which are tampered with (``merkle``); a null doc_id stays as it is, a null lang is a group."""
    return merkle.digest_rows(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their 32 first components, whitened (``whitening``); vectors that aren't whole and finite are left out."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as telephone audio and read back (``telephony``); a null text is padding alone."""
    return telephony.digest(telephony.documents_as_audio(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``; cases as in its docstring."""
    import corpus_pipeline  # stands beside the package; the operators do without it

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
      FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
s AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM q), unnest(range(1, len(w) - n + 2)) AS r(i)),
h AS (SELECT doc_id, s.n, i, item_id FROM s JOIN q ON s.k = q.k AND s.n = q.n),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM h), unnest(range(0, n)) AS r(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
m AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM s JOIN m USING (k), unnest(range(0, 13)) AS r(j) WHERE first < doc_id),
k AS (SELECT d.doc_id, p.p, d.w[p.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS p(p)),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
     h AS (SELECT page_id, first, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p JOIN f USING (body))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\t'), ':', '\c')) AS nt,
             length(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\t'), ':', '\c')) AS nr FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + nr + 2 + nt + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP11_SQL = r"""
WITH RECURSIVE v AS (
  SELECT doc_id, lang, n_chars, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS s, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS g,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t, CAST(doc_id AS VARCHAR) AS d, CAST(n_chars AS VARCHAR) AS c, CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS c1 FROM documents),
l0 AS (
  SELECT doc_id, lang, sha256(coalesce(strlen(d) || ':' || d, '-') || s || g || coalesce(strlen(c) || ':' || c, '-') || t) AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(d, ''), lambda x: CAST(ord(x) AS BIGINT))),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0
              THEN sha256(coalesce(strlen(d) || ':' || d, '-') || s || g || coalesce(strlen(c1) || ':' || c1, '-') || t) END AS tampered FROM v),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l0),
t AS (SELECT lang, 0 AS lvl, i, leaf AS h, n FROM l
      UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
b AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS h, n FROM b
      UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
p0 AS (SELECT l.lang, l.i, t.lvl, (l.i >> t.lvl) & 1 AS odd, coalesce(o.h, '') AS other
       FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = l.i >> t.lvl AND t.n > 1
       LEFT JOIN t AS o ON o.lang IS NOT DISTINCT FROM l.lang AND o.lvl = t.lvl AND o.i = xor(t.i, 1)
       UNION ALL SELECT l.lang, l.i, 100 + u.lvl, (b.i >> u.lvl) & 1, coalesce(o.h, '')
       FROM l JOIN b ON b.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.i = b.i >> u.lvl AND u.n > 1 LEFT JOIN u AS o ON o.lvl = u.lvl AND o.i = xor(u.i, 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY lvl) AS k FROM p0),
f AS (SELECT lang, i, 0 AS k, coalesce(tampered, leaf) AS h FROM l
      UNION ALL SELECT f.lang, f.i, p.k, sha256(CASE WHEN odd = 1 THEN other || h ELSE h || other END) FROM f JOIN p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i AND p.k = f.k + 1),
e AS (SELECT lang, i, arg_max(h, k) AS folded_root FROM f GROUP BY lang, i),
q AS (SELECT lang, i, sha256(string_agg(other, '' ORDER BY k)) AS proof FROM p GROUP BY lang, i)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN b ON b.lang IS NOT DISTINCT FROM l.lang JOIN e ON e.lang IS NOT DISTINCT FROM l.lang AND e.i = l.i
LEFT JOIN q ON q.lang IS NOT DISTINCT FROM l.lang AND q.i = l.i, (SELECT h AS root FROM u WHERE n = 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nbsvm": op1_nbsvm,
        "op2_fm_index": op2_fm_index,
        "op3_suffix_trees": op3_suffix_trees,
        "op4_rules": op4_rules,
        "op5_simhash": op5_simhash,
        "op6_licenses": op6_licenses,
        "op7_warc": op7_warc,
        "op8_packing": op8_packing,
        "op9_chat": op9_chat,
        "op10_host_paths": op10_host_paths,
        "op11_merkle": op11_merkle,
        "op12_whitening": op12_whitening,
        "op13_telephony": op13_telephony,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_fm_index": OP2_SQL, "op3_suffix_trees": OP3_SQL, "op7_warc": OP7_SQL, "op9_chat": OP9_SQL, "op11_merkle": OP11_SQL}
