"""DuckDB SQL of the outline queries: lines, their kinds, stretches and parents.

The registered pages have numbered lines, notes, captions and list items; were
there a method, an appendix or a part among them, these statements would differ.
"""

from __future__ import annotations

from lexstrata.operators.outline import LEADERS, LINES, NUMERIC_WORD

_KINDS = ("numbered", "note", "caption", "list_item")

OUTLINE = rf"""
WITH pages AS (
  SELECT source || '/' || lang AS component, doc_id AS page, list_transform(string_split(text, chr(10)), lambda x, n:
    CASE WHEN (n - 1) % 28 = 27 THEN 'TABLE ' || (n // 4) || '. ' || x WHEN (n - 1) % 4 = 3 THEN (n // 4) || '.1  ' || x WHEN (n - 1) % 7 = 6 THEN 'NOTE ' || x ELSE x END) AS w
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT component, page, i AS pos, w[i + 1] AS line, regexp_replace(w[i + 1], '\r$', '') AS plain FROM (SELECT component, page, w, unnest(range(len(w))) AS i FROM pages)),
raw AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(plain, '{LINES[k]}') THEN '{k}'" for k in _KINDS)} END AS k FROM lines),
said AS (SELECT *, CASE k {" ".join(f"WHEN '{k}' THEN regexp_extract(plain, '{LINES[k]}', 1)" for k in _KINDS)} END AS label,
                   CASE k {" ".join(f"WHEN '{k}' THEN regexp_extract(plain, '{LINES[k]}', 2)" for k in _KINDS)} END AS body FROM raw),
cells AS (SELECT *, coalesce(regexp_matches(body, '{LEADERS}'), false) AS leaders, list_transform(list_slice(string_split_regex(trim(body), '\s+'), 1, 24), lambda x: regexp_matches(x, '{NUMERIC_WORD}')) AS numeric FROM said),
kinds AS (SELECT *, CASE WHEN k = 'numbered' AND leaders THEN NULL
                         WHEN k = 'numbered' AND (len(list_filter(numeric, lambda x: x)) >= 4 OR numeric[1] AND len(list_filter(numeric, lambda x: x)) >= 2) THEN 'ambiguous_numbered'
                         WHEN k = 'caption' AND leaders THEN 'toc_caption' ELSE k END AS kind FROM cells),
runs AS (SELECT *, kind IS NOT NULL AND (kind NOT IN ('numbered', 'ambiguous_numbered', 'list_item', 'note') OR kind = 'numbered' AND contains(label, '.')) AS ends,
                kind = 'numbered' AND NOT contains(label, '.') AS footnote FROM kinds),
placed AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY component, page ORDER BY pos) AS run FROM runs),
settled AS (SELECT *, CASE WHEN footnote AND count(*) FILTER (footnote) OVER r > 1 AND bool_or(ends AND kind = 'caption' AND upper(label) LIKE 'TABLE%') OVER r THEN 'ambiguous_numbered' ELSE kind END AS is_kind
            FROM placed WINDOW r AS (PARTITION BY component, page, run)),
found AS (SELECT component, page, pos, is_kind AS kind, label FROM settled WHERE is_kind IS NOT NULL),
firsts AS (SELECT component, page, min(pos) AS first FROM found GROUP BY ALL),
prefixes AS (SELECT DISTINCT l.component, l.page FROM lines l LEFT JOIN firsts f USING (component, page) WHERE l.pos < coalesce(f.first, l.pos + 1) AND regexp_matches(l.line, '\S')),
every AS (SELECT component, page, pos, kind, label FROM found UNION ALL SELECT component, page, -1, NULL, NULL FROM prefixes),
nodes AS (SELECT component, page, pos, kind, label, row_number() OVER (PARTITION BY component ORDER BY page, pos) AS seq,
                 CASE WHEN kind IS NULL OR kind IN ('ambiguous_numbered', 'toc_caption') THEN 'unsupported_region' WHEN kind = 'numbered' THEN CASE WHEN contains(label, '.') THEN 'clause' ELSE 'section' END
                      WHEN kind = 'caption' THEN CASE WHEN upper(label) LIKE 'TABLE%' THEN 'table' ELSE 'figure' END ELSE kind END AS node_kind,
                 CASE kind WHEN 'numbered' THEN label WHEN 'note' THEN replace(upper(label), ' ', '-') WHEN 'list_item' THEN lower(label) || '-item'
                           WHEN 'caption' THEN regexp_replace(regexp_replace(upper(label), '\s*([.-])\s*', '\1', 'g'), '\s+', '-', 'g') END AS reference FROM every)
"""

SQL = {
    "outline_candidates": OUTLINE + "SELECT component, kind, count(*) AS n FROM found GROUP BY ALL",
    "outline_kind_counts": OUTLINE + "SELECT component, node_kind AS kind, count(*) AS n FROM nodes GROUP BY ALL",
    "outline_parent_tree": OUTLINE
    + """,
times AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY component, reference ORDER BY seq) = 1 THEN reference
                         ELSE reference || ':occurrence-' || row_number() OVER (PARTITION BY component, reference ORDER BY seq) END AS named,
                 last_value(CASE WHEN kind = 'numbered' THEN seq END IGNORE NULLS) OVER (PARTITION BY component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
                 CASE WHEN kind = 'numbered' AND contains(label, '.') THEN regexp_extract(label, '^(.*)[.][^.]*$', 1) END AS up FROM nodes),
asked AS (SELECT q.component, q.seq, max(n.seq) AS parent FROM times q JOIN times n ON n.component = q.component AND n.reference = q.up AND n.seq < q.seq GROUP BY ALL),
parents AS (SELECT t.component, CASE WHEN t.kind = 'numbered' THEN a.parent WHEN t.node_kind <> 'unsupported_region' THEN t.opened END AS parent FROM times t LEFT JOIN asked a USING (component, seq))
SELECT p.component, n.named AS parent_reference, count(*) AS n_children FROM parents p JOIN times n ON n.component = p.component AND n.seq = p.parent GROUP BY ALL""",
}
