"""Lexical search with row-local ranks.

Scores use the row alone (no corpus statistics), so rows that a caller may not
see can't move those that it may.  Packages are filtered before texts are
tokenized, tokens are made in the scan's stage, and the k best rows come out of
``TakeOrderedAndProject``; snippets are made for those rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexstrata.functions.text import WRITTEN_TOKEN, Phrase, Query, fold_word, folded, instances, parse, porter, tokens

COLUMNS = ("clause_reference", "heading", "text")


@F.pandas_udf(ArrayType(StringType()))
def stems(listed: pd.Series) -> pd.Series:
    """Porter stems of arrays of tokens; each distinct word of a batch is stemmed once."""
    known: dict[str, str] = {}
    return listed.map(lambda words: [known.get(w) or known.setdefault(w, porter(w)) for w in words])


def token_columns(records: DataFrame, stemmed: bool) -> DataFrame:
    """Adds clause_tokens, heading_tokens and text_tokens.

    They come out of a generator of one row: a plain projection would be put
    into every predicate and lambda that uses it and tokenize again in each.
    """
    make = (lambda c: stems(tokens(F.col(c)))) if stemmed else (lambda c: tokens(F.col(c)))
    clause = F.array().cast("array<string>") if stemmed else tokens(F.col("clause_reference"))
    once = F.struct(clause.alias("clause_tokens"), make("heading").alias("heading_tokens"), make("text").alias("text_tokens"))
    return records.select("*", F.inline(F.array(once)))


def possible(query: Query) -> Column:
    """A cheap test before tokenizing: the folded row holds the letters of the phrases' tokens."""
    if query.stemmed:
        return F.lit(True)
    row = folded(F.concat_ws("\n", *COLUMNS))
    return all_of([all_of([all_of([F.contains(row, F.lit(t)) for t in p.tokens], True) for p in group], False) for group in query.groups], query.every)


def _row_has(phrase: Phrase) -> Column:
    return phrase.in_tokens(F.col("clause_tokens")) | phrase.in_tokens(F.col("heading_tokens")) | phrase.in_tokens(F.col("text_tokens"))


def all_of(parts: list[Column], every: bool) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p if every else out | p
    return out


def matches(query: Query) -> Column:
    """Terms may match in different columns; a phrase lies in one."""
    return all_of([all_of([_row_has(p) for p in group], False) for group in query.groups], query.every)


def score(query: Query) -> Column:
    """Negative, smaller is better: hits in the clause, heading and text over the row's length."""
    hits = lambda c: instances(query.phrases, F.col(c))
    size = 1.0 + F.char_length("heading") / 200.0 + F.char_length("text") / 1000.0
    exact = F.lit(0.0) if query.stemmed else 0.25 * hits("clause_tokens")
    rank = -(exact + 2.0 * hits("heading_tokens") + hits("text_tokens")) / size
    if query.concepts:
        n = sum((all_of([_row_has(p) for p in g], False).cast("int") for g in query.groups), F.lit(0))
        rank = -100.0 * n + F.greatest(F.lit(-9.0), rank)
    return rank


def in_scope(column: Column, scope: str) -> Column:
    """The clause itself or a dotted descendant; case-sensitive, no wildcards."""
    return (column == scope) | column.startswith(scope + ".")


def ranked(records: DataFrame, packages: DataFrame, query: Query, limit: int | None = 20, package_digest: str | None = None, scope: str | None = None) -> DataFrame:
    """The best rows: package_digest, record_id, clause_reference, ordinal, heading, text and score."""
    rows = records.join(packages.select("package_digest"), "package_digest", "left_semi")
    if package_digest is not None:
        rows = rows.where(F.col("package_digest") == package_digest)
    if scope is not None:
        rows = rows.where(in_scope(F.col("clause_reference"), scope))
    rows = token_columns(rows.where(possible(query)), query.stemmed).where(matches(query))
    rows = rows.withColumn("score", F.round(score(query), 6))
    kept = [c for c in ("package_digest", "record_id", "clause_reference", "ordinal", "heading", "text", "kind", "parent_record_id", "doc_id", "pos") if c in rows.columns]
    rows = rows.select(*kept, "score")
    return rows if limit is None else rows.orderBy("score", "package_digest", "ordinal").limit(limit)


def search(records: DataFrame, packages: DataFrame, text: str, mode: str = "all_terms", limit: int = 20, package_digest: str | None = None, scope: str | None = None) -> tuple[DataFrame, bool]:
    """(hits, relaxed).  A natural or concept query without hits is tried once more with any of its terms."""
    strict = parse(text, mode)
    found = ranked(records, packages, strict, limit, package_digest, scope)
    if mode in ("natural_language", "concept_language") and len(strict.groups) > 1 and found.isEmpty():
        return ranked(records, packages, parse(text, mode, relaxed=True), limit, package_digest, scope), True
    return found, False


def many(records: DataFrame, packages: DataFrame, queries: dict[str, Query], limit: int = 20) -> DataFrame:
    """Several queries in one scan: the texts are tokenized once, each query's best rows kept."""
    from pyspark.sql import Window

    rows = records.join(packages.select("package_digest"), "package_digest", "left_semi")
    rows = token_columns(rows, next(iter(queries.values())).stemmed)
    found = [F.when(matches(q), F.struct(F.lit(name).alias("query"), F.round(score(q), 6).alias("score"))) for name, q in queries.items()]
    rows = rows.withColumn("hit", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    rows = rows.select("hit.query", "hit.score", "package_digest", "record_id", "ordinal")
    best = Window.partitionBy("query").orderBy("score", "package_digest", "ordinal")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def snippets(hits: DataFrame, query: Query, most: int = 20) -> DataFrame:
    """Adds matched_snippet: at most ``most`` tokens of the text around the first match, marked and verbatim."""
    phrases, stem = [(p.tokens, p.prefix) for p in query.phrases], porter if query.stemmed else str

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["matched_snippet"] = [snippet(t, phrases, stem, most) for t in b["text"]]
            yield b

    def snippet(text: str, wanted: list, stem, most: int) -> str:  # noqa: ANN001
        found = [(m.start(), m.end(), stem(fold_word(m[0]))) for m in WRITTEN_TOKEN.finditer(text)]
        marks: list[tuple[int, int]] = []
        for words, prefix in wanted:
            n = len(words)
            for i in range(len(found) - n + 1):
                if all(found[i + k][2] == w or prefix and k == n - 1 and found[i + k][2].startswith(w) for k, w in enumerate(words)):
                    marks.append((i, i + n))
        marks.sort()
        joined: list[list[int]] = []
        for b, e in marks:
            if joined and b < joined[-1][1]:
                joined[-1][1] = max(e, joined[-1][1])
            else:
                joined.append([b, e])
        first = max(0, joined[0][0] - 2) if joined else 0
        last = min(len(found), first + most)
        if not found:
            return text
        out, at = [], found[first][0] if first else 0
        for b, e in joined:
            if b >= first and e <= last:
                out += [text[at : found[b][0]], "⟦", text[found[b][0] : found[e - 1][1]], "⟧"]
                at = found[e - 1][1]
        out.append(text[at : found[last - 1][1]] if last < len(found) else text[at:])
        return (" … " if first else "") + "".join(out) + (" … " if last < len(found) else "")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema.fields)
    return hits.mapInPandas(cut, f"{fields}, matched_snippet string")
