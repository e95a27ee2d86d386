"""Queries over every record of a small corpus, against plain loops."""

from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import verify
from lexstrata.plans.registry import QUERIES

TEXTS = {4: "one", 7: "\n".join(f"line {i}" for i in range(13)), 9: "a\n\nb\nc", 0: "x\ny\nz\nw\nv"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", f"src{i % 2}", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def records():
    return [(i, n) for i, t in TEXTS.items() for n in range(len([x for x in t.split("\n") if x.strip()]))]


def reached():
    """(document, root line) to its closure: line to depth."""
    out = {}
    for doc, root in records():
        out[doc, root], at, depth = {root: 0}, root, 0
        while at > 0 and at % 3:
            at, depth = at // 2, depth + 1
            out[doc, root][at] = depth
    return out


def rows(spark, corpus, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, corpus).collect())


def test_closures_start_from_every_record(spark, corpus):
    walks = reached()
    assert rows(spark, corpus, "closure_required", "record_id") == sorted((f"d{i}-l{n}",) for i, n in records())
    want = sorted((f"d{i}-l{n}", len(w), max(w.values()), min(f"d{i}-l{k}" for k in w)) for (i, n), w in walks.items())
    assert rows(spark, corpus, "closure_multi_root", "root_id", "n_records", "depth", "first_id") == want
    depths = [d for w in walks.values() for d in w.values()]
    assert rows(spark, corpus, "closure_depth_histogram", "depth", "n") == sorted((d, depths.count(d)) for d in set(depths))


def test_navigation_takes_every_record(spark, corpus):
    edges = [(f"d{i}-l{n}", f"d{i}-l{n // 2}", n % 3 != 0) for i, n in records() if n]
    assert rows(spark, corpus, "nav_outgoing", "anchor_id", "record_id", "required") == sorted(edges)
    assert rows(spark, corpus, "nav_incoming", "anchor_id", "record_id", "required") == sorted((t, s, r) for s, t, r in edges)
    assert rows(spark, corpus, "ancestor_paths", "record_id", "ancestors") == sorted((f"d{i}-l{n}", f"d{i}-l0" if n else "") for i, n in records())


def test_every_line_is_assembled(spark, corpus):
    want = sorted((i, len(t), sha256(t.encode()).hexdigest()) for i, t in TEXTS.items())
    assert rows(spark, corpus, "structure_assemble", "doc_id", "n_chars", "content_sha256") == want


def test_every_statement_fault_occurs(spark, tmp_path):
    long = "x" * 50
    rows = [(3, f"{long} with the end"), (4, f"{long} with the end\nno more"), (5, "the rest")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(spark, str(tmp_path)) == {"text_not_cited": 1, "subject_not_in_text": 2, "modality_not_in_text": 1}


def rows_of(spark, folder):
    return {r["code"]: r["n"] for r in QUERIES["semantic_checks"](spark, folder).collect()}


def test_spans_that_cut_a_character_are_faults(spark):
    sources = spark.createDataFrame([(1, "caf\u00e9 \U0001f600")], "doc_id long, source_text string")
    rows = [(1, 0, 5, "caf\u00e9"), (1, 0, 4, "caf\u00e9"), (1, 4, 5, "\u00e9"), (1, 6, 10, "\U0001f600"), (1, 7, 10, "\ufffd"), (1, 0, 4, None)]
    spans = spark.createDataFrame(rows, "doc_id long, start_byte long, end_byte long, text string").withColumn("quote_sha256", F.sha2("text", 256))
    assert sorted((r["start_byte"], r["end_byte"], r["text"] is None, r["said"]) for r in verify.quote_faults(spans, sources, "doc_id").collect()) == [(0, 4, False, None), (0, 4, True, None), (4, 5, False, None), (7, 10, False, None)]
    assert spark.range(1).select(verify.byte_slice(F.lit("\u00e9"), F.lit(0), F.lit(1)).alias("x")).first()["x"] is None
