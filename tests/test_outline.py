from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexstrata.errors import EvidenceError
from lexstrata.operators import coverage, diff, graph, outline
from lexstrata.sources.adapter import Corpus
from lexstrata.streaming.ingest import ingest

PAGE = "\n".join(
    [
        "M E T H O D  501.2",
        "1  SCOPE",
        "1.1  Purpose. This clause says why.",
        "  a. first item",
        "NOTE 1. Mind the gap.",
        "TABLE I. Limits",
        "1  first footnote",
        "2  second footnote",
        "Some text",
        "FIGURE 2. A drawing",
        "3.4  1 2 3 4 5",
        "1.2  Contents ........ 7",
    ]
)


COLUMNS = "component string, page long, text string"


def test_candidates(spark):
    found = outline.page_candidates(spark.createDataFrame([("x", 1, PAGE), ("x", 2, ""), ("x", 3, None)], COLUMNS)).orderBy("start_byte").collect()
    assert [(r["kind"], r["label"]) for r in found] == [
        ("method", "M E T H O D  501.2"), ("numbered", "1"), ("numbered", "1.1"), ("list_item", "a"), ("note", "NOTE 1"), ("caption", "TABLE I"), ("ambiguous_numbered", "1"), ("ambiguous_numbered", "2"),
        ("caption", "FIGURE 2"), ("ambiguous_numbered", "3.4"),
    ]
    raw = PAGE.encode()
    assert all(raw[r["start_byte"] :].startswith(r["label"].encode()) for r in found)
    said = spark.createDataFrame([("Purpose. This clause says why.", "1.1"), ("  ", " 7 "), ("x" * 300, "l"), ("a  b\tc...", "l")], "body string, label string")
    assert [r[0] for r in said.select(outline.heading(F.col("body"), F.col("label"))).collect()] == ["Purpose", "7", "x" * 240, "a b c"]


def test_parts_need_their_first_clause(spark):
    pages = [("PART ONE - General\n1.1  Scope", ["part", "numbered"]), ("PART TWO -- x\n2.1  Scope", ["numbered"]), ("P A R T  T H R E E – y\n1.1  Scope ..... 4\n1.1  Scope", ["numbered"]), ("PART ONE - x\n" + "y" * 4100 + "\n1.1  Scope", ["numbered"]), ("PART ONE - x", [])]
    rows = outline.page_candidates(spark.createDataFrame([("x", i, t) for i, (t, _) in enumerate(pages)], COLUMNS)).orderBy("page", "start_byte").collect()
    assert [[r["kind"] for r in rows if r["page"] == i] for i in range(len(pages))] == [k for _, k in pages]


@pytest.mark.parametrize("page_range", [1, 2, 1024])
def test_outline_keeps_all_text(spark, monkeypatch, page_range):
    monkeypatch.setattr(outline, "PAGE_RANGE", page_range)
    second = "1.3  Möre\nM E T H O D  501.2\n1.1  Again\n1.1.1  Deeper"
    third = "PART ONE - General\n1.1  Scope\n4.2  Stray\nNOTE 2: x\nAPPENDIX B\n1  Top\n1.1  Sub"
    pages = spark.createDataFrame([("x", 1, PAGE), ("x", 2, second), ("x", 3, third), ("y", 1, "nothing here"), ("y", 2, None), ("z", 5, " \n é\n1  One")], COLUMNS)
    rows = outline.compile_outline(pages).orderBy("component", "seq").collect()
    x = [r for r in rows if r["component"] == "x"]
    assert [r["seq"] for r in x] == list(range(len(x)))
    assert {r["kind"] for r in x} == {"section", "clause", "list_item", "note", "table", "figure", "unsupported_region"}
    by_ref = {(r["context"], r["reference"]): r for r in x}
    parent = lambda c, r: next(((p["context"], p["reference"]) for p in x if p["seq"] == by_ref[c, r]["parent_seq"]), None)
    method, part, appendix = "METHOD-501.2", "PART-ONE", "APPENDIX-B"
    assert parent(method, "1") == (method, "METHOD 501.2") and parent(method, "1.1") == (method, "1") and parent(method, "a-item") == (method, "1.1")
    assert parent(method, "1.1:occurrence-2") == (method, "1") and parent(method, "1.1.1") == (method, "1.1:occurrence-2") and by_ref[method, "1.1:occurrence-2"]["page"] == 2
    assert (method, "page-0002-repeated-method-header") in by_ref and by_ref[method, "page-0002-repeated-method-header"]["kind"] == "unsupported_region"
    assert parent(part, "1.1") == (part, "PART-ONE") and parent(part, "4.2") == (part, "PART-ONE") and parent(part, "NOTE-2") == (part, "4.2") and parent(part, "PART-ONE") is None
    assert parent(appendix, "1") == (appendix, "APPENDIX B") and parent(appendix, "1.1") == (appendix, "1")
    assert by_ref[method, "TABLE-I"]["kind"] == "table" and by_ref[method, "page-0001-ambiguous-numbered-7"]["parent_seq"] is None
    for page, text in ((1, PAGE), (2, second), (3, third)):
        mine = [r for r in x if r["page"] == page]
        assert "".join("".join(r["text"].split()) for r in mine) == "".join(text.split())
        assert all(text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"] for r in mine)
    assert [r["reference"] for r in rows if r["component"] == "y"] == ["page-0001-unparsed"]
    assert [(r["reference"], r["start_byte"], r["text"]) for r in rows if r["component"] == "z"] == [("page-0005-prefix", 3, "é"), ("1", 6, "1  One")]


def test_interval_union_and_partitions(spark):
    spans = spark.createDataFrame([("p", 0, 5), ("p", 3, 9), ("p", 20, 22), ("p", 4, 6)], "page string, start long, stop long")
    assert coverage.linked_bytes(spans, ["page"]).first()["linked_bytes"] == 11
    parts = spark.createDataFrame([("p", 0, 5, 9), ("p", 5, 9, 9), ("q", 0, 4, 9), ("q", 5, 8, 9)], "page string, start long, stop long, size long")
    found = {r["page"]: (r["n_faults"], r["reaches_end"]) for r in coverage.partition_faults(parts, ["page"]).collect()}
    assert found == {"p": (0, True), "q": (1, False)}


def test_ordered_closure(spark):
    edges = spark.createDataFrame([("p", "a", "r", "c", True), ("p", "a", "r", "b", True), ("p", "b", "r", "d", True), ("p", "d", "r", "a", True), ("p", "a", "r", "z", False)], "package_digest string, source_record_id string, relationship string, target_record_id string, required boolean")
    roots = spark.createDataFrame([("c", 0), ("a", 1)], "record_id string, root_pos long")
    assert [r["record_id"] for r in graph.ordered_closure(roots, edges).orderBy("place").collect()] == ["c", "a", "b", "d"]


def chain(spark, n, loops=()):
    """Records 0..n-1, each under the one before; loops: (record, parent) instead."""
    parent = {i: i - 1 if i else None for i in range(n)} | dict(loops)
    return spark.createDataFrame([("p", f"r{i:05}", None if parent[i] is None else f"r{parent[i]:05}") for i in parent], "package_digest string, record_id string, parent_record_id string")


def test_long_chains_and_cycles(spark):
    got = {r["record_id"]: r["depth"] for r in graph.depths(chain(spark, 10_000)).collect()}
    assert got == {f"r{i:05}": i for i in range(10_000)}
    paths = {r["record_id"]: r["path"] for r in graph.ancestry(chain(spark, 100)).collect()}
    assert paths == {f"r{i:05}": [f"r{k:05}" for k in range(i)] for i in range(100)}
    # 0..4 a cycle with a tail up to 19; 30 on itself; 40 under one that isn't there
    looped = chain(spark, 20, [(0, 4), (30, 30), (31, 30), (40, 99), (41, 40), (50, None)])
    assert sorted(tuple(r)[1:] for r in graph.cycles(looped).collect()) == [("r00000", f"r{i:05}") for i in range(5)] + [("r00030", "r00030")]
    deep = {r["record_id"]: r["depth"] for r in graph.depths(looped).collect()}
    assert deep == {f"r{i:05}": None for i in (*range(20), 30, 31)} | {"r00040": 0, "r00041": 1, "r00050": 0}
    with pytest.raises(EvidenceError) as e:
        graph.ancestry(looped)
    assert e.value.code == "invalid_records" and "r00000" in str(e.value.details)
    assert graph.cycles(chain(spark, 5)).count() == 0 and graph.depths(chain(spark, 0)).count() == 0


def test_closures_as_sets(spark, monkeypatch):
    """Random edges with cycles, hubs and long chains against a walk; chunks of two numbers."""
    monkeypatch.setattr(graph, "CHUNK_BITS", 1)
    rng = random.Random(6)
    edges = {(rng.choice("pq"), f"r{rng.randint(0, 15):02}", f"r{rng.randint(0, 15):02}", rng.random() < 0.8) for _ in range(40)} | {("q", f"s{i:02}", f"s{i + 1:02}", True) for i in range(12)}
    roots = [(p, f"r{i:02}") for p in "pq" for i in range(0, 16, 2)] + [("q", "s00"), ("p", "alone"), ("q", "s00")]
    want = {}
    for p, r in set(roots):
        depth, level = {r: 0}, [r]
        while level:
            level = [t for t in {b for q, a, b, must in edges if q == p and must and a in level} if t not in depth]
            depth |= dict.fromkeys(level, max(depth.values()) + 1)
        want[p, r] = (len(depth), max(depth.values()), min(depth))
    frame = spark.createDataFrame([(p, a, "r", b, must) for p, a, b, must in edges], "package_digest string, source_record_id string, relationship string, target_record_id string, required boolean")
    found = graph.reach_summary(spark.createDataFrame(roots, "package_digest string, record_id string"), frame)
    assert {(r["package_digest"], r["root_id"]): (r["n_records"], r["depth"], r["first_id"]) for r in found.collect()} == want
    deep = spark.createDataFrame([("p", f"r{i}", "r", f"r{i + 1}", True) for i in range(70)], frame.schema)
    assert graph.closure(spark.createDataFrame([("p", "r0")], "package_digest string, record_id string"), deep).agg({"depth": "max"}).first()[0] == 70


def test_impact_paths(spark):
    schema = "package_digest string, source_record_id string, relationship string, target_record_id string, required boolean"
    before = spark.createDataFrame([("p", "a", "r", "b", True), ("p", "b", "r", "c", True)], schema)
    ids = spark.createDataFrame([("p", x) for x in "abc"], "package_digest string, record_id string")
    status = spark.createDataFrame([("p", "a", "unchanged"), ("p", "b", "unchanged"), ("p", "c", "modified")], "package_digest string, record_id string, status string")
    rows = {(r["side"], r["record_id"]): (r["cause_type"], r["depth"], r["path"]) for r in graph.impact(status, before, before, ids, ids).collect()}
    assert rows == {(s, k): v for s in ("before", "after") for k, v in {"a": ("target_record_changed", 2, ["a>b", "b>c"]), "b": ("target_record_changed", 1, ["b>c"])}.items()}


def test_incremental_ingest(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(50).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first > 0
    docs.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() > first


def test_statuses_move_no_texts(spark, sf_dir):
    """Above the join of the editions there is nothing left to do with texts but to show their digests."""
    c = Corpus(spark, sf_dir)
    plan = diff.status(c.edition("before"), c.edition("after"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join FullOuter" in line)
    assert not any("sha2(" in line for line in plan[:join]) and any("sha2(" in line for line in plan[join:])
