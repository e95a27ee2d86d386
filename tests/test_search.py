from __future__ import annotations

import os
import random
import re
import sqlite3
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.errors import EvidenceError
from lexstrata.functions import text as T
from lexstrata.operators import graph, postings, search
from lexstrata.sources.adapter import Corpus

ROWS = [
    ("p1", "r1", "7.3", "Buoy mooring", "The harbour shall moor the buoy with a heavy iron chain of 60 m.", 0),
    ("p1", "r2", "7.3 REMARK", "Governing tide", "Lay the chain after counting at low tide for two days; see HBR-CODE-310K.", 1),
    ("p1", "r3", "7.4", "Harbour lighting", "The harbour shall prevent drifting lamps. Chain chain chain, iron chains of 600 m.", 2),
    ("p2", "r4", "9", "Hidden", "heavy iron chain chain heavy iron chain", 0),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "package_digest string, record_id string, clause_reference string, heading string, text string, ordinal long")


@pytest.fixture(scope="module")
def packages(spark):
    return spark.createDataFrame([("p1",)], "package_digest string")


@pytest.fixture(scope="module")
def index(records):
    return graph.checkpointed(postings.build(records))


def ids(found):
    return {r["record_id"] for r in found[0].collect()}


@pytest.mark.parametrize(
    ("query", "mode", "want"),
    [
        ("heavy iron chain", "exact_phrase", {"r1"}),
        ("iron heavy chain", "exact_phrase", set()),
        ("iron chain", "all_terms", {"r1", "r3"}),
        ("iron counting", "all_terms", set()),
        ("counting drifting", "any_terms", {"r2", "r3"}),
        ("7.3 lamps", "any_terms", {"r1", "r2", "r3"}),
        ("mooring buoy", "all_terms", {"r1"}),
        ("How should buoys be moored on chains?", "natural_language", {"r1", "r2", "r3"}),
        ("HBR-CODE-310", "natural_language", {"r2"}),
        ("60", "natural_language", {"r1"}),
        ("duration", "concept_language", set()),
        ("iron nonexistenttopic", "natural_language", {"r1", "r3"}),
    ],
)
def test_modes(records, packages, index, query, mode, want):
    rows = lambda found: sorted((r["record_id"], r["clause_reference"], r["ordinal"], r["score"]) for r in found.collect())
    scanned, relaxed = search.search(records, packages, query, mode)
    assert ids((scanned,)) == want
    found, again = postings.search(index, packages, query, mode)
    assert rows(found) == rows(scanned) and again == relaxed
    for scope in ("7.3", "7", "9"):
        assert rows(postings.search(index, packages, query, mode, scope=scope)[0]) == rows(search.search(records, packages, query, mode, scope=scope)[0])


def test_index_equals_scan_on_every_table(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    rows = lambda found: sorted((r["package_digest"], r["record_id"], r["score"]) for r in found.collect())
    for query, mode in (("to the and the", "exact_phrase"), ("In of the", "any_terms"), ("conditions usual failure", "concept_language"), ("the of in", "all_terms"), ("Which licenses are applied?", "natural_language"), ("a-1 x/2", "natural_language")):
        want, relaxed = search.search(c.records, c.authorized(), query, mode, 1000)
        found, again = postings.search(c.postings, c.authorized(), query, mode, 1000)
        assert rows(found) == rows(want) and again == relaxed


def test_pruned_equals_ranked(spark, monkeypatch):
    """Small blocks and a small first look, so that all ways through the search are taken."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    rng = random.Random(4)
    words = ["iron", "chain", "heavy", "buoy", "duration", "period", "moored", "x1", "zz"]
    weights = [9, 7, 5, 3, 2, 2, 1, 1, 1]
    text = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(0, most)))
    rows = [(f"p{i % 3}", f"r{i}", rng.choice(["1", "1.2", "iron.3", None]), text(3), text(rng.choice([3, 40])), i // 3) for i in range(400)]
    frame = spark.createDataFrame(rows, "package_digest string, record_id string, clause_reference string, heading string, text string, ordinal long")
    served = spark.createDataFrame([("p0",), ("p1",)], "package_digest string")
    index = graph.checkpointed(postings.build(frame))
    promises = graph.checkpointed(postings.blocks(index))
    got = lambda df: [tuple(r) for r in df.collect()]
    cases = [("iron chain", "all_terms", 1, {}), ("zz moored buoy", "any_terms", 5, {}), ("iron chain", "exact_phrase", 5, {}), ("heavy duration", "concept_language", 5, {}), ("irons mooring", "natural_language", 1000, {"package_digest": "p1"}), ("x-1 iron", "natural_language", 5, {}), ("nothing", "all_terms", 5, {}), ("iron chain", "any_terms", 5, {"scope": "1"})]
    ways = ((2, 2048, 48), (1, 5, 48), (2, 2048, 1))
    for i, (query, mode, limit, narrow) in enumerate(cases):
        q = T.parse(query, mode)
        want = got(postings.ranked(index, served, q, limit, **narrow))
        for first, most, ranges in ways if not i else [ways[i % 3]]:
            monkeypatch.setattr(postings, "FIRST_BLOCKS", first)
            monkeypatch.setattr(postings, "MOST_BLOCKS", most)
            monkeypatch.setattr(postings, "MOST_RANGES", ranges)
            assert got(postings.pruned(index, promises, served, q, limit, **narrow)) == want, (query, mode, first)


def test_packed_equals_posted(spark, monkeypatch):
    """Short runs and small blocks, ordinals out of order, empty and missing columns."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "PACKED_BLOCK", 4)
    monkeypatch.setattr(postings, "RUN_TOKENS", 50)
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " ".join(rng.choices(["iron", "irons", "ironing", "chain", "9", "été"], k=rng.randint(1, 30)))])
    rows = [(f"p{i % 3}", f"r{i}", rng.choice(["1", "1.2", "iron.3", None]), text(), text(), i // 3) for i in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "package_digest string, record_id string, clause_reference string, heading string, text string, ordinal long")
    index = graph.checkpointed(postings.packed(frame))
    want, got = (df.where("form = 'word'").select(*(f.split()[0] for f in postings.POSTINGS.split(", "))).collect() for df in (postings.posted(frame), postings.unpacked(index)))
    shown = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)
    assert shown(got) == shown(want)
    stems = lambda df: sorted(map(repr, df.where("form = 'stem'").select("token", "record_id", "place", F.explode("positions").alias("p")).collect()))
    assert stems(postings.unpacked(index)) == stems(postings.posted(frame))
    # What a block promises is at least what its postings have.
    key = ["form", "token", "package_digest", "block"]
    least = postings.blocks(postings.unpacked(index)).withColumnRenamed("gain", "least")
    promised = postings.promises(index).groupBy(*key).agg(F.sum("gain").alias("gain"))
    assert least.join(promised, key, "left").where("gain is null or gain < least - 1e-9").count() == 0
    served = spark.createDataFrame([("p0",), ("p1",)], "package_digest string")
    for query, mode in (("iron chain", "all_terms"), ("iron chain", "exact_phrase"), ("irons", "natural_language"), ("ir-9 chain", "natural_language")):
        q = T.parse(query, mode)
        want = postings.ranked(postings.posted(frame), served, q, 7).collect()
        assert postings.ranked(postings.unpacked(index), served, q, 7).collect() == want
        for ranges in (48, 1):
            monkeypatch.setattr(postings, "MOST_RANGES", ranges)
            monkeypatch.setattr(postings, "FIRST_BLOCKS", 2)
            monkeypatch.setattr(postings, "MOST_BLOCKS", 2048 if ranges > 1 else 5)
            assert postings.pruned(postings.unpacked(index), postings.promises(index), served, q, 7).collect() == want


def test_index_is_small(spark):
    c = Corpus(spark, "/root/testdata/sf0.01")
    bytes_of = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    assert bytes_of(c.postings) < 2.5 * bytes_of(c.documents)


def test_few_rows_are_read_for_few_results(spark, sf_dir, monkeypatch):
    c, q, read = Corpus(spark, sf_dir), T.parse("that with", "all_terms"), []
    whole = postings._in_blocks
    monkeypatch.setattr(postings, "_in_blocks", lambda chosen, rows: read.extend(chosen) or whole(chosen, rows))
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 1)
    sizes = []
    for limit in (1, 1000):
        read.clear()
        assert postings.pruned(c.postings, c.blocks, c.authorized(), q, limit).collect() == postings.ranked(c.postings, c.authorized(), q, limit).collect()
        sizes.append(len(read))
    assert sizes[0] < sizes[1]


def test_a_changed_input_has_another_index(spark, tmp_path):
    made = lambda text: spark.createDataFrame([(0, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = lambda word: postings.search(Corpus(spark, str(tmp_path)).postings, Corpus(spark, str(tmp_path)).authorized(), word, blocks=Corpus(spark, str(tmp_path)).blocks)[0].count()
    made("first text")
    assert (found("first"), found("second")) == (1, 0)
    made("the second text")
    assert (found("first"), found("second")) == (0, 1)


def full_text_tokens(texts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts))
    out = [[] for _ in texts]
    for term, doc in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        out[doc].append(term)
    return out


#: Characters that the full-text index knows, whose tables are older than Python's: those of Unicode 3.2, but for the letters it takes for separators.
OLD = [chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.ucd_3_2_0.category(chr(i)) != "Cn" and unicodedata.category(chr(i)) == unicodedata.ucd_3_2_0.category(chr(i))]


def test_tokens_equal_full_text_index_on_all_characters(spark):
    texts = [f"q{c}z" for c in OLD] + [unicodedata.normalize("NFD", f"q{c}z") for c in OLD if len(unicodedata.normalize("NFD", c)) == 2 and unicodedata.normalize("NFD", c)[1] in T.MARKS]
    texts += ["École e\u0301cole \u0301x", "žlutý kůň ğ", "İstanbul ſtraße", "ΣΑΣ ΟΔΟΣ", "a_b c.d", "x\u0305y"]
    want = full_text_tokens(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    got = {r[0]: r[1] for r in frame.select("i", T.tokens(F.col("x"))).collect()}
    wrong = [(t, w, got[i]) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if got[i] != w]
    assert not wrong, (len(wrong), wrong[:20])
    assert [T.index_tokens(t) for t in texts] == want


def test_index_of_nothing(spark, records, packages):
    assert postings.build(records.limit(0)).count() == 0
    odd = spark.createDataFrame([("p1", "a", None, None, None, 0), ("p1", "b", "1", "", "...", 1), ("p1", "c", "1", "H", "x x x", 2), ("p1", "c", "1", "H", "x x x", 2)], records.schema)
    assert sorted((r["form"], r["token"], r["place"], r["positions"]) for r in postings.build(odd).where("record_id <> 'c'").collect()) == [("word", "1", 0, [0])]
    assert postings.many(postings.build(odd), packages, {"q": T.parse("x", "all_terms"), "r": T.parse("y", "all_terms")}).count() > 0


def test_concept_finds_alternatives(spark, packages):
    rows = spark.createDataFrame([("p1", "a", "1", "h", "the rationale is given", 0)], "package_digest string, record_id string, clause_reference string, heading string, text string, ordinal long")
    assert ids(search.search(rows, packages, "justification", "concept_language")) == {"a"}
    assert ids(search.search(rows, packages, "justification", "natural_language")) == set()


def test_hidden_rows_do_not_move_scores(spark, records, packages):
    both = spark.createDataFrame([("p1",), ("p2",)], "package_digest string")
    score = lambda p: {r["record_id"]: r["score"] for r in search.search(records, p, "iron chain", "all_terms")[0].collect()}
    alone, shared = score(packages), score(both)
    assert alone == {k: v for k, v in shared.items() if k in alone} and "r4" in shared


@pytest.mark.parametrize(("query", "mode", "code"), [("", "all_terms", "invalid_query"), ("...", "all_terms", "invalid_query"), ("the of a", "natural_language", "invalid_query"), ("x", "fuzzy", "invalid_query_mode"), ("x " * 40, "all_terms", "invalid_query")])
def test_invalid_queries(query, mode, code):
    with pytest.raises(EvidenceError) as e:
        T.parse(query, mode)
    assert e.value.code == code


def test_snippets_are_verbatim(records, packages):
    q = T.parse("iron chain", "all_terms")
    for r in search.snippets(search.ranked(records, packages, q), q).collect():
        body = r["matched_snippet"].strip(" …").replace("⟦", "").replace("⟧", "")
        assert body in r["text"] and re.findall("⟦(.*?)⟧", r["matched_snippet"])
        assert all(m.lower() in ("iron", "chain") for m in re.findall("⟦(.*?)⟧", r["matched_snippet"]))


TEXTS = ["a b a b a b", "a a a a", "b a c", "a b c a b", "", "c c"]


@pytest.mark.parametrize("phrases", [["a"], ["a b"], ["a a"], ["a b", "b a"], ["a", "a b"], ["c", "b"]])
def test_instances_equal_full_text_highlights(spark, phrases):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?)", [(t,) for t in TEXTS])
    rows = db.execute("SELECT x, (length(highlight(t, 0, '[', ']')) - length(x)) / 2 FROM t WHERE t MATCH ?", (" OR ".join(f'"{p}"' for p in phrases),)).fetchall()
    want = {t: 0 for t in TEXTS} | dict(rows)
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    got = {r[0]: r[1] for r in df.select("x", T.instances([T.Phrase(tuple(p.split())) for p in phrases], T.tokens(F.col("x")))).collect()}
    assert got == want


WORDS = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll loads retained connectors".split()


def test_porter_equals_full_text_index():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for w in WORDS:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert db.execute("SELECT term FROM v").fetchall() == [(T.porter(w),)], w


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB -/0\t", min_size=1, max_size=20))
def test_identifiers_are_stable(value):
    try:
        once = T.normalize_identifier(value)
    except EvidenceError:
        return
    assert T.normalize_identifier(once) == once
