from __future__ import annotations

import hashlib
import html
import json
import random
import unicodedata
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lexstrata.errors import EvidenceError
from lexstrata.functions import scalars
from lexstrata.operators import pages

TEXTS = ["", "plain", "a/b c~*+_.-%", "é́ é \r\nx \t\r\n\r\n", "\n\n  two\r\rthree  \n\n", "<a href='x'>&\"", "中文  \n", None, "a" * 100, "___...", "2024-02-29"]


def plain_page_text(text):
    lines = [x.rstrip() for x in unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n")]
    return "\n".join(lines).strip("\n")


def test_scalars_equal_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    t = F.col("t")
    got = rows.select("t", scalars.url_quoted(t).alias("q"), scalars.page_text(t).alias("p"), scalars.html_escaped(t).alias("h"), scalars.safe_file_name(t).alias("n")).collect()
    for r in got:
        if r["t"] is None:
            assert r["q"] is r["p"] is r["h"] is None
            continue
        assert (r["q"], r["p"], r["h"]) == (quote(r["t"], safe=".-"), plain_page_text(r["t"]), html.escape(r["t"]))
    assert {r["t"]: r["n"] for r in got if r["t"] in ("", "plain", "___...", "a" * 100, "a/b c~*+_.-%")} == {"": "document", "plain": "plain", "___...": "document", "a" * 100: "a" * 72, "a/b c~*+_.-%": "a_b_c"}


def test_pointers_and_dates(spark):
    value = {"a/b": {"~x": [1, {"k": "v"}]}, "n": None, "0": "z"}
    rows = spark.createDataFrame([(json.dumps(value),)], "j string")
    for pointer, want in (("/a~1b/~0x/1/k", "v"), ("/a~1b/~0x/0", "1"), ("/n", None), ("/none", None)):
        assert rows.select(scalars.at_pointer(F.col("j"), pointer)).first()[0] == want
    with pytest.raises(EvidenceError, match="invalid_pointer"):
        scalars.at_pointer(F.col("j"), "a")
    said = ["2024-02-29", "2023-02-29", "01-JAN-2020", "1-JAN-2020", "2024-2-1", "31-apr-2020", "", None]
    days = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i long, x string").orderBy("i").select(scalars.checked_date(F.col("x"))).collect()
    assert [str(r[0]) if r[0] else None for r in days] == ["2024-02-29", None, "2020-01-01", None, None, None, None, None]


def test_pages_are_where_they_are_said_to_be(spark):
    rows = [("d", 1, "one\r\ntwo  "), ("d", 2, " \n"), ("d", 3, None), ("d", 12345, "é́nd"), ("e", 7, "")]
    made = pages.compiled(spark.createDataFrame(rows, "document string, page long, text string"))
    whole = {r["document"]: r["text"].encode() for r in pages.extracted_text(made).collect()}
    assert set(whole) == {"d"} and whole["d"].startswith(b"[[PAGE_0001]]\none\ntwo\n\n[[PAGE_12345]]\n")
    for r in made.collect():
        if r["status"] == "extracted":
            assert whole["d"][r["start_byte"] : r["end_byte"]].decode() == r["text"]
        else:
            assert r["start_byte"] is r["text_sha256"] is None
    spans = spark.createDataFrame([(1, "d", 14, 17), (2, "d", 14, 40), (3, "d", 5, 16), (4, "x", 0, 1), (5, "d", 15, 15)], "i long, document string, start_byte long, end_byte long")
    got = {r["i"]: (r["page"], r["page_start"], r["page_end"], r["held"]) for r in pages.in_pages(spans, made.where("status = 'extracted'"), ["document"]).collect()}
    assert got == {1: (1, 0, 3, True)} | dict.fromkeys((2, 3, 4, 5), (None, None, None, False))


def test_documents_of_many_pages(spark, monkeypatch):
    """Small ranges, bins and parts against the whole text in one row."""
    monkeypatch.setattr(pages, "PAGE_RANGE", 3)
    monkeypatch.setattr(pages, "BIN_BYTES", 16)
    rng = random.Random(2)
    rows = [(d, p, rng.choice([None, "", "é" * rng.randint(1, 90), "line\nother " * rng.randint(1, 5)])) for d in "de" for p in rng.sample(range(200), 60)]
    frame = spark.createDataFrame(rows, "document string, page long, text string")
    made = pages.compiled(frame).collect()
    whole = {r["document"]: r["text"].encode() for r in pages.extracted_text(pages.compiled(frame)).collect()}
    assert len(made) == len(rows) and all(whole[r["document"]][r["start_byte"] : r["end_byte"]].decode() == r["text"] for r in made if r["status"] == "extracted")
    parts = sorted(tuple(r) for r in pages.text_parts(frame, 64).select("document", "part", "start_byte", "text").collect())
    for d, text in whole.items():
        assert "\n\n".join(x for doc, _, _, x in parts if doc == d).encode() == text
        assert all(text[start:].startswith(x.encode()) for doc, _, start, x in parts if doc == d)
    assert {r["document"]: (r["bytes"], r["text_sha256"]) for r in pages.text_digests(pages.text_parts(frame, 64)).collect()} == {d: (len(t), hashlib.sha256(t).hexdigest()) for d, t in whole.items()}
    spans = [(i, d, a, a + rng.randint(0, 40)) for i, (d, a) in enumerate((rng.choice("de"), rng.randint(0, 3000)) for _ in range(150))] + [(200 + i, r["document"], r["start_byte"], r["end_byte"]) for i, r in enumerate(made) if r["status"] == "extracted"]
    got = {r["i"]: (r["page"], r["page_start"], r["held"]) for r in pages.in_pages(spark.createDataFrame(spans, "i long, document string, start_byte long, end_byte long"), pages.placed(frame).where("status = 'extracted'"), ["document"]).collect()}
    for i, d, a, b in spans:
        inside = [r for r in made if r["document"] == d and r["status"] == "extracted" and r["start_byte"] <= a < b <= r["end_byte"]]
        assert got[i] == ((inside[0]["page"], a - inside[0]["start_byte"], True) if inside else (None, None, False))


def test_claims():
    packet = {"approved": True, "a": [{"Compliance": "yes", "approval": "not_decided", "compliant": None}, {"project_applicability": "applies"}], "b": {"approved": 0, "project_applicability": "not_decided"}}
    assert pages.claims_in(packet) == 3 and pages.claims_in([]) == 0
