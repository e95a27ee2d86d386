"""Closed schemas against a plain walk of the parsed JSON."""

from __future__ import annotations

import datetime
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.functions import closed as C
from lexstrata.sources import packs as P
from tests.test_service import make_pack

NODE = C.Closed({"id": C.Text(), "n": C.Whole(1), "ok": C.Flag()}, {"up": C.Null(C.Text(least=0)), "role": C.Text(choices=("a", "b")), "any": C.Any(), "day": C.Day()})
TREE = C.Closed({"v/~": C.Text(pattern="^[0-9]+$"), "nodes": C.Items(NODE, least=1, most=3)}, {"rows": C.Items(C.Items(C.Whole()))})


def walk(value, kind, path=""):
    if isinstance(kind, C.Any):
        return
    if isinstance(kind, C.Null):
        if value is not None:
            yield from walk(value, kind.kind, path)
        return
    wanted = {C.Closed: dict, C.Items: list, C.Flag: bool, C.Whole: int, C.Text: str, C.Day: str}[type(kind)]
    if type(value) is not wanted or wanted is int and not -(2**63) <= value < 2**63:
        yield path, "wrong_type"
    elif isinstance(kind, C.Closed):
        known = kind.required | kind.optional
        step = lambda k: path + "/" + k.replace("~", "~0").replace("/", "~1")
        yield from ((step(k), "missing_field") for k in kind.required if k not in value)
        for k, v in value.items():
            if k in known:
                yield from walk(v, known[k], step(k))
            else:
                yield step(k), "unknown_field"
    elif isinstance(kind, C.Items):
        if len(value) < kind.least or kind.most is not None and len(value) > kind.most:
            yield path, "out_of_range"
        for i, v in enumerate(value):
            yield from walk(v, kind.of, f"{path}/{i}")
    elif isinstance(kind, C.Whole):
        if value < kind.least:
            yield path, "out_of_range"
    elif isinstance(kind, C.Day):
        try:
            if not re.fullmatch(r"\d{4}-\d\d-\d\d", value, re.A):
                raise ValueError
            datetime.date.fromisoformat(value)
        except ValueError:
            yield path, "not_allowed"
    elif isinstance(kind, C.Text):
        if len(value) < kind.least:
            yield path, "out_of_range"
        elif kind.choices and value not in kind.choices or kind.pattern and not re.search(kind.pattern, value):
            yield path, "not_allowed"


def expected(text, kind):
    def pairs(found):
        if len({k for k, _ in found}) != len(found):
            raise ValueError("repeated key")
        return dict(found)

    try:
        value = json.loads(text, object_pairs_hook=pairs)
    except (ValueError, TypeError):
        return [("", "invalid_json")]
    return sorted(walk(value, kind))


def found(spark, texts, kind):
    rows = C.json_faults(spark.createDataFrame(list(enumerate(texts)), "i int, j string"), F.col("j"), kind, ["i"]).collect()
    return [sorted((r["path"], r["fault"]) for r in rows if r["i"] == i) for i in range(len(texts))]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "a", "7", "2024-02-29", "2023-02-29", "é", 1.5, 2.0, 2**63]), lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.sampled_from(["id", "n", "ok", "up", "role", "day", "x~y", "a/b"]), inner, max_size=6), max_leaves=12)
NODES = st.fixed_dictionaries({}, optional={k: VALUES | good for k, good in {"id": st.just("i"), "n": st.integers(0, 3), "ok": st.booleans(), "up": st.none(), "role": st.sampled_from("abc"), "day": st.just("2024-02-29"), "any": VALUES}.items()})
TREES = st.fixed_dictionaries({}, optional={"v/~": st.sampled_from(["12", "x", 3]), "nodes": st.lists(NODES | VALUES, max_size=4), "rows": st.lists(st.lists(st.integers(-1, 2)), max_size=3) | VALUES, "more": VALUES})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES | VALUES, min_size=40, max_size=60))
def test_faults_are_those_of_a_walk(spark, values):
    texts = [json.dumps(v) for v in values]
    assert found(spark, texts, TREE) == [expected(t, TREE) for t in texts]


def test_what_is_no_json(spark):
    texts = [None, "", "{", '{"id":1,"id":2}', "nul", '{"id": NaN}', "[]", "null", '"x"']
    assert found(spark, texts[:6], NODE) == [[("", "invalid_json")]] * 6
    assert found(spark, texts[6:], NODE) == [[("", "wrong_type")]] * 3
    rows = spark.createDataFrame([(1, '{"r":[1,{"id":"a","n":0,"ok":true,"z":1}]}'), (2, '{"r":{}}'), (3, "{"), (4, None), (5, '{"r":[]}')], "i int, j string")
    got = C.item_faults(rows, F.col("j"), "r", NODE, ["i"]).collect()
    assert sorted(map(tuple, got)) == [(1, "/r/0", "wrong_type"), (1, "/r/1/n", "out_of_range"), (1, "/r/1/z", "unknown_field")]
    assert C.json_faults(rows.limit(0), F.col("j"), NODE, ["i"]).collect() == []


@pytest.mark.parametrize(
    ("path", "change", "code", "item"),
    [
        ("manifest.json", lambda v: v | {"owner": "x"}, "invalid_manifest", "manifest.json#/owner unknown_field"),
        ("manifest.json", lambda v: v | {"publication_date": "2025-02-30"}, "invalid_manifest", "manifest.json#/publication_date not_allowed"),
        ("manifest.json", lambda v: v | {"coverage": {"corpus_scope": 1}}, "invalid_manifest", "manifest.json#/coverage/corpus_scope wrong_type"),
        ("rights.json", lambda v: v | {"processing": ["a", 2]}, "invalid_rights", "rights.json#/processing/1 wrong_type"),
        ("records.json", lambda v: v | {"records": [v["records"][0] | {"kind": "verse"}, *v["records"][1:]]}, "invalid_record", "records.json#/records/0/kind not_allowed"),
        ("records.json", lambda v: v | {"records": [{k: x for k, x in r.items() if k != "heading"} for r in v["records"]]}, "invalid_record", "records.json#/records/2/heading missing_field"),
        ("records.json", lambda v: [v], "invalid_records", "records.json# wrong_type"),
    ],
)
def test_shapes_of_packs(spark, tmp_path, path, change, code, item):
    make_pack(tmp_path / "a", "a", 80)
    assert P.Packs(spark, str(tmp_path)).shape_faults.collect() == []
    f = tmp_path / "a" / path
    f.write_text(json.dumps(change(json.loads(f.read_text()))))
    assert (code, item) in {(r["code"], r["item"]) for r in P.Packs(spark, str(tmp_path)).violations.collect()}
