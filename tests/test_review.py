"""Drafts and promoted reviews, step by step."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from lexstrata.operators import pages, review

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
CANDIDATE = "document string, record_id string, logical_id string, kind string, clause_reference string, heading string, parent_logical_id string, text string, package_digest string, spans array<struct<start_byte bigint, end_byte bigint>>"
DECISION = f"draft_sha256 string, accepted boolean, node {review.NODE}, review struct<reviewer_id string, reviewer_type string, reviewed_at string>"
TEXTS = {1: "Größe\nlast é", 2: "", 3: "two"}


def compiled(spark, texts=TEXTS):
    return pages.compiled(spark.createDataFrame([("d", n, t) for n, t in texts.items()], "document string, page int, text string"))


def candidates(spark, made, cuts):
    """Candidates (name, kind, [(page, start, end)], text or None for the cited one) with spans in the extracted text."""
    at = {r["page"]: r["start_byte"] for r in made.collect()}
    rows = []
    for name, kind, spans, text in cuts:
        raw = [TEXTS[p].encode()[a:b] for p, a, b in spans]
        said = text if text is not None else "\n".join(x.decode("utf-8", "replace") for x in raw)
        rows.append(("d", name, "L" + name, kind, f"page-1-ambiguous-numbered-{name}" if name.isdigit() else "R" + name, "H", None, said, sha("pack"), [(at[p] + a, at[p] + b) for p, a, b in spans]))
    return spark.createDataFrame(rows, CANDIDATE)


CUTS = [
    ("whole", "clause", [(1, 0, 7)], None), ("both", "note", [(1, 8, 15), (3, 0, 3)], None), ("split", "clause", [(1, 0, 3)], None), ("across", "clause", [(1, 8, 20)], None), ("other", "clause", [(3, 0, 3)], "owt"),
    ("none", "clause", [], ""), ("many", "clause", [(3, 0, 3)] * 65, None), ("kind", "page", [(3, 0, 3)], None), ("7", "unsupported_region", [(3, 0, 2)], None), ("region", "unsupported_region", [(3, 0, 2)], None),
]


def test_drafts_and_decisions(spark):
    made = compiled(spark).cache()
    c = candidates(spark, made, CUTS)
    got = {r["record_id"]: r for r in review.drafts(c, made).collect()}
    bad, unsupported = "outline_source_mismatch", "outline_candidate_unsupported"
    assert {k: r["status"] for k, r in got.items()} == {"whole": review.STATE, "both": review.STATE, "7": review.STATE, "split": bad, "across": bad, "other": bad, "none": bad, "many": bad, "kind": unsupported, "region": unsupported}
    draft = json.loads(got["both"]["draft"])
    assert list(draft) == sorted(draft) and got["both"]["draft_sha256"] == sha(got["both"]["draft"])
    assert draft["proposed_node"] == {
        "logical_id": "Lboth", "kind": "note", "clause_reference": "Rboth", "heading": "H", "exact_text": "last é\ntwo",
        "source_spans": [{"physical_page": 1, "page_text_sha256": sha(TEXTS[1]), "start_byte": 8, "end_byte": 15}, {"physical_page": 3, "page_text_sha256": sha("two"), "start_byte": 0, "end_byte": 3}],
    }

    submitted = spark.createDataFrame([(r["draft"],) for r in got.values() if r["draft"]], "draft string")
    node = lambda name, **change: json.loads(got[name]["draft"])["proposed_node"] | change
    human = {"reviewer_id": "r", "reviewer_type": "human", "reviewed_at": "2025-01-01"}

    def status(name, proposal=None, accepted=True, by=human, at=made, times=1, rows=submitted, asked=None, **change):
        row = (proposal or got[name]["draft_sha256"], accepted, node(name, **change), by)
        found = review.promoted(rows, spark.createDataFrame([row] * times, DECISION), asked if asked is not None else c, at).collect()
        return {r["record_id"]: r["status"] for r in found}[None if proposal else name], found

    one, found = status("both")
    assert one == "reviewed_annotation_written" and {r["status"] for r in found if r["record_id"] != "both"} == {"undecided"}
    annotation = next(r["annotation"] for r in found if r["annotation"])
    assert json.loads(annotation)["proposal_sha256"] == got["both"]["draft_sha256"] and json.loads(annotation)["review"] == human
    made_now = spark.createDataFrame(found)
    both = spark.createDataFrame([(annotation,), (annotation + " ",)], "annotation string")
    assert [r["annotation"] for r in review.altered(both, made_now).collect()] == [annotation + " "]
    spans = node("whole")["source_spans"]
    stale, invalid = "outline_review_stale", "invalid_outline_review"
    assert status("whole", accepted=False)[0] == "rejected" and status("whole", times=2)[0] == "repeated_decision"
    assert status("whole", proposal=sha("x"))[0] == stale
    assert status("whole", logical_id="Lz")[0] == stale and status("whole", exact_text="Grosse")[0] == stale
    assert status("whole", source_spans=[spans[0] | {"page_text_sha256": sha("x")}])[0] == stale
    assert status("whole", source_spans=[spans[0] | {"physical_page": 9}])[0] == stale
    assert status("whole", source_spans=[spans[0] | {"end_byte": 3}], exact_text="Gr")[0] == invalid
    assert status("whole", source_spans=[spans[0] | {"end_byte": 99}])[0] == invalid and status("whole", source_spans=[])[0] != "reviewed_annotation_written"
    assert status("whole", by=human | {"reviewer_type": "nobody"})[0] == invalid
    # a region whose kind was open needs a kind and a reference of its own
    assert status("7")[0] == invalid and status("7", kind="clause")[0] == invalid
    assert status("7", kind="clause", clause_reference="4.1")[0] == "reviewed_annotation_written"
    # the page has changed since
    other = TEXTS | {3: "Two"}
    assert status("both", at=compiled(spark, other).cache())[0] == stale
    assert status("whole", at=compiled(spark, other).cache())[0] == "reviewed_annotation_written"
    assert status("whole", asked=c.where("record_id <> 'whole'"))[0] == stale


def test_drafts_of_another_shape(spark):
    made = compiled(spark)
    c = candidates(spark, made, CUTS[:1])
    good = review.drafts(c, made).first()["draft"]
    texts = [good[:-1], "", "[]", good.replace(review.STATE, "approved"), good.replace('"heading"', '"title"')]
    rows = spark.createDataFrame([(t,) for t in texts], "draft string")
    decisions = spark.createDataFrame([(sha(t), True, None, None) for t in texts], DECISION)
    assert [r["status"] for r in review.promoted(rows, decisions, c, made).collect()] == ["invalid_outline_review"] * 5
    assert review.promoted(rows.limit(0), decisions.limit(0), c.limit(0), made.limit(0)).collect() == [] == review.drafts(c.limit(0), made).collect()
