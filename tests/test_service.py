from __future__ import annotations

import base64
import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexstrata import cursor as cursors
from lexstrata import render
from lexstrata.api import EvidenceService, locator, parse_locator
from lexstrata.errors import EvidenceError
from lexstrata.operators import graph
from lexstrata.sources import packs as P
from lexstrata.sources.store import Policy, Store

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def make_pack(root, edition, load, note="Count the links at low tide – twice.", extra=(), drop_edge=False):
    rows = [("buoy", "clause", "7.3", "Mooring", f"A buoy shall hang on a chain of {load} links.", "obligation"), ("tide", "note", "7.3 REMARK", "Counting", note, "governing_note"), ("paint", "clause", "7.4", "Colour", "A buoy shall be yellow all over.", "obligation"), *extra]
    source = "\n".join(r[4] for r in rows)
    records = [
        {
            "record_id": i, "edition_id": edition, "kind": k, "clause_reference": c, "heading": h, "text": t,
            "source": {"path": "sources/rules.txt", "sha256": sha(source), "page": 1, "locator": c, "quote_sha256": sha(t)},
            "derivation": {"statement_role": role, "method": "authored", "review_status": "reviewed"},
            "dependencies": [{"relationship": "governed_by", "target_record_id": "tide", "required": True}] if i == "buoy" and not drop_edge else [],
        }
        for i, k, c, h, t, role in rows
    ]
    coverage = dict.fromkeys(("corpus_scope", "edition_composition", "parsed_source_coverage", "dependency_closure", "enumeration_traversal", "output_budget_coverage"), "complete")
    files = {
        "manifest.json": json.dumps({"schema_version": "0.1.0", "pack_id": f"pack.{edition}", "document_family_id": "fam", "edition_id": edition, "publisher": "p", "identifier": "BUOY-RULES-1", "title": "t", "revision": "A", "publication_date": "2025-01-01", "category": "c", "coverage": coverage}),
        "rights.json": json.dumps({"rights_schema_version": "0.1.0", "content_class": "synthetic", "redistribution": "yes", "processing": [], "model_use": "yes", "statement": "s"}),
        "records.json": json.dumps({"schema_version": "0.1.0", "records": records}, ensure_ascii=False),
        "sources/rules.txt": source,
    }
    listed = [{"path": p, "sha256": sha(c), "bytes": len(c.encode())} for p, c in sorted(files.items())]
    files["inventory.json"] = json.dumps({"schema_version": "0.1.0", "algorithm": "sha256", "files": listed})
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return sha(cursors.canonical(listed))


POLICY = Policy("p", "user", True, True, ("pack.a", "pack.b"), ("synthetic",))


@pytest.fixture(scope="module")
def installed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("packs")
    a = make_pack(root / "a", "a", 80)
    b = make_pack(root / "b", "b", 100, extra=[("lamp", "clause", "7.5", "Light", "A lamp is optional.", "informative")])
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    digests = store.install(P.Packs(spark, str(root)), POLICY)
    assert set(digests) == {a, b}
    return EvidenceService(store, b"secret"), store, a, b


def test_get_clause_has_its_closure(installed):
    service, _, a, _ = installed
    packet = service.get_clause(a, "user", clause_reference="7.3")
    assert [r["record_id"] for r in packet["records"]] == ["buoy", "tide"]
    assert packet["relationships"] == [{"source_record_id": "buoy", "relationship": "governed_by", "target_record_id": "tide"}]
    assert packet["budget"]["used"] == len(cursors.canonical(packet))
    with pytest.raises(EvidenceError, match="budget_too_small"):
        service.get_clause(a, "user", clause_reference="7.3", max_bytes=100)
    with pytest.raises(EvidenceError, match="record_selector_mismatch"):
        service.get_clause(a, "user", clause_reference="7.3", record_id="paint")
    with pytest.raises(EvidenceError, match="not_found"):
        service.get_clause(a, "stranger", clause_reference="7.3")


def test_build_context_and_profiles(installed):
    service, _, a, _ = installed
    packet = service.build_context(a, ["7.3", "7.4", "7.3"], "user")
    assert [r["record_id"] for r in packet["records"]] == ["buoy", "tide", "paint"]
    assert service.select_evidence(a, "buoy", "user")["selected_profile"] == "concise"


@pytest.mark.parametrize("edges", [[], [("a", "r", "b"), ("b", "r", "x"), ("c", "r", "b")], [("c", "r", "b"), ("a", "r", "b")], [("x", "q", "a"), ("a", "q", "x")]])
def test_smaller_forms_lose_nothing(edges):
    records = [{"record_id": i, "kind": k, "clause_reference": None, "text": f"said é {i}", "ordinal": n, "statement_role": role, "text_sha256": sha(f"said é {i}"), "locator": locator("d", i)} for n, (i, k, role) in enumerate([("a", "note", "informative"), ("b", "note", None), ("c", "clause", "informative")])]
    packet = {"package": {"package_digest": "d"}, "records": records, "relationships": [dict(zip(("source_record_id", "relationship", "target_record_id"), e, strict=True)) for e in edges]}
    for some in (packet, packet | {"records": []}):
        sizes = [len(cursors.canonical(form(some))) for form in (lambda p: p, render.compact, render.concise)]
        assert render.expanded(render.compact(some)) == some and render.expanded(render.concise(some)) == some == render.expanded(some)
        assert not some["records"] or sizes[2] <= sizes[1] < sizes[0]


def test_changed_sources_are_not_shown(spark, tmp_path):
    digest = make_pack(tmp_path / "packs/a", "a", 80)
    store = Store(spark, str(tmp_path / "store"))
    store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY)
    service = EvidenceService(store, b"x")
    assert len(service.get_clause(digest, "user", record_id="buoy")["records"]) == 2
    whole = graph.checkpointed(store.records)
    store.__dict__["records"] = whole.withColumn("text", F.when(F.col("record_id") == "tide", "other").otherwise(F.col("text")))
    with pytest.raises(EvidenceError, match="source_changed") as e:
        service.get_clause(digest, "user", record_id="buoy")
    assert e.value.details["record_ids"] == ["tide"]
    assert len(service.get_clause(digest, "user", record_id="paint")["records"]) == 1
    store.__dict__["records"] = whole
    store.__dict__["sources"] = graph.checkpointed(store.sources).withColumn("content", F.encode(F.lit("A buoy shall be yellow all over."), "UTF-8"))
    with pytest.raises(EvidenceError, match="source_changed"):
        service.enumerate_obligations(digest, "user")


def test_install_after_a_crash(spark, tmp_path, monkeypatch):
    digest = make_pack(tmp_path / "packs/a", "a", 80)
    for last in ("postings", "records", "packages", "event"):
        store = Store(spark, str(tmp_path / last))
        whole, event = Store._write, Store._event

        def broken(self, name, rows, whole=whole, last=last):
            whole(self, name, rows)
            if name == last:
                raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(Store, "_write", broken)
            if last == "event":
                m.setattr(Store, "_event", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY)
        assert store._there("grants") is None and event is Store._event
        assert store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY) == [digest]
        assert (store.packages.count(), store.records.count(), store.dependencies.count(), store.sources.count()) == (1, 3, 1, 1)
        assert EvidenceService(store, b"x").browse_records(digest, "user")["total"] == 3


def test_obligations_page_by_page(installed):
    service, _, a, _ = installed
    first = service.enumerate_obligations(a, "user", limit=1)
    assert first["total"] == 2 and not first["traversal_complete"]
    assert [e["record_id"] for e in first["obligations"][0]["evidence"]] == ["buoy", "tide"]
    second = service.enumerate_obligations(a, "user", limit=1, cursor=first["next_cursor"])
    assert [o["record_id"] for o in second["obligations"]] == ["paint"] and second["traversal_complete"]
    with pytest.raises(EvidenceError, match="invalid_cursor"):
        service.enumerate_obligations(a, "user", limit=1, cursor=first["next_cursor"][:-3] + "abc")
    with pytest.raises(EvidenceError, match="cursor_scope_mismatch"):
        service.enumerate_obligations(a, "user", scope_prefix="7", limit=1, cursor=first["next_cursor"])


def test_browse(installed):
    service, _, a, _ = installed
    ids = lambda **k: [r["record_id"] for r in service.browse_records(a, "user", **k)["records"]]
    assert ids() == ["buoy", "tide", "paint"] and ids(kind="note") == ["tide"]
    assert ids(relation="outgoing", record_id="buoy") == ["tide"] and ids(relation="incoming", record_id="tide") == ["buoy"]
    assert ids(relation="adjacent", record_id="tide") == ["buoy", "paint"]


def test_diff(installed):
    service, _, a, b = installed
    packet = service.diff_editions(a, b, "user")
    status = {c["record_id"]: c["status"] for c in packet["changes"]}
    assert status == {"buoy": "modified", "tide": "unchanged", "paint": "unchanged", "lamp": "added"}
    assert packet["counts"] == {"added": 1, "removed": 0, "modified": 1, "moved": 0, "unchanged": 2}
    assert packet["dependencies_added"] == [] and packet["dependency_impact_paths"] == []


def with_structure(rows, structure):
    """The records with these structures (by record id, as JSON values)."""
    kind, out = rows.schema["structure"].dataType, F.lit(None)
    for record_id, value in structure.items():
        out = F.when(F.col("record_id") == record_id, F.from_json(F.lit(json.dumps(value)), kind)).otherwise(out)
    return rows.withColumn("structure", out.cast(kind))


def test_structure_in_navigation_and_comparison(installed):
    _, store, a, b = installed
    edge = {"relationship": "see", "target_status": "resolved", "target_logical_id": "T", "required": True, "evidence_spans": [{"start_byte": 1}]}
    old = {"tide": {"logical_id": "T"}, "paint": {"logical_id": "P", "source_spans": [{"start_byte": 3}], "relationships": [edge, edge | {"target_status": "ambiguous", "target_logical_id": "P"}]}}
    tables = lambda rows: SimpleNamespace(packages=store.packages, records=rows, dependencies=store.dependencies, grants=store.grants)
    one = with_structure(store.records.where(F.col("package_digest") == a), old)
    service = EvidenceService(tables(one), b"x")
    ids = lambda **k: [r["record_id"] for r in service.browse_records(a, "user", **k)["records"]]
    assert ids(relation="outgoing", record_id="paint") == ["tide"] and ids(relation="incoming", record_id="tide") == ["buoy", "paint"]
    assert service.browse_records(a, "user", relation="incoming", record_id="tide")["edges"] == [{"relationship": "governed_by", "record_id": "buoy", "required": True}, {"relationship": "see", "record_id": "paint", "required": True}]
    paint = old["paint"]
    for change, want in (({}, "unchanged"), ({"source_spans": [{"start_byte": 4}]}, "moved"), ({"relationships": [edge | {"evidence_spans": []}, paint["relationships"][1]]}, "moved"), ({"relationships": [edge]}, "modified"), ({"parent_logical_id": "T"}, "modified")):
        other = with_structure(store.records.where(F.col("package_digest") == b), old | {"paint": paint | change})
        changes = EvidenceService(tables(one.unionByName(other)), b"x").diff_editions(a, b, "user")["changes"]
        assert next(c["status"] for c in changes if c["record_id"] == "paint") == want
    role = store.records.withColumn("statement_role", F.when((F.col("package_digest") == b) & (F.col("record_id") == "paint"), "informative").otherwise(F.col("statement_role")))
    assert next(c["status"] for c in EvidenceService(tables(role), b"x").diff_editions(a, b, "user")["changes"] if c["record_id"] == "paint") == "modified"


def test_search_list_resolve(installed):
    service, _, a, b = installed
    hits = service.search("chain", "user", query_mode="all_terms")["results"]
    assert {(h["package_digest"], h["record_id"]) for h in hits} == {(a, "buoy"), (b, "buoy")} and all("⟦chain⟧" in h["matched_snippet"] for h in hits)
    scanned = EvidenceService(SimpleNamespace(**{n: getattr(service.tables, n) for n in ("packages", "records", "dependencies", "grants")}), b"x")
    for mode, said in (("natural_language", "Which buoys are yellow?"), ("any_terms", "tide lamp"), ("exact_phrase", "on a chain")):
        assert service.search(said, "user", query_mode=mode) == scanned.search(said, "user", query_mode=mode)
    page = service.list_documents("user", limit=1)
    rest = service.list_documents("user", limit=1, cursor=page["next_cursor"])
    assert {d["package_digest"] for d in page["documents"] + rest["documents"]} == {a, b} and not rest["has_more"]
    with pytest.raises(EvidenceError, match="ambiguous_document") as e:
        service.resolve_document(" buoy-rules - 1 ", "user")
    assert len(e.value.details["candidates"]) == 2
    assert service.resolve_document("BUOY-RULES-1", "user", edition_id="a")["document"]["package_digest"] == a


def test_follow_references(spark, installed):
    service, store, a, b = installed
    text = "A buoy shall hang on a chain of 100 links."
    row = lambda s: spark.createDataFrame([(a, "buoy", b, "buoy", s)], "source_package string, source_record_id string, target_package string, target_record_id string, text_sha256 string")
    linked = EvidenceService(store, b"x", bindings=row(sha(text)))
    assert linked.follow_references(a, "buoy", "user")["references"][0]["text"] == text
    with pytest.raises(EvidenceError, match="stale_reference_binding"):
        EvidenceService(store, b"x", bindings=row(sha("other"))).follow_references(a, "buoy", "user")


def test_revoked_packages_are_gone(spark, tmp_path):
    digest = make_pack(tmp_path / "packs/a", "a", 80)
    store = Store(spark, str(tmp_path / "store"))
    store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY)
    service = EvidenceService(store, b"x")
    assert service.browse_records(digest, "user")["total"] == 3
    assert store.revoke("user", digest) and not store.revoke("user", digest)
    with pytest.raises(EvidenceError, match="not_found"):
        service.browse_records(digest, "user")
    store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY)
    assert service.browse_records(digest, "user")["total"] == 3


@pytest.mark.parametrize(
    ("path", "change", "code"),
    [
        ("sources/rules.txt", lambda s: s[:-1] + "?", "pack_hash_mismatch"),
        ("sources/more.txt", lambda s: "extra", "untracked_pack_content"),
        ("rights.json", None, "missing_pack_file"),
        ("records.json", lambda s: s.replace("80 links", "90 links"), "source_quote_missing"),
        ("records.json", lambda s: s.replace('"target_record_id": "tide"', '"target_record_id": "gone"'), "unresolved_dependency"),
    ],
)
def test_violations(spark, tmp_path, path, change, code):
    make_pack(tmp_path / "a", "a", 80)
    f = tmp_path / "a" / path
    if change is None:
        f.unlink()
    else:
        f.write_text(change(f.read_text() if f.exists() else ""))
    assert code in {r["code"] for r in P.Packs(spark, str(tmp_path)).violations.collect()}


def test_policy_denies(spark, tmp_path):
    make_pack(tmp_path / "packs/a", "z", 80)
    with pytest.raises(EvidenceError, match="policy_denied"):
        Store(spark, str(tmp_path / "store")).install(P.Packs(spark, str(tmp_path / "packs")), POLICY)


def test_archives_round_trip(spark, tmp_path):
    members = {"a.json": b"{}", "sources/x.txt": "é".encode()}
    data = P.write_archive(members)
    assert data == P.write_archive(dict(reversed(members.items()))) and dict(P.archive_members(data)) == members
    (tmp_path / "p.zip").write_bytes(data)
    assert {r["path"] for r in P.unpacked(spark, str(tmp_path / "p.zip")).collect()} == set(members)
    with pytest.raises(EvidenceError, match="invalid_pack_path"):
        list(P.archive_members(P.write_archive({"../x": b""})))


def test_zips_are_packs_like_their_directories(spark, tmp_path):
    make_pack(tmp_path / "dirs/a", "a", 80)
    make_pack(tmp_path / "dirs/b", "b", 90, extra=())
    (tmp_path / "dirs/b/sources/rules.txt").write_text("changed")  # a violation
    (tmp_path / "zips/below").mkdir(parents=True)
    for name in "ab":
        home = tmp_path / "dirs" / name
        files = {str(f.relative_to(home)): f.read_bytes() for f in home.rglob("*") if f.is_file()}
        # one with its files at the top, one with them in a directory
        (tmp_path / "zips/below" / f"{name}.ZIP").write_bytes(P.write_archive(files if name == "a" else {f"in/{k}": v for k, v in files.items()}))
    dirs, zips = P.Packs(spark, str(tmp_path / "dirs")), P.Packs(spark, str(tmp_path / "zips"))
    rows = lambda df, *without: sorted(map(str, df.drop("pack", *without).collect()))
    assert rows(zips.packages) == rows(dirs.packages) and len(rows(zips.packages)) == 2
    assert rows(zips.records) == rows(dirs.records) and rows(zips.dependencies) == rows(dirs.dependencies)
    assert rows(zips.violations) == rows(dirs.violations) != []
    good = P.write_archive({"inventory.json": b"{}", "x": hashlib.shake_256(b"x").digest(1000)})
    bad = {"cut": good[:-30], "device": P.write_archive({"a/con.txt": b""}), "damaged": good[:400] + b"\xff" * 8 + good[408:]}
    for name, data in bad.items():
        (tmp_path / f"bad/{name}").mkdir(parents=True)
        (tmp_path / f"bad/{name}/p.zip").write_bytes(data)
        codes = {r["code"] for r in P.Packs(spark, str(tmp_path / f"bad/{name}")).violations.collect()}
        assert codes & {"invalid_pack_archive", "invalid_pack_path"}, name
    # a zip that is a source of a pack is a file
    (tmp_path / "dirs/a/sources/x.zip").write_bytes(good)
    again = P.Packs(spark, str(tmp_path / "dirs"))
    assert any(r["path"] == "sources/x.zip" for r in again.files.collect()) and again.packages.count() == 2
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "zips/below/b.ZIP").unlink()
    assert len(store.install(P.Packs(spark, str(tmp_path / "zips")), Policy("p", "user", True, True, ("pack.a",), ("synthetic",)))) == 1 and store.records.count() == 3


def test_locators_and_cursors():
    d = "a" * 64
    assert parse_locator(locator(d, "ü/1")) == (d, "ü/1")
    c = cursors.encode(b"k", {"principal": "u"}, 5, now=0)
    assert b"principal" in base64.urlsafe_b64decode(c.split(".")[0] + "==") and b'"u"' not in base64.urlsafe_b64decode(c.split(".")[0] + "==")
    assert cursors.decode(b"k", c, {"principal": "u"}, now=10) == 5
    for now, binding, key, code in ((901, {"principal": "u"}, b"k", "expired_cursor"), (1, {"principal": "v"}, b"k", "invalid_cursor"), (1, {"principal": "u"}, b"j", "invalid_cursor")):
        with pytest.raises(EvidenceError, match=code):
            cursors.decode(key, c, binding, now=now)


def test_command_line(spark, tmp_path, capsys):
    from lexstrata.cli import main

    digest = make_pack(tmp_path / "packs/a", "a", 80)
    (tmp_path / "policy.json").write_text(json.dumps({"policy_id": "p", "principal_id": "user", "allow_admin_install": True, "allow_serve": True, "allowed_pack_ids": ["pack.a"], "allowed_content_classes": ["synthetic"]}))
    call = lambda *a: (main(["--store", str(tmp_path / "store"), "--principal", "user", *a], spark), json.loads(capsys.readouterr().out))
    assert call("verify", str(tmp_path / "packs"))[1]["result"] == {"violations": []}
    assert call("install", str(tmp_path / "packs"), str(tmp_path / "policy.json"))[1]["result"]["installed"] == [digest]
    assert [r["record_id"] for r in call("get-clause", digest, "--clause-reference", "7.3")[1]["result"]["records"]] == ["buoy", "tide"]
    assert call("search", "chain")[1]["result"]["results"][0]["record_id"] == "buoy"
    assert call("list-documents", "--cursor", "x")[1]["error"]["code"] == "cursor_secret_missing"
    code, out = call("get-clause", digest, "--record-id", "none")
    assert code == 2 and out["error"]["code"] == "not_found"
