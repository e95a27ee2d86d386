"""Compiles that break off, and reads while a store changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexstrata.api import EvidenceService
from lexstrata.errors import EvidenceError
from lexstrata.sources import packs as P
from lexstrata.sources.ledger import Compile
from lexstrata.sources.store import Policy, Snapshot, Store
from tests.test_service import POLICY, make_pack


def units(spark, n=12, changed=()):
    return spark.createDataFrame([(f"u{i}", f"new{i}" if i in changed else f"d{i}", i) for i in range(n)], "unit string, digest string, size int")


def work(rows):
    bad = F.when(F.col("size") % 5 == 4, "unreadable")
    return rows.select("unit", bad.alias("error"), F.explode(F.when(bad.isNull(), F.sequence(F.lit(0), F.col("size"))).otherwise(F.array(F.lit(None).cast("int")))).alias("value"))


def state(c):
    return sorted(tuple(r) for r in c.results().select("unit", "value").collect()), sorted((r["unit"], r["error"]) for r in c.outcomes.collect())


def test_a_broken_run_is_taken_up_again(spark, tmp_path):
    whole = Compile(spark, str(tmp_path / "whole"))
    whole.run(units(spark), work, slices=4)
    done = []

    def breaks(rows):
        done.append(1)
        if len(done) == 3:
            # some rows are written, then a task dies
            return work(rows).withColumn("value", F.when(F.col("value") == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("value")).cast("int"))
        return work(rows)

    c = Compile(spark, str(tmp_path / "c"))
    with pytest.raises(Exception, match="lost"):
        c.run(units(spark), breaks, slices=4)
    assert not any((tmp_path / "c/staged").iterdir())
    first = {r["unit"]: r["run"] for r in c.outcomes.collect()}
    assert 0 < len(first) < 12 and c.results().count() < whole.results().count()
    with pytest.raises(EvidenceError, match="corpus_compile_incomplete"):
        c.finished(units(spark))
    c.run(units(spark), work, slices=4)
    assert state(c) == state(whole)
    # what was compiled before stays; only what failed is tried again
    tried = {r["unit"]: r["attempts"] for r in c.outcomes.collect()}
    assert {u for u, n in tried.items() if n > 1} == {u for u in first if u in ("u4", "u9")}
    assert all(r["run"] == first[r["unit"]] for r in c.outcomes.collect() if r["unit"] in first and r["error"] is None)
    with pytest.raises(EvidenceError, match="corpus_compile_incomplete") as e:
        c.finished(units(spark))
    assert e.value.details["first"] == {"u4": "unreadable", "u9": "unreadable"}
    c.finished(units(spark).where("size % 5 <> 4"))


def test_changed_units_silent_work_and_damage(spark, tmp_path):
    c = Compile(spark, str(tmp_path / "c"))
    with pytest.raises(EvidenceError, match="not_found"):
        c.results()
    c.run(units(spark, 0), work)
    assert c.outcomes.count() == 0
    c.run(units(spark), work, slices=2)
    before = c.results().count()
    c.run(units(spark, changed=(2,)), lambda rows: work(rows.withColumn("size", F.col("size") + 1)), slices=2)
    assert c.results().where("unit = 'u2'").count() == 4 and c.results().count() >= before + 1
    c.run(units(spark, 14), lambda rows: work(rows).where("unit <> 'u13'"), slices=2)
    assert {r["unit"]: r["error"] for r in c.outcomes.collect()}["u13"] == "no_result"
    assert c.damaged().collect() == [] and c.pending(units(spark, 14, changed=(2,)), check=True).count() <= 3
    run = c.outcomes.where("unit = 'u0'").first()
    for f in (tmp_path / "c/rows" / f"run={run['run']}" / f"slice={run['slice']}").glob("*.parquet"):
        f.unlink()
    lost = {r["unit"] for r in c.damaged().collect()}
    assert "u0" in lost
    c.run(units(spark, 14, changed=(2,)), work, slices=2, check=True)
    assert c.damaged().collect() == [] and c.results().where("unit = 'u0'").count() == 1


def test_reads_of_one_state(spark, tmp_path):
    a = make_pack(tmp_path / "one/a", "a", 80)
    store = Store(spark, str(tmp_path / "store"))
    assert Snapshot(store).generation == 0
    store.install(P.Packs(spark, str(tmp_path / "one")), POLICY)
    state = store.snapshot()
    service = EvidenceService(state, b"x")
    first = service.get_clause(a, "user", clause_reference="7.3")
    visible = service.visibility("user")
    b = make_pack(tmp_path / "two/b", "b", 100)
    other = Store(spark, store.path)  # another process
    other.install(P.Packs(spark, str(tmp_path / "two")), POLICY)
    other.revoke("user", a)
    assert service.get_clause(a, "user", clause_reference="7.3") == first and service.visibility("user") == visible
    with pytest.raises(EvidenceError, match="not_found"):
        service.get_clause(b, "user", clause_reference="7.3")
    # the store itself serves what is there now
    now = EvidenceService(store, b"x")
    assert [r["record_id"] for r in now.get_clause(b, "user", clause_reference="7.3")["records"]] == ["buoy", "tide"]
    with pytest.raises(EvidenceError, match="not_found"):
        now.get_clause(a, "user", clause_reference="7.3")
    assert store.snapshot().generation == 3 and state.generation == 1


def test_a_revoke_while_an_operation_reads(spark, tmp_path):
    a = make_pack(tmp_path / "packs/a", "a", 80)
    store = Store(spark, str(tmp_path / "store"))
    store.install(P.Packs(spark, str(tmp_path / "packs")), POLICY)
    service = EvidenceService(store, b"x")
    read = EvidenceService._closure
    try:
        def revoked_in_between(self, *args):
            found = read(self, *args)
            Store(spark, store.path).revoke("user", a)
            return found

        EvidenceService._closure = revoked_in_between
        with pytest.raises(EvidenceError, match="authorization_changed"):
            service.get_clause(a, "user", clause_reference="7.3")
    finally:
        EvidenceService._closure = read


def test_other_content_under_a_digest(spark, tmp_path):
    make_pack(tmp_path / "packs/a", "a", 80)
    packs = P.Packs(spark, str(tmp_path / "packs"))
    store = Store(spark, str(tmp_path / "store"))
    digest = store.install(packs, POLICY)[0]
    assert store.install(packs, POLICY) == [digest]
    rows = spark.read.parquet(f"{store.path}/sources").withColumn("content", F.encode(F.lit("other"), "UTF-8")).collect()
    spark.createDataFrame(rows, store.sources.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package_digest").parquet(f"{store.path}/sources")
    with pytest.raises(EvidenceError, match="object_store_conflict") as e:
        store.install(packs, Policy("p", "user", True, True, ("pack.a",), ("synthetic",)))
    assert e.value.details["package_digests"] == [digest]
