"""Bundles: what is put in comes out, and nothing comes out of a broken one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexstrata.errors import EvidenceError
from lexstrata.sources import packs as P
from tests.test_service import make_pack


def test_round_trip_and_faults(spark, tmp_path):
    make_pack(tmp_path / "a", "a", 80)
    make_pack(tmp_path / "b", "b", 80)
    files = P.Packs(spark, str(tmp_path)).files.cache()
    blobs, members = P.bundle(files)
    rows = lambda df: sorted(map(str, df.select("pack", "path", "bytes", "sha256", "content").collect()))
    assert rows(P.materialized(blobs, members)) == rows(files) and blobs.count() < files.count() == members.count()
    codes = lambda b, m: {r["code"] for r in P.bundle_faults(b, m).collect()}
    source = F.col("path") == "sources/rules.txt"
    assert codes(blobs.withColumn("content", F.concat("content", F.encode(F.lit("?"), "UTF-8"))), members) == {"blob_hash_mismatch", "blob_size_mismatch"}
    assert codes(blobs.union(blobs), members) == {"repeated_blob"} and codes(blobs, members.union(members)) == {"repeated_member"}
    assert codes(blobs.limit(0), members) == {"blob_missing"} and codes(blobs, members.limit(0)) == {"unused_blob"}
    assert codes(blobs, members.withColumn("path", F.when(source, "a/../b").otherwise(F.col("path")))) == {"invalid_pack_path"}
    assert codes(blobs, members.withColumn("bytes", F.col("bytes") + 1)) == {"member_size_mismatch"}
    with pytest.raises(EvidenceError, match="bundle_mismatch") as e:
        P.materialized(blobs.limit(0), members)
    assert e.value.details["fault"] == "blob_missing"
    assert P.materialized(blobs.limit(0), members.limit(0)).collect() == []
