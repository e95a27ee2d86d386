"""Installing packs: policies, append-only tables and latest-wins grants."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexstrata.cursor import digest
from lexstrata.errors import error
from lexstrata.operators import postings
from lexstrata.operators.graph import checkpointed
from lexstrata.sources.packs import Packs

#: Files that the index of a package has at most.
INDEX_FILES = 8
GRANT = "principal_id string, package_digest string, generation long, can_serve boolean, revoked_at string, policy_fingerprint string"


@dataclass(frozen=True)
class Policy:
    """Who may install and be served which packs; its fingerprint is SHA-256 of its canonical JSON."""

    policy_id: str
    principal_id: str
    allow_admin_install: bool
    allow_serve: bool
    allowed_pack_ids: tuple[str, ...]
    allowed_content_classes: tuple[str, ...]

    @property
    def fingerprint(self) -> str:
        return digest({k: list(v) if isinstance(v, tuple) else v for k, v in self.__dict__.items()})


def latest(events: DataFrame) -> DataFrame:
    """The last event of each principal and package."""
    order = Window.partitionBy("principal_id", "package_digest").orderBy(F.desc("generation"))
    return events.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


class Store:
    """Parquet tables below a path: packages, records and dependencies by package, and grant events.

    A package's rows are partitions under its digest.  Its row in packages is
    written last and so says that all others are there: after a crash in between,
    the next install writes the same partitions again.  Installing it again only
    adds a grant event; a revoke is an event too.  Each event takes its number by
    creating a file that must not exist yet.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    @cached_property
    def packages(self) -> DataFrame:
        return self._read("packages")

    @cached_property
    def records(self) -> DataFrame:
        return self._read("records")

    @cached_property
    def dependencies(self) -> DataFrame:
        return self._read("dependencies")

    @cached_property
    def sources(self) -> DataFrame:
        """package_digest, path, bytes, sha256, content of the installed source files."""
        return self._read("sources")

    @cached_property
    def postings(self) -> DataFrame:
        """The search index, written with each package."""
        return self._read("postings", postings.POSTINGS)

    @cached_property
    def blocks(self) -> DataFrame:
        """What the blocks of the index promise."""
        return self._read("blocks", postings.BLOCKS)

    @property
    def grants(self) -> DataFrame:
        return latest(self._read("grants", GRANT))

    def _there(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A table, or None before its first write."""
        try:
            return self._read(name, schema)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @property
    def generation(self) -> int:
        events = self._there("grants", GRANT)
        return 0 if events is None else events.agg(F.max("generation")).first()[0] or 0

    def _next_generation(self) -> int:
        """A number that no other event has, whoever writes at the same time."""
        number = self.generation + 1
        while True:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations/{number}")
            if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(at):
                return number
            number += 1

    def install(self, packs: Packs, policy: Policy) -> list[str]:
        """Check and write packs that the policy allows; returns their digests."""
        packs.checked()
        found = packs.packages.select("package_digest", "pack_id", "content_class").collect()  # a row per pack of this call
        if not (policy.allow_admin_install and policy.allow_serve):
            raise error("policy_denied", "The policy doesn't allow installing.")
        for r in found:
            if r["pack_id"] not in policy.allowed_pack_ids or r["content_class"] not in policy.allowed_content_classes:
                raise error("policy_denied", "The policy doesn't allow this pack.", pack_id=r["pack_id"])
        new = [r["package_digest"] for r in found]
        whole = self._there("packages")
        there = set() if whole is None else {r[0] for r in whole.select("package_digest").where(F.col("package_digest").isin(new)).collect()}
        other = self._conflicting(packs, sorted(there)) if there else []
        if other:
            raise error("object_store_conflict", "The store holds other content under a pack's digest.", package_digests=other)
        fresh = [d for d in new if d not in there]
        if fresh:
            parent = packs.records.select("package_digest", F.col("structure.logical_id").alias("parent_logical_id"), F.col("record_id").alias("parent_record_id")).where("parent_logical_id is not null")
            records = packs.records.withColumn("parent_logical_id", F.col("structure.parent_logical_id")).join(parent, ["package_digest", "parent_logical_id"], "left").drop("pack", "dependencies", "parent_logical_id")
            files = packs.files.where(F.col("path").startswith("sources/")).join(packs.packages.select("pack", "package_digest"), "pack").drop("pack")
            # A package's postings are dealt to INDEX_FILES by token, so tasks don't each write a file for each package.
            index = postings.posted(records).repartition("package_digest", F.pmod(F.xxhash64("token"), F.lit(INDEX_FILES))).sortWithinPartitions("package_digest", "form", "token", "ordinal")
            self._write("postings", index.where(F.col("package_digest").isin(fresh)))
            promises = postings.blocks(self._read("postings", postings.POSTINGS)).repartition("package_digest").sortWithinPartitions("package_digest", "form", "token")
            for name, rows in (("blocks", promises), ("records", records), ("dependencies", packs.dependencies), ("sources", files), ("packages", packs.packages.drop("pack"))):
                self._write(name, rows.where(F.col("package_digest").isin(fresh)))
        number = self._next_generation()
        self._event(policy.principal_id, new, number, True, None, policy.fingerprint)
        self._seen(number, whole=True)
        return new

    def _conflicting(self, packs: Packs, digests: list[str]) -> list[str]:
        """Those of the digests under which records, edges or source files are stored that aren't the packs'."""

        def marks(records: DataFrame, dependencies: DataFrame, sources: DataFrame) -> DataFrame:
            mark = lambda rows, *columns: rows.where(F.col("package_digest").isin(digests)).select("package_digest", F.sha2(F.to_json(F.struct(*columns)), 256).alias("mark"))
            return mark(records, "record_id", "ordinal", "text").union(mark(dependencies, "source_record_id", "relationship", "target_record_id", "required")).union(mark(sources, "path", "hash"))

        files = packs.files.where(F.col("path").startswith("sources/")).join(packs.packages.select("pack", "package_digest"), "pack")
        given = checkpointed(marks(packs.records, packs.dependencies, files.withColumn("hash", F.col("sha256"))))
        stored = checkpointed(marks(self._read("records"), self._read("dependencies"), self._read("sources").withColumn("hash", F.sha2("content", 256))))
        unlike = given.exceptAll(stored).union(stored.exceptAll(given)).select("package_digest").distinct()
        return sorted(r[0] for r in unlike.collect())  # at most a row per pack of this call

    def _seen(self, number: int, whole: bool = False) -> None:
        """Tables read before the event of this number are listed anew."""
        if whole or number != self.__dict__.get("_at"):
            for name in ("packages", "records", "dependencies", "sources", "postings", "blocks"):
                self.__dict__.pop(name, None)
            self._at = number

    def snapshot(self) -> Snapshot:
        """The store as it is now, whatever is installed or revoked later."""
        return Snapshot(self)

    def _write(self, name: str, rows: DataFrame) -> None:
        """The partitions of these packages, in place of what a broken install may have left."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package_digest").parquet(f"{self.path}/{name}")

    def revoke(self, principal_id: str, package_digest: str) -> bool:
        now = self.grants.where((F.col("principal_id") == principal_id) & (F.col("package_digest") == package_digest) & F.col("can_serve")).select("policy_fingerprint").first()
        if now is None:
            return False
        self._event(principal_id, [package_digest], self._next_generation(), False, datetime.now(UTC).isoformat(), now[0])
        return True

    def _event(self, principal: str, digests: list[str], generation: int, serve: bool, revoked_at: str | None, fingerprint: str) -> None:
        self.spark.createDataFrame([(principal, d, generation, serve, revoked_at, fingerprint) for d in digests], GRANT).coalesce(1).write.mode("append").parquet(f"{self.path}/grants")


class Snapshot:
    """One state of a store for all reads of an operation.

    The files of events are listed once, when it is made, and never change; an
    event is an install's last write.  So grants, and the packages that any of
    these events names, stay what they are, and a package's rows are those of its
    digest.
    """

    def __init__(self, store: Store) -> None:
        events = store._there("grants", GRANT)
        events = store.spark.createDataFrame([], GRANT) if events is None else events
        self.generation: int = events.agg(F.max("generation")).first()[0] or 0
        store._seen(self.generation)
        self.store, self.grants = store, latest(events)
        self._named = events.select("package_digest").distinct()

    @cached_property
    def packages(self) -> DataFrame:
        return self.store.packages.join(self._named, "package_digest", "left_semi")

    @property
    def records(self) -> DataFrame:
        return self.store.records

    @property
    def dependencies(self) -> DataFrame:
        return self.store.dependencies

    @property
    def sources(self) -> DataFrame:
        return self.store.sources

    @property
    def postings(self) -> DataFrame:
        return self.store.postings

    @property
    def blocks(self) -> DataFrame:
        return self.store.blocks
