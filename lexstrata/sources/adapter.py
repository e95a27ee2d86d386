"""The record model over ordinary text tables.

``documents`` (and ``labels``) are projected into packages, records, typed
edges and grants.  Everything downstream works on these four DataFrames, or on
the same ones read from real packs (``lexstrata.sources.packs``).

* package: one for each (source, lang); its digest is SHA-256 of its edition.
* record: one for each non-blank line of a text, in order; line 0 is the
  section, the others are its clauses.
* edge: line n is governed by line n // 2 of its document; it is required
  unless n is a multiple of 3.
* grant: ``local-user`` is served en and fr, had de revoked, and has no es.

The line number comes from ``posexplode``, so records need no shuffle where the
ordinal isn't used; Catalyst drops the window then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexstrata.operators import postings
from lexstrata.sources.folder import shared_folder, signature

PRINCIPAL = "local-user"
#: Ids in a range that is numbered by one task.
ID_RANGE = 4096


#: Where tables made of an input stand, by application, input, what the input was then, and name.
_MADE: dict[tuple[str, str, str, str], str] = {}
#: Bytes of a row group in them.
ROW_GROUP = 1 << 25
#: Rows of the packed index up to which a search reads all of its tokens'.
PRUNED_ROWS = 1 << 22


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edition_of(source: Column, lang: Column) -> Column:
    return F.concat(F.lit("fam:"), source, F.lit(":"), lang)


@dataclass(frozen=True)
class Corpus:
    """packages, records, dependencies and grants of one input directory."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def documents(self) -> DataFrame:
        return read(self.spark, self.sf_dir, "documents")

    def _made(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table made of the documents: written once in an application while they stay as they are, then read."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._signature, name)
        if key not in _MADE:
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            build().write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
            _MADE[key] = path
        return self.spark.read.parquet(_MADE[key])

    @cached_property
    def _signature(self) -> str:
        return signature(self.spark, f"{self.sf_dir}/documents.parquet")

    @cached_property
    def packages(self) -> DataFrame:
        return self._made("packages", lambda: self._packages)

    @property
    def _packages(self) -> DataFrame:
        keys = self.documents.select("source", "lang").distinct()
        edition = edition_of(F.col("source"), F.col("lang"))
        return keys.select(
            F.sha2(edition, 256).alias("package_digest"),
            F.concat(F.lit("fam:"), "source").alias("family_id"),
            edition.alias("edition_id"),
            F.upper(F.concat_ws("-", "source", "lang")).alias("identifier"),
            F.col("lang"),
            F.when(F.col("lang") == "en", "page_text").otherwise("curated_records").alias("representation"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Non-blank lines with their number; no exchange."""
        kept = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
        return self.documents.select(F.sha2(edition_of(F.col("source"), F.col("lang")), 256).alias("package_digest"), edition_of(F.col("source"), F.col("lang")).alias("edition_id"), "doc_id", F.posexplode(kept).alias("pos", "text"))

    @cached_property
    def unnumbered(self) -> DataFrame:
        """Records without their ordinal in the package."""
        return self._named(self.lines)

    def _named(self, lines: DataFrame) -> DataFrame:
        """Records of lines; an ordinal stays."""
        pos = F.col("pos")
        doc = F.col("doc_id").cast("string")
        return lines.select(
            "package_digest",
            "edition_id",
            F.concat(F.lit("d"), doc, F.lit("-l"), pos.cast("string")).alias("record_id"),
            F.when(pos == 0, doc).otherwise(F.concat(doc, F.lit("."), pos.cast("string"))).alias("clause_reference"),
            F.substring("text", 1, 60).alias("heading"),
            F.when(pos == 0, "section").otherwise("clause").alias("kind"),
            "text",
            "doc_id",
            pos.cast("long").alias("pos"),
            F.when(pos > 0, F.concat(F.lit("d"), doc, F.lit("-l0"))).alias("parent_record_id"),
            *(["ordinal"] if "ordinal" in lines.columns else []),
        )

    @cached_property
    def records(self) -> DataFrame:
        """Records with their ordinal in the package, in the order of doc_id and line.

        A package may hold a third of all rows, so rows are numbered within
        (package, range of ids), and a running sum over the ranges' counts,
        one row each, says where a range starts.  Lines are moved for it, and
        what is made of them comes after.
        """
        span = F.floor(F.col("doc_id") / ID_RANGE)
        per_text = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
        digest = F.sha2(edition_of(F.col("source"), F.col("lang")), 256)
        counts = self.documents.groupBy(digest.alias("package_digest"), span.alias("span")).agg(F.sum(per_text).alias("n"))
        before = Window.partitionBy("package_digest").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("package_digest", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_ordinal"))
        here = Window.partitionBy("package_digest", "span").orderBy("doc_id", "pos")
        rows = self.lines.withColumn("span", span).join(starts, ["package_digest", "span"])
        return self._named(rows.withColumn("ordinal", (F.col("first_ordinal") + F.row_number().over(here) - 1).cast("long")))

    @cached_property
    def index(self) -> DataFrame:
        """The search index of the records, packed."""
        return self._made("index", lambda: postings.packed(self.records))

    @cached_property
    def postings(self) -> DataFrame:
        """The postings of the search index."""
        return postings.unpacked(self.index)

    @cached_property
    def blocks(self) -> DataFrame:
        """What the blocks of the index promise."""
        return postings.promises(self.index)

    @cached_property
    def promises(self) -> DataFrame | None:
        """The blocks if the index is large enough for them to save more than a look at them costs."""
        return self.blocks if self.index.count() > PRUNED_ROWS else None  # counted by the files' footers

    def around(self, hits: DataFrame) -> Corpus:
        """The corpus of the documents of some records only; hits are few."""
        ids = hits.select(F.regexp_extract("record_id", r"^d(\d+)-", 1).cast("long").alias("doc_id")).distinct()
        out = Corpus(self.spark, self.sf_dir)
        out.__dict__["documents"] = self.documents.join(F.broadcast(ids), "doc_id", "left_semi")
        return out

    @cached_property
    def roles(self) -> DataFrame:
        """doc_id, statement_role: obligation, informative or (no label) unclassified by default."""
        labels = read(self.spark, self.sf_dir, "labels")
        return labels.select("doc_id", F.when(F.col("quality") == 1, "obligation").otherwise("informative").alias("statement_role"))

    def with_roles(self, records: DataFrame) -> DataFrame:
        return records.join(self.roles, "doc_id", "left").withColumn("statement_role", F.coalesce("statement_role", F.lit("unclassified")))

    @cached_property
    def dependencies(self) -> DataFrame:
        """Edges from each line after the first; made from the lines, without a join."""
        record = lambda n: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-l"), n.cast("string"))
        return self.lines.where("pos > 0").select("package_digest", record(F.col("pos")).alias("source_record_id"), F.lit("governed_by").alias("relationship"), record(F.expr("pos div 2")).alias("target_record_id"), (F.col("pos") % 3 != 0).alias("required"))

    @cached_property
    def grants(self) -> DataFrame:
        return self.packages.where("lang in ('en', 'fr', 'de')").select(
            F.lit(PRINCIPAL).alias("principal_id"),
            "package_digest",
            (F.col("lang") != "de").alias("can_serve"),
            F.when(F.col("lang") == "de", "2026-01-01T00:00:00Z").alias("revoked_at"),
            F.sha2(F.concat(F.lit("policy:"), "lang"), 256).alias("policy_fingerprint"),
        )

    def authorized(self, principal: str = PRINCIPAL) -> DataFrame:
        """The packages that the principal is served: a row per grant, so small next to the records."""
        active = self.grants.where((F.col("principal_id") == principal) & F.col("can_serve") & F.col("revoked_at").isNull())
        return self.packages.join(active.select("package_digest", "policy_fingerprint"), "package_digest")

    def edition(self, side: str) -> DataFrame:
        """Two made-up editions of all records, for comparing: ``before`` and ``after``.

        before lacks documents with an id of 0 modulo 10, after those of 1;
        after, texts of 2 end in a mark, the spans of 3 moved by a byte and the
        records of 6 have other ids.
        """
        out = self.unnumbered.withColumn("start_byte", F.lit(0).cast("long"))
        turn = F.col("doc_id") % 10
        if side == "before":
            return out.where(turn != 0)
        text = F.when(turn == 2, F.concat("text", F.lit(" (amended)"))).otherwise(F.col("text"))
        renamed = F.when(turn == 6, F.concat(F.lit("e"), F.expr("substring(record_id, 2)"))).otherwise(F.col("record_id"))
        return out.where(turn != 1).withColumns({"text": text, "record_id": renamed, "start_byte": F.when(turn == 3, F.lit(1)).otherwise(F.lit(0)).cast("long")})
