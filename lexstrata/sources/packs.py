"""Immutable document packs: reading, checking, archives and bundles.

A pack is a directory (or zip) of ``inventory.json``, ``manifest.json``,
``rights.json``, ``records.json`` and ``sources/``.  Any number of packs is read
by one ``binaryFile`` scan; the JSON is parsed on the executors with closed
schemas, and every rule that a pack must meet is a DataFrame of violations.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.errors import EvidenceError, error
from lexstrata.functions import closed
from lexstrata.functions.closed import SHA256, Closed, Day, Flag, Items, Null, Text, Whole
from lexstrata.operators.graph import checkpointed
from lexstrata.operators.verify import byte_slice

INVENTORY = "schema_version string, algorithm string, files array<struct<path string, sha256 string, bytes long>>"
COVERAGE = "struct<corpus_scope string, edition_composition string, parsed_source_coverage string, dependency_closure string, enumeration_traversal string, output_budget_coverage string>"
MANIFEST = f"schema_version string, pack_id string, document_family_id string, edition_id string, publisher string, identifier string, title string, revision string, publication_date string, category string, representation string, coverage {COVERAGE}"
RIGHTS = "rights_schema_version string, content_class string, redistribution string, processing array<string>, model_use string, statement string"
SPAN = "struct<path string, sha256 string, text_path string, text_sha256 string, physical_page int, start_byte long, end_byte long, quote_sha256 string>"
RELATION = f"struct<relationship string, target_status string, target_logical_id string, target_locator string, required boolean, method string, review_status string, evidence_spans array<{SPAN}>>"
STRUCTURE = f"struct<logical_id string, content_sha256 string, parent_logical_id string, ordinal long, source_spans array<{SPAN}>, relationships array<{RELATION}>>"
RECORD = (
    "struct<record_id string, edition_id string, kind string, clause_reference string, heading string, text string, "
    "source struct<path string, sha256 string, text_path string, text_sha256 string, page int, locator string, quote_sha256 string, text_start_byte long, text_end_byte long>, "
    "derivation struct<statement_role string, method string, review_status string>, "
    f"dependencies array<struct<relationship string, target_record_id string, required boolean>>, structure {STRUCTURE}>"
)
RECORDS = f"schema_version string, records array<{RECORD}>"

# The closed vocabularies of records.
ROLES = ("obligation", "governing_note", "informative", "unclassified")
KINDS = ("clause", "note", "page", "document", "section", "paragraph", "list", "list_item", "table", "table_row", "table_cell", "definition", "figure", "unsupported_region")
REPRESENTATIONS = ("page_text", "derived_structure", "reviewed_structure", "curated_records")
RELATIONSHIPS = ("contains", "sequence_after", "governed_by", "defines", "uses_definition", "qualifies", "exception_to", "references", "caption_of", "table_footnote_for", "footnote_for", "header_for", "illustrates", "continues_on")
DIMENSIONS = ("corpus_scope", "edition_composition", "parsed_source_coverage", "dependency_closure", "enumeration_traversal", "output_budget_coverage")
REQUIRED_FILES = ("inventory.json", "manifest.json", "rights.json", "records.json")
TARGET_STATUSES = ("resolved", "out_of_scope", "unresolved", "ambiguous")
MAX_FILES, MAX_BYTES, MAX_JSON = 512, 512 << 20, 32 << 20

# The shapes of a pack's files.  Paths of the files may be left out of a manifest; if given they are these.
VERSION = Text(choices=("0.1.0",))
INVENTORY_SHAPE = Closed({"schema_version": VERSION, "algorithm": Text(choices=("sha256",)), "files": Items(Closed({"path": Text(), "sha256": SHA256, "bytes": Whole()}), least=1, most=MAX_FILES)})
MANIFEST_SHAPE = Closed(
    dict.fromkeys(("pack_id", "document_family_id", "edition_id", "publisher", "identifier", "title", "revision", "category"), Text())
    | {"schema_version": VERSION, "publication_date": Day(), "coverage": Closed(dict.fromkeys(DIMENSIONS, Text()))},
    {"representation": Text(choices=REPRESENTATIONS), "inventory_path": Text(choices=("inventory.json",)), "rights_path": Text(choices=("rights.json",)), "records_path": Text(choices=("records.json",))},
)
RIGHTS_SHAPE = Closed({"rights_schema_version": VERSION, "content_class": Text(), "redistribution": Text(), "processing": Items(Text(least=0)), "model_use": Text(), "statement": Text()})
SPAN_SHAPE = Closed({"path": Text(), "sha256": SHA256, "text_path": Text(), "text_sha256": SHA256, "physical_page": Whole(1), "start_byte": Whole(), "end_byte": Whole(1), "quote_sha256": SHA256})
RELATION_SHAPE = Closed({
    "relationship": Text(choices=RELATIONSHIPS), "target_status": Text(choices=TARGET_STATUSES), "target_logical_id": Null(Text()), "target_locator": Null(Text()), "candidate_logical_ids": Items(Text()),
    "required": Flag(), "method": Text(), "review_status": Text(), "evidence_spans": Items(SPAN_SHAPE, least=1),
})
STRUCTURE_SHAPE = Closed(
    {"logical_id": Text(), "content_sha256": SHA256, "parent_logical_id": Null(Text()), "ordinal": Whole(), "source_spans": Items(SPAN_SHAPE, least=1, most=64), "relationships": Items(RELATION_SHAPE)},
    {"semantics": Null(closed.Any()), "review": Null(closed.Any())},
)
RECORD_SHAPE = Closed(
    dict.fromkeys(("record_id", "edition_id", "clause_reference", "heading"), Text())
    | {
        "kind": Text(choices=KINDS),
        "source": Closed({"path": Text(pattern="^sources/"), "sha256": SHA256, "page": Whole(1), "locator": Text(), "quote_sha256": SHA256}, {"text_path": Text(pattern="^sources/"), "text_sha256": SHA256, "text_start_byte": Whole(), "text_end_byte": Whole(1)}),
        "derivation": Closed({"statement_role": Text(choices=ROLES), "method": Text(), "review_status": Text()}),
        "dependencies": Items(Closed({"relationship": Text(), "target_record_id": Text(), "required": Flag()})),
    },
    {"text": Text(), "structure": Null(STRUCTURE_SHAPE)},
)
RECORDS_SHAPE = Closed({"schema_version": Text(choices=("0.1.0", "0.2.0", "0.3.0")), "records": Items(least=1)})
SHAPES = {"inventory.json": (INVENTORY_SHAPE, "invalid_inventory"), "manifest.json": (MANIFEST_SHAPE, "invalid_manifest"), "rights.json": (RIGHTS_SHAPE, "invalid_rights"), "records.json": (RECORDS_SHAPE, "invalid_records")}


#: Absolute paths, backslashes, . and .. parts, characters and device names that some systems don't take, trailing dots and spaces.
UNSAFE_PATH = r"^/|\\|(^|/)\.{0,2}(/|$)|[\x00-\x1f<>:\"|?*]|[ .](/|$)|(^|/)(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"


def safe_path(path: Column) -> Column:
    """Relative, with / only, and nothing of UNSAFE_PATH."""
    return (F.length(path) > 0) & ~path.rlike(UNSAFE_PATH)


def members(archives: DataFrame) -> DataFrame:
    """(path, length, content, fault) of the members of zips (path, content), as files below their archive's path.

    An archive that can't be read, or breaks the bounds on number, sizes and
    names, has one row with the fault's code instead of its further members.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    for name, content in archive_members(data.as_buffer()):
                        yield row(f"{path}/{name}", content, None)
                except EvidenceError as e:
                    yield row(path, None, e.code)

    def row(path: str, content: bytes | None, fault: str | None) -> pa.RecordBatch:
        kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("fault", pa.string())])
        return pa.RecordBatch.from_pylist([{"path": path, "length": None if content is None else len(content), "content": content, "fault": fault}], kinds)

    return archives.select("path", "content").mapInArrow(read, "path string, length long, content binary, fault string")


def _decoded(content: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8: filters on it may be tried on any file."""
    return F.try_validate_utf8(content.cast("string"))


def _above(path: Column) -> Column:
    """The directories above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


@dataclass(frozen=True)
class Packs:
    """Packs below a root, as the DataFrames of the record model and their violations."""

    spark: SparkSession
    root: str

    @cached_property
    def files(self) -> DataFrame:
        """(pack, path, bytes, sha256, content): every file of every directory, or directory of a zip, that has an inventory."""
        raw = self._raw.where("fault is null").drop("fault")
        # A file's directories, each a possible pack, are joined with those that have an inventory.
        homes = raw.where(F.col("path").endswith("/inventory.json")).select(F.regexp_replace("path", "/inventory.json$", "").alias("pack"))
        of = raw.select(F.col("path").alias("whole_path"), F.explode(_above(F.col("path"))).alias("pack")).join(homes, "pack")
        named = of.select("pack", "whole_path", F.expr("substring(whole_path, length(pack) + 2)").alias("path"))
        return named.join(raw.withColumnRenamed("path", "whole_path"), "whole_path").select("pack", "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")

    @cached_property
    def _raw(self) -> DataFrame:
        """(path, length, content, fault) of all files, and of the members of zips that aren't part of a directory's pack."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root).select("path", "length", "content")
        homes = found.where(F.col("path").endswith("/inventory.json")).select(F.regexp_replace("path", "/inventory.json$", "").alias("home"))
        zips = found.where(F.lower("path").endswith(".zip")).select("path", F.explode(_above(F.col("path"))).alias("home")).join(homes, "home", "left_semi").select("path")
        archives = found.where(F.lower("path").endswith(".zip")).join(zips, "path", "left_anti")
        return found.join(archives.select("path"), "path", "left_anti").withColumn("fault", F.lit(None).cast("string")).union(members(archives))

    @cached_property
    def listed_files(self) -> DataFrame:
        """files without their content: hashed once and kept, as most rules need no more."""
        return checkpointed(self.files.drop("content"))

    def _json(self, name: str, schema: str) -> DataFrame:
        text = _decoded(F.col("content"))
        return self.files.where(F.col("path") == name).select("pack", F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("j"))

    @cached_property
    def inventory(self) -> DataFrame:
        return self._json("inventory.json", INVENTORY).select("pack", F.inline("j.files"))

    @cached_property
    def packages(self) -> DataFrame:
        """One row per pack; the digest is SHA-256 of the inventory's canonical JSON, sorted by path."""
        entry = F.concat(F.lit('{"bytes":'), F.col("bytes").cast("string"), F.lit(',"path":"'), "path", F.lit('","sha256":"'), "sha256", F.lit('"}'))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), ",")
        digests = self.inventory.groupBy("pack").agg(F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256).alias("package_digest"))
        manifest = self._json("manifest.json", MANIFEST).select("pack", "j.*").drop("schema_version")
        rights = self._json("rights.json", RIGHTS).select("pack", F.col("j.content_class").alias("content_class"))
        inferred = F.when(F.col("coverage.parsed_source_coverage").startswith("text_layer_extracted_"), "page_text").when(F.col("coverage.parsed_source_coverage").startswith("partial_reviewed_structural_"), "reviewed_structure").otherwise("curated_records")
        out = digests.join(manifest, "pack").join(rights, "pack", "left")
        return out.withColumn("representation", F.coalesce("representation", inferred)).withColumnRenamed("document_family_id", "family_id")

    @cached_property
    def records(self) -> DataFrame:
        rows = self._json("records.json", RECORDS).select("pack", F.posexplode("j.records").alias("ordinal", "r"))
        rows = rows.join(self.packages.select("pack", "package_digest"), "pack")
        rows = rows.select("pack", "package_digest", F.col("ordinal").cast("long").alias("ordinal"), "r.*")
        # Offset-backed records hold no text of their own.
        texts = self.files.select("pack", F.col("path").alias("text_path"), "content")
        path = F.coalesce("source.text_path", "source.path")
        backed = rows.withColumn("text_path", F.when(F.col("text").isNull(), path)).join(texts, ["pack", "text_path"], "left")
        start, stop = F.col("source.text_start_byte"), F.col("source.text_end_byte")
        sliced = _decoded(F.substring("content", (start + 1).cast("int"), (stop - start).cast("int")))
        return backed.withColumns({"text": F.coalesce("text", sliced), "statement_role": F.col("derivation.statement_role")}).drop("content", "text_path")

    @cached_property
    def dependencies(self) -> DataFrame:
        return self.records.select("package_digest", F.col("record_id").alias("source_record_id"), F.inline("dependencies"))

    @cached_property
    def shape_faults(self) -> DataFrame:
        """(pack, file, code, path, fault): where the JSON files aren't of their closed shapes; a record is a row of its own."""
        text = _decoded(F.col("content"))
        mine = self.files.where(F.col("path").isin(*SHAPES)).withColumnRenamed("path", "file")
        code = F.coalesce(*(F.when(F.col("file") == name, F.lit(code)) for name, (_, code) in SHAPES.items()))
        whole = closed.json_faults_by(mine, text, F.col("file"), {name: shape for name, (shape, _) in SHAPES.items()}, ["pack", "file"])
        out = whole.select("pack", "file", code.alias("code"), "path", "fault")
        each = closed.item_faults(self.files.where("path = 'records.json'"), text, "records", RECORD_SHAPE, ["pack"])
        return out.union(each.select("pack", F.lit("records.json").alias("file"), F.lit("invalid_record").alias("code"), "path", "fault"))

    @cached_property
    def violations(self) -> DataFrame:
        """(pack, code, item) of every broken rule; a sound pack has none."""
        parts = []

        def broken(rows: DataFrame, code: str, item: Column) -> None:
            parts.append(rows.select("pack", F.lit(code).alias("code"), item.cast("string").alias("item")))

        faults = self._raw.where("fault is not null")
        parts.append(faults.select(F.col("path").alias("pack"), F.col("fault").alias("code"), F.col("path").alias("item")))
        parts.append(self.shape_faults.select("pack", "code", F.concat_ws(" ", F.concat(F.col("file"), F.lit("#"), F.col("path")), "fault").alias("item")))
        listed = self.inventory.withColumnsRenamed({"bytes": "said_bytes", "sha256": "said_sha256"})
        both = self.listed_files.where("path <> 'inventory.json'").join(listed, ["pack", "path"], "full_outer")
        broken(both.where("said_sha256 is null"), "untracked_pack_content", F.col("path"))
        broken(both.where("sha256 is null"), "missing_pack_file", F.col("path"))
        broken(both.where("bytes <> said_bytes"), "pack_size_mismatch", F.col("path"))
        broken(both.where("sha256 <> said_sha256"), "pack_hash_mismatch", F.col("path"))
        broken(self.inventory.groupBy("pack", "path").count().where("count > 1"), "invalid_inventory", F.col("path"))
        broken(self.inventory.where(~safe_path(F.col("path"))), "invalid_pack_path", F.col("path"))
        homes = self.inventory.select("pack").distinct()
        needed = homes.select("pack", F.explode(F.array(*map(F.lit, REQUIRED_FILES))).alias("path"))
        broken(needed.join(self.listed_files.select("pack", "path"), ["pack", "path"], "left_anti"), "missing_pack_file", F.col("path"))
        sizes = self.listed_files.groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
        broken(sizes.where((F.col("n") > MAX_FILES) | (F.col("total") > MAX_BYTES)), "pack_limit_exceeded", F.col("n"))
        r = checkpointed(self.records)
        for key in ("record_id", "clause_reference"):
            broken(r.groupBy("pack", key).count().where(f"count > 1 and {key} is not null"), "invalid_records", F.col(key))
        editions = self.packages.select("pack", F.col("edition_id").alias("pack_edition"))
        broken(r.join(editions, "pack").where("edition_id <> pack_edition"), "edition_mismatch", F.col("record_id"))
        broken(r.where(~F.coalesce(F.col("statement_role").isin(*ROLES), F.lit(False))), "invalid_record", F.col("record_id"))
        broken(r.where(~F.sha2("text", 256).eqNullSafe(F.col("source.quote_sha256"))), "source_quote_missing", F.col("record_id"))
        sources = self.files.select("pack", F.col("path").alias("source_path"), F.col("sha256").alias("file_sha256"), "content")
        cited = r.withColumn("source_path", F.coalesce("source.text_path", "source.path")).join(sources, ["pack", "source_path"], "left")
        broken(cited.where("file_sha256 is null or (source.text_path is null and file_sha256 <> source.sha256)"), "source_hash_mismatch", F.col("record_id"))
        whole = _decoded(F.col("content"))
        said = F.when(F.col("source.text_start_byte").isNotNull(), byte_slice(whole, F.col("source.text_start_byte"), F.col("source.text_end_byte")) == F.col("text")).otherwise(F.contains(whole, F.col("text")))
        broken(cited.where(~F.coalesce(said, F.lit(False))), "source_quote_missing", F.col("record_id"))
        edges = r.select("pack", "record_id", F.inline("dependencies"))
        broken(edges.join(r.select("pack", F.col("record_id").alias("target_record_id")), ["pack", "target_record_id"], "left_anti"), "unresolved_dependency", F.col("target_record_id"))
        nodes = r.where("structure is not null").select("pack", "record_id", "structure.logical_id", "structure.parent_logical_id")
        broken(nodes.groupBy("pack", "logical_id").count().where("count > 1"), "invalid_record", F.col("logical_id"))
        broken(nodes.where("parent_logical_id is not null").join(nodes.select("pack", F.col("logical_id").alias("parent_logical_id")), ["pack", "parent_logical_id"], "left_anti"), "invalid_record", F.col("parent_logical_id"))
        broken(nodes.where("parent_logical_id = logical_id"), "invalid_record", F.col("logical_id"))
        asked = r.select("pack", "record_id", F.inline("structure.relationships")).where("required and target_status = 'resolved'").join(nodes.select("pack", F.col("logical_id").alias("target_logical_id"), F.col("record_id").alias("target_record_id")), ["pack", "target_logical_id"]).select("pack", "record_id", "relationship", "target_record_id").distinct()
        stored = edges.where("required").join(nodes.select("pack", "record_id"), ["pack", "record_id"], "left_semi").select("pack", "record_id", "relationship", "target_record_id").distinct()
        broken(asked.exceptAll(stored).union(stored.exceptAll(asked)), "invalid_record", F.col("record_id"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def checked(self) -> Packs:
        """Itself, or the first violation as an error."""
        first = self.violations.orderBy("pack", "code", "item").limit(1).collect()
        if first:
            raise error(first[0]["code"], "A pack breaks a rule.", pack=first[0]["pack"], item=first[0]["item"])
        return self


def write_archive(members: dict[str, bytes]) -> bytes:
    """A zip of a pack with fixed times and order, so equal packs give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, members[name])
    return out.getvalue()


def archive_members(data: bytes | pa.Buffer) -> Iterator[tuple[str, bytes]]:
    """The members of a pack's zip, with its bounds on number, sizes and names enforced while reading."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise error("invalid_pack_archive", str(e)) from e
    with archive:
        infos = archive.infolist()
        if not (len(infos) <= MAX_FILES and sum(i.file_size for i in infos) <= MAX_BYTES):
            raise error("pack_limit_exceeded", "The archive is too large.")
        if len({i.filename.lower() for i in infos}) != len(infos):
            raise error("invalid_pack_archive", "Names repeat.")
        for info in infos:
            name = info.filename
            if not name or re.search(UNSAFE_PATH, name) or info.is_dir():
                raise error("invalid_pack_path", "A member's path is not safe.", path=name)
            try:
                with archive.open(info) as f:
                    content = f.read(info.file_size + 1)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:  # damaged, of an unknown method, or encrypted
                raise error("invalid_pack_archive", str(e)) from e
            if len(content) != info.file_size:
                raise error("pack_limit_exceeded", "A member is longer than it says.", path=name)
            yield name, content


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, bytes, sha256, content) of the members of pack archives."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    found = members(raw).withColumn("archive", F.regexp_extract("path", r"(?i)^(.*?\.zip)/", 1))
    name = F.when(F.col("fault").isNull(), F.expr("substring(path, length(archive) + 2)")).otherwise(F.raise_error(F.concat_ws(": ", "fault", "path")))
    return found.select("archive", name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def bundle(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, members): each content once by digest, and where it stands in each pack."""
    blobs = files.groupBy("sha256").agg(F.first("content").alias("content"), F.first("bytes").alias("bytes"))
    return blobs, files.select("pack", "path", "sha256", "bytes")


def bundle_faults(blobs: DataFrame, members: DataFrame) -> DataFrame:
    """(code, pack, path, sha256) of every broken rule of a bundle: each blob is what its digest says and used, each member safe, there and of its size."""
    none = F.lit(None).cast("string")
    parts = []

    def broken(rows: DataFrame, code: str, pack: Column = none, path: Column = none) -> None:
        parts.append(rows.select(F.lit(code).alias("code"), pack.alias("pack"), path.alias("path"), "sha256"))

    # Contents are read once; all other rules need digests and sizes only.
    seen = checkpointed(blobs.select("sha256", "bytes", F.sha2("content", 256).alias("now"), F.octet_length("content").cast("long").alias("size")))
    broken(seen.where(~F.col("now").eqNullSafe(F.col("sha256"))), "blob_hash_mismatch")
    broken(seen.where(~F.col("size").eqNullSafe(F.col("bytes"))), "blob_size_mismatch")
    broken(seen.groupBy("sha256").count().where("count > 1"), "repeated_blob")
    broken(seen.select("sha256").distinct().join(members, "sha256", "left_anti"), "unused_blob")
    pack, path = F.col("pack"), F.col("path")
    broken(members.join(seen, "sha256", "left_anti"), "blob_missing", pack, path)
    sizes = seen.groupBy("sha256").agg(F.max("bytes").alias("blob_bytes"))
    broken(members.join(sizes, "sha256").where(~F.col("bytes").eqNullSafe(F.col("blob_bytes"))), "member_size_mismatch", pack, path)
    broken(members.where(~F.coalesce(safe_path(path), F.lit(False))), "invalid_pack_path", pack, path)
    broken(members.groupBy("pack", "path").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("sha256")).where("n > 1"), "repeated_member", pack, path)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def materialized(blobs: DataFrame, members: DataFrame) -> DataFrame:
    """(pack, path, bytes, sha256, content): the files of a sound bundle; of any other the first fault is an error, before a file is made."""
    first = bundle_faults(blobs, members).orderBy("code", "pack", "path", "sha256").first()
    if first is not None:
        raise error("bundle_mismatch", "A bundle breaks a rule.", fault=first["code"], pack=first["pack"], path=first["path"], sha256=first["sha256"])
    return members.join(blobs.select("sha256", "content"), "sha256").select("pack", "path", "bytes", "sha256", "content")
