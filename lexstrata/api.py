"""The eleven read operations over packages, records, edges and grants.

Each operation checks its arguments before it touches data, looks up the
caller's packages (what isn't served is not found), runs DataFrame plans whose
results are bounded by the request, and assembles a packet with its byte budget.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata import cursor as cursors
from lexstrata.errors import EvidenceError, error
from lexstrata.functions.text import MODES, normalize_identifier, parse
from lexstrata.operators import catalog, diff, graph, postings, verify
from lexstrata.operators import search as lexical
from lexstrata.render import FORMS, locator, text_digest

RELATIONS = ("all", "roots", "children", "parent", "adjacent", "outgoing", "incoming")
PROFILES = ("detailed", "compact", "concise")
FIELDS = ("record_id", "kind", "clause_reference", "heading", "text", "ordinal", "statement_role")


class Tables(Protocol):
    packages: DataFrame  # package_digest, family_id, edition_id, identifier, representation
    records: DataFrame  # package_digest, record_id, clause_reference, heading, text, kind, ordinal, ...
    dependencies: DataFrame  # package_digest, source_record_id, relationship, target_record_id, required
    grants: DataFrame  # principal_id, package_digest, can_serve, revoked_at, policy_fingerprint


def budgeted(packet: dict[str, Any], max_bytes: int | None) -> dict[str, Any]:
    """The packet with budget.used, the length of its canonical JSON with that number in it."""
    if not (max_bytes is None or type(max_bytes) is int and max_bytes > 0):
        raise error("invalid_budget", "A byte budget is a positive integer.")
    packet["budget"] = {"unit": "bytes", "limit": max_bytes, "used": 0}
    used = -1
    while used != packet["budget"]["used"]:
        used = packet["budget"]["used"]
        packet["budget"]["used"] = len(cursors.canonical(packet))
    if not (max_bytes is None or packet["budget"]["used"] <= max_bytes):
        raise error("budget_too_small", "The packet doesn't fit; evidence isn't cut.", needed=packet["budget"]["used"])
    return packet


def parse_locator(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"lexstrata://packages/([0-9a-f]{64})/records/([A-Za-z0-9_-]+)", text)
    if m is None:
        raise error("invalid_record_id", "The locator is malformed.")
    record_id = base64.urlsafe_b64decode(m[2] + "=" * (-len(m[2]) % 4)).decode()
    if locator(m[1], record_id) != text:
        raise error("invalid_record_id", "The locator isn't canonical.")
    return m[1], record_id


def one_state(operation: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
    """The operation with one state of the tables for all that it reads; only its last look at the rights is at those of then."""

    @wraps(operation)
    def run(self: EvidenceService, *args: Any, **named: Any) -> dict[str, Any]:
        if not hasattr(self.tables, "snapshot"):
            return operation(self, *args, **named)
        return operation(replace(self, tables=self.tables.snapshot(), live=self.tables), *args, **named)

    return run


@dataclass
class EvidenceService:
    tables: Tables
    secret: bytes
    bindings: DataFrame | None = None  # source_package, source_record_id, target_package, target_record_id, text_sha256
    sources: DataFrame | None = None  # package_digest, path, bytes, sha256
    _visible: dict[str, str] = field(default_factory=dict)
    live: Any = None  # what rights are looked up in at the end of an operation, where tables is a state of it

    # Arguments and authorisation -------------------------------------------------------------------

    def _served(self, principal: str) -> DataFrame:
        if not (isinstance(principal, str) and bool(principal)):
            raise error("invalid_principal", "A principal is required.")
        active = self.tables.grants.where((F.col("principal_id") == principal) & F.col("can_serve") & F.col("revoked_at").isNull())
        return self.tables.packages.join(active.select("package_digest", "policy_fingerprint"), "package_digest")

    def _package(self, digest: str, principal: str) -> dict[str, Any]:
        if not (isinstance(digest, str) and re.fullmatch("[0-9a-f]{64}", digest) is not None):
            raise error("invalid_package_pin", "A package digest has 64 hex digits.")
        found = self._served(principal).where(F.col("package_digest") == digest).limit(1).collect()
        if not found:
            raise error("not_found", "No such package is served.")
        return {k: v for k, v in found[0].asDict(recursive=True).items() if k in ("package_digest", "family_id", "edition_id", "identifier", "representation", "coverage")}

    def _now(self) -> EvidenceService:
        return self if self.live is None else replace(self, tables=self.live.snapshot(), live=None)

    def _recheck(self, package: dict[str, Any], principal: str) -> None:
        try:
            self._now()._package(package["package_digest"], principal)
        except EvidenceError as e:
            raise error("authorization_changed", "The package is no longer served.") from e

    def _records(self, digest: str) -> DataFrame:
        rows = self.tables.records
        if "statement_role" not in rows.columns:
            rows = rows.withColumn("statement_role", F.lit("unclassified"))
        return rows.where(F.col("package_digest") == digest)

    def _edges(self, digest: str) -> DataFrame:
        return self.tables.dependencies.where(F.col("package_digest") == digest)

    def _linked(self, digest: str) -> DataFrame:
        """Stored edges and resolved structural relationships."""
        rows, edges = self._records(digest), self._edges(digest)
        if "structure" not in rows.columns:
            return edges
        target = rows.select(F.col("structure.logical_id").alias("target_logical_id"), F.col("record_id").alias("target_record_id")).where("target_logical_id is not null")
        related = rows.select("package_digest", F.col("record_id").alias("source_record_id"), F.inline("structure.relationships")).where("target_status = 'resolved'")
        return graph.with_structure(edges, related.withColumn("required", F.coalesce("required", F.lit(False))).join(target, "target_logical_id"))

    @staticmethod
    def _limit(limit: int) -> int:
        if not (type(limit) is int and 1 <= limit <= 100):
            raise error("invalid_limit", "A limit lies between 1 and 100.")
        return limit

    def visibility(self, principal: str) -> str:
        rows = self._served(principal).select("package_digest", "policy_fingerprint").collect()  # a row per grant of a principal
        return cursors.digest(sorted([r["package_digest"], r["policy_fingerprint"]] for r in rows))

    # Discovery ---------------------------------------------------------------------------------------

    @one_state
    def search(self, query: str, principal: str, limit: int = 20, package_digest: str | None = None, scope_prefix: str | None = None, query_mode: str = "all_terms") -> dict[str, Any]:
        parsed, limit = parse(query, query_mode), self._limit(limit)
        if not (scope_prefix is None or bool(scope_prefix)):
            raise error("invalid_scope", "A scope is a clause reference.")
        if package_digest is not None:
            self._package(package_digest, principal)
        index = getattr(self.tables, "postings", None)
        if index is None:
            found, relaxed = lexical.search(self.tables.records, self._served(principal), query, query_mode, limit, package_digest, scope_prefix)
        else:
            hits, relaxed = postings.search(index, self._served(principal), query, query_mode, limit, package_digest, scope_prefix, getattr(self.tables, "blocks", None))
            found = postings.with_text(hits, self.tables.records, limit)
        shown = parse(query, query_mode, relaxed) if relaxed else parsed
        rows = lexical.snippets(found, shown).orderBy("score", "package_digest", "ordinal").collect()
        hits = [{k: r[k] for k in ("package_digest", "record_id", "clause_reference", "heading", "score", "matched_snippet")} | {"evidence_selector": {"package_digest": r["package_digest"], "record_id": r["record_id"]}} for r in rows]
        interpretation = {"mode": query_mode, "modes": list(MODES), "effective_terms": list(parsed.terms), "ignored_terms": list(parsed.ignored), "relaxed": relaxed}
        filters = {"package_digest": package_digest, "scope_prefix": scope_prefix, "limit": limit}
        shown_packages = sorted({r["package_digest"] for r in rows})
        about = self._served(principal).where(F.col("package_digest").isin(shown_packages)).collect() if shown_packages else []
        coverage = {r["package_digest"]: {k: v for k, v in r.asDict(recursive=True).items() if k in ("identifier", "edition_id", "representation", "coverage")} for r in about}
        return {"query_interpretation": interpretation, "filters": filters, "packages": coverage, "results": hits, "complete": False, "limitations": ["discovery only; read evidence before citing"]}

    @one_state
    def list_documents(self, principal: str, identifier_prefix: str | None = None, limit: int = 50, cursor: str | None = None) -> dict[str, Any]:
        prefix = None if identifier_prefix is None else normalize_identifier(identifier_prefix, prefix=True)
        binding = {"principal": principal, "scope": prefix, "visibility": self.visibility(principal), "operation": "list_documents"}
        after = cursors.decode(self.secret, cursor, binding) if cursor else None
        rows = catalog.listing(self._served(principal), prefix, after, self._limit(limit) + 1).select(*catalog.KEY).collect()
        page = [r.asDict() for r in rows[:limit]]
        if self._now().visibility(principal) != binding["visibility"]:
            raise error("authorization_changed", "The inventory changed while it was read.")
        more = len(rows) > limit
        return {"documents": page, "has_more": more, "next_cursor": cursors.encode(self.secret, binding, {k: page[-1][k] for k in catalog.KEY}) if more else None}

    @one_state
    def resolve_document(self, identifier: str, principal: str, edition_id: str | None = None, representation: str | None = None) -> dict[str, Any]:
        name = normalize_identifier(identifier)
        served = self._served(principal)
        found = [r.asDict(recursive=True) for r in catalog.resolved(served, name, edition_id, representation).select(*catalog.KEY).orderBy(*catalog.KEY).limit(2).collect()]
        if len(found) == 1:
            return {"document": found[0]}
        near = [r.asDict() for r in catalog.near_matches(served, name, catalog.CANDIDATES + 1).select("identifier", "edition_id", "representation", "package_digest", "match_basis").collect()]
        details = {"candidates": near[: catalog.CANDIDATES], "truncated": len(near) > catalog.CANDIDATES}
        raise error("ambiguous_document" if found else "not_found", "The identifier names several documents." if found else "No such document is served.", **details)

    @one_state
    def get_source_pdfs(self, package_digest: str, principal: str) -> dict[str, Any]:
        package = self._package(package_digest, principal)
        files = self.sources if self.sources is not None else getattr(self.tables, "sources", None)
        if files is None:
            raise error("not_found", "No source files are attached.")
        mine = files.where((F.col("package_digest") == package_digest) & F.col("path").rlike(r"^sources/.*\.pdf$"))
        same = F.sha2("content", 256) == F.col("sha256") if "content" in files.columns else F.lit(True)
        rows = mine.select("path", "bytes", "sha256", same.alias("same")).orderBy("path").collect()
        changed = [r["path"] for r in rows if not r["same"]]
        if changed:
            raise error("source_changed", "Stored files are not what was installed.", paths=changed)
        return {"package": package, "files": [{k: r[k] for k in ("path", "bytes", "sha256")} for r in rows]}

    # Evidence ----------------------------------------------------------------------------------------

    def _closure(self, digest: str, roots: DataFrame) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
        """The roots' closure in order and the required edges inside it."""
        order = graph.ordered_closure(roots, self._edges(digest))
        found = graph.checkpointed(order.join(self._records(digest), "record_id", "left"))
        rows = found.orderBy("place").collect()
        missing = [r["record_id"] for r in rows if r["text"] is None]
        if missing:
            raise error("incomplete_dependency", "A required record is missing.", record_ids=missing)
        self._verified(digest, found)
        inside = order.select(F.col("record_id").alias("source_record_id"), "place")
        edges = self._edges(digest).where("required").join(inside, "source_record_id").orderBy("place", "relationship", "target_record_id").select("source_record_id", "relationship", "target_record_id").collect()
        records = [{k: r[k] for k in FIELDS} | {"text_sha256": text_digest(r["text"]), "locator": locator(digest, r["record_id"])} for r in rows]
        return records, [e.asDict() for e in edges]

    def _roots(self, digest: str, selectors: list[Any]) -> DataFrame:
        spark = self.tables.records.sparkSession
        wanted = spark.createDataFrame(list(enumerate(selectors)), "root_pos long, clause_reference string")
        return self._records(digest).join(F.broadcast(wanted), "clause_reference").select("record_id", "root_pos", "clause_reference")  # at most 64 selectors

    @staticmethod
    def _rendered(packet: dict[str, Any], profile: str | None) -> dict[str, Any]:
        if profile not in (None, *PROFILES):
            raise error("invalid_response_profile", "The profile is not supported.")
        return FORMS[profile or "detailed"](packet)

    def _verified(self, digest: str, records: DataFrame) -> None:
        """Raise unless the records' texts are the quotes that were installed, at their places in the stored source files."""
        if "source" not in records.columns:
            return
        quoted = records.where(~F.sha2("text", 256).eqNullSafe(F.col("source.quote_sha256"))).select("record_id")
        files = getattr(self.tables, "sources", None)
        if files is not None:
            path = F.coalesce("source.text_path", "source.path")
            files = files.where(F.col("package_digest") == digest).select(F.col("path").alias("at_path"), F.sha2("content", 256).alias("now"), "content")
            cited = records.select("record_id", "text", "source").withColumn("at_path", path).join(files, "at_path", "left")
            quoted = quoted.union(cited.where(~F.coalesce(verify.still_there(), F.lit(False))).select("record_id"))
        changed = sorted({r[0] for r in quoted.collect()})  # of the records of one packet
        if changed:
            raise error("source_changed", "Texts are not those of their sources any more.", record_ids=changed)

    @one_state
    def get_clause(self, package_digest: str, principal: str, clause_reference: str | None = None, record_id: str | None = None, max_bytes: int | None = None, response_profile: str | None = None) -> dict[str, Any]:
        if not (clause_reference is not None or record_id is not None):
            raise error("invalid_record_selector", "A clause or a record id is required.")
        package = self._package(package_digest, principal)
        rows = self._records(package_digest)
        by = {k: rows.where(F.col(k) == v).select("record_id").limit(1).collect() for k, v in (("clause_reference", clause_reference), ("record_id", record_id)) if v is not None}
        if not all(by.values()):
            raise error("not_found", "No such record.")
        ids = {r[0]["record_id"] for r in by.values()}
        if len(ids) != 1:
            raise error("record_selector_mismatch", "The clause and the record id name different records.")
        roots = rows.where(F.col("record_id") == ids.pop()).select("record_id", F.lit(0).cast("long").alias("root_pos"))
        records, edges = self._closure(package_digest, roots)
        packet = self._rendered({"package": package, "records": records, "relationships": edges}, response_profile)
        self._recheck(package, principal)
        return budgeted(packet, max_bytes)

    @one_state
    def build_context(self, package_digest: str, clause_references: list[str], principal: str, max_bytes: int | None = None, response_profile: str | None = None) -> dict[str, Any]:
        if not (isinstance(clause_references, list) and 1 <= len(clause_references) <= 64 and all(isinstance(c, str) and c for c in clause_references)):
            raise error("invalid_clause_reference", "1 to 64 clause references are required.")
        package, wanted = self._package(package_digest, principal), list(dict.fromkeys(clause_references))
        roots = self._roots(package_digest, wanted)
        there = {r["clause_reference"] for r in roots.collect()}
        if there != set(wanted):
            raise error("not_found", "A clause is missing.", clause_references=sorted(set(wanted) - there))
        records, edges = self._closure(package_digest, roots.drop("clause_reference"))
        packet = self._rendered({"package": package, "requested": wanted, "records": records, "relationships": edges}, response_profile)
        self._recheck(package, principal)
        return budgeted(packet, max_bytes)

    @one_state
    def enumerate_obligations(self, package_digest: str, principal: str, scope_prefix: str | None = None, limit: int = 50, cursor: str | None = None, max_bytes: int | None = None) -> dict[str, Any]:
        package, limit = self._package(package_digest, principal), self._limit(limit)
        binding = {"principal": principal, "scope": [package_digest, scope_prefix], "visibility": self.visibility(principal), "operation": "obligations"}
        after, before = cursors.decode(self.secret, cursor, binding) if cursor else (-1, 0)
        rows = self._records(package_digest).where("statement_role = 'obligation'")
        if scope_prefix is not None:
            rows = rows.where(lexical.in_scope(F.col("clause_reference"), scope_prefix))
        total = rows.count()
        page = rows.where(F.col("ordinal") > after).orderBy("ordinal", "record_id").limit(limit + 1).collect()
        more, page = len(page) > limit, page[:limit]
        ids = [r["record_id"] for r in page]
        found = graph.closure(self._records(package_digest).where(F.col("record_id").isin(ids)), self._edges(package_digest), by_root=True).collect() if ids else []
        cited = self._records(package_digest).where(F.col("record_id").isin(sorted({r["record_id"] for r in found})))
        self._verified(package_digest, cited)
        texts = {r["record_id"]: r["text"] for r in cited.select("record_id", "text").collect()}
        items = [{k: r[k] for k in FIELDS} | {"evidence": [{"record_id": e["record_id"], "text": texts[e["record_id"]]} for e in sorted((x for x in found if x["root_id"] == r["record_id"]), key=lambda x: (x["depth"], x["record_id"]))]} for r in page]
        seen = before + len(items)
        packet = {"package": package, "obligations": items, "total": total, "returned": seen, "traversal_complete": not more and seen == total, "next_cursor": cursors.encode(self.secret, binding, [page[-1]["ordinal"], seen]) if more else None}
        self._recheck(package, principal)
        return budgeted(packet, max_bytes)

    @one_state
    def browse_records(self, package_digest: str, principal: str, relation: str = "all", record_id: str | None = None, kind: str | None = None, scope_prefix: str | None = None, limit: int = 50, cursor: str | None = None, max_bytes: int | None = None) -> dict[str, Any]:
        if relation not in RELATIONS:
            raise error("invalid_relation", "The relation is not supported.", relations=list(RELATIONS))
        if not (kind is None or re.fullmatch("[a-z_]{1,64}", kind) is not None):
            raise error("invalid_kind", "The kind is malformed.")
        if (record_id is None) != (relation in ("all", "roots")):
            raise error("invalid_record_id", "This relation needs, or takes no, record id.")
        package, limit = self._package(package_digest, principal), self._limit(limit)
        binding = {"principal": principal, "scope": [package_digest, relation, record_id, kind, scope_prefix], "visibility": self.visibility(principal), "operation": "browse"}
        after = cursors.decode(self.secret, cursor, binding) if cursor else -1
        rows = self._records(package_digest)
        anchor = None
        if record_id is not None:
            found = rows.where(F.col("record_id") == record_id).limit(1).collect()
            if not found:
                raise error("not_found", "No such record.")
            anchor = found[0]
        edges: list[dict[str, Any]] = []
        match relation:
            case "roots":
                rows = rows.where("parent_record_id is null")
            case "children":
                rows = rows.where(F.col("parent_record_id") == record_id)
            case "parent":
                rows = rows.where(F.col("record_id") == anchor["parent_record_id"])
            case "adjacent":
                near = rows.agg(F.max(F.when(F.col("ordinal") < anchor["ordinal"], F.col("ordinal"))), F.min(F.when(F.col("ordinal") > anchor["ordinal"], F.col("ordinal")))).first()
                rows = rows.where(F.col("ordinal").isin([o for o in near if o is not None]))
            case "outgoing" | "incoming":
                here = rows.where(F.col("record_id") == record_id)
                linked = graph.edges_of(self._linked(package_digest), here, relation)
                edges = [r.asDict() for r in linked.select("relationship", "record_id", "required").orderBy("relationship", "record_id").collect()]
                rows = rows.join(linked.select("record_id").distinct(), "record_id", "left_semi")
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        if scope_prefix is not None:
            rows = rows.where(lexical.in_scope(F.col("clause_reference"), scope_prefix))
        total = rows.count()
        page = rows.where(F.col("ordinal") > after).orderBy("ordinal", "record_id").limit(limit + 1).select("record_id", "kind", "clause_reference", "heading", "ordinal").collect()
        more, page = len(page) > limit, page[:limit]
        packet = {"package": package, "relation": relation, "records": [r.asDict() for r in page], "edges": edges, "total": total, "next_cursor": cursors.encode(self.secret, binding, page[-1]["ordinal"]) if more else None}
        self._recheck(package, principal)
        return budgeted(packet, max_bytes)

    @one_state
    def select_evidence(self, package_digest: str, record_id: str, principal: str, max_tokens: int | None = None, max_bytes: int | None = None, count_tokens: Any = None) -> dict[str, Any]:
        """The smallest of the profiles that fits."""
        if not (max_tokens is None or count_tokens is not None):
            raise error("tokenizer_unavailable", "A token budget needs a tokenizer.")
        whole = self.get_clause(package_digest, principal, record_id=record_id)
        fits = []
        for profile in PROFILES:
            packet = budgeted(self._rendered({k: v for k, v in whole.items() if k != "budget"}, profile), None)
            tokens = count_tokens(json.dumps(packet, ensure_ascii=False)) if count_tokens else None
            if (max_bytes is None or packet["budget"]["used"] <= max_bytes) and (max_tokens is None or tokens <= max_tokens):
                fits.append((tokens or packet["budget"]["used"], packet["budget"]["used"], profile, packet))
        if not fits:
            raise error("budget_too_small", "No profile fits.")
        return min(fits, key=lambda x: x[:3])[3] | {"selected_profile": min(fits, key=lambda x: x[:3])[2]}

    # Comparison --------------------------------------------------------------------------------------

    @one_state
    def diff_editions(self, from_digest: str, to_digest: str, principal: str, max_bytes: int | None = None) -> dict[str, Any]:
        old, new = self._package(from_digest, principal), self._package(to_digest, principal)
        if old["family_id"] != new["family_id"]:
            raise error("different_document_families", "The packages are of different families.")
        label = lambda rows: rows.withColumn("package_digest", F.lit("pair"))  # noqa: E731  both sides under one key
        b, a = label(self._records(from_digest)), label(self._records(to_digest))
        if "start_byte" not in b.columns:
            place = F.col("source.locator") if "source" in b.columns else F.lit(None).cast("string")
            b, a = b.withColumn("start_byte", place), a.withColumn("start_byte", place)
        be, ae = label(self._edges(from_digest)), label(self._edges(to_digest))
        status = graph.checkpointed(diff.status(b, a))
        edge = ("source_record_id", "relationship", "target_record_id", "required")
        listed = lambda rows: [r.asDict() for r in rows.select(*edge).orderBy(*edge).collect()]
        paths = graph.impact(status, be, ae, b, a).orderBy("record_id", "side", "depth", "cause_type", "cause_record_id").collect()
        packet = {
            "from": old,
            "to": new,
            "changes": [r.asDict() for r in status.drop("package_digest").orderBy("record_id").collect()],
            "counts": {s: n for s, n in zip(diff.STATUSES, diff.counts(status).select(*diff.STATUSES).first() or (0,) * 5, strict=True)},
            "alignment_candidates": [r.asDict() for r in diff.alignment(b, a, ["kind", "clause_reference"]).drop("package_digest").orderBy("before_record_id").collect()],
            "dependencies_added": listed(diff.edge_delta(ae, be)),
            "dependencies_removed": listed(diff.edge_delta(be, ae)),
            "dependency_impact_paths": [r.asDict() for r in paths],
        }
        self._recheck(old, principal)
        self._recheck(new, principal)
        return budgeted(packet, max_bytes)

    @one_state
    def follow_references(self, package_digest: str, record_id: str, principal: str, max_bytes: int | None = None) -> dict[str, Any]:
        """One hop over reviewed bindings; both ends must be served, and the target's text must be the bound one."""
        package = self._package(package_digest, principal)
        if self.bindings is None:
            raise error("reference_bindings_not_configured", "No bindings are configured.")
        mine = self.bindings.where((F.col("source_package") == package_digest) & (F.col("source_record_id") == record_id))
        served = self._served(principal).select(F.col("package_digest").alias("target_package"), F.lit(True).alias("served"))
        target = self.tables.records.select(F.col("package_digest").alias("target_package"), F.col("record_id").alias("target_record_id"), "clause_reference", "text")
        rows = mine.join(served, "target_package", "left").join(target, ["target_package", "target_record_id"], "left").orderBy("target_package", "target_record_id").collect()
        if not all(r["served"] or r["target_package"] is None for r in rows):
            raise error("not_found", "A referenced package is not served.")
        stale = [r["target_record_id"] for r in rows if r["text"] is not None and text_digest(r["text"]) != r["text_sha256"]]
        if stale:
            raise error("stale_reference_binding", "A bound text has changed.", record_ids=stale)
        links = [{"target_package": r["target_package"], "record_id": r["target_record_id"], "clause_reference": r["clause_reference"], "text": r["text"], "status": "resolved" if r["text"] is not None else "unresolved"} for r in rows]
        return budgeted({"package": package, "record_id": record_id, "references": links}, max_bytes)
