"""Smaller forms of an evidence packet that lose nothing.

``compact`` writes records as rows under one list of columns, with values that
repeat (kinds, roles) as numbers into a table, and leaves out what follows from
the rest: locators and digests of texts.  ``concise`` also names records by their
number and merges relationships of the same kind and target.  ``expanded`` gives
the detailed packet back, from either.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from typing import Any

Packet = dict[str, Any]
INTERNED = ("kind", "statement_role")
DERIVED = ("text_sha256", "locator")


def locator(package_digest: str, record_id: str) -> str:
    return f"lexstrata://packages/{package_digest}/records/{base64.urlsafe_b64encode(record_id.encode()).decode().rstrip('=')}"


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def compact(packet: Packet) -> Packet:
    records = packet["records"]
    columns = [c for c in (records[0] if records else ()) if c not in DERIVED]
    tables = {c: sorted({r[c] for r in records}, key=lambda v: (v is None, v or "")) for c in INTERNED if c in columns}
    place = {c: {v: i for i, v in enumerate(values)} for c, values in tables.items()}
    rows = [[place[c][r[c]] if c in place else r[c] for c in columns] for r in records]
    return packet | {"profile": "compact", "columns": columns, "tables": tables, "records": rows}


def concise(packet: Packet) -> Packet:
    number = {r["record_id"]: i for i, r in enumerate(packet["records"])}
    named = lambda i: number.get(i, i)
    merged: dict[tuple[Any, str], list[Any]] = {}
    for e in packet["relationships"]:
        merged.setdefault((named(e["target_record_id"]), e["relationship"]), []).append(named(e["source_record_id"]))
    order = [list((e["source_record_id"], e["relationship"], e["target_record_id"])) for e in packet["relationships"]]
    out = compact(packet) | {"profile": "concise", "relationships": [[target, kind, sources] for (target, kind), sources in merged.items()]}
    if _unmerged(out["relationships"], [r["record_id"] for r in packet["records"]]) != order:  # keep an order that doesn't follow from the records'
        out["relationships"] = [[named(t), kind, [named(s)]] for s, kind, t in order]
        out["in_order"] = True
    return out


def _unmerged(merged: list[list[Any]], ids: list[str], in_order: bool = False) -> list[list[str]]:
    name = lambda i: ids[i] if isinstance(i, int) else i
    edges = [[name(s), kind, name(target)] for target, kind, sources in merged for s in sources]
    place = {x: i for i, x in enumerate(ids)}
    return edges if in_order else sorted(edges, key=lambda e: (place.get(e[0], len(ids)), e[1], e[2]))


def expanded(packet: Packet) -> Packet:
    """The detailed packet."""
    if "columns" not in packet:
        return packet
    digest = packet["package"]["package_digest"]
    records = []
    for row in packet["records"]:
        r = {c: packet["tables"][c][v] if c in packet["tables"] else v for c, v in zip(packet["columns"], row, strict=True)}
        records.append(r | {"text_sha256": text_digest(r["text"]), "locator": locator(digest, r["record_id"])})
    out = {k: v for k, v in packet.items() if k not in ("profile", "columns", "tables", "in_order")} | {"records": records}
    if packet["profile"] == "concise":
        edges = _unmerged(packet["relationships"], [r["record_id"] for r in records], packet.get("in_order", False))
        out["relationships"] = [{"source_record_id": s, "relationship": kind, "target_record_id": t} for s, kind, t in edges]
    return out


FORMS: dict[str, Callable[[Packet], Packet]] = {"detailed": lambda p: p, "compact": compact, "concise": concise}
