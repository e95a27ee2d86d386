"""Command line over a store: one JSON envelope on standard output, exit 0, or 2 for a typed error."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from lexstrata.api import PROFILES, RELATIONS, EvidenceService
from lexstrata.errors import EvidenceError, error
from lexstrata.functions.text import MODES
from lexstrata.sources.packs import Packs
from lexstrata.sources.store import Policy, Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexstrata", description=__doc__)
    top.add_argument("--store", required=True)
    top.add_argument("--principal", default="local-user")
    top.add_argument("--secret-file", type=Path)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options: Any) -> None:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, kind in options.items():
            extra = {"choices": kind} if isinstance(kind, tuple) else {"type": kind}
            p.add_argument("--" + x.replace("_", "-"), dest=x, **extra)

    command("search", "query", limit=int, package_digest=str, scope_prefix=str, query_mode=MODES)
    command("list-documents", identifier_prefix=str, limit=int, cursor=str)
    command("resolve-document", "identifier", edition_id=str, representation=str)
    command("get-clause", "package_digest", clause_reference=str, record_id=str, max_bytes=int, response_profile=PROFILES)
    command("enumerate-obligations", "package_digest", scope_prefix=str, limit=int, cursor=str, max_bytes=int)
    command("browse-records", "package_digest", relation=RELATIONS, record_id=str, kind=str, scope_prefix=str, limit=int, cursor=str, max_bytes=int)
    command("diff-editions", "from_digest", "to_digest", max_bytes=int)
    command("select-evidence", "package_digest", "record_id", max_bytes=int)
    command("verify", "packs")
    command("install", "packs", "policy")
    command("revoke", "package_digest")
    commands.choices["search"].set_defaults(query_mode="all_terms")
    context = commands.add_parser("build-context")
    context.add_argument("package_digest")
    context.add_argument("clause_references", nargs="+")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> Any:
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("store", "principal", "secret_file", "command")}
    store = Store(spark, args.store)
    match args.command:
        case "verify":
            return {"violations": [r.asDict() for r in Packs(spark, args.packs).violations.orderBy("pack", "code", "item").limit(100).collect()]}
        case "install":
            policy = json.loads(Path(args.policy).read_text())
            names = ("policy_id", "principal_id", "allow_admin_install", "allow_serve", "allowed_pack_ids", "allowed_content_classes")
            return {"installed": store.install(Packs(spark, args.packs), Policy(*(tuple(v) if isinstance(v := policy[n], list) else v for n in names)))}
        case "revoke":
            return {"revoked": store.revoke(args.principal, args.package_digest)}
    if given.get("cursor") and not args.secret_file:
        raise error("cursor_secret_missing", "A cursor needs the --secret-file that it was signed with.")
    secret = args.secret_file.read_bytes() if args.secret_file else os.urandom(32)  # cursors of this call then end with it
    return getattr(EvidenceService(store, secret), args.command.replace("-", "_"))(principal=args.principal, **given)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexstrata").getOrCreate()
    try:
        out, code = {"ok": True, "result": run(args, spark)}, 0
    except EvidenceError as e:
        out, code = {"ok": False, "error": e.report()}, 2
    print(json.dumps(out, ensure_ascii=False, sort_keys=True))
    return code


if __name__ == "__main__":
    sys.exit(main())
