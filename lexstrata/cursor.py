"""Signed keyset cursors: a canonical JSON body and an HMAC tag, bound to what they were made for.

The body holds keyed digests of principal, scope and the like, not themselves.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from typing import Any

from lexstrata.errors import error

LIFETIME = 900


def canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def bound(secret: bytes, binding: dict[str, Any]) -> dict[str, str]:
    return {k: hmac.digest(secret, canonical([k, v]), "sha256").hex()[:32] for k, v in binding.items()}


def encode(secret: bytes, binding: dict[str, Any], last: Any, now: float | None = None) -> str:
    body = canonical({"binding": bound(secret, binding), "last": last, "expires": int((time.time() if now is None else now) + LIFETIME)})
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (body, hmac.digest(secret, body, "sha256")))


def decode(secret: bytes, cursor: str, binding: dict[str, Any], now: float | None = None) -> Any:
    """The position of a cursor; tampered, expired and foreign cursors are told apart."""
    parts = cursor.split(".") if isinstance(cursor, str) else []
    if len(parts) != 2:
        raise error("invalid_cursor", "The cursor is malformed.")
    try:
        body, tag = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in parts)
    except ValueError:
        body = tag = b""
    if not hmac.compare_digest(hmac.digest(secret, body, "sha256"), tag):
        raise error("invalid_cursor", "The cursor's signature is wrong.")
    value = json.loads(body)
    if not (canonical(value) == body and value["expires"] > (time.time() if now is None else now)):
        raise error("expired_cursor", "The cursor has expired.")
    made_for, wanted = value["binding"], bound(secret, binding)
    for name, code in (("principal", "invalid_cursor"), ("visibility", "cursor_inventory_changed"), ("policy", "cursor_policy_changed"), ("scope", "cursor_scope_mismatch")):
        if made_for.get(name) != wanted.get(name):
            raise error(code, f"The cursor was made for another {name}.")
    if made_for != wanted:
        raise error("cursor_scope_mismatch", "The cursor was made for another request.")
    return value["last"]


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()
