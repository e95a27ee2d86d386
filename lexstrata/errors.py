"""What can go wrong, as exceptions by kind; each kind lists the codes that callers may meet.

A code is part of the interface: callers branch on it.  ``error`` makes the
exception of a code's kind, and a code that no kind lists is a mistake here.
"""

from __future__ import annotations


class EvidenceError(Exception):
    """Base of all kinds; ``report()`` is what a command line or service shows."""

    codes: tuple[str, ...] = ()

    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(code, message)
        self.code, self.message, self.details = code, message, details

    def __str__(self) -> str:
        return f"{self.message} [{self.code}]"

    def report(self) -> dict[str, object]:
        return {"code": self.code, "kind": type(self).__name__, "message": self.message} | ({"details": self.details} if self.details else {})


class BadRequest(EvidenceError):
    """The arguments can't be used, whatever the data."""

    codes = (
        "invalid_budget", "invalid_clause_reference", "invalid_date", "invalid_identifier", "invalid_kind", "invalid_limit", "invalid_package_pin", "invalid_pointer", "invalid_principal", "invalid_query",
        "invalid_query_mode", "invalid_record_id", "invalid_record_selector", "invalid_relation", "invalid_response_profile", "invalid_scope", "record_selector_mismatch", "different_document_families",
    )


class NotServed(EvidenceError):
    """Nothing that the caller may see, or no longer."""

    codes = ("not_found", "ambiguous_document", "authorization_changed", "policy_denied")


class NotSetUp(EvidenceError):
    """A part that the request needs wasn't given."""

    codes = ("tokenizer_unavailable", "reference_bindings_not_configured", "cursor_secret_missing")


class BadCursor(EvidenceError):
    """A cursor that isn't this service's, or is for something else or too old."""

    codes = ("invalid_cursor", "expired_cursor", "cursor_inventory_changed", "cursor_policy_changed", "cursor_scope_mismatch")


class TooLarge(EvidenceError):
    """What was asked for doesn't fit; evidence isn't cut."""

    codes = ("budget_too_small", "pack_limit_exceeded")


class BadPack(EvidenceError):
    """A pack, archive or bundle that breaks a rule."""

    codes = (
        "untracked_pack_content", "missing_pack_file", "pack_size_mismatch", "pack_hash_mismatch", "invalid_inventory", "invalid_manifest", "invalid_rights", "invalid_pack_path", "invalid_pack_archive", "edition_mismatch", "invalid_record", "invalid_records",
        "source_quote_missing", "source_hash_mismatch", "unresolved_dependency", "bundle_mismatch",
    )


class BrokenEvidence(EvidenceError):
    """Stored evidence that can't be shown to be whole and unchanged."""

    codes = ("incomplete_dependency", "stale_reference_binding", "source_changed", "object_store_conflict", "corpus_compile_incomplete")


_KIND = {code: kind for kind in EvidenceError.__subclasses__() for code in kind.codes}


def error(code: str, message: str, **details: object) -> EvidenceError:
    """The exception of a code's kind, to be raised."""
    return _KIND[code](code, message, **details)
