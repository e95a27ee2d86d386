"""Small text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexstrata.errors import error

#: Runs of other characters become one underscore in file names.
UNSAFE_NAME = r"[^A-Za-z0-9._-]+"
NAME_CHARS = 72


def url_quoted(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and ``_.-~`` stay."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def page_text(text: Column) -> Column:
    """Line feeds only, canonically composed, no white space at the ends of lines, no blank lines at either end.

    Only texts beyond ASCII leave the JVM to be composed.
    """
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)
    lines = F.split(F.regexp_replace(composed, r"\r\n?", "\n"), "\n", -1)
    stripped = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.regexp_replace(stripped, r"^\n+|\n+$", "")


def safe_file_name(text: Column, most: int = NAME_CHARS) -> Column:
    """A name of letters, digits and ``._-``, not empty, of at most so many characters."""
    clean = F.regexp_replace(F.regexp_replace(text, UNSAFE_NAME, "_"), r"^[._-]+|[._-]+$", "")
    return F.substring(F.when(clean == "", "document").otherwise(clean), 1, most)


def html_escaped(text: Column) -> Column:
    out = text
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def at_pointer(json: Column, pointer: str) -> Column:
    """The value at a JSON pointer, as text; null where there is none.  Keys may not hold quotes."""
    if pointer and not pointer.startswith("/") or "'" in pointer:
        raise error("invalid_pointer", "A JSON pointer is empty or starts with a slash.", pointer=pointer)
    steps = [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]
    return F.get_json_object(json, "$" + "".join(f"[{x}]" if x.isdecimal() else f"['{x}']" for x in steps))


def checked_date(text: Column) -> Column:
    """The date of a text of the form YYYY-MM-DD or DD-MMM-YYYY (English months); null if it isn't one."""
    named = F.try_to_timestamp(F.initcap(text), F.lit("dd-MMM-yyyy")).cast("date")
    plain = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(plain, F.when(text.rlike(r"^\d\d-[A-Za-z]{3}-\d{4}$"), named))


def distribution(statement: Column, token: Column) -> Column:
    """Whether a component may be fetched: only statement A with a token."""
    return F.when(~F.coalesce(statement == "A", F.lit(False)), "restricted_distribution").when(F.coalesce(token, F.lit("")) == "", "not_publicly_exposed").otherwise("pending")
