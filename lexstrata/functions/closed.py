"""Closed schemas of JSON, compiled to column expressions that give each fault with its path.

JSON is parsed once into VARIANT; a schema is a tree of the kinds below, and
``faults`` is one expression that walks a value along it.  Paths are JSON
pointers.  Text that is no JSON, or repeats a key of an object, has the one
fault invalid_json at the root; numbers are whole if they have no fraction,
exponent or decimal point and fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULTS = "array<struct<path string, fault string>>"


@dataclass(frozen=True)
class Any:
    """Whatever is there."""


@dataclass(frozen=True)
class Text:
    """A string of at least so many characters, of the choices if there are any, that matches the pattern if there is one."""

    least: int = 1
    choices: tuple[str, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class Day:
    """A string YYYY-MM-DD that is a day of the calendar."""


@dataclass(frozen=True)
class Whole:
    least: int = 0


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Null:
    """Null, or what the kind says."""

    kind: Kind


@dataclass(frozen=True)
class Items:
    """An array of so many items of one kind."""

    of: Kind = field(default_factory=Any)
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Closed:
    """An object with all of the required fields, maybe the optional ones, and no others."""

    required: dict[str, Kind]
    optional: dict[str, Kind] = field(default_factory=dict)


Kind = Any | Text | Day | Whole | Flag | Null | Items | Closed

SHA256 = Text(pattern="^[0-9a-f]{64}$")


def _none() -> Column:
    return F.array().cast(FAULTS)


def _one(path: Column, fault: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(fault).alias("fault"))).cast(FAULTS)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(path: Column, key: str) -> Column:
    return F.concat(path, F.lit("/" + key.replace("~", "~0").replace("/", "~1")))


def _step(path: Column, key: Column) -> Column:
    return F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def faults(value: Column, kind: Kind, path: Column) -> Column:
    """(path, fault) of all that a VARIANT has against a kind: wrong_type, not_allowed, out_of_range, missing_field or unknown_field."""
    if isinstance(kind, Any):
        return _none()
    named = F.schema_of_variant(value)
    if isinstance(kind, Null):
        return F.when(named == "VOID", _none()).otherwise(faults(value, kind.kind, path))
    if isinstance(kind, Closed):
        inside = _bound(F.try_variant_get(value, "$", "map<string,variant>"), lambda fields: _object(fields, kind, path))
        return F.when(named.startswith("OBJECT"), inside).otherwise(_one(path, "wrong_type"))
    if isinstance(kind, Items):
        inside = _bound(F.try_variant_get(value, "$", "array<variant>"), lambda items: _array(items, kind, path))
        return F.when(named.startswith("ARRAY"), inside).otherwise(_one(path, "wrong_type"))
    if isinstance(kind, Flag):
        return F.when(named == "BOOLEAN", _none()).otherwise(_one(path, "wrong_type"))
    if isinstance(kind, Whole):
        low = F.try_variant_get(value, "$", "long") < kind.least
        return F.when(named != "BIGINT", _one(path, "wrong_type")).when(low, _one(path, "out_of_range")).otherwise(_none())
    text = F.try_variant_get(value, "$", "string")
    if isinstance(kind, Day):
        day = text.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
        return F.when(named != "STRING", _one(path, "wrong_type")).when(~day, _one(path, "not_allowed")).otherwise(_none())
    bad = F.lit(False)
    if kind.choices:
        bad = bad | ~text.isin(*kind.choices)
    if kind.pattern is not None:
        bad = bad | ~text.rlike(kind.pattern)
    short = F.char_length(text) < kind.least
    return F.when(named != "STRING", _one(path, "wrong_type")).when(short, _one(path, "out_of_range")).when(bad, _one(path, "not_allowed")).otherwise(_none())


def _object(fields: Column, kind: Closed, path: Column) -> Column:
    known = kind.required | kind.optional
    keys = F.map_keys(fields)
    missing = F.array_except(F.array(*map(F.lit, kind.required)).cast("array<string>"), keys)
    unknown = F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))
    told = lambda names, fault: F.transform(names, lambda k: F.struct(_step(path, k).alias("path"), F.lit(fault).alias("fault"))).cast(FAULTS)
    # A field that is there is never SQL null: JSON's null is a VARIANT.
    inner = [F.when(F.map_contains_key(fields, name), faults(fields[name], k, _named(path, name))).otherwise(_none()) for name, k in known.items() if not isinstance(k, Any)]
    return F.concat(told(missing, "missing_field"), told(unknown, "unknown_field"), *inner)


def _array(items: Column, kind: Items, path: Column) -> Column:
    size = F.size(items)
    wrong = size < kind.least
    if kind.most is not None:
        wrong = wrong | (size > kind.most)
    inner = _none() if isinstance(kind.of, Any) else F.flatten(F.transform(items, lambda x, i: faults(x, kind.of, F.concat(path, F.lit("/"), i.cast("string")))))
    return F.concat(F.when(wrong, _one(path, "out_of_range")).otherwise(_none()), inner)


def json_faults(rows: DataFrame, text: Column, kind: Kind, keys: list[str]) -> DataFrame:
    """keys, path and fault of each fault of JSON texts; null text is invalid_json too."""
    return json_faults_by(rows, text, F.lit(""), {"": kind}, keys)


def json_faults_by(rows: DataFrame, text: Column, which: Column, kinds: dict[str, Kind], keys: list[str]) -> DataFrame:
    """json_faults of texts of several kinds in one pass: which names a text's kind."""
    parsed = rows.select(*keys, which.alias("_which"), F.try_parse_json(text).alias("value"))
    found = F.when(F.col("value").isNull(), _one(F.lit(""), "invalid_json"))
    for name, kind in kinds.items():
        found = found.when(F.col("_which") == name, faults(F.col("value"), kind, F.lit("")))
    return parsed.select(*keys, F.inline(found))


def item_faults(rows: DataFrame, text: Column, at: str, kind: Kind, keys: list[str]) -> DataFrame:
    """json_faults of the items of the array at a top-level field, an item a row: for arrays too long for one expression."""
    parsed = rows.select(*keys, F.try_parse_json(text).alias("value"))
    items = parsed.select(*keys, F.posexplode(F.try_variant_get("value", f"$.{at}", "array<variant>")).alias("place", "item"))
    return items.select(*keys, F.inline(faults(F.col("item"), kind, F.concat(F.lit(f"/{at}/"), F.col("place").cast("string")))))
