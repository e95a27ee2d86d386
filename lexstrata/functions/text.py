"""Text functions of the search index, as column expressions where Spark has them."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexstrata.errors import error

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TOKEN = re.compile(r"[\w./-]+")


def _fold_table() -> tuple[dict[str, str], str]:
    """Letters that lower-casing alone doesn't fold, and the marks that the index passes over.

    A letter folds to its simple case folding, and from there to its ASCII
    letter if it is that with one mark.  The marks are those of such letters.
    """
    letters, marks = {}, set()
    for code in range(0x80, 0x20000):
        c = chr(code)
        if unicodedata.category(c)[0] not in "LN":
            continue
        low = c.casefold() if len(c.casefold()) == 1 else c.lower() if len(c.lower()) == 1 else c
        parts = unicodedata.normalize("NFD", "\u0069\u0307" if c == "\u0130" else low)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            marks.add(parts[1])
            low = parts[0]
        # The capital sigma has two small forms, of which lower-casing takes one by what stands beside it.
        if low != c.lower() or c == "\u03a3":
            letters[c] = low
    return letters, "".join(sorted(marks))


_LETTERS, MARKS = _fold_table()
#: What is translated before lower-casing; what has no partner, the marks, goes.
FOLD_FROM = "".join(_LETTERS) + MARKS
FOLD_TO = "".join(_LETTERS.values())
_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, MARKS)
_TOKENS = regex.compile(TOKEN)
#: A token as it stands in a text, marks and all.
WRITTEN_TOKEN = regex.compile(TOKEN[:-1] + "[" + TOKEN[1:-2] + MARKS + "]*")

# Words that natural-language queries pass over.
STOP_WORDS = frozenset({
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it",
    "of", "on", "or", "say", "that", "the", "to", "what", "when", "where", "which", "with",
})
WRAPPER_WORDS = frozenset({"document", "spec", "specification", "standard"})

# Discovery alternatives of the concept mode.
CONCEPTS = (
    ("rationale", "justification", "reason", "basis", "why"),
    ("assumption", "assumptions", "premise", "hypothesis"),
    ("tailored", "tailoring", "customized", "adapted"),
    ("criterion", "criteria"),
    ("selected", "chosen", "selection", "derived"),
    ("environmental", "environment", "ambient"),
    ("worldwide", "global", "world"),
    ("polar", "antarctic", "arctic"),
    ("excluded", "except", "exclusion", "exception"),
    ("replace", "substitute", "substitutes", "replacement"),
    ("standalone", "separately", "separate", "independent"),
    ("failure", "malfunction", "fault"),
    ("inspect", "inspection", "examine", "examination"),
    ("maximum", "upper", "ceiling"),
    ("minimum", "lower", "floor"),
    ("duration", "period", "time"),
)
_CONCEPT_OF = {word: group for group in CONCEPTS for word in group}
MODES = ("exact_phrase", "all_terms", "any_terms", "natural_language", "concept_language")


def folded(text: Column) -> Column:
    """Lower case, without diacritics; texts of ASCII alone need no table."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO)))


def tokens(text: Column) -> Column:
    """The index's tokens: runs of letters and numbers, lower case, without diacritics."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def fold_word(word: str) -> str:
    return word.translate(_FOLD).lower()


def index_tokens(text: str) -> list[str]:
    """The same tokens on the driver, for queries."""
    return _TOKENS.findall(fold_word(text))


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; prefix lets the last one be the beginning of a token."""

    tokens: tuple[str, ...]
    prefix: bool = False

    def starts_in(self, listed: Column) -> Column:
        """Positions where the phrase starts in an array of tokens."""
        n = len(self.tokens)
        last = F.size(listed) - n

        def here(i: Column) -> Column:
            found = F.lit(True)
            for k, t in enumerate(self.tokens):
                word = F.get(listed, i + k)
                found = found & (word.startswith(t) if self.prefix and k == n - 1 else word == F.lit(t))
            return found

        if n == 1 and not self.prefix and len(self.tokens) == 1:
            return F.filter(F.transform(listed, lambda w, i: F.when(w == F.lit(self.tokens[0]), i)), lambda i: i.isNotNull())
        return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))

    def in_tokens(self, listed: Column) -> Column:
        if len(self.tokens) == 1:
            t = self.tokens[0]
            return F.exists(listed, lambda w: w.startswith(t)) if self.prefix else F.array_contains(listed, t)
        words = self.tokens[:-1] if self.prefix else self.tokens
        there = F.lit(True)
        for t in dict.fromkeys(words):
            there = there & F.array_contains(listed, t)
        return there & (F.size(self.starts_in(listed)) > 0)


def instances(phrases: list[Phrase], listed: Column) -> Column:
    """How many stretches of an array of tokens any of the phrases marks; overlapping ones count once."""

    def marked(p: Phrase) -> Column:
        return F.transform(p.starts_in(listed), lambda i: F.struct(i.cast("int").alias("b"), (i + len(p.tokens)).cast("int").alias("e")))

    spans = [marked(p) for p in phrases]
    if len(phrases) == 1 and len(phrases[0].tokens) == 1 or all(len(p.tokens) == 1 for p in phrases):
        return F.size(F.array_distinct(F.flatten(F.array(*[p.starts_in(listed) for p in phrases]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("e"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct((acc["n"] + F.when(s["b"] >= acc["e"], 1).otherwise(0)).alias("n"), F.greatest(acc["e"], s["e"]).alias("e"))

    return F.aggregate(F.array_sort(F.flatten(F.array(*spans))), start, step, lambda acc: acc["n"])


# Fixed value: terms whose last token may be the beginning of an identifier.
_IDENTIFIER_LIKE = re.compile(r"(?:[A-Za-z]+[-/][A-Za-z0-9./-]*\d[A-Za-z0-9./-]*|\d{3,}[A-Za-z])")


@dataclass(frozen=True)
class Query:
    """A parsed query: groups of alternative phrases, all or any of which must match."""

    groups: tuple[tuple[Phrase, ...], ...]
    every: bool
    stemmed: bool
    concepts: bool
    terms: tuple[str, ...]
    ignored: tuple[str, ...]

    @property
    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys(p for g in self.groups for p in g))


def parse(query: str, mode: str, relaxed: bool = False) -> Query:
    if not (isinstance(query, str) and bool(query.strip()) and len(query) <= 4096 and len(query.encode("utf-8", "surrogatepass")) <= 16384):
        raise error("invalid_query", "A query of 1 to 4096 characters is required.")
    if mode not in MODES:
        raise error("invalid_query_mode", "The query mode is not supported.", modes=list(MODES))
    found = [t for t in QUERY_TOKEN.findall(query) if any(c.isalnum() for c in t)]
    if not (bool(found) and len(found) <= 32 and all(len(t) <= 256 and len(t.encode()) <= 1024 for t in found)):
        raise error("invalid_query", "A query needs 1 to 32 terms of at most 256 characters.")
    natural = mode in ("natural_language", "concept_language")
    skip = STOP_WORDS | WRAPPER_WORDS if natural else frozenset()
    kept = [t for t in found if t.casefold() not in skip]
    if not kept:
        raise error("invalid_query", "The query has nothing but stop words.")
    stem = porter if natural else str

    def phrase(term: str) -> Phrase:
        words = index_tokens(term)
        prefix = natural and _IDENTIFIER_LIKE.fullmatch(term) is not None
        return Phrase(tuple(stem(w) for w in words), prefix)

    if mode == "exact_phrase":
        groups = [(Phrase(tuple(w for t in kept for w in index_tokens(t))),)]
    elif mode == "concept_language":
        groups = list(dict.fromkeys(tuple(phrase(w) for w in _CONCEPT_OF.get(t.casefold(), (t,))) for t in kept))
    else:
        groups = [(phrase(t),) for t in kept]
    return Query(tuple(groups), mode != "any_terms" and not relaxed, natural, mode == "concept_language", tuple(kept), tuple(t for t in found if t.casefold() in skip))


_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWEL:
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    n, before = 0, False  # whether the letter before is a vowel
    for i, c in enumerate(w):
        vowel = c in _VOWEL or c == "y" and i > 0 and not before
        n += before and not vowel
        before = vowel
    return n


def _vowel_in(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# Suffixes of the published Porter algorithm, steps 2 to 4.
_STEP2 = [
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
    ("logi", "log"),
]
_STEP3 = [
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Longest suffixes first; most words have none of a step's.
_STEP2, _STEP3 = (sorted(pairs, key=lambda p: -len(p[0])) for pairs in (_STEP2, _STEP3))
_STEP4.sort(key=len, reverse=True)
_ENDS2, _ENDS3, _ENDS4 = tuple(old for old, _ in _STEP2), tuple(old for old, _ in _STEP3), tuple(_STEP4)


def _replaced(w: str, pairs: list[tuple[str, str]], ends: tuple[str, ...]) -> str:
    if not w.endswith(ends):
        return w
    for old, new in pairs:
        if w.endswith(old):
            stem = w[: len(w) - len(old)]
            return stem + new if _measure(stem) > 0 else w
    return w


def porter(word: str) -> str:
    """The Porter stem of an ASCII lower-case word; other words stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel_in(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel_in(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2, _ENDS2), _STEP3, _ENDS3)
    for s in _STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def normalized_identifier(column: Column) -> Column:
    """Trimmed, upper case, one space between words, none around - and /.  Null if not a safe identifier.

    Compatibility characters aren't rewritten here; ``normalize_identifier``
    does it for arguments.
    """
    x = F.upper(F.trim(F.regexp_replace(column, r"\s+", " ")))
    x = F.regexp_replace(F.regexp_replace(x, r"\s*-\s*", "-"), r"\s*/\s*", "/")
    return F.when(x.rlike(r"^[A-Z0-9][A-Z0-9 () ./_-]{1,127}$"), x)


def normalize_identifier(value: str, prefix: bool = False) -> str:
    if not (isinstance(value, str) and bool(value.strip())):
        raise error("invalid_identifier", "A non-empty identifier is required.")
    x = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).strip().upper())
    x = re.sub(r"\s*/\s*", "/", re.sub(r"\s*-\s*", "-", x))
    if re.fullmatch(r"[A-Z0-9][A-Z0-9 () ./_-]{%d,127}" % (not prefix), x) is None:
        raise error("invalid_identifier", "The identifier has unsupported characters or length.")
    return x
