"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance.

The file as a whole, its leading block (the lines before the first blank one)
and each of its lines are sparse TF-IDF vectors of words, which are compared
with the notices and licence texts of ``licence_texts``.  The document
frequencies of all words are counted over all files, in ``2 ** DF_BITS`` buckets
of their hashes; words of a bucket share its frequency.  A vector may only match
a template whose name it has, whose version it has beside the same word as the
template (a number elsewhere says nothing), and whose distinguishing words
(``MARKS``) it has and no others of that family: so a version or variant without
a template matches nothing rather than its relative.  A file has the licence of
its part with the best cosine (ties: the larger part), and those of its lines
that match nearly exactly (CLOSE): several are joined by AND.  SPDX tags come
before that: the expression as written (``spdx``), names of templates in their
spelling, other names as they are; different tags of a file are joined by AND.
An expression without the name of a template is no licence, but such a file
doesn't inherit one either.

A file without a licence takes that of the nearest directory at or above its own
that has a licence file, found by joining directories with their ancestors; of
several licence files in a directory the best match counts, then the first path.
A licence file is one named like one (LICENSE, LICENCE, COPYING, NOTICE,
UNLICENSE, with any extension), or one that is a notice and little else (WHOLE),
without an SPDX tag.

Cases: null and empty texts match nothing; ties between templates go to the one
listed first; a null path has no directory and inherits nothing; repeated rows
are scanned each; extra columns are kept, but those named like a result
(``RESULTS``) are replaced by it; the empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexstrata.llm.licence_texts import MARKS, TEMPLATES
from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import spread_join, stored
from lexstrata.llm.wordspans import FOLDED_WORDS, PLAIN_WORDS, Block, RollingHash, _spans, text_blocks

THRESHOLD = 0.7
CLOSE = 0.9
WHOLE = 0.8
DF_BITS = 16
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)([.-][^/]*)?$"
RESULTS = ("licence", "how", "from_path", "cosine", "n_lines", "spdx")

_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(?:([()])|(AND|OR|WITH)(?![\w.+-])|([A-Za-z0-9][A-Za-z0-9.:-]*\+?))", re.I)
_HASH = RollingHash(0x11CE)
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _block(texts: list[str]) -> Block:
    return next(text_blocks(pa.array(texts, pa.string()), FOLDED_WORDS, fold=True, block_bytes=1 << 62))


def _words(text: str) -> list[str]:
    block = _block([text])
    raw = block.data.tobytes()
    return [raw[i:j].decode() for i, j in zip(block.starts, block.ends, strict=True)]


def _hashes(words: list[str]) -> np.ndarray:
    return _HASH.words(_block([" ".join(words)]))


def version_pairs(words: list[str], version: list[str]) -> set[tuple[str, str]]:
    """The version's numbers with the word before each, where the words say most of it."""
    best, said = 0, 0
    for p in range(1, len(words)):
        if words[p] in (version[0], "v" + version[0]):
            n = 1
            while n < len(version) and words[p + n : p + n + 1] == [version[n]]:
                n += 1
            if n > said:
                best, said = p, n
    return {(words[best + i - 1], words[best + i]) for i in range(said)}


class Templates:
    """The templates' terms: counts, the words of name and version that each needs, and those that bar it."""

    def __init__(self) -> None:
        words = [_words(t) for _, t in TEMPLATES]
        listed = sorted({w for ws in words for w in ws} | {w for _, marks in MARKS for w in marks.split()})
        hashes = _hashes(listed)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [listed[i] for i in order]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.licences = [licence for licence, _ in TEMPLATES]
        size = (len(TEMPLATES), len(self.words))
        bound: list[set[tuple[str, str]]] = []
        self.counts, self.needs, self.bars = (np.zeros(size, np.float32) for _ in range(3))
        for k, (licence, ws) in enumerate(zip(self.licences, words, strict=True)):
            for w in ws:
                self.counts[k, self.number[w]] += 1
            version = re.search(r"-(\d+(?:\.\d+)*)$", licence)
            bound.append(version_pairs(ws, version[1].split(".")) if version else set())
            if "clause" in ws:
                bound[-1].add((ws[ws.index("clause") - 1], "clause"))
            named = {w for w in _words(licence) if w.isalpha()} | set(version[1].split(".") if version else ())
            if "clause" in ws:  # else a number in a text counts its conditions
                named |= set(_words(licence))
            for w in named & set(ws):
                self.needs[k, self.number[w]] = 1
            for family, marks in MARKS:
                if any(licence == name or licence.startswith(name + "-") for name in family.split()) or family == "CC" and licence.startswith("CC"):
                    for w in marks.split():
                        (self.needs if w in ws else self.bars)[k, self.number[w]] = 1

        pair = {(self.number[a], self.number[b]) for some in bound for a, b in some}
        self.pairs = np.array(sorted(a * size[1] + b for a, b in pair))
        self.needs_pairs = np.zeros((size[0], len(self.pairs)), np.float32)
        for k, some in enumerate(bound):
            for a, b in some:
                self.needs_pairs[k, np.searchsorted(self.pairs, self.number[a] * size[1] + self.number[b])] = 1

    def pairs_in(self, term: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, pair) of the pairs of words that stand side by side in a group."""
        key = term[:-1] * len(self.words) + term[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        there = (self.pairs[at] == key) & (group[:-1] == group[1:]) & (term[:-1] >= 0) & (term[1:] >= 0)
        return group[1:][there], at[there]

    def terms(self, h: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


_KNOWN = Templates()


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64)


@dataclass
class Weights:
    """Inverse document frequencies of the buckets, and the templates as unit vectors."""

    idf: np.ndarray
    templates: np.ndarray

    @classmethod
    def of(cls, n_files: int, buckets: np.ndarray, files_with: np.ndarray) -> Weights:
        seen = np.zeros(1 << DF_BITS)
        seen[buckets] = files_with
        idf = (np.log((1 + n_files) / (1 + seen)) + 1).astype(np.float32)
        rows = _KNOWN.counts * idf[bucket_of(_KNOWN.hashes)]
        return cls(idf, (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32))

    def best(self, h: np.ndarray, term: np.ndarray, group: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, template) of the best template for each of n groups of words; 0 and -1 under the threshold."""
        cosine, which = np.zeros(n), np.full(n, -1)
        of_pair, pair = _KNOWN.pairs_in(term, group)
        known, size = term >= 0, len(_KNOWN.words)
        weight = self.idf[bucket_of(h)].astype(np.float64)
        # Repeats only add to a norm, so words outside the templates are worth at least this much.
        other = np.bincount(group[~known], weight[~known] ** 2, n)
        key, tf = np.unique(group[known].astype(np.int64) * size + term[known], return_counts=True)
        at, word = key // size, key % size
        value = tf * self.idf[bucket_of(_KNOWN.hashes)][word].astype(np.float64)
        inside = np.bincount(at, value * value, n)
        likely = np.flatnonzero((inside > 0) & (inside >= threshold**2 * (inside + other) * (1 - 1e-6)))
        if not len(likely):
            return cosine, which
        mine = np.flatnonzero(np.isin(group, likely) & ~known)
        order = mine[np.lexsort((h[mine], group[mine]))]
        first = np.flatnonzero(np.append(True, (group[order][1:] != group[order][:-1]) | (h[order][1:] != h[order][:-1]))) if len(order) else order
        times = np.diff(np.append(first, len(order)))
        other = np.bincount(group[order][first], (times * weight[order][first]) ** 2, n)
        for lo in range(0, len(likely), 2048):
            some = likely[lo : lo + 2048]
            rows = np.zeros((len(some), size), np.float32)
            here = np.isin(at, some)
            rows[np.searchsorted(some, at[here]), word[here]] = value[here]
            has = (rows > 0).astype(np.float32)
            score = rows @ self.templates.T / np.sqrt(inside[some] + other[some])[:, None]
            pairs = np.zeros((len(some), len(_KNOWN.pairs)), np.float32)
            beside = np.isin(of_pair, some)
            pairs[np.searchsorted(some, of_pair[beside]), pair[beside]] = 1
            score[((1 - has) @ _KNOWN.needs.T > 0) | (has @ _KNOWN.bars.T > 0) | ((1 - pairs) @ _KNOWN.needs_pairs.T > 0)] = 0
            top = np.round(score, 5).argmax(1)
            cosine[some], which[some] = np.minimum(score[np.arange(len(some)), top], 1.0), top
        low = cosine < threshold
        cosine[low], which[low] = 0, -1
        return cosine, which


def expression(tag: str) -> str | None:
    """The SPDX expression at the start of a tag, with known names in their spelling; None without one."""
    out: list[str] = []
    depth, at, name_next = 0, 0, True
    whole = 0  # tokens of the longest expression so far
    while m := _TOKEN.match(tag, at):
        bracket, operator, name = m.groups()
        if operator and not name_next:
            out.append(operator.upper())
            name_next = True
        elif (name or operator) and name_next:
            out.append(spelled(name or operator))
            name_next = False
        elif bracket == "(" and name_next:
            out.append("(")
            depth += 1
        elif bracket == ")" and not name_next and depth:
            out.append(")")
            depth -= 1
        else:
            break
        at = m.end()
        if not depth and not name_next:
            whole = len(out)
    out = out[:whole]
    while len(out) > 2 and out[0] == "(" and _closing(out) == len(out) - 1:
        out = out[1:-1]
    return " ".join(out).replace("( ", "(").replace(" )", ")") or None


def _closing(tokens: list[str]) -> int:
    """Where the bracket that the tokens start with ends."""
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if not depth:
            return i
    return -1


def spelled(name: str) -> str:
    """A template's licence for a name with or without ``-only``, ``-or-later`` or ``+``, else the name."""
    plain = re.sub(r"(?i)(-only|-or-later|\+)$", "", name)
    return _SPELLING.get(name.lower()) or _SPELLING.get(plain.lower()) or name


_SPELLED = frozenset(_KNOWN.licences)
_SPELLING = {name.lower(): name for name in _SPELLED}


def tagged(text: str | None) -> str | None:
    """The expressions of a file's SPDX tags."""
    found = dict.fromkeys(e for t in _TAG.findall(text or "") if (e := expression(t)))
    if len(found) < 2:
        return next(iter(found), None)
    return " AND ".join(f"({e})" if " OR " in e else e for e in sorted(found))


def line_of_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(line of each word, text of each line), of lines with a word."""
    lines = _spans(block.data, block.text_at, _LINES, 0)
    of = np.searchsorted(lines.starts, block.starts, side="right") - 1
    kept, number = np.unique(of, return_inverse=True)
    return number, lines.text_of_word()[kept]


def in_leading_block(block: Block) -> np.ndarray:
    """Whether each word stands before the first blank line after its text's first non-blank one."""
    seen = _spans(block.data, block.text_at, PLAIN_WORDS, 0)
    text, line = seen.text_of_word(), np.cumsum(block.data == 0x0A)[seen.starts]
    later = np.flatnonzero((text[1:] == text[:-1]) & (line[1:] - line[:-1] > 1)) + 1
    stop = block.text_at[1:].copy()
    np.minimum.at(stop, text[later], seen.starts[later])
    return block.starts < stop[block.text_of_word()]


def files_with_terms(files: DataFrame) -> Weights:
    """Count in how many files each bucket of words occurs; a row per bucket and task is shuffled."""

    def count(batches):
        n, files_seen = np.zeros(1 << DF_BITS, np.int64), 0
        for b in batches:
            files_seen += b.num_rows
            for block in text_blocks(b.column(0), FOLDED_WORDS, fold=True):
                key = np.unique(block.text_of_word() << DF_BITS | bucket_of(_HASH.words(block)))
                n += np.bincount(key & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(n[seen], files_seen))], names=["bucket", "n"])

    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** DF_BITS + 1 rows
    bucket, n = (found.column(c).to_numpy() for c in ("bucket", "n"))
    return Weights.of(int(n[bucket < 0].sum()), bucket[bucket >= 0], n[bucket >= 0])


def chosen(weights: Weights, block: Block, threshold: float) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """Licence, cosine, number of matching lines and whether the file is a notice as a whole, for each text."""
    n, h, owner = len(block), _HASH.words(block), block.text_of_word()
    term, lead = _KNOWN.terms(h), in_leading_block(block)
    line, text = line_of_words(block)
    top, of = weights.best(h, term, owner, n, threshold)
    whole = top >= WHOLE
    header, header_of = weights.best(h[lead], term[lead], owner[lead], n, threshold)
    take = header > top + 1e-6
    top[take], of[take] = header[take], header_of[take]
    score, which = weights.best(h, term, line, len(text), threshold)
    hits = np.flatnonzero(which >= 0)
    close: dict[int, set[str]] = {}
    for i in hits.tolist():
        t = int(text[i])
        if score[i] > top[t] + 1e-6:
            top[t], of[t] = score[i], which[i]
        if score[i] >= CLOSE:
            close.setdefault(t, set()).add(_KNOWN.licences[which[i]])
    licence: list[str | None] = [_KNOWN.licences[k] if k >= 0 else None for k in of.tolist()]
    for t, names in close.items():
        licence[t] = " AND ".join(sorted(names | {licence[t]}))
    return licence, top, np.bincount(text[hits], minlength=n), whole


def matches(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The files' columns but text, with licence, cosine, n_lines (matching), whole (the file is a notice) and spdx (its tags' expression)."""
    names = [c for c in files.columns if c != "text"]

    def scan(batches):
        for b in batches:
            licence, cosine, n_lines, whole, spdx = [], [], [], [], [None] * b.num_rows
            for block in text_blocks(b.column("text"), FOLDED_WORDS, fold=True):
                found, top, lines, entire = chosen(weights, block, threshold)
                licence += found
                cosine += [round(c, 6) if c else None for c in top.tolist()]
                n_lines += lines.tolist()
                whole += entire.tolist()
            tags = pc.fill_null(pc.match_substring(b.column("text"), "spdx-license-identifier:", ignore_case=True), False)
            for i in np.flatnonzero(tags.to_numpy(zero_copy_only=False)).tolist():
                if said := tagged(b.column("text")[i].as_py()):
                    known = not _SPELLED.isdisjoint(re.split(r"[\s()]+", said))
                    spdx[i], whole[i] = said, False
                    licence[i], cosine[i] = (said, 1.0) if known else (None, None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(licence, pa.string()), pa.array(cosine, pa.float64()), pa.array(n_lines, pa.int64()), pa.array(whole, pa.bool_()), pa.array(spdx, pa.string())], names=[*names, "licence", "cosine", "n_lines", "whole", "spdx"])

    schema = StructType([files.schema[c] for c in names]).add("licence", "string").add("cosine", "double").add("n_lines", "long").add("whole", "boolean").add("spdx", "string")
    return files.mapInArrow(tidy(scan), schema)


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")


def directory_licences(found: DataFrame) -> DataFrame:
    """dir, n_files, inherited, from_path: for each directory of a file, the nearest licence file at or above it, if any."""
    declared = found.where("licence is not null").where(F.col("whole") | F.col("path").rlike(LICENCE_FILE))
    best = F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), F.col("licence").alias("l"))
    declared = declared.groupBy("dir").agg(F.min(best).alias("best")).select(F.col("dir").alias("above"), F.col("best.l").alias("inherited"), F.col("best.p").alias("from_path"))
    dirs = found.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    every = dirs.select("dir", "n_files", F.explode(above).alias("a")).select("dir", "n_files", "a.depth", "a.above").dropDuplicates(["dir", "above"])
    near = every.join(declared, "above", "left").groupBy("dir").agg(F.first("n_files").alias("n_files"), F.max_by(F.struct("inherited", "from_path"), F.when(F.col("inherited").isNotNull(), F.col("depth"))).alias("near"))
    return near.select("dir", "n_files", "near.inherited", "near.from_path")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every file (columns path, text and any others): how is own, inherited or none."""
    others = [c for c in files.columns if c not in ("path", "text", *RESULTS)]
    carried = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(True)
    rows = files.select(carried.alias("carried"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    found = stored(matches(rows, files_with_terms(rows), threshold).withColumn("dir", directory(F.col("path"))), "licences")
    placed = found.where("path is not null")
    joined = spread_join(placed, stored(directory_licences(placed), "directories"), "dir", "n_files")
    nowhere = found.where("path is null").withColumns({"inherited": F.lit(None).cast("string"), "from_path": F.lit(None).cast("string")})
    own = F.col("licence").isNotNull()
    joined = joined.withColumns({c: F.when(F.col("spdx").isNull(), F.col(c)) for c in ("inherited", "from_path")})
    return joined.unionByName(nowhere).select(
        *(F.col(f"carried.`{c}`").alias(c) for c in others),
        "path",
        F.coalesce("licence", "inherited").alias("licence"),
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
        "cosine",
        "n_lines",
        "spdx",
    )
