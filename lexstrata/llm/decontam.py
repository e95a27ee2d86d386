"""Benchmark decontamination with an FM-index per shard of training text.

Words are lower-cased ASCII runs of letters, digits and non-ASCII characters.
An item's windows are its runs of 13 consecutive words (an item of fewer, but
not none, is one window).  Every shard of documents is indexed and all windows
are searched in it backwards, through the ranks of a wavelet tree over the
Burrows-Wheeler transform; occurrences are located by sampled suffix positions
and their spans merged into removal spans of words.

The alphabet is the benchmark's vocabulary.  Any other word ends a run: a
window can't contain it, so runs of vocabulary words that are shorter than the
shortest window are left out of the index, which loses no occurrence and keeps
the index a small part of the shard.

Cases: null and empty texts and items have no words (an item without words has
no window); repeated rows, ties and items with equal texts are each judged;
an empty benchmark or document table gives clean or no rows; extra columns are
ignored.  The benchmark is collected in parts of at most ``part_bytes`` and
every part is searched in all documents, so no bound on its size is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lexstrata.llm.memory import tidy
from lexstrata.llm.wordspans import FOLDED_WORDS, Block, text_blocks

WINDOW = 13
SAMPLE_EVERY = 8
SHARD_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: A document is contaminated if it is hit and 20 times its hit words reach its words.
SHARE = 20


class RankBits:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbol at each level (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(np.uint8)
            self.levels.append(RankBits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position i."""
        start = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = level.ones(start), level.ones(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            ones = level.ones(i)
            bit = level.ones(i + 1) - ones
            out = out << 1 | bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Backward search and locating over a sequence of positive symbols; 0 is the end."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.tree = WaveletTree(last, max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        sampled = order % SAMPLE_EVERY == 0
        self.sampled = RankBits(sampled.astype(np.uint8))
        self.is_sampled, self.positions = sampled, order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of equally long phrases, given as the rows of an array."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled position are counted."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.copy(), np.arange(len(rows))
        while len(live):
            done = self.is_sampled[at[live]]
            found = live[done]
            out[found] = self.positions[self.sampled.ones(at[found])] + steps[found]
            live = live[~done]
            if len(live):
                c = self.tree.access(at[live])
                at[live] = self.first[c] + self.tree.rank(c, at[live])
                steps[live] += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a part of the benchmark."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]  # rows of symbols
    items: dict[int, list[list[int]]]  # of each row, the item ids

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[int]] = {}
        for block in text_blocks(pa.array([t for _, t in rows], pa.string()), FOLDED_WORDS, fold=True):
            raw = block.data.tobytes()
            for i in range(len(block)):
                span = range(block.word_at[i], block.word_at[i + 1])
                words = [vocabulary.setdefault(raw[block.starts[w] : block.ends[w]], len(vocabulary) + 2) for w in span]
                size = min(window, len(words))
                for j in range(len(words) - size + 1 if words else 0):
                    ids = found.setdefault(tuple(words[j : j + size]), [])
                    if not ids or ids[-1] != rows[block.first_row + i][0]:
                        ids.append(rows[block.first_row + i][0])
        out = cls(vocabulary, {}, {})
        for size in sorted({len(k) for k in found}):
            keys = sorted(k for k in found if len(k) == size)
            out.by_length[size] = np.array(keys, np.int64)
            out.items[size] = [found[k] for k in keys]
        return out

    def symbols(self, block: Block) -> np.ndarray:
        """The vocabulary number of each word of a block; 1 for any other word."""
        starts = block.starts
        offsets = np.empty(2 * len(starts) + 1, np.int64)  # of words and what lies between them, in turn
        offsets[0:-1:2], offsets[1::2], offsets[-1] = starts, block.ends, len(block.data)
        pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(block.data)])
        coded = pieces.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode() if len(starts) else pa.array([], pa.large_binary()).dictionary_encode()
        number = np.array([self.vocabulary.get(w, 1) for w in coded.dictionary.to_pylist()], np.int64)
        return number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)


@dataclass
class Hits:
    text: np.ndarray  # text of each occurrence
    start: np.ndarray  # word index in the shard
    size: np.ndarray
    items: list[list[int]]


def find(block: Block, phrases: Phrases) -> Hits:
    """All occurrences of all windows in a shard."""
    none = Hits(*(np.zeros(0, np.int64) for _ in range(3)), [])
    if not phrases.by_length or not len(block.starts):
        return none
    symbols, text = phrases.symbols(block), block.text_of_word()
    known = symbols > 1
    edge = np.ones(len(known), bool)
    edge[1:] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
    run = np.cumsum(edge) - 1
    size = np.bincount(run)
    keep = known & (size[run] >= min(phrases.by_length))
    if not keep.any():
        return none
    where = np.flatnonzero(keep)
    # One separator (symbol 1) after each run that is kept.
    new_run = np.concatenate([[0], np.cumsum(run[where][1:] != run[where][:-1])])
    place = np.arange(len(where)) + new_run
    sequence = np.ones(place[-1] + 2, np.int64)
    sequence[place] = symbols[where]
    back = np.full(len(sequence), -1, np.int64)
    back[place] = where
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    out, items = [], []
    for n, rows in phrases.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        start = back[index.locate(at)]
        out.append((text[start], start, np.full(len(start), n)))
        items += [phrases.items[n][i] for i in which.tolist()]
    return Hits(*(np.concatenate(x) for x in zip(*out, strict=True)), items)


def removal_spans(n_words: int, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Merged half-open spans of word indexes."""
    covered = np.zeros(n_words + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + size, -1)
    inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
    step = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Phrases]:
    """The benchmark's windows, a bounded part of the items at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // part_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Phrases.of(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


SPANS = "array<struct<begin:int,stop:int>>"


def hits(documents: DataFrame, phrases: Phrases, names: tuple[str, str, str]) -> DataFrame:
    """The documents, all columns, and (n_words, spans, items) of one part of the benchmark by these names."""
    carried = documents.columns
    span = ArrayType(StructType([StructField("begin", IntegerType()), StructField("stop", IntegerType())]))
    found_fields = [StructField(names[0], LongType()), StructField(names[1], span), StructField(names[2], ArrayType(LongType()))]
    schema = StructType([*(documents.schema[c] for c in carried), *found_fields])

    def searched(batches):
        for b in batches:
            for block in text_blocks(b.column("text"), FOLDED_WORDS, fold=True, block_bytes=SHARD_BYTES):
                found = find(block, phrases)
                order = np.argsort(found.text, kind="stable")
                cut = np.searchsorted(found.text[order], np.arange(len(block) + 1))
                spans, items = [], []
                for i in range(len(block)):
                    mine = order[cut[i] : cut[i + 1]]
                    if not len(mine):
                        spans.append([])
                        items.append([])
                        continue
                    at = block.word_at[i]
                    spans.append([{"begin": s, "stop": e} for s, e in removal_spans(int(block.word_at[i + 1] - at), found.start[mine] - at, found.size[mine])])
                    items.append(sorted({x for m in mine.tolist() for x in found.items[m] if x is not None}))
                span_type = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(block.first_row, len(block)) for c in carried), pa.array(block.counts(), pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.int64()))], names=[*carried, *names])

    return documents.mapInArrow(tidy(searched), schema)


def merged(spans: Column) -> Column:
    """The union of half-open spans."""

    def added(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = F.size(acc).eqNullSafe(0) | (last["stop"] < s["begin"])
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), added)


def searched_parts(documents: DataFrame, benchmark: DataFrame, part_bytes: int) -> tuple[DataFrame, str, str, str]:
    """The documents with what all parts of the benchmark found, and the names of the three new columns."""
    n = max([0, *(len(c) for c in documents.columns)])
    new = lambda what: what.ljust(n + 1, "_")  # noqa: E731  a name that no column has
    n_words, spans, items = new("n_words"), new("spans"), new("items")
    found = None
    for phrases in parts(benchmark, part_bytes):
        if found is None:
            found = hits(documents, phrases, (n_words, spans, items))
            continue
        more = (n_words + "2", spans + "2", items + "2")
        both = hits(found, phrases, more)
        found = both.withColumns({spans: merged(F.concat(spans, more[1])), items: F.array_sort(F.array_union(items, more[2]))}).drop(*more)
    return found, n_words, spans, items


def verdicts(n_words: str, spans: str) -> tuple[Column, Column]:
    """(n_hit, contaminated)."""
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return n_hit, (n_hit > 0) & (SHARE * n_hit >= F.col(n_words))


def contamination(documents: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, spans, items, n_hit and contaminated of every document's row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, n_words, spans, items = searched_parts(rows, benchmark, part_bytes)
    n_hit, contaminated = verdicts(n_words, spans)
    return found.select("doc_id", F.col(n_words).alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"), n_hit.alias("n_hit"), contaminated.alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents' rows, all columns, that are not contaminated."""
    found, n_words, spans, _ = searched_parts(documents, benchmark, part_bytes)
    return found.where(~verdicts(n_words, spans)[1]).select(*documents.columns)
