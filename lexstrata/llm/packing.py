"""Best-fit decreasing packing of tokenized documents.

Documents are tokenized once and cut where longer than a sequence.  Only the
lengths of the pieces matter for the packing, and there are at most
``capacity`` of them, so the plan is made from the histogram of lengths: all
pieces of a length are placed together, each time into the tightest open bins
that hold them.  The open bins are found in a segment tree over remaining
capacities.  The plan is the same that placing every piece by itself gives, for
any number of documents, and its size depends on ``capacity`` alone.

Pieces then look up their place by their rank among the pieces of their
length.  Ranks come from per-task counters and a running sum over tasks, so no
task sees all pieces.

Cases: null and empty texts are one separator token; a repeated row is packed
each time it occurs; ties of a length are placed in any order; the empty table
gives no rows; extra columns are ignored.  A document of any length is held by
one task while it is cut.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import stored

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a task remembers; beyond it the memory starts anew.
KNOWN_WORDS = 800_000
#: Bytes of text that are tokenized at a time.
TEXT_BYTES = 4 << 20


class FreeSpace:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, dtype=np.int64)

    def add(self, room: int, bins: int) -> None:
        i = room + self.size
        while i:
            self.any[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` with an open bin, or -1."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Plan:
    """For each length: the bins of its pieces, by rank.

    Pieces with ranks from ``rank[k]`` lie in bins from ``bin[k]``, ``each[k]``
    to a bin, the first at ``offset[k]``.
    """

    n_bins: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, bins, each, offset = np.array(self.runs[length], dtype=np.int64).T
        k = np.searchsorted(first, rank, side="right") - 1
        nth = rank - first[k]
        return bins[k] + nth // each[k], offset[k] + nth % each[k] * length


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> Plan:
    """Place all pieces, longest first, each into the tightest bin that holds it."""
    plan, tree = Plan(), FreeSpace(capacity)
    #: By remaining room: runs (first bin, number of bins).
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def opened(room: int, first: int, n: int) -> None:
        open_bins.setdefault(room, []).append((first, n))
        tree.add(room, n)

    for length in sorted(lengths, reverse=True):
        left, rank, runs = lengths[length], 0, []
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                full, over = divmod(left, each)
                for n_bins, fill in ((full, each), (1, over)):
                    if n_bins and fill:
                        runs.append((rank, plan.n_bins, fill, 0))
                        opened(capacity - fill * length, plan.n_bins, n_bins)
                        plan.n_bins += n_bins
                        rank += n_bins * fill
                break
            # A bin just filled to ``room - length`` is the tightest for the next piece while it still holds one.
            first, n = open_bins[room].pop()
            each = room // length
            full, over = divmod(left, each)
            take = min(n, full)
            if take:
                runs.append((rank, first, each, capacity - room))
                opened(room - each * length, first, take)
                rank += take * each
                left -= take * each
            elif over:
                take = 1
                runs.append((rank, first, over, capacity - room))
                opened(room - over * length, first, 1)
                rank += over
                left -= over
            tree.add(room, -n)
            if n > take:
                opened(room, first + take, n - take)
        plan.runs[length] = runs
    return plan


class WordIds:
    """Token ids of texts through a memory of words' ids.

    The vocabulary's rules never join characters across white space, so a
    text's ids are those of its white-space words one after another.  Words are
    remembered as an Arrow array, about 45 bytes a word with its ids.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([" "], pa.string())  # word 0 stands for the separator; no word is a space
        self.at = np.zeros(1, np.int32)
        self.sizes = np.ones(1, np.int32)
        self.ids = np.array([SEPARATOR], np.uint32)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them); each text ends with SEPARATOR."""
        words = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        number = self._numbers(coded.dictionary.cast(pa.string()))
        code = np.insert(number[coded.indices.to_numpy(zero_copy_only=False)], ends, 0)
        start, size = self.at[code], self.sizes[code]
        stop = np.cumsum(size)
        out = self.ids[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        return out, np.concatenate([[0], stop[ends + np.arange(len(ends))]])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self._clear()
        found = pc.index_in(words, value_set=self.known)
        missing = pc.is_null(found)
        new = words.filter(missing)
        number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
        if len(new):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            number[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        return number


_WORDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """The Python worker's own, kept from task to task."""
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = WordIds(vocabulary)
    return _WORDS[vocabulary]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, to
        at = to


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Tokenize and cut.  task and rank tell a piece's place among those of its length in its task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = word_ids(vocabulary), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for lo, hi in slices(texts, TEXT_BYTES):
                ids, at = words.of(texts[lo:hi])
                n_pieces = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(hi - lo), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[row] - start)
                begin = at[row] + start
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sizes, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(first - seen[sizes], counts)
                seen[sizes] += counts
                doc = b.column("doc_id").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), schema)


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and offset there."""
    pieces = stored(pieces_of(documents, vocabulary, capacity), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(lengths, capacity)
    placed = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    placed = placed.withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                sequence[at], offset[at] = plan.place(n, rank[at])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
