"""Word spans and rolling word hashes over Arrow string columns, in NumPy.

Every word-level operator of this subpackage reads texts as UTF-8 bytes.  A
word class is a 256-entry table that says which bytes belong to words; since
both classes in use keep every byte from 0x80 on, byte tables and code-point
patterns find the same words.

Nulls and empty texts have no words.  Columns are taken a bounded number of
bytes at a time (``text_blocks``), and a text beyond the bound forms a block of
its own, so memory follows the longest text and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 2 << 20
#: Bytes hashed at a time inside a block; bounds the 8-byte temporaries.
_HASH_BYTES = 1 << 19
#: Words longer than this are hashed one by one with XXH3.
_LONG_WORD = 64

#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
PLAIN_WORDS = np.ones(256, dtype=bool)
PLAIN_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
FOLDED_WORDS = np.zeros(256, dtype=bool)
FOLDED_WORDS[0x30:0x3A] = FOLDED_WORDS[0x41:0x5B] = FOLDED_WORDS[0x61:0x7B] = FOLDED_WORDS[0x80:] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


@dataclass
class Block:
    """Consecutive texts of one Arrow column with their words."""

    data: np.ndarray  # bytes of all texts, one after another
    text_at: np.ndarray  # n + 1 byte offsets of the texts
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    word_at: np.ndarray  # n + 1 offsets of the texts' words in starts
    first_row: int  # row of the column that the first text stands in

    def __len__(self) -> int:
        return len(self.text_at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())


def _as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray, fold: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``block_bytes`` and find the words of each."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        data, offsets = _as_bytes(chunk)
        at = 0
        while at < len(chunk):
            to = int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1
            to = min(max(to, at + 1), len(chunk))
            part = data[offsets[at] : offsets[to]]
            yield _spans(_FOLD[part] if fold else part, offsets[at : to + 1] - offsets[at], is_word, row + at)
            at = to
        row += len(chunk)


def _spans(data: np.ndarray, text_at: np.ndarray, is_word: np.ndarray, first_row: int) -> Block:
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        bounds = text_at[(text_at > 0) & (text_at < len(data))]
        before[bounds] = False
        after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Block(data, text_at, starts, ends, np.searchsorted(starts, text_at), first_row)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


class RollingHash:
    """64-bit hashes of words, and of runs of k words, from prefix sums.

    A word's hash is the sum of table[byte] * base**position, taken modulo
    2**64 and mixed; a run's hash is the same sum over its words' hashes.
    Instances of different seeds are independent, so two make 128 bits.
    """

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.table = _odd(seed, 256)
        self.base = _odd(seed + 1, 2) | np.uint64(1)
        self.base = (self.base & ~np.uint64(7)) | np.uint64(5)
        self._powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[which][0]) < n:
            base = int(self.base[which])
            size = 1 << max(10, int(n - 1).bit_length())
            self._powers[which] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
        forth, back = self._powers[which]
        return forth[:n], back[:n]

    def words(self, block: Block) -> np.ndarray:
        out = np.empty(len(block.starts), np.uint64)
        at = 0
        while at < len(out):
            origin = block.starts[at]
            to = max(at + 1, int(np.searchsorted(block.ends, origin + _HASH_BYTES, side="right")))
            if block.ends[at] - origin > _HASH_BYTES:
                out[at] = 0  # one of the long words below
                at += 1
                continue
            part = block.data[origin : block.ends[to - 1]]
            forth, back = self.powers(0, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.table[part] * forth[:-1], out=sums[1:])
            lo, hi = block.starts[at:to] - origin, block.ends[at:to] - origin
            out[at:to] = (sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)
            at = to
        out = mix(out)
        for i in np.flatnonzero(block.ends - block.starts > _LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(block.data[block.starts[i] : block.ends[i]].tobytes(), self.seed)
        return out

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of words[i : i + k] for each i with k words left (texts' ends aren't seen here)."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        base = int(self.base[1])
        for j in range(k):
            out += words[j : j + n] * np.uint64(pow(base, j, 1 << 64))
        return mix(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have += take
        step = step * step % (1 << 64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_runs(block: Block, k: int) -> np.ndarray:
    """Indexes i of words so that words i .. i + k - 1 lie in one text."""
    n = len(block.starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ends = np.repeat(block.word_at[1:], block.counts())
    return np.flatnonzero(np.arange(n) + k <= ends[:n])
