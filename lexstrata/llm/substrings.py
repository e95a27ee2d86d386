"""Substring dedup with prefix-partitioned suffix trees.

A window is 13 consecutive words of a document.  Words covered by a window
whose word sequence also starts in a document with a smaller doc_id go.

1. Documents are dealt into blocks by a hash of their id.  In each window one
   anchor is chosen by content, the 5-word run with the least hash, so equal
   windows have equal anchors.  Anchors that lie in one document only can't be
   part of a repeat; partial counts over each anchor's blocks find the others.
2. A block builds the suffix tree of its windows on shared anchors, cut at 13
   words: under each of the tree's nodes of that depth, the windows of all
   documents but the smallest are marked.  What is left goes on as stretches of
   words around the anchor, so a passage that very many documents share leaves a
   block only once.
3. Stretches are split by variable-length prefixes: by one word from the anchor
   on, and where more than ``GROUP_ROWS`` stretches start with it, by two words
   or by the whole anchor.  Prefixes are put into groups of that size, whatever
   the input, and each group builds its suffix tree.
4. Where even an anchor has too many stretches, each window (suffix) goes by
   itself, by its whole 13 words: the subtree under such a prefix is one node,
   and the smallest document under it is a partial aggregate that is joined back,
   so the copies of a window are never gathered.

In a tree suffixes are ranked by doubling lengths, and the common prefixes of
neighbours (LCP) cut them into the subtrees under its nodes of 13 words.  Words
are compared as words; a word of over ``LONG_WORD`` bytes is compared by its
SHA-256 and length outside its block.  Hashes only choose anchors, blocks and
groups.

Cases: null and empty texts have no words; documents of fewer than 13 words
lose none; a window that repeats within one document alone stays; rows that
repeat a doc_id don't take words from each other; a row without doc_id keeps
all words and takes none; extra columns are kept; the empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexstrata.llm.shared import stored
from lexstrata.llm.simhash import single_spaced
from lexstrata.llm.wordspans import PLAIN_WORDS, Block, RollingHash, text_blocks, whole_runs

WINDOW = 13
ANCHOR = 5
PREFIXES = (1, 2, ANCHOR)
BLOCK_BYTES = 2 << 20
#: Stretches of words in a group; a prefix with more is made longer.
GROUP_ROWS = 60_000
#: Long prefixes are broadcast up to this number (16 MB), and joined by sort and merge beyond.
BROADCAST_PREFIXES = 1 << 20
#: Longer words are written as their digest.
LONG_WORD = 256

_ONE = RollingHash(0xA11CE)


def least_runs(block: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their anchors' positions, hashes of all anchor-long runs)."""
    starts = whole_runs(block, WINDOW)
    runs = _ONE.runs(words, ANCHOR)
    if not len(starts):
        return starts, starts, runs
    n = len(words) - WINDOW + 1
    least, at = runs[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - ANCHOR + 1):
        less = runs[j : j + n] < least
        least[less] = runs[j : j + n][less]
        at[less] = j
    return starts, starts + at[starts], runs


def _block_of(table: pa.Table) -> tuple[Block | None, np.ndarray, np.ndarray]:
    """The words of a block's documents in the order of (doc_id, text); ids; which rows have one."""
    column = table.column("doc_id")
    ids, known = column.fill_null(0).to_numpy(), column.is_valid().to_numpy()
    blocks = list(text_blocks(table.column("text").combine_chunks(), PLAIN_WORDS, block_bytes=1 << 62))
    return (blocks[0] if blocks else None), ids, known


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def block_anchors(table: pa.Table) -> pa.Table:
    """anchor, and seen: the block's number twice over, plus 1 if several of its documents have the anchor."""
    table = _sorted(table)
    block, ids, known = _block_of(table)
    anchor, many = np.zeros(0, np.uint64), np.zeros(0, bool)
    if block is not None:
        words, text = _ONE.words(block), block.text_of_word()
        _, at, runs = least_runs(block, words)
        at = np.unique(at)
        at = at[known[text[at]]]
        if len(at):
            h, doc = runs[at], ids[text[at]]
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.insert(h[1:] != h[:-1], 0, True))
            anchor, many = h[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    seen = 2 * int(table.column("q")[0].as_py()) + many.astype(np.int64)
    return pa.table({"anchor": pa.array(anchor.view(np.int64)), "seen": pa.array(seen, pa.int64())})


def _runs_of(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive numbers within a group; both sorted by (group, at)."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))[: len(first)] - 1


PREFIX_COLUMNS = [f"prefix_{n}" for n in PREFIXES]
PIECES = "q int, row int, doc_id long, begin int, stop int, words string" + "".join(f", {c} int" for c in PREFIX_COLUMNS)


def block_pieces(table: pa.Table, shared: pa.Table) -> pa.Table:
    """Rows of PIECES: spans marked within the block (words null), and stretches to compare further.

    prefix_n is a hash of the n words from the anchor on; it only says what is
    grouped together.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()] + [pa.int32()] * len(PREFIXES)
    empty = pa.table([pa.array([], t) for t in types], names=names)
    if not len(table) or not len(shared):
        return empty
    table = _sorted(table)
    q = table.column("q")[0].as_py()
    block, ids, known = _block_of(table)
    words, text = _ONE.words(block), block.text_of_word()
    starts, at, runs = least_runs(block, words)
    wanted = known[text[starts]] & np.isin(runs[at].view(np.int64), shared.column("anchor").to_numpy())
    starts, at = starts[wanted], at[wanted]
    if not len(starts):
        return empty
    doc = ids[text[starts]]
    later = doc > smallest_under(deep_nodes(*windows_only(word_codes(block), starts)), doc)
    row_at = block.word_at[text]

    def rows(begin: np.ndarray, stop: np.ndarray, said: pa.Array, prefixes: list[pa.Array]) -> pa.Table:
        local = begin - row_at[begin]  # word number within its text
        return pa.table([pa.array(np.full(len(begin), q), pa.int32()), pa.array(text[begin], pa.int32()), pa.array(ids[text[begin]]), pa.array(local, pa.int32()), pa.array(local + stop - begin, pa.int32()), said, *prefixes], names=names)

    first, last = _runs_of(starts[later], text[starts[later]])
    marked = rows(starts[later][first], starts[later][last] + WINDOW, pa.nulls(len(first), pa.string()), [pa.nulls(len(first), pa.int32())] * len(PREFIXES))
    starts, at = starts[~later], at[~later]
    first = np.flatnonzero(np.insert(at[1:] != at[:-1], 0, True)) if len(at) else np.zeros(0, np.int64)
    begin, stop = starts[first], np.append(starts[first[1:] - 1], starts[-1:]) + WINDOW
    raw, word_from, word_to = single_spaced(block)
    long = np.flatnonzero(word_to - word_from > LONG_WORD)

    def said(i: int, j: int) -> str:
        if not len(long) or np.searchsorted(long, i) == np.searchsorted(long, j):
            return raw[word_from[i] : word_to[j - 1]].decode()
        each = (raw[word_from[k] : word_to[k]] for k in range(i, j))
        return " ".join(w.decode() if len(w) <= LONG_WORD else f"{hashlib.sha256(w).hexdigest()}:{len(w)}:{'_' * LONG_WORD}" for w in each)

    short = lambda h: pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
    left = rows(begin, stop, pa.array([said(i, j) for i, j in zip(begin.tolist(), stop.tolist(), strict=True)], pa.string()), [short(_ONE.runs(words, n)[at[first]]) for n in PREFIXES])
    return pa.concat_tables([marked, left])


def word_codes(block: Block) -> np.ndarray:
    """A number for each word, equal for equal words."""
    n = len(block.starts)
    offsets = np.empty(2 * n + 1, np.int64)  # of words and what lies between them, in turn
    offsets[0:-1:2], offsets[1::2], offsets[-1] = block.starts, block.ends, len(block.data)
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(offsets), pa.py_buffer(block.data)])
    return pieces.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def windows_only(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that lie in the windows at these sorted starts, one after another, and the starts there."""
    inside = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + WINDOW, -1)
    keep = np.cumsum(inside[:-1]) > 0
    return symbols[keep], (np.cumsum(keep) - 1)[starts]


def suffix_ranks(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, as long as these are at most ``depth``."""
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    length, pad = 1, np.full(depth, -1, np.int64)
    while 2 * length <= depth:
        rank = ranks[-1]
        second = np.concatenate([rank, pad])[length : length + len(rank)]
        ranks.append(np.unique((rank + 1) * (len(rank) + 2) + second + 1, return_inverse=True)[1].astype(np.int64))
        length *= 2
    return ranks


def suffix_tree(symbols: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the suffixes at ``starts``, cut at ``depth`` words: (their order, LCP of each with the one before).

    Every start has ``depth`` words after it.
    """
    ranks = suffix_ranks(symbols, depth)
    longest = 1 << (len(ranks) - 1)
    # Two overlapping runs make up the depth.
    order = np.lexsort((ranks[-1][starts + depth - longest], ranks[-1][starts]))
    a, b = starts[order][:-1], starts[order][1:]
    lcp = np.zeros(len(starts), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = np.minimum(a + lcp[1:], len(symbols) - 1), np.minimum(b + lcp[1:], len(symbols) - 1)
        fits = lcp[1:] + (1 << k) <= depth
        lcp[1:] += np.where(fits & (ranks[k][i] == ranks[k][j]), 1 << k, 0)
    return order, lcp


def deep_nodes(symbols: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For the suffix at each start, the number of the tree's node at ``depth`` above it, in the order of the suffixes."""
    order, lcp = suffix_tree(symbols, starts, depth)
    node = np.empty(len(starts), np.int64)
    node[order] = np.cumsum(lcp < depth) - 1
    return node


def smallest_under(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix the smallest document under its node."""
    least = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc)
    return least[node]


SPANS = "q int, row int, begin int, stop int"


def group_spans(table: pa.Table) -> pa.Table:
    """Marked spans of a group's stretches: words under a deep node with a smaller document."""
    listed = pc.split_pattern(table.column("words").combine_chunks(), " ")
    n_words = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.list_flatten(listed).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    word_at = np.cumsum(n_words) - n_words
    n_windows = n_words - WINDOW + 1
    row = np.repeat(np.arange(len(n_words)), n_windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    doc = table.column("doc_id").to_numpy()[row]
    marked = np.flatnonzero(smallest_under(deep_nodes(symbols, word_at[row] + nth), doc) < doc)
    first, last = _runs_of(nth[marked], row[marked])
    of = row[marked][first]
    begin = table.column("begin").to_numpy()[of] + nth[marked][first]
    stop = table.column("begin").to_numpy()[of] + nth[marked][last] + WINDOW
    pick = lambda c: table.column(c).combine_chunks().take(pa.array(of))
    return pa.table({"q": pick("q"), "row": pick("row"), "begin": pa.array(begin, pa.int32()), "stop": pa.array(stop, pa.int32())})


def with_groups(pieces: DataFrame, group_rows: int) -> tuple[DataFrame, bool]:
    """The stretches with their group (part), by the shortest of their prefixes that few enough stretches share; null if none.  And whether any has none."""
    n_groups = F.lit(max(1, -(-pieces.count() // group_rows)))
    out, left, part, size = pieces, pieces.select(*PREFIX_COLUMNS), F.lit(None).cast("long"), 0
    for c in PREFIX_COLUMNS:
        # Prefixes of over group_rows stretches: at most a group_rows-th as many as there are stretches.
        long = stored(left.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select(c), "long_prefixes")
        size = long.count()
        group = F.pmod(F.xxhash64(c, F.lit(c)), n_groups)
        if not size:
            part = F.coalesce(part, group)
            break
        long = F.broadcast(long) if size <= BROADCAST_PREFIXES else long
        out = out.join(long.select(c, F.lit(True).alias(f"long_{c}")), c, "left")
        part = F.coalesce(part, F.when(F.col(f"long_{c}").isNull(), group))
        left = left.join(long, c, "left_semi")
    return out.withColumn("part", part).drop(*PREFIX_COLUMNS, *(f"long_{c}" for c in PREFIX_COLUMNS)), size > 0


def window_spans(pieces: DataFrame) -> DataFrame:
    """Marked spans of stretches window by window, through the smallest document of each window."""
    listed = F.split("words", " ", -1)
    one = F.transform(F.sequence(F.lit(0), F.size(listed) - WINDOW), lambda i: F.struct((F.col("begin") + i).alias("begin"), F.unhex(F.sha2(F.array_join(F.slice(listed, i + 1, F.lit(WINDOW)), " "), 256)).alias("label")))
    windows = stored(pieces.select("q", "row", "doc_id", F.explode(one).alias("w")).select("q", "row", "doc_id", "w.begin", "w.label"), "windows")
    least = windows.groupBy("label").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return windows.join(least, "label").where("least < doc_id").select("q", "row", "begin", (F.col("begin") + WINDOW).alias("stop"))


def n_blocks(documents: DataFrame, block_bytes: int) -> int:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(size) // block_bytes))


def remaining(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the marked words and the white space after each."""
    keep = np.ones(len(text), bool)
    follow = np.append(starts[1:], len(text))
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts[gone], 1)
    np.add.at(step, follow[gone], -1)
    keep &= np.cumsum(step[:-1]) == 0
    return np.frombuffer(text, np.uint8)[keep].tobytes()


def dedup(documents: DataFrame, block_bytes: int = BLOCK_BYTES, group_rows: int = GROUP_ROWS, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents, all columns, without the repeated words; with ``counts``, two columns n_words and n_removed by those names."""
    n = n_blocks(documents, block_bytes)
    number = F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))), F.xxhash64("text")), F.lit(n)).cast("int")
    blocks = documents.select(number.alias("q"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = blocks.groupBy("q").applyInArrow(block_anchors, "anchor long, seen long")
    # Counts are partial within tasks, so an anchor of very many blocks isn't gathered; the join splits where it is skewed.
    several = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seen") % 2).alias("many")).where("n > 1 or many = 1").select("anchor")
    shared = seen.join(several, "anchor", "left_semi").select(F.shiftright("seen", 1).cast("int").alias("q"), "anchor")
    pieces = stored(blocks.groupBy("q").cogroup(shared.groupBy("q")).applyInArrow(block_pieces, PIECES), "pieces")
    further, hot = with_groups(pieces.where("words is not null"), group_rows)
    spans = further.where("part is not null").groupBy("part").applyInArrow(group_spans, SPANS)
    spans = pieces.where("words is null").select("q", "row", "begin", "stop").union(spans)
    if hot:
        spans = spans.union(window_spans(further.where("part is null").drop("part")))

    names = documents.columns
    extra = [StructField(c, LongType()) for c in counts or ()]
    schema = StructType([StructField("text", StringType()) if c == "text" else documents.schema[c] for c in names] + extra)
    whole = documents.withColumn("text", F.col("text").cast("string")).select(number.alias("q"), F.col("doc_id").cast("long").alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"))

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        rows = table.column("all").combine_chunks()
        order = pc.sort_indices(pa.table({"doc_id": table.column("key"), "text": rows.field("text")}), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        rows = rows.take(order)
        texts = rows.field("text")
        row, begin, stop = (marks.column(c).to_numpy().astype(np.int64) for c in ("row", "begin", "stop"))
        by_row = np.argsort(row, kind="stable")
        at = np.searchsorted(row[by_row], np.arange(len(rows) + 1))
        out, n_words, n_removed = [], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for block in text_blocks(texts, PLAIN_WORDS):
            for i in range(len(block)):
                r = block.first_row + i
                n_words[r] = size = int(block.word_at[i + 1] - block.word_at[i])
                mine = by_row[at[r] : at[r + 1]]
                if not len(mine):
                    out.append(texts[r].as_py())
                    continue
                step = np.zeros(size + 1, np.int64)
                np.add.at(step, begin[mine], 1)
                np.add.at(step, stop[mine], -1)
                gone = np.cumsum(step[:-1]) > 0
                n_removed[r] = int(gone.sum())
                lo, hi = block.text_at[i], block.text_at[i + 1]
                w = slice(block.word_at[i], block.word_at[i + 1])
                out.append(remaining(block.data[lo:hi].tobytes(), block.starts[w] - lo, block.ends[w] - lo, gone).decode())
        columns = [pa.array(out, pa.string()) if c == "text" else rows.field(c) for c in names]
        return pa.table(columns + [pa.array(x) for x in (n_words, n_removed)] if counts else columns, names=[*names, *(counts or ())])

    return whole.groupBy("q").cogroup(spans.groupBy("q")).applyInArrow(cut, schema)


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    kept = dedup(documents.select("doc_id", "text"), counts=("n_words", "n_removed"))
    words = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"))
