"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits; two are linked at a few differing bits.  The anchors
are the words of a covering code: the perfect binary Golay code, 4096 words of
23 bits so that every point is within 3 bits of one.  A fingerprint is cut into
three parts of at most 23 bits.  Fingerprints that differ in at most t bits
differ in at most t // 3 bits in one of the parts, so in that part both are
within 3 + t // 3 bits of the first one's own anchor: every fingerprint is
replicated to all anchors within covering radius plus threshold (5.3 a part
for t up to 5, whatever the data), and only compared there, the anchor's own
fingerprints against all that reach it.

An anchor with more than ``CELL_ROWS`` fingerprints is refined by the anchors
of the two other parts: of these, one has at most t // 2 differing bits.  What
is still larger is cut into blocks that are compared block by block, so no task
holds more, and no link is lost.  Per cell the links found are reduced to a
spanning forest, so a group of n near copies gives less than n rows and not
n * n.

``near_duplicates`` links fingerprints of 4-word shingles at ``MOST_BITS``.
``one_of_each`` finds texts whose sets of 5-word shingles are alike at 0.8 or
more: that is a distance of about 39 bits between fingerprints of ``WIDE`` bits,
too far for any anchors, but such texts have nearly the same words.  So two
independent 64-bit fingerprints of the distinct words bring the candidates
together, and wide fingerprints of the shingles say which are worth a look:
of each cell a spanning forest of the nearest.  The sets themselves, taken
from the whole texts, decide on each of its edges; only those are links.

Cases: null and empty texts, and those of white space, have fingerprint zero
and are linked like any other; texts of fewer words than a shingle are one
shingle; repeated rows are in the same class; a null doc_id is never a
component's id unless all its ids are null; extra columns are ignored; the
empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.components import components
from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import spread_join, stored
from lexstrata.llm.wordspans import PLAIN_WORDS, Block, RollingHash, mix, text_blocks

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: The parts of a fingerprint: (lowest bit, bits).
PARTS = ((0, 22), (22, 21), (43, 21))
CELL_ROWS = 16_384
#: of the near-dedup stage: words in a shingle, bits of its fingerprint and how many may differ.
WIDE_SHINGLE = 5
WIDE = 256
WIDE_BITS = 48
WIDE_LEVELS = 6
#: Texts whose sets of shingles are alike at NUMERATOR / DENOMINATOR or more are near copies.
ALIKE = (4, 5)
#: Candidates differ in at most so many bits in one of the fingerprints of distinct words.
WORD_BITS = 5
_WORDS, _HASH_BITS = RollingHash(0x51A5), 42
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
RADIUS = 3


def single_spaced(block: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with one space between words: bytes, word starts and word ends."""
    data, text_end = block.data.copy(), np.repeat(block.text_at[1:], block.counts())
    gaps = block.ends[block.ends < text_end]
    data[gaps] = 0x20
    keep = PLAIN_WORDS[data]
    keep[gaps] = True
    at = np.cumsum(keep) - 1
    starts = at[block.starts]
    return data[keep].tobytes(), starts, starts + block.ends - block.starts


def fingerprints(block: Block) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' XXH64."""
    counts, out = block.counts(), np.zeros(len(block), np.uint64)
    if not len(block.starts):
        return out
    raw, starts, ends = single_spaced(block)
    n_shingles = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(block)), n_shingles)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    first = block.word_at[text] + nth
    last = np.minimum(first + SHINGLE, block.word_at[text + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    return majority(h, text, nth, len(block))


def majority(h: np.ndarray, text: np.ndarray, nth: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the bits set in over half of its hashes; h in the order of (text, nth)."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    size = np.bincount(text, minlength=n)
    # Bits are counted in four 16-bit lanes of a word, so runs of a text are cut before a lane is full.
    cut = np.flatnonzero(nth % 32768 == 0)
    lanes = np.uint64(0x0001000100010001)
    owner = text[cut]
    for b in range(16):
        sums = np.add.reduceat((h >> np.uint64(b)) & lanes, cut)
        for lane in range(4):
            ones = np.bincount(owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.float64), n)
            out |= (2 * ones > size).astype(np.uint64) << np.uint64(b + 16 * lane)
    return out


def _once(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, nth of its text) of the distinct hashes of each text."""
    key = np.unique(text.astype(np.uint64) << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS))
    owner = (key >> np.uint64(_HASH_BITS)).astype(np.int64)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner, key & np.uint64((1 << _HASH_BITS) - 1), nth


def wide_fingerprints(block: Block) -> np.ndarray:
    """A row for each text: two 64-bit fingerprints of its distinct words, then that of its distinct 5-word shingles in words of 64 bits."""
    n, counts = len(block), block.counts()
    words, text = _WORDS.words(block), block.text_of_word()
    place = np.arange(len(words)) - block.word_at[text]
    shingle, of = [], []
    for k in range(1, WIDE_SHINGLE + 1):
        runs = _WORDS.runs(words, k)
        i = np.flatnonzero((counts[text] - place >= k) if k == WIDE_SHINGLE else (counts[text] == k) & (place == 0))
        shingle.append(mix(runs[i] + np.uint64(k)))
        of.append(text[i])
    out = np.empty((n, 2 + WIDE // 64), np.uint64)
    for column, (owner, h, nth) in ((0, _once(text, words)), (2, _once(np.concatenate(of), np.concatenate(shingle)))):
        for k in range(column, 2 if column == 0 else out.shape[1]):
            out[:, k] = majority(mix(h * np.uint64(2 * k + 1) + np.uint64(k << 50)), owner, nth, n)
    return out


def with_fingerprints(documents: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, the carried columns and fp (the fingerprint as a signed long) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    names = rows.columns[:-1]

    def printed(batches):
        for b in batches:
            found = [fingerprints(block) for block in text_blocks(b.column("text"), PLAIN_WORDS, fold=True)]
            fp = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fp)], names=[*names, "fp"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(tidy(printed), f"{schema}, fp long")


def remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator: the syndrome of 23-bit points."""
    x = x.copy()
    for k in range(22, 10, -1):
        x ^= (x >> k & 1) * (GOLAY << (k - 11))
    return x


@cache
def errors_by_syndrome(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, errors): for each of the 2048 syndromes, the patterns of at most ``reach`` bits that have it, lightest first."""
    patterns = np.array([sum(1 << i for i in c) for w in range(reach + 1) for c in combinations(range(23), w)], np.int64)
    syndrome = remainder(patterns)
    order = np.argsort(syndrome, kind="stable")
    return np.searchsorted(syndrome[order], np.arange(2049)), patterns[order]


def anchors_of(fp: np.ndarray, part: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, own): the anchors within covering radius plus threshold of each fingerprint's part.

    own marks the anchor within the covering radius; a perfect code has just one.
    """
    low, bits = PARTS[part]
    x = ((fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    offsets, errors = errors_by_syndrome(RADIUS + threshold)
    s = remainder(x)
    n = offsets[s + 1] - offsets[s]
    row = np.repeat(np.arange(len(x)), n)
    e = errors[np.repeat(offsets[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return row, (x[row] ^ e) >> 11, np.bitwise_count(e) <= RADIUS


def forest(own: np.ndarray, node: np.ndarray, prints: np.ndarray, most_bits: int, wide: np.ndarray, wide_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links from the rows ``own`` of a cell to its rows.

    Rows are linked at ``most_bits`` or fewer differing bits of their prints,
    if their wide fingerprints (columns of ``wide``, maybe none) differ in at
    most ``wide_bits``.  Links of nearer wide fingerprints come first, in WIDE_LEVELS.
    """
    parent = np.arange(len(node))

    def root(x: int) -> int:
        while (up := int(parent[x])) != x:
            parent[x] = parent[up]
            x = up
        return x

    out, label = [], np.arange(len(node))  # a root once known, to pass over what is joined already
    step = max(1, (1 << 20) // max(1, len(node)))
    levels = [wide_bits * k // WIDE_LEVELS for k in range(1, WIDE_LEVELS + 1)] if len(wide) else [0]
    for nth, bits in enumerate(levels):
        some_near = []
        for at in range(0, len(own), step):
            some = own[at : at + step]
            near = np.bitwise_count(prints[some][:, None] ^ prints[None, :]) <= most_bits
            rows = np.flatnonzero(near.sum(1) > 1)
            some_near.append(some[rows])
            for i in rows.tolist():
                a = int(some[i])
                ra = root(a)
                found = np.flatnonzero(near[i])
                found = found[label[found] != ra]
                if len(found) and len(wide):
                    found = found[np.bitwise_count(wide[:, found] ^ wide[:, a][:, None]).sum(0) <= bits]
                for k in found.tolist():
                    rb = root(k)
                    if rb != ra:
                        parent[rb] = ra
                        out.append((int(node[a]), int(node[k])))
                label[found] = ra
        if not nth:
            own = np.concatenate([own[:0], *some_near])  # the others have no link at any level
    return out


def cells_of(nodes: DataFrame, prints: list[str], carried: list[str], most_bits: int) -> DataFrame:
    """(cell, i, j, own, node, fp, carried): the rows to compare in each cell."""
    names = ["node", *prints, *carried]

    def replicate(batches):
        for b in batches:
            for k, name in enumerate(prints):
                fp = b.column(1 + k).to_numpy(zero_copy_only=False)
                for part in range(len(PARTS)):
                    row, anchor, own = anchors_of(fp, part, most_bits // len(PARTS))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor + 4096 * (len(PARTS) * k + part)), pa.array(own), b.column(0).take(take), pa.array(fp[row]), *(b.column(names.index(c)).take(take) for c in carried)], names=["cell", "own", "node", "fp", *carried])

    schema = "cell long, own boolean, node long, fp long" + "".join(f", {c} long" for c in carried)
    at = nodes.select(*names).mapInArrow(tidy(replicate), schema)
    n_anchors = 4096 * len(PARTS) * len(prints)
    large = at.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell").collect()  # at most n_anchors rows
    one = [F.lit(0).alias("i"), F.lit(0).alias("j"), "own", "node", "fp", *carried]
    if not large:
        return at.select("cell", *one)
    hot = F.broadcast(nodes.sparkSession.createDataFrame([(r["cell"],) for r in large], "cell long"))

    def refine(batches):
        for b in batches:
            cell, own, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "own", "fp"))
            mine = cell // 4096 % len(PARTS)
            for part in range(len(PARTS)):
                here = np.flatnonzero(mine != part)
                row, anchor, owner = anchors_of(fp[here], part, most_bits // (len(PARTS) - 1))
                row = here[row]
                take = pa.array(row)
                fine = n_anchors + (cell[row] * len(PARTS) + part) * 4096 + anchor
                yield pa.RecordBatch.from_arrays([pa.array(fine), pa.array(owner & own[row]), *(b.column(c).take(take) for c in ("node", "fp", *carried))], names=["cell", "own", "node", "fp", *carried])

    fine = at.join(hot, "cell", "left_semi").select("cell", "own", "node", "fp", *carried).mapInArrow(tidy(refine), schema)
    huge = stored(fine.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("n")), "huge_cells")
    rest = at.join(hot, "cell", "left_anti").select("cell", *one).union(fine.join(huge, "cell", "left_anti").select("cell", *one))
    # Own rows of block i meet all of block j.
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    cut = fine.join(huge, "cell").select("cell", "own", "node", "fp", *carried, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    reaching = cut.select("cell", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("own"), "node", "fp", *carried)
    as_own = cut.where("own").select("cell", F.col("block").alias("i"), F.col("other").alias("j"), "own", "node", "fp", *carried)
    return rest.union(reaching).union(as_own)


def links(nodes: DataFrame, prints: list[str], most_bits: int, wide: list[str] = [], wide_bits: int = 0) -> DataFrame:  # noqa: B006
    """Edges (u, v) that join all nodes linked directly or through others.

    nodes: a long ``node`` each, the fingerprints ``prints`` of which one must
    be near, and the words of a wide fingerprint that must be near too.
    """

    def compare(cell: pa.Table) -> pa.Table:
        node, own, fp = (cell.column(c).to_numpy() for c in ("node", "own", "fp"))
        node, at = np.unique(node, return_index=True)
        found: list[tuple[int, int]] = []
        if len(node) > 1 and own.any():
            mine = np.searchsorted(node, np.unique(cell.column("node").to_numpy()[own]))
            words = np.array([cell.column(c).to_numpy()[at] for c in wide]).view(np.uint64)
            found = forest(mine, node, fp[at].view(np.uint64), most_bits, words, wide_bits)
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return cells_of(nodes, prints, wide, most_bits).groupBy("cell", "i", "j").applyInArrow(compare, "u long, v long")


def classes(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, n, component_id): each distinct fingerprint's rows and the smallest doc_id of its class."""
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(links(fps.select(F.col("fp").alias("node"), "fp"), ["fp"], most_bits)).withColumnsRenamed({"node": "fp"})
    members = stored(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    least = stored(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    return stored(spread_join(members, least, "root", "size").select("fp", "n", "component_id"), "classes")


def near_duplicates(documents: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = stored(with_fingerprints(documents), "prints")
    found = spread_join(prints, classes(prints, most_bits), "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("string"), 256))


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of 64 bits) of the distinct 5-word shingles of each text, in this order; a shorter text is one shingle."""
    counts = block.counts()
    words, text = _WORDS.words(block), block.text_of_word()
    place = np.arange(len(words)) - block.word_at[text]
    shingle, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(1, WIDE_SHINGLE + 1):
        runs = _WORDS.runs(words, k)
        i = np.flatnonzero((counts[text] - place >= k) if k == WIDE_SHINGLE else (counts[text] == k) & (place == 0))
        shingle.append(mix(runs[i] + np.uint64(k)))
        of.append(text[i])
    owner, h = np.concatenate(of), np.concatenate(shingle)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))[: len(owner)]
    return owner[new], h[new]


def set_digests(block: Block) -> np.ndarray:
    """Two sums over each text's set of shingles: equal sets have equal ones, others don't but by chance of 2 ** -128."""
    owner, h = shingle_sets(block)
    out = np.zeros((len(block), 2), np.uint64)
    for k in range(2):
        np.add.at(out[:, k], owner, mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)))
    return out


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the sets of shingles of two texts, row by row, are alike at ALIKE or more; two empty sets are."""
    out = []
    for i in range(len(a)):
        two = next(text_blocks(pa.concat_arrays([a.slice(i, 1), b.slice(i, 1)]), PLAIN_WORDS, True, 1 << 62))
        owner, h = shingle_sets(two)
        size = int(np.searchsorted(owner, 1))
        both = len(np.intersect1d(h[:size], h[size:], assume_unique=True))
        out.append(ALIKE[1] * both >= ALIKE[0] * (len(h) - both))
    return np.array(out, bool)


def verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (u, v) between texts (node, text) whose sets are alike."""
    pairs = edges.join(texts.withColumnsRenamed({"node": "u", "text": "a"}), "u").join(texts.withColumnsRenamed({"node": "v", "text": "b"}), "v")

    def check(batches):
        for batch in batches:
            keep = pa.array(alike(batch.column("a"), batch.column("b")))
            yield batch.select(["u", "v"]).filter(keep)

    return pairs.select("u", "v", "a", "b").mapInArrow(tidy(check), "u long, v long")


def with_wide_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, a, b (fingerprints of the words), s0.. (the wide fingerprint) and t0, t1 (the set's digest) of every row."""
    names = ["a", "b", *(f"s{k}" for k in range(WIDE // 64)), "t0", "t1"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))

    def printed(batches):
        for b in batches:
            found = [np.hstack([wide_fingerprints(block), set_digests(block)]) for block in text_blocks(b.column("text"), PLAIN_WORDS, fold=True)]
            fp = np.concatenate([np.zeros((0, len(names)), np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(len(names)))], names=["doc_id", "text_key", *names])

    return rows.mapInArrow(tidy(printed), "doc_id long, text_key binary" + "".join(f", {c} long" for c in names))


def one_of_each(documents: DataFrame, word_bits: int = WORD_BITS, wide_bits: int = WIDE_BITS) -> DataFrame:
    """The documents' rows, all columns, with one row of each class of texts alike at 0.8 or more: the smallest doc_id's.

    Ids may be null or stand for several texts, so the row that stays is found
    by its id and its text's hash; of rows that share both, the one whose columns
    as JSON sort first.
    """
    prints = with_wide_fingerprints(documents)
    wide = [c for c in prints.columns if c[0] == "s"]
    sets = [*wide, "t0", "t1"]
    rows = prints.groupBy(*sets, "doc_id", "text_key").agg(F.min(F.struct("a", "b")).alias("words"), F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "n")
    # Numbers are given to a table that is then written once, so they stay what they are.
    nodes = stored(rows.groupBy(*sets).agg(F.min(first).alias("first"), F.min("words").alias("words")).select(F.monotonically_increasing_id().alias("node"), "words.a", "words.b", *wide, "first"), "nodes")
    edges = stored(links(nodes, ["a", "b"], word_bits, wide, wide_bits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    looked = nodes.join(ends, "node", "left_semi").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key"))
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    found = hashed.join(looked, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    texts = stored(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    roots = components(verified(edges, texts))
    members = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = stored(members.agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key", "first.n"), "kept")
    same = documents["doc_id"].eqNullSafe(kept["doc_id"]) & text_key(documents["text"]).eqNullSafe(kept["text_key"])
    # A sort-merge join at every size: a plan that changes with the input hides how it grows.
    once = documents.join(kept.where("n = 1").hint("merge"), same, "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    repeated = documents.join(kept.where("n > 1"), same, "left_semi").groupBy(F.col("doc_id").alias("of_id"), text_key(F.col("text")).alias("of_key"))
    return once.union(repeated.agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*"))
