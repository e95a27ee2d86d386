"""A stored search index: where each token and stem stands in each record.

A posting is a row per (form, token, record, column) with the positions, and the
lengths that ranks need beside them (``posted``, ``build``).  Ranks are those of
``search``: they use the row alone.

A large index is stored packed (``packed``): one row for each token and PACKED_BLOCK
consecutive ordinals of a package holds all its postings, and a row of the kind
``record`` what the block's records are called and how long they are, once and not
once a posting.  A token's row names its stem, too, so both forms read the same
rows.  They are ordered by stem and token within runs of RUN_TOKENS tokens, so the
statistics of Parquet's pages leave out the rest; they aren't moved for that, so each
file has the tokens of its records.  ``unpacked`` gives the postings back: a search unpacks the rows of its
tokens and joins them with their records.

``blocks`` has, for each token and each block, the most that the columns of the
token can add to a score.  The best records of a query are looked for in the
blocks that promise most; the k-th best score found there says which other blocks
could hold a better one, and only their rows are read (``pruned``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import Phrase, Query, parse, porter, tokens
from lexstrata.operators.search import all_of, in_scope

COLUMNS = ("clause_reference", "heading", "text")
POSTINGS = "form string, token string, package_digest string, record_id string, clause_reference string, ordinal long, heading_chars int, text_chars int, place byte, n_hits int, positions array<int>, gain double"
PACKED = "kind string, stem string, token string, package_digest string, block long, gain double, ordinals array<int>, places array<tinyint>, ends array<int>, positions array<int>, record_ids array<string>, clause_references array<string>, heading_chars array<int>, text_chars array<int>"
BLOCKS = "form string, token string, package_digest string, block long, gain double"
CARRIED = ("package_digest", "record_id", "clause_reference", "ordinal", "heading_chars", "text_chars")
#: What an occurrence in a column adds to a score, before the row's length divides it.
WEIGHTS = (0.25, 2.0, 1.0)
#: Ordinals in a block, and rows of the sample that the index's ranges are taken from.
BLOCK = 64
SAMPLE_ROWS = 20_000
#: Ordinals in a block of a packed index; postings stored in a row each, as in stores, keep blocks of BLOCK.
PACKED_BLOCK = 1024
#: Tokens that a task packs at once, and rows that it hands on at once.
RUN_TOKENS, RUN_ROWS = 1 << 19, 1 << 15
#: Blocks that a search begins with, blocks that the driver may hold, and ranges of ordinals that a scan is told.
FIRST_BLOCKS, MOST_BLOCKS, MOST_RANGES = 32, 2048, 48


def _listed(records: DataFrame) -> DataFrame:
    """Records with their lengths and the tokens of each column."""
    sizes = [F.coalesce(F.char_length(c), F.lit(0)).alias(f"{c}_chars") for c in ("heading", "text")]
    listed = [F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"{c}_tokens") for c in COLUMNS]
    return records.select("package_digest", "record_id", "clause_reference", F.col("ordinal").cast("long").alias("ordinal"), *sizes, *listed)


def posted(records: DataFrame, bounds: list[str] | None = None) -> DataFrame:
    """The postings of records, in no order; with bounds also the range of the index that each belongs to.

    A token that reaches over several ranges is dealt to them by blocks of ordinals.
    """
    rows = _listed(records)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            size = 1.0 + b.column("heading_chars").to_numpy() / 200.0 + b.column("text_chars").to_numpy() / 1000.0
            ordinal = b.column("ordinal").to_numpy()
            for place, c in enumerate(COLUMNS):
                column = b.column(f"{c}_tokens")
                n_tokens = np.diff(column.offsets.to_numpy())
                words = column.flatten().dictionary_encode()
                if not len(words):
                    continue
                row = np.repeat(np.arange(len(n_tokens)), n_tokens)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                names = words.dictionary.to_pylist()
                forms = [("word", names, code)]
                if place:  # clause references aren't stemmed
                    stems = pa.array([known.get(w) or known.setdefault(w, porter(w)) for w in names]).dictionary_encode()
                    forms.append(("stem", stems.dictionary.to_pylist(), stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]))
                for form, listed_names, codes in forms:
                    order = np.lexsort((at, codes, row))
                    first = np.flatnonzero(np.append(True, (row[order][1:] != row[order][:-1]) | (codes[order][1:] != codes[order][:-1])))
                    ends = np.append(first, len(order))
                    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
                    mine, word = row[order][first], codes[order][first]
                    take, n = pa.array(mine), len(first)
                    gain = WEIGHTS[place] * np.diff(ends) / size[mine]
                    arrays = [pa.array([form] * n), pa.array(listed_names).take(pa.array(word)), *(b.column(x).take(take) for x in CARRIED), pa.array(np.full(n, place, np.int8)), pa.array(np.diff(ends).astype(np.int32)), positions, pa.array(gain)]
                    if bounds is not None:
                        keys = [f"{form} {w}" for w in listed_names]
                        low = np.array([bisect_left(bounds, k) for k in keys])
                        wide = np.array([bisect_right(bounds, k) for k in keys]) - low + 1
                        arrays.append(pa.array((low[word] + ordinal[mine] // BLOCK % wide[word]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(arrays, names=names_out)

    names_out = [f.split()[0] for f in POSTINGS.split(", ")] + (["range"] if bounds is not None else [])
    return rows.mapInArrow(post, POSTINGS + (", range int" if bounds is not None else ""))


def build(records: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """The postings of records, in the order of the index, in one pass over them.

    The index's ranges are taken from at most SAMPLE_ROWS postings of a sample of
    records (all of them where none is given).
    """
    sample = records if sample is None else sample
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = posted(sample).select(F.concat_ws(" ", "form", "token").alias("key")).orderBy(F.rand(7)).limit(SAMPLE_ROWS).collect()
    keys = sorted(r["key"] for r in few)
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    ranged = posted(records, bounds).repartitionById(len(bounds) + 1, F.col("range"))
    return ranged.sortWithinPartitions("form", "token", "package_digest", "ordinal").drop("range")


def packed(records: DataFrame) -> DataFrame:
    """The postings of records, packed by token and block, and the records by block; (package, ordinal) is a record's key.

    One pass over the records, without an exchange or a sort of Spark's.  Records
    in the order of package and ordinal give the fewest rows; a block that comes in
    parts has a row for each.
    """
    block_size = PACKED_BLOCK
    numbers, texts = pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = [pa.string()] * 4 + [pa.int64(), pa.float64(), numbers, pa.list_(pa.int8()), numbers, numbers, texts, texts, numbers, numbers]
    schema = pa.schema([pa.field(f.split()[0], kind) for f, kind in zip(PACKED.split(", "), kinds, strict=True)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            run.append(b)
            held += sum(len(b.column(f"{c}_tokens").flatten()) for c in COLUMNS)
            if held >= RUN_TOKENS:
                yield from packed_run(run)
                run, held = [], 0
                pa.default_memory_pool().release_unused()
        yield from packed_run(run)

    def packed_run(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in run)
        if not n:
            return
        b = pa.Table.from_batches(run).combine_chunks().to_batches()[0]
        run.clear()
        ordinal, package = b.column("ordinal").to_numpy(), b.column("package_digest").dictionary_encode().indices.to_numpy()
        by = np.lexsort((ordinal, package))
        b, ordinal, package = b.take(pa.array(by)), ordinal[by], package[by]
        starts = np.flatnonzero(np.append(True, (package[1:] != package[:-1]) | (ordinal[1:] // block_size != ordinal[:-1] // block_size)))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        size = 1.0 + b.column("heading_chars").to_numpy() / 200.0 + b.column("text_chars").to_numpy() / 1000.0
        within = (ordinal % block_size).astype(np.int32)

        def rows(kind: str, first: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
            plain = {"kind": pa.array([kind] * len(first)), "package_digest": b.column("package_digest").take(pa.array(first)), "block": pa.array(ordinal[first] // block_size), **columns}
            whole = pa.RecordBatch.from_arrays([plain.get(f.name, pa.nulls(len(first), f.type)) for f in schema], schema=schema)
            return (whole.slice(i, RUN_ROWS) for i in range(0, len(first), RUN_ROWS))

        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        called = {"record_ids": "record_id", "clause_references": "clause_reference", "heading_chars": "heading_chars", "text_chars": "text_chars"}
        blocks_end = np.append(starts, n)
        yield from rows("record", starts, ordinals=listed(blocks_end, pa.array(within)), **{to: listed(blocks_end, b.column(c)) for to, c in called.items()})

        lists = [b.column(f"{c}_tokens") for c in COLUMNS]
        counts = [np.diff(x.offsets.to_numpy()) for x in lists]
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        if not len(words):
            return
        names = words.dictionary.to_pylist()
        order = sorted((porter(w), w, i) for i, w in enumerate(names))
        rank = np.empty(len(names), np.int64)
        rank[[i for _, _, i in order]] = np.arange(len(names))
        # Occurrences by column, record and position; a stable sort by token, record and column keeps the positions' order.
        record = np.concatenate([np.repeat(np.arange(n), k) for k in counts])
        at = np.concatenate([np.arange(k.sum(), dtype=np.int32) - np.repeat((np.cumsum(k) - k).astype(np.int32), k) for k in counts])
        key = (rank[words.indices.to_numpy()] * n + record) * 3 + np.repeat(np.arange(3), [k.sum() for k in counts])
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        hits = np.diff(np.append(first, len(key)))
        places, record, token = key[first] % 3, key[first] // 3 % n, key[first] // (3 * n)
        heads = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (group[record[1:]] != group[record[:-1]])))
        gain = np.array(WEIGHTS)[places] * hits / size[record]
        most = sum(np.maximum.reduceat(np.where(places == p, gain, 0.0), heads) for p in range(3))
        postings_end, positions_end = np.append(heads, len(first)), np.append(first[heads], len(key))
        ends = np.append(first, len(key))[1:] - np.repeat(first[heads], np.diff(postings_end))
        mine = pa.array(token[heads])
        columns = {"ordinals": listed(postings_end, pa.array(within[record])), "places": listed(postings_end, pa.array(places.astype(np.int8))), "ends": listed(postings_end, pa.array(ends.astype(np.int32))), "positions": listed(positions_end, pa.array(at))}
        yield from rows("posting", record[heads], stem=pa.array([x for x, _, _ in order]).take(mine), token=pa.array([x for _, x, _ in order]).take(mine), gain=pa.array(_rounded_up(most)), **columns)

    return _listed(records).mapInArrow(pack, PACKED)


def _rounded_up(gain: np.ndarray) -> np.ndarray:
    """The next of 8 values in each power of two: a promise may be too high, and few values take little space."""
    return np.exp2(np.ceil(np.log2(gain) * 8 + 1e-6) / 8)


def _forms(index: DataFrame) -> DataFrame:
    """The rows of tokens once by word and once by stem; a filter on the form leaves one of them."""
    rows = index.where("kind = 'posting'")
    stems = rows.withColumn("token", F.col("stem")).withColumn("form", F.lit("stem"))
    return rows.withColumn("form", F.lit("word")).union(stems)


def unpacked(index: DataFrame) -> DataFrame:
    """The postings of a packed index, each with its block; filters on form, token, package and block reach the stored rows.

    A stem has a row for each of its words here.
    """
    whole = F.col("block") * PACKED_BLOCK + F.col("ordinals")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    posting = lambda x, i: F.struct(x["ordinals"].alias("ordinals"), x["places"].alias("places"), F.slice("positions", begin(i) + 1, x["ends"] - begin(i)).alias("positions"))
    hits = _forms(index).select("form", "token", "package_digest", "block", F.inline(F.transform(F.arrays_zip("ordinals", "places", "ends"), posting)))
    hits = hits.where("form = 'word' or places > 0")  # clause references aren't stemmed
    hits = hits.select("form", "token", "package_digest", "block", whole.alias("ordinal"), F.col("places").alias("place"), F.size("positions").alias("n_hits"), "positions")
    named = index.where("kind = 'record'").select("package_digest", "block", F.inline(F.arrays_zip("ordinals", "record_ids", "clause_references", "heading_chars", "text_chars")))
    named = named.select("package_digest", "block", whole.alias("ordinal"), F.col("record_ids").alias("record_id"), F.col("clause_references").alias("clause_reference"), "heading_chars", "text_chars")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), F.col("place") + 1)
    gain = weight * F.col("n_hits") / (1.0 + F.col("heading_chars") / 200.0 + F.col("text_chars") / 1000.0)
    return hits.join(named, ["package_digest", "block", "ordinal"]).select(*(f.split()[0] for f in POSTINGS.split(", ")[:-1]), gain.alias("gain"), "block")


def promises(index: DataFrame) -> DataFrame:
    """BLOCKS of a packed index, without unpacking it; rounded up, and for a stem a row for each of its words."""
    return _forms(index).select(*(f.split()[0] for f in BLOCKS.split(", ")))


def blocks(postings: DataFrame) -> DataFrame:
    """BLOCKS of stored postings: the largest gain of each column in a block, added up over the columns."""
    most = postings.groupBy("form", "token", "package_digest", F.expr(f"ordinal div {BLOCK}").alias("block"), "place").agg(F.max("gain").alias("gain"))
    return most.groupBy("form", "token", "package_digest", "block").agg(F.sum("gain").alias("gain"))


def _positions(token: str, prefix: bool, place: int) -> Column:
    here = lambda h: (h["place"] == place) & (h["token"].startswith(token) if prefix else h["token"] == token)
    return F.flatten(F.transform(F.filter("hits", here), lambda h: h["positions"]))


def _starts(phrase: Phrase, place: int) -> Column:
    """Where a phrase starts in a column, from the positions of its tokens."""
    last = len(phrase.tokens) - 1
    out = _positions(phrase.tokens[0], phrase.prefix and last == 0, place)
    for k in range(1, last + 1):
        out = _followed(out, _positions(phrase.tokens[k], phrase.prefix and k == last, place), k)
    return out


def _followed(starts: Column, positions: Column, distance: int) -> Column:
    return F.filter(starts, lambda i: F.array_contains(positions, i + distance))


def _spans(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("b"), (i + n).alias("e")))


def _instances(phrases: list[Phrase], place: int) -> Column:
    """How many stretches the phrases mark; overlapping ones count once."""
    if all(len(p.tokens) == 1 for p in phrases):
        return F.size(F.array_distinct(F.flatten(F.array(*(_starts(p, place) for p in phrases)))))
    spans = [_spans(_starts(p, place), len(p.tokens)) for p in phrases]
    begin = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("e"))
    step = lambda acc, s: F.struct((acc["n"] + F.when(s["b"] >= acc["e"], 1).otherwise(0)).alias("n"), F.greatest(acc["e"], s["e"]).alias("e"))
    return F.aggregate(F.array_sort(F.flatten(F.array(*spans))), begin, step, lambda acc: acc["n"])


def _wanted(query: Query) -> Column:
    """The rows of the query's tokens."""
    exact = sorted({t for p in query.phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    wanted = F.col("token").isin(exact) if exact else F.lit(False)
    for begin in sorted({p.tokens[-1] for p in query.phrases if p.prefix}):
        wanted = wanted | F.col("token").startswith(begin)
    return (F.col("form") == ("stem" if query.stemmed else "word")) & wanted


def _record_key(rows: DataFrame) -> list[str]:
    """What a record's postings share; those of a packed index are dealt by block, too."""
    return [*CARRIED, *(["block"] if "block" in rows.columns else [])]


def ranked(postings: DataFrame, packages: DataFrame, query: Query, limit: int | None = 20, package_digest: str | None = None, scope: str | None = None) -> DataFrame:
    """The best records: package_digest, record_id, clause_reference, ordinal and score."""
    rows = postings.where(_wanted(query))
    if package_digest is not None:
        rows = rows.where(F.col("package_digest") == package_digest)
    if scope is not None:
        rows = rows.where(in_scope(F.col("clause_reference"), scope))
    rows = rows.join(packages.select("package_digest"), "package_digest", "left_semi")
    if all(len(p.tokens) == 1 and not p.prefix for p in query.phrases):
        return _best(_ranked_words(rows, query), limit)
    # A record has at most one row per token of the query and column.
    rows = rows.groupBy(*_record_key(rows)).agg(F.collect_list(F.struct("place", "token", "positions")).alias("hits"))
    places = range(1, 3) if query.stemmed else range(3)
    has = lambda group: all_of([F.size(_starts(p, place)) > 0 for p in group for place in places], False)
    rows = rows.where(all_of([has(g) for g in query.groups], query.every))
    size = 1.0 + F.col("heading_chars") / 200.0 + F.col("text_chars") / 1000.0
    hits = lambda place: _instances(query.phrases, place)
    rank = -((F.lit(0.0) if query.stemmed else WEIGHTS[0] * hits(0)) + WEIGHTS[1] * hits(1) + hits(2)) / size
    if query.concepts:
        rank = -100.0 * sum((has(g).cast("int") for g in query.groups), F.lit(0)) + F.greatest(F.lit(-9.0), rank)
    return _best(rows.withColumn("score", F.round(rank, 6)), limit)


def _best(rows: DataFrame, limit: int | None) -> DataFrame:
    rows = rows.select("package_digest", "record_id", "clause_reference", "ordinal", "score")
    return rows if limit is None else rows.orderBy("score", "package_digest", "ordinal").limit(limit)


def _ranked_words(rows: DataFrame, query: Query) -> DataFrame:
    """Scores of records for phrases of one token each: sums of counts, without positions."""
    names = {t: f"has{i}" for i, t in enumerate(sorted({p.tokens[0] for p in query.phrases}))}
    counts = [F.sum(F.when(F.col("place") == place, F.col("n_hits")).otherwise(0)).alias(f"hits{place}") for place in range(3)]
    rows = rows.groupBy(*_record_key(rows)).agg(*counts, *(F.bool_or(F.col("token") == t).alias(c) for t, c in names.items()))
    has = lambda group: reduce(lambda x, y: x | y, [F.col(names[p.tokens[0]]) for p in group])
    size = 1.0 + F.col("heading_chars") / 200.0 + F.col("text_chars") / 1000.0
    rank = -((F.lit(0.0) if query.stemmed else WEIGHTS[0] * F.col("hits0")) + WEIGHTS[1] * F.col("hits1") + F.col("hits2")) / size
    if query.concepts:
        rank = -100.0 * sum((has(g).cast("int") for g in query.groups), F.lit(0)) + F.greatest(F.lit(-9.0), rank)
    return rows.where(all_of([has(g) for g in query.groups], query.every)).withColumn("score", F.round(rank, 6))


def promised(blocks: DataFrame, packages: DataFrame, query: Query, package_digest: str | None = None) -> DataFrame:
    """package_digest, block and the most that the score of a record in it can be, of blocks that may hold a match."""
    rows = blocks.where(_wanted(query))
    if package_digest is not None:
        rows = rows.where(F.col("package_digest") == package_digest)
    rows = rows.join(packages.select("package_digest"), "package_digest", "left_semi")
    names = {t: f"t{i}" for i, t in enumerate(sorted({t for p in query.phrases for t in p.tokens}))}
    rows = rows.groupBy("package_digest", "block").agg(*(F.sum(F.when(F.col("token") == t, F.col("gain")).otherwise(0.0)).alias(c) for t, c in names.items()))
    # A phrase occurs at most as often as the rarest of its tokens.
    most = {p: F.least(*(F.col(names[t]) for t in p.tokens)) if len(p.tokens) > 1 else F.col(names[p.tokens[0]]) for p in query.phrases}
    there = [reduce(lambda x, y: x | y, [most[p] > 0 for p in g]) for g in query.groups]
    bound = reduce(lambda x, y: x + y, most.values())
    if query.concepts:
        bound = 100.0 * reduce(lambda x, y: x + y, [x.cast("int") for x in there]) + F.least(F.lit(9.0), bound)
    return rows.where(all_of(there, query.every)).select("package_digest", "block", bound.alias("bound"))


def _in_blocks(chosen: list[tuple[str, int]], postings: DataFrame) -> DataFrame:
    """The postings of these blocks; runs of blocks are said to the scan, so it can pass over the rest."""
    runs: list[list] = []
    for package, block in sorted(chosen):
        if runs and runs[-1][0] == package and block <= runs[-1][2]:
            runs[-1][2] = block + 1
        else:
            runs.append([package, block, block + 1])
    packages, numbers = sorted({p for p, _ in chosen}), sorted({b for _, b in chosen})
    stored = "block" in postings.columns  # a packed index; conditions on one column each reach its postings and its records
    rows = postings.where(F.col("package_digest").isin(packages) & F.col("block").isin(numbers)) if stored else postings
    if len(runs) <= MOST_RANGES:
        within = lambda a, b: F.col("block").between(a, b - 1) if stored else F.col("ordinal").between(a * BLOCK, b * BLOCK - 1)
        return rows.where(reduce(lambda x, y: x | y, [(F.col("package_digest") == p) & within(a, b) for p, a, b in runs]))
    few = postings.sparkSession.createDataFrame(chosen, "package_digest string, block long")  # at most MOST_BLOCKS rows
    if stored:
        return rows.join(F.broadcast(few), ["package_digest", "block"], "left_semi")
    rows = rows.where(F.col("package_digest").isin(packages) & F.col("ordinal").between(numbers[0] * BLOCK, (numbers[-1] + 1) * BLOCK - 1))
    return rows.withColumn("block", F.expr(f"ordinal div {BLOCK}")).join(F.broadcast(few), ["package_digest", "block"], "left_semi").drop("block")


def pruned(postings: DataFrame, blocks: DataFrame, packages: DataFrame, query: Query, limit: int = 20, package_digest: str | None = None, scope: str | None = None) -> DataFrame:
    """What ``ranked`` gives, reading only blocks that can hold one of the best.

    A query with the beginning of a token isn't pruned: which tokens it has isn't known beforehand.
    """
    plain = lambda rows: ranked(rows, packages, query, limit, package_digest, scope)
    if any(p.prefix for p in query.phrases):
        return plain(postings)
    bounds = promised(blocks, packages, query, package_digest)
    best = bounds.orderBy(F.desc("bound"), "package_digest", "block").limit(MOST_BLOCKS).collect()
    spark, schema = postings.sparkSession, "package_digest string, record_id string, clause_reference string, ordinal long, score double"
    if not best:
        return spark.createDataFrame([], schema)
    first = best[:FIRST_BLOCKS]
    found = plain(_in_blocks([(r["package_digest"], r["block"]) for r in first], postings)).collect()
    # Scores are rounded, so a block that promises as much but for rounding may hold an equal one.
    least = -found[-1]["score"] - 1e-6 if len(found) == limit else 0.0
    more = [r for r in best[FIRST_BLOCKS:] if r["bound"] >= least]
    known = spark.createDataFrame(found, schema)
    if not more:
        return known
    if len(best) == MOST_BLOCKS and best[-1]["bound"] >= least:  # there may be others than those of the driver
        seen = spark.createDataFrame([(r["package_digest"], r["block"]) for r in first], "package_digest string, block long")
        others = bounds.where(F.col("bound") >= least).join(F.broadcast(seen), ["package_digest", "block"], "left_anti")
        rows = postings.where(_wanted(query))
        rows = (rows if "block" in rows.columns else rows.withColumn("block", F.expr(f"ordinal div {BLOCK}"))).join(others, ["package_digest", "block"], "left_semi")
    else:
        rows = _in_blocks([(r["package_digest"], r["block"]) for r in more], postings)
    return known.union(plain(rows)).orderBy("score", "package_digest", "ordinal").limit(limit)


#: How a search ranks: (packages, query, limit, package_digest, scope) to the best records.
Ranker = Callable[..., DataFrame]


def _ranker(postings: DataFrame, blocks: DataFrame | None) -> Ranker:
    if blocks is None:
        return lambda *how: ranked(postings, *how)
    return lambda *how: pruned(postings, blocks, *how)


def search(postings: DataFrame, packages: DataFrame, text: str, mode: str = "all_terms", limit: int = 20, package_digest: str | None = None, scope: str | None = None, blocks: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(hits, relaxed), as ``search.search`` gives them; with blocks, by ``pruned``."""
    strict, rank = parse(text, mode), _ranker(postings, blocks)
    found = rank(packages, strict, limit, package_digest, scope)
    if mode in ("natural_language", "concept_language") and len(strict.groups) > 1 and found.isEmpty():
        return rank(packages, parse(text, mode, relaxed=True), limit, package_digest, scope), True
    return found, False


def many(postings: DataFrame, packages: DataFrame, queries: dict[str, Query], limit: int = 20, blocks: DataFrame | None = None) -> DataFrame:
    """The best records of several queries: query, place and what ``ranked`` gives."""
    out, rank = None, _ranker(postings, blocks)
    for name, query in queries.items():
        found = rank(packages, query, limit)
        mine = found.agg(F.array_sort(F.collect_list(F.struct("score", "package_digest", "ordinal", "record_id"))).alias("best"))  # at most `limit` rows
        mine = mine.select(F.lit(name).alias("query"), F.posexplode("best").alias("place", "r")).select("query", (F.col("place") + 1).alias("place"), "r.*")
        out = mine if out is None else out.union(mine)
    return out


def with_text(hits: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """The hits (at most ``most``) with their records' heading and text."""
    few = hits.limit(most)
    return records.select("package_digest", "record_id", "heading", "text").join(F.broadcast(few), ["package_digest", "record_id"])
