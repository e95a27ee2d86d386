"""A Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups' roots.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests as hex
text.  A leaf is H of the row's columns, each ``-`` if null, else its UTF-8
byte count, ``:`` and the value.  While a run has several nodes, every two
consecutive ones become their H, an odd last one the H of itself.  What remains
is the group's subroot; subroots, ordered by group (null first, then by their
UTF-8 bytes), become the root in the same way.

Blocks of BLOCK consecutive leaves are reduced on the executors, and so are
blocks of the nodes above for as long as more than TOP_NODES are left.  The
driver builds the tree over these, whatever the input at most TOP_NODES, and
broadcasts the path that each has to the root.  A row's proof is its path within
its block, stored with it, and that path; the fold from leaf to root is an
expression of the row alone.

A path lists the siblings from the leaf up: ``<`` and a digest that stands left,
``>`` and one that stands right, empty where a node is alone.

Cases: leaves ascend by id, nulls first, and rows that share an id by their
leaves; rows equal in all columns have equal leaves at consecutive places and
are interchangeable.  A null group is a group.  Empty texts are ``0:``.  A lone
leaf is its group's subroot, a lone group's subroot the root; a path may be
empty.  The empty table has no rows, hence no root.  Columns that aren't named
are ignored, whatever their names.  More groups than TOP_NODES are leaves of a
distributed tree themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.shared import stored

#: Leaves, or nodes, that one task reduces at a time; a power of two.
BLOCK = 1 << 10
#: Nodes that the driver may hold, and whose paths are broadcast.
TOP_NODES = 1 << 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATHS = "grp string, idx long, path array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it stands in a leaf's input."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf has with these siblings."""

    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.sha2(F.when(sibling.startswith("<"), F.concat(other, node)).when(sibling.startswith(">"), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(path, start, step)


def proof_digest(path: Column) -> Column:
    """H of the siblings of a path."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.substring(s, 2, 64))), 256)


def climb(nodes: list[str], levels: int | None = None) -> tuple[str, list[list[str]]]:
    """The node above these, and for each level the path entry of each of its nodes.

    All levels that several nodes need, or the given number of them, as a block
    has them that isn't its group's only one.
    """
    entries: list[list[str]] = []
    while len(nodes) > 1 if levels is None else len(entries) < levels:
        pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        entries.append([e for p in pairs for e in ([">" + p[1], "<" + p[0]] if len(p) == 2 else [""])])
        nodes = [digest(*p) for p in pairs]
    return nodes[0], entries


def block_reducer(size: int) -> Callable[[pa.Table], pa.Table]:
    """For the nodes of a block: ``path`` within it and its ``top``."""

    def reduced(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        only = block["n"][0].as_py() <= size
        top, entries = climb(block["node"].to_pylist(), None if only else size.bit_length() - 1)
        m, levels = block.num_rows, len(entries)
        flat = pa.array([e[i >> k] for i in range(m) for k, e in enumerate(entries)], pa.string())
        paths = pa.ListArray.from_arrays(pa.array(range(0, (m + 1) * levels, levels) if levels else [0] * (m + 1), pa.int32()), flat)
        return block.append_column("path", paths).append_column("top", pa.array([top] * m))

    return reduced


def top_paths(rows: Iterable[tuple[str | None, int, str]]) -> list[tuple]:
    """The rest of the way for (group, index, node): group, index, path, subroot, root."""
    groups: dict[str | None, list[str]] = {}
    for group, _, node in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        groups.setdefault(group, []).append(node)
    if not groups:
        return []
    trees = [climb(nodes) for nodes in groups.values()]
    root, above = climb([subroot for subroot, _ in trees])
    return [
        (group, i, [e[i >> k] for k, e in enumerate(entries)] + [e[g >> k] for k, e in enumerate(above)], subroot, root)
        for g, (group, (subroot, entries)) in enumerate(zip(groups, trees, strict=True))
        for i in range(len(groups[group]))
    ]


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each row of a stored table with its place ``idx`` in its ``grp`` and the group's ``n``.

    Ranges of (grp, order) are sorted apart, so a large group is sorted by many
    tasks; a place is the count of the ranges before plus that within the range.
    """
    by = ["grp", *order]
    ranges = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "ranges")
    counts = ranges.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count("*").alias("c"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("grp").alias("of"), F.col("part").alias("range"), "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(group).alias("n"))
    placed = ranges.join(counts, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range")))
    return placed.select(*rows.columns, (F.col("before") + F.col("seq") - F.col("first")).alias("idx"), "n")


def _proved(nodes: DataFrame, block: int, top_nodes: int) -> DataFrame:
    """Nodes (grp, idx, n, node and others) with their whole ``path``, ``subroot`` and ``root``."""
    keyed = nodes.withColumn("block", F.expr(f"idx div {block}"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    low = stored(keyed.groupBy("grp", "block").applyInArrow(block_reducer(block), f"{kinds}, path array<string>, top string"), "blocks")
    heads = low.where(F.col("idx") % block == 0)
    high = heads.select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / block).alias("n"), F.col("top").alias("node"))
    above = _above(high, block, top_nodes)
    above = above.select(F.col("grp").alias("of"), F.col("idx").alias("at"), F.col("path").alias("rest"), "subroot", "root")
    joined = low.join(above, F.col("grp").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    return joined.withColumn("path", F.concat("path", "rest")).drop("of", "at", "rest", "block", "top")


def _above(nodes: DataFrame, block: int, top_nodes: int) -> DataFrame:
    """PATHS of these nodes: by the driver if they are few, else by blocks of them."""
    count, widest = nodes.agg(F.count("*"), F.max("n")).first()
    if count <= top_nodes:
        rows = top_paths((r.grp, r.idx, r.node) for r in nodes.select("grp", "idx", "node").collect())
        return F.broadcast(nodes.sparkSession.createDataFrame(rows, PATHS))
    if widest == 1:  # a node is a subroot: one tree of them
        one = numbered(stored(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("group"), "node"), "subroots"), ["group"])
        proved = _proved(one, block, top_nodes)
        return proved.select(F.col("group").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot"), "root")
    proved = _proved(nodes, block, top_nodes)
    return proved.select("grp", "idx", "path", "subroot", "root")


def manifest(rows: DataFrame, id_column: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS, also: dict[str, Column] | None = None, block: int = BLOCK, top_nodes: int = TOP_NODES) -> DataFrame:
    """Each row's id, grp (its group), leaf, path, subroot and root, and what ``also`` names."""
    also = also or {}
    leaves = rows.select(F.col(id_column).alias("id"), F.col(group).cast("string").alias("grp"), leaf(F.col(c) for c in columns).alias("node"), *(c.alias(name) for name, c in also.items()))
    # Rows that are equal throughout are dealt out by their place in the stored table.
    leaves = stored(leaves.withColumn("place", F.monotonically_increasing_id()), "leaves")
    proved = _proved(numbered(leaves, ["id", "node", "place"]), block, top_nodes)
    return proved.select("id", "grp", F.col("node").alias("leaf"), *also, "path", "subroot", "root")


def tampered_leaf() -> Column:
    """The leaf with 1 added to n_chars where 7 divides the CRC-32 of the decimal doc_id, else null."""
    values = {c: F.col(c) for c in COLUMNS}
    values["n_chars"] = F.col("n_chars").cast("decimal(20,0)") + 1
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(values.values()))


def digest_rows(docs: DataFrame, block: int = BLOCK, top_nodes: int = TOP_NODES) -> DataFrame:
    """The manifest of documents with a proof that is folded from leaves of which some are tampered with."""
    rows = manifest(docs, also={"tampered": tampered_leaf()}, block=block, top_nodes=top_nodes)
    fold = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
