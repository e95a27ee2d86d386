"""Closures, ancestry, cycles, navigation and impact paths over edge DataFrames.

Walks are frontier loops: each level joins the frontier with the edges and
drops what was seen by an anti join.  Keys are record ids within packages, so
both sides of a level are hashed alike; every few levels the state is written
to the cluster's checkpoint folder, which keeps plans short and survives lost
executors.  No walk has a bound: each ends when it meets nothing new.

Parent chains are followed by pointer doubling: a chain of n records takes
log2(n) rounds, and one that hasn't ended after more steps than there are
records runs into a cycle.  Closures of all roots at once (``reaches``) are kept
as sets of numbers in chunks of CHUNK_BITS bits, not as a row for each root and record.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.errors import error
from lexstrata.sources.folder import shared_folder

EVERY = 3
#: Records whose numbers agree but for so many low bits share a chunk of a set.
CHUNK_BITS = 16
#: Members of cycles that an error names.
NAMED = 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(roots: DataFrame, edges: DataFrame, by_root: bool = False) -> DataFrame:
    """(package_digest, record_id, depth) of what required edges reach from the roots.

    With ``by_root`` each root has its own closure and rows carry root_id.
    """
    keys = ["package_digest", *(["root_id"] if by_root else []), "record_id"]
    # Edges are written once; each level reads them and not what they were made from.
    step = checkpointed(edges.where("required").select("package_digest", F.col("source_record_id").alias("record_id"), F.col("target_record_id").alias("target")))
    seen = (roots.withColumn("root_id", F.col("record_id")) if by_root else roots).select(*keys).distinct().withColumn("depth", F.lit(0).cast("long"))
    seen = frontier = checkpointed(seen)
    for depth in count(1):
        nxt = frontier.join(step, ["package_digest", "record_id"]).withColumn("record_id", F.col("target")).select(*keys).distinct()
        nxt = checkpointed(nxt.join(seen, keys, "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if nxt.isEmpty():
            return seen
        seen, frontier = seen.union(nxt), nxt
        if depth % EVERY == 0:
            seen = checkpointed(seen)
    return seen


def numbered(records: DataFrame) -> DataFrame:
    """package_digest, record_id and ``number``: numbers rise with (package, record), so their order is that of the ids.

    Written once, so numbers stay what they are.
    """
    ids = checkpointed(records.select("package_digest", "record_id").distinct())
    return checkpointed(ids.repartitionByRange("package_digest", "record_id").sortWithinPartitions("package_digest", "record_id").withColumn("number", F.monotonically_increasing_id()))


def _chunk(number: Column) -> Column:
    return F.shiftright(number, CHUNK_BITS)


def _low(number: Column) -> Column:
    return number.bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")


def reaches(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers, sets): what each root reaches over required edges, itself included.

    sets has (root, chunk, depth, members): the low bits of the numbers that lie
    at this depth, the least number of edges from the root; a row has at most
    2 ** CHUNK_BITS members.  Ids are near to those of the same document, so a
    closure is a few rows.  A round goes one level up: a root's next level is
    what its targets have at their last level, less what it has already.
    """
    required = edges.where("required").select("package_digest", "source_record_id", "target_record_id").distinct()
    ends = required.select("package_digest", F.col("source_record_id").alias("record_id")).union(required.select("package_digest", F.col("target_record_id").alias("record_id")))
    numbers = numbered(roots.select("package_digest", "record_id").union(ends))
    source = numbers.select("package_digest", F.col("record_id").alias("source_record_id"), F.col("number").alias("source"))
    target = numbers.select("package_digest", F.col("record_id").alias("target_record_id"), F.col("number").alias("target"))
    step = checkpointed(required.join(source, ["package_digest", "source_record_id"]).join(target, ["package_digest", "target_record_id"]).select("source", "target"))
    # Sets are of all numbers, as roots reach through records that aren't roots.
    own = numbers.select(F.col("number").alias("root"), _chunk(F.col("number")).alias("chunk"), F.array(_low(F.col("number"))).alias("members"))
    levels = own.withColumn("depth", F.lit(0).cast("long"))
    last, seen = own, own
    for depth in count(1):
        there = step.join(last.withColumnRenamed("root", "target"), "target").select(F.col("source").alias("root"), "chunk", F.explode("members").alias("member"))
        met = there.groupBy("root", "chunk").agg(F.collect_set("member").alias("met"))
        new = met.join(seen.withColumnRenamed("members", "old"), ["root", "chunk"], "left")
        new = new.select("root", "chunk", F.array_except("met", F.coalesce("old", F.array().cast("array<int>"))).alias("members"))
        last = checkpointed(new.where(F.size("members") > 0))
        if last.isEmpty():
            break
        levels = levels.union(last.withColumn("depth", F.lit(depth).cast("long")))
        both = seen.union(last).groupBy("root", "chunk").agg(F.flatten(F.collect_list("members")).alias("members"))  # two rows at most
        seen = checkpointed(both)
    wanted = roots.select("package_digest", "record_id").distinct().join(numbers, ["package_digest", "record_id"]).select(F.col("number").alias("root"))
    return numbers, levels.join(wanted, "root", "left_semi").select("root", "chunk", "depth", "members")


def reach_summary(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """package_digest, root_id, n_records, depth and first_id (the least id) of each root's closure."""
    numbers, sets = reaches(roots, edges)
    least = F.shiftleft(F.col("chunk"), CHUNK_BITS) + F.array_min("members")
    found = sets.groupBy("root").agg(F.sum(F.size("members")).cast("long").alias("n_records"), F.max("depth").alias("depth"), F.min(least).alias("least"))
    named = found.join(numbers.withColumnRenamed("number", "root").withColumnRenamed("record_id", "root_id"), "root")
    first = numbers.select(F.col("number").alias("least"), F.col("record_id").alias("first_id"))
    return named.join(first, "least").select("package_digest", "root_id", "n_records", "depth", "first_id")


def ordered_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_digest, request, root_pos, level, record_id, place) of the closures of requests in emission order.

    A request is some roots of a package in an order (``root_pos``), each walked
    breadth first with edges by (relationship, target); a record comes once in a
    request, where it is met first.  Requests are numbered apart; roots without
    a request, or without a package, are one.
    """
    of = [c for c in ("package_digest", "request") if c in roots.columns]
    package = of[:1] if "package_digest" in of else []
    step = checkpointed(edges.where("required").select(*package, F.col("source_record_id").alias("record_id"), "relationship", F.col("target_record_id").alias("target")))
    start = roots.groupBy(*of, "record_id").agg(F.min("root_pos").alias("root_pos"))
    seen = frontier = checkpointed(start.select(*of, "root_pos", "record_id", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("seq")))
    for level in count(1):
        met = frontier.join(step, [*package, "record_id"]).select(*of, "root_pos", "seq", "relationship", F.col("target").alias("record_id"))
        first = met.groupBy(*of, "root_pos", "record_id").agg(F.min(F.struct("seq", "relationship")).alias("at"))
        order = Window.partitionBy(*of, "root_pos").orderBy("at", "record_id")
        nxt = first.join(seen, [*of, "root_pos", "record_id"], "left_anti").select(*of, "root_pos", "record_id", F.lit(level).cast("long").alias("level"), (F.row_number().over(order) - 1).cast("long").alias("seq"))
        nxt = checkpointed(nxt)
        if nxt.isEmpty():
            break
        seen, frontier = seen.union(nxt), nxt
    rows = seen.groupBy(*of, "record_id").agg(F.min(F.struct("root_pos", "level", "seq")).alias("at"))
    everywhere = Window.partitionBy(*of).orderBy("at")
    return rows.select(*of, "at.root_pos", "at.level", "record_id", (F.row_number().over(everywhere) - 1).cast("long").alias("place"))


def _chains(records: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
    """(ended, cyclic): what is known of each record's chain of parents, and the records whose chain never ends.

    ended: package_digest, record_id, depth and, with ``paths``, path (root first).
    cyclic: package_digest, record_id, at (a member of its cycle) and least (for
    members, the cycle's least one).  A parent that isn't there ends its chain.
    """
    key = ["package_digest", "record_id"]
    path = [F.array().cast("array<string>").alias("path")] if paths else []
    now = checkpointed(records.select(*key, F.col("parent_record_id").alias("at"), F.lit(0).cast("long").alias("depth"), F.col("record_id").alias("least"), *path))
    before, steps, ended = -1, 1, None
    while True:
        active = now.where("at is not null")
        up = now.select("package_digest", F.col("record_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("up_depth"), F.col("least").alias("up_least"), *([F.col("path").alias("up_path")] if paths else []))
        there = F.col("up_depth").isNotNull()
        longer = [F.when(there, F.concat("up_path", F.array("at"), "path")).otherwise(F.col("path")).alias("path")] if paths else []
        went = active.join(up, ["package_digest", "at"], "left").select(*key, F.col("next").alias("at"), F.when(there, F.col("depth") + 1 + F.col("up_depth")).otherwise(F.col("depth")).alias("depth"), F.least("least", F.coalesce("up_least", "least")).alias("least"), *longer)
        now = checkpointed(now.where("at is null").union(went))
        steps *= 2
        left = now.where("at is not null").count()
        if ended is None and left == before:
            # A round in which no chain ends shows that all others go on for ever: had one reached an end, it would have ended.
            ended, now = now.where("at is null"), now.where("at is not null")
        before = left
        if not left or ended is not None and steps > left:  # every place of each cycle has been passed, too
            break
    out = now.where("at is null") if ended is None else ended
    return out.select(*key, "depth", *(["path"] if paths else [])), now.where("at is not null").select(*key, "at", "least")


def depths(records: DataFrame) -> DataFrame:
    """(package_digest, record_id, depth): the number of records above; records whose chain runs into a cycle have none."""
    ended, cyclic = _chains(records, False)
    return ended.union(cyclic.select("package_digest", "record_id", F.lit(None).cast("long")))


def cycles(records: DataFrame) -> DataFrame:
    """(package_digest, cycle, record_id): the members of each cycle of parents, the cycle named by its least one."""
    _, cyclic = _chains(records, False)
    # A chain of more steps than records stands on a cycle, and each member is stepped on by another.
    members = cyclic.select("package_digest", F.col("at").alias("record_id")).distinct()
    return members.join(cyclic.select("package_digest", "record_id", F.col("least").alias("cycle")), ["package_digest", "record_id"]).select("package_digest", "cycle", "record_id")


def ancestry(records: DataFrame) -> DataFrame:
    """(package_digest, record_id, path) with the ids of the parents, root first; a cycle is an error that names members."""
    ended, cyclic = _chains(records, True)
    if not cyclic.isEmpty():
        some = cycles(records).orderBy("package_digest", "cycle", "record_id").limit(NAMED).collect()
        raise error("invalid_records", "Parent chains have cycles.", members=[r["record_id"] for r in some])
    return ended.select("package_digest", "record_id", "path")


def neighbours(records: DataFrame) -> DataFrame:
    """Each record with the ids before and after it in its package.

    Ordinals have no gaps, so this joins on (package, ordinal) and needs no
    window over a whole package, which may be a third of the corpus.
    """
    rows = records.select("package_digest", "ordinal", "record_id")
    beside = lambda step, name: rows.select("package_digest", (F.col("ordinal") + step).alias("ordinal"), F.col("record_id").alias(name))
    key = ["package_digest", "ordinal"]
    return rows.join(beside(1, "previous_id"), key, "left").join(beside(-1, "next_id"), key, "left").select("package_digest", "record_id", "previous_id", "next_id")


def with_structure(edges: DataFrame, structural: DataFrame) -> DataFrame:
    """Stored edges and resolved structural relationships as one set of edges."""
    names = ["package_digest", "source_record_id", "relationship", "target_record_id", "required"]
    return edges.select(*names).union(structural.select(*names)).distinct()


def edges_of(edges: DataFrame, record_ids: DataFrame, direction: str) -> DataFrame:
    """Distinct edges out of, or into, the given records."""
    near, far = ("source_record_id", "target_record_id") if direction == "outgoing" else ("target_record_id", "source_record_id")
    anchors = record_ids.select("package_digest", F.col("record_id").alias(near))
    return edges.join(anchors, ["package_digest", near], "left_semi").select("package_digest", F.col(near).alias("anchor_id"), "relationship", F.col(far).alias("record_id"), "required").distinct()


def impact(status: DataFrame, before: DataFrame, after: DataFrame, before_ids: DataFrame, after_ids: DataFrame) -> DataFrame:
    """Why a record is touched by a change: (side, record_id, cause_type, cause_record_id, depth, path).

    On each side's required edges, a walk from every record stops at an edge
    that the other side lacks, or at a changed target; otherwise it goes on to
    targets not met before.  Of several paths to the same cause one is kept,
    the shortest and then the first.
    """
    out = None
    key = ["package_digest", "source_record_id", "relationship", "target_record_id"]
    status = checkpointed(status.where("status <> 'unchanged'").select("package_digest", "record_id", "status"))
    for side, mine, other, ids, gone, changed in (
        ("before", before, after, before_ids, "dependency_edge_removed", ("removed", "modified", "moved")),
        ("after", after, before, after_ids, "dependency_edge_added", ("added", "modified", "moved")),
    ):
        e = mine.where("required").select(*key).distinct()
        kept = other.where("required").select(*key).distinct().withColumn("kept", F.lit(True))
        s = status.where(F.col("status").isin(*changed)).select("package_digest", F.col("record_id").alias("target_record_id"), F.lit(True).alias("changed"))
        e = e.join(kept, key, "left").join(s, ["package_digest", "target_record_id"], "left")
        cause = F.when(F.col("kept").isNull(), gone).when(F.col("changed"), "target_record_changed")
        e = checkpointed(e.select(*key, cause.alias("cause_type")))
        start = ids.select("package_digest", F.col("record_id").alias("start"), F.col("record_id").alias("source_record_id"), F.array().cast("array<string>").alias("path"))
        seen = start.select("package_digest", "start", F.col("source_record_id").alias("node"))
        frontier = start
        while True:
            met = frontier.join(e, ["package_digest", "source_record_id"])
            met = checkpointed(met.select("package_digest", "start", "source_record_id", "relationship", "target_record_id", "cause_type", F.concat("path", F.array(F.concat_ws(">", "source_record_id", "target_record_id"))).alias("path")))
            hit = met.where("cause_type is not null").withColumn("side", F.lit(side))
            out = hit if out is None else out.union(hit)
            nxt = met.where("cause_type is null").groupBy("package_digest", "start", F.col("target_record_id").alias("node")).agg(F.min("path").alias("path")).join(seen, ["package_digest", "start", "node"], "left_anti")
            nxt = checkpointed(nxt)
            if nxt.isEmpty():
                break
            seen = seen.union(nxt.select("package_digest", "start", "node"))
            frontier = nxt.select("package_digest", "start", F.col("node").alias("source_record_id"), "path")
    edge = F.when(F.col("cause_type") != "target_record_changed", F.struct("source_record_id", "relationship"))
    best = out.groupBy("side", "package_digest", F.col("start").alias("record_id"), "cause_type", F.col("target_record_id").alias("cause_record_id"), edge.alias("edge")).agg(F.min(F.struct(F.size("path").alias("depth"), F.col("path"))).alias("best"))
    return best.select("side", "package_digest", "record_id", "cause_type", "cause_record_id", F.col("best.depth").cast("long").alias("depth"), F.col("best.path").alias("path"))
