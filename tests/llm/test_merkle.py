"""The Merkle manifest against a plain builder."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    d, source, lang, n, text = row
    fields = [d, source, lang, None if n is None else n + more, text]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """Root, and for each node its siblings as (side, digest) or None."""
    proofs, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(of):
            proofs[i].append((0, nodes[k - 1]) if k % 2 else (1, nodes[k + 1]) if k + 1 < len(nodes) else None)
        nodes, of = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], [k // 2 for k in of]
    return nodes[0], proofs


def plain_fold(node, proof):
    for s in proof:
        node = h(node) if s is None else h(node, s[1]) if s[0] else h(s[1], node)
    return node


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, proof in zip(groups[g], trees[g][1], strict=True):
            whole = proof + above[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = plain_fold(plain_leaf(r, int(tampered)), whole)
            out.append((r[0], plain_leaf(r), trees[g][0], root, h(*(s[1] for s in whole if s)), fold, fold == root))
    return out


def got(spark, rows, **sizes):
    return [tuple(r) for r in merkle.digest_rows(spark.createDataFrame(rows, SCHEMA), **sizes).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def rows_of(seed, n, langs):
    rng = random.Random(seed)
    out = [(rng.choice([None, *range(n)]), rng.choice([None, "", "a:b"]), rng.choice(langs), rng.choice([None, 0, 7, 2**63 - 1]), rng.choice([None, "", "é", "x" * 5000, "two words"])) for _ in range(n)]
    return out + out[:3]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (2, [None]), (5, ["en", None, ""]), (61, ["en", "de", None, "Z", "é", "\U0001f600", "￮"]), (130, ["en"])])
def test_equals_plain_builder(spark, n, langs):
    rows = rows_of(n, n, langs)
    # blocks of four and a top of two nodes: many distributed passes
    for sizes in ({}, {"block": 4, "top_nodes": 2}):
        assert sorted(map(repr, got(spark, rows, **sizes))) == sorted(map(repr, plain_manifest(rows)))


def test_more_groups_than_top_nodes(spark):
    rows = [(i, "s", f"lang{i % 40}", i, "t") for i in range(90)]
    assert sorted(got(spark, rows, block=4, top_nodes=8)) == sorted(plain_manifest(rows))


def test_empty_extra_columns_and_own_columns(spark):
    assert got(spark, []) == []
    rows = [(i, "s", "en", i, "t") for i in range(5)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "path", "idx", "n", "grp", "leaf", "root", "id", "top", "block")})
    assert sorted(tuple(r) for r in merkle.digest_rows(clash).collect()) == sorted(plain_manifest(rows))
    own = merkle.manifest(spark.createDataFrame(rows, SCHEMA), "n_chars", "source", ["text", "doc_id"]).collect()
    assert {r.leaf for r in own} == {h("1:t", f"1:{i}") for i in range(5)} and len({r.root for r in own}) == 1


def test_one_group_of_repeated_rows_is_dealt_out(spark):
    rows = [(3, "s", "en", 1, "same")] * 300
    out = got(spark, rows, block=16, top_nodes=4)
    assert sorted(out) == sorted(plain_manifest(rows))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.sampled_from([1, 2, 8, 64]))
def test_blocks_climb_as_the_whole(n, size):
    nodes = [h(str(i)) for i in range(n)]
    heads = [merkle.climb(nodes[i : i + size], None if n <= size else size.bit_length() - 1) for i in range(0, n, size)]
    top, above = merkle.climb([head for head, _ in heads])
    root, proofs = plain_tree(nodes)
    assert top == root
    for i in range(n):
        path = [e[(i % size) >> k] for k, e in enumerate(heads[i // size][1])] + [e[(i // size) >> k] for k, e in enumerate(above)]
        assert path == ["" if s is None else "<>"[s[0]] + s[1] for s in proofs[i]]
