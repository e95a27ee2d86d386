"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexstrata.llm import chat, decontam, htmlmain, licence_texts, licenses, nbsvm, packing, queries, rules, shared, simhash, substrings, warc
from lexstrata.llm.components import components
from lexstrata.llm.labelled import labelled_sample
from lexstrata.llm.shared import vocabulary_path
from lexstrata.llm.wordspans import PLAIN_WORDS, text_blocks
from tests.oracle import same

PLAIN = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, fp string, task string, q string"


def made(seed, n):
    """Texts with nulls, empties, white space, a very long one, copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = text(60), [None, "", " \n\t ", "one", "two words", text(3000), None]
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 4 == 0:
            t = t[: len(t) // 2] + "\n" + passage + "\n" + t[len(t) // 2 :]
        if i % 5 == 0 and out[-1]:
            t = out[-1]
        if i % 7 == 0 and out[-1]:
            t = out[-1] + " tail"
        out.append(t)
    return out


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", "z", "0") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return made(1, 60)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


def brute_kept(texts, ids):
    first = {}
    for i, t in zip(ids, texts, strict=True):
        w = PLAIN.findall(t or "")
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = PLAIN.findall(t or "")
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        out.append((len(w), [x for j, x in enumerate(w) if j not in gone]))
    return out


@pytest.mark.parametrize(("block", "group"), [(400, 5), (4000, 50), (1 << 21, 60_000)])
def test_substrings_equal_brute_force(spark, docs, texts, block, group):
    rows = {r["doc_id"]: r for r in substrings.dedup(docs, block, group, counts=("before", "gone")).collect()}
    assert len(rows) == len(texts)
    for i, (n, kept) in enumerate(brute_kept(texts, range(len(texts)))):
        r = rows[i]
        assert (r["before"], r["before"] - r["gone"], PLAIN.findall(r["text"] or "")) == (n, len(kept), kept)
        assert (r["n_words"], r["spans"], r["q"]) == (7, "x", "0")
        if not r["gone"]:
            assert r["text"] == texts[i]


def test_hot_anchors_are_split(spark):
    """One 5-word phrase in very many texts, and one window in many: no group is over its bound, and the result is that of brute force."""
    rng = random.Random(5)
    word = lambda: f"x{rng.randrange(10_000)}"
    code = lambda *words: zlib.crc32(" ".join(words).encode()) >> 1
    rows = [(0, i, i, 0, 13, "a b c d e " + " ".join(word() for _ in range(8)), code("a"), code("a", "b"), code(*"abcde")) for i in range(4000)]
    for i in range(4000):
        w = [f"q{i % 50}", *(word() for _ in range(12))]
        rows.append((1, i, i, 0, 13, " ".join(w), code(w[0]), code(*w[:2]), code(*w[:5])))
    found, hot = substrings.with_groups(spark.createDataFrame(rows, substrings.PIECES), 200)
    parts = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
    assert hot and parts.pop(None) == 4000 and sum(parts.values()) == 4000 and max(parts.values()) < 3 * 200
    phrase, window = "a b c d e", " ".join(f"same{i}" for i in range(13))
    texts = [" ".join([*(word() for _ in range(9)), phrase if i % 3 else window, *(word() for _ in range(9))]) for i in range(400)]
    texts += ["y " * 20 + "z" * 5000 + " " + " ".join(f"t{i}" for i in range(14)), "z" * 5000 + " " + " ".join(f"t{i}" for i in range(14)), "z" * 5001 + " " + " ".join(f"t{i}" for i in range(14))]
    found = {r["doc_id"]: r for r in substrings.dedup(frame(spark, texts), 3000, 20, counts=("n", "gone")).collect()}
    for i, (n, kept) in enumerate(brute_kept(texts, range(len(texts)))):
        assert (found[i]["n"], PLAIN.findall(found[i]["text"])) == (n, kept)


def test_substrings_with_odd_ids(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts, ids = [passage, passage, passage + " a", passage + " b", passage, "x " * 40], [5, 5, 5, 9, None, 1]
    found = substrings.dedup(frame(spark, texts, ids), counts=("n", "gone")).collect()
    assert sorted((r["doc_id"] or 0, r["gone"]) for r in found) == [(0, 0), (1, 0), (5, 0), (5, 0), (5, 0), (9, 30)]


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    prints = []
    for t in texts:
        w = PLAIN.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, label, strict=True))}


def test_one_of_each_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = [None, "", "a b", "a b", "A  B"]
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            for _ in range(rng.randint(1, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    prints = [row for b in text_blocks(pa.array(texts, pa.string()), PLAIN_WORDS, fold=True) for row in simhash.wide_fingerprints(b)]
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, alike, caught = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            near = np.bitwise_count(prints[i] ^ prints[j])
            linked = near[:2].min() <= simhash.WORD_BITS and near[2:].sum() <= simhash.WIDE_BITS
            same = len(shingles[i] & shingles[j]) / max(1, len(shingles[i] | shingles[j]))
            assert not linked or same > 0.5 or not shingles[i] | shingles[j]
            alike, caught = alike + (same >= 0.8), caught + (same >= 0.8 and linked)
            if linked:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert caught >= 0.9 * alike > 30
    docs = frame(spark, texts)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_labelled_sample_is_bounded(spark):
    rows = [(i % 2, f"text {i % 7}") for i in range(2000)] + [(2, "x" * 5000), (3, "short"), (4, None), (4, None), (5, "other"), (6, "no label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(3, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 100, False).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["label"]) for r in got) == sorted({(i % 2, f"text {i % 7}", i % 2) for i in range(2000)} | {(2, "x" * 5000, 0), (3, "short", 1), (4, "", 0), (5, "other", 1)})
    assert len(labelled_sample(docs, labels, "quality", 2, False).collect()) == 2
    few = labelled_sample(docs, labels, "quality", 100, False, sample_bytes=30).collect()
    assert 0 < sum(len(r["text"] or "") for r in few) <= 30


def test_sets_decide_which_texts_go(spark):
    """Copies on both sides of 0.8: what goes has a partner at 0.8 in its class, and few such pairs both stay."""
    rng = random.Random(31)
    texts = []
    for _ in range(150):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([1, 1, 2])):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(j, i) for i in range(len(texts)) for j in range(max(0, i - 3), i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    below = [(j, i) for i in range(len(texts)) for j in range(max(0, i - 3), i) if 0.6 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8]
    assert len(pairs) > 60 and len(below) > 40
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, texts)).collect()}
    partners = defaultdict(set)
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    assert all(partners[i] for i in range(len(texts)) if i not in kept)
    assert sum(not {a, b} <= kept for a, b in pairs) >= 0.95 * len(pairs)


def test_which_of_repeated_rows_stays(spark):
    rows = [(3, "same text here now", x, None) for x in ("b", "a", "c")] * 5 + [(4, "other words entirely apart", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert sorted(tuple(r) for r in simhash.one_of_each(docs).collect()) == [(3, "same text here now", "a", None), (4, "other words entirely apart", "z", 1)]


def test_one_of_repeated_rows_stays(spark):
    rows = frame(spark, ["same text here now", "same text here now", "other words entirely apart"], [3, 3, 8])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(rows).collect()) == [3, 8]


def test_one_of_each_with_null_and_shared_ids(spark):
    a, b, c, d, e = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black", "north south east west up", "salt sugar flour butter milk")

    def kept(*rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in simhash.one_of_each(docs).collect())

    assert kept((None, a), (None, b), (None, a), (5, c)) == [(-1, a), (-1, b), (5, c)]
    assert kept((None, a), (2, b), (None, b), (None, b)) == [(-1, a), (2, b)]
    assert kept((4, a), (4, b), (4, b), (9, a), (4, c), (None, d), (None, d), (None, e), (7, e)) == [(-1, d), (4, a), (4, b), (4, c), (7, e)]
    assert kept((1, None), (1, None), (1, "")) in ([(1, None)], [(1, "")])


@pytest.mark.parametrize("cell_rows", [2, 8, 40])
def test_links_in_refined_and_cut_anchors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 60, 2) for b in (a + 1, a + 3)} | set(rng.integers(0, 1 << 62, 50).tolist()))
    fps = spark.createDataFrame([(v, v) for v in values], "node long, fp long")
    found = defaultdict(set)
    for r in components(simhash.links(fps, ["fp"], 4)).collect():
        found[r["root"]].add(r["node"])
    label = {v: v for v in values}
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                x, y = label[a], label[b]
                label = {k: (min(x, y) if v in (x, y) else v) for k, v in label.items()}
    want = defaultdict(set)
    for k, v in label.items():
        want[v].add(k)
    assert {frozenset(s) for s in found.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


def test_spread_join_and_removal(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", 4)
    since = shared.mark()
    rows = shared.stored(spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(40)], "k long, i long"), "rows")
    values = shared.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most")), "values")
    got = sorted((r["i"], r["k"], r["most"]) for r in shared.spread_join(rows, values, "k", "n").collect())
    most = {r["k"]: r["most"] for r in values.collect()}
    assert got == sorted((r["i"], r["k"], most[r["k"]]) for r in rows.collect())
    shared.remove_stored(spark, since, but=1)
    assert values.count() == 4 and shared.mark() == since + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FAILED_READ_FILE"):
        rows.collect()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {200: 200, 201: 200}


BENCH = [(1, "Alpha beta gamma DELTA, epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "short item"), (3, None), (4, "..."), (5, "short item"), (None, "w1 w2 w3")]


@pytest.mark.parametrize("part_bytes", [1 << 24, 40])
def test_contamination_equals_brute_force(spark, part_bytes):
    rng = random.Random(4)
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for _, t in BENCH]
    texts = [None, "", "nothing to see", "a short item here", "Short, ITEM! short item", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"]
    for _ in range(30):
        t = [rng.choice(["alpha", "beta", "x", "y", "short", "w1", "w2"]) for _ in range(rng.randint(1, 80))]
        at = rng.randrange(len(t))
        t[at:at] = rng.choice(words)[: rng.choice([2, 13, 14])]
        texts.append(" ".join(t))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.digest(decontam.contamination(docs, bench, part_bytes)).collect()}
    windows = [(i, tuple(w[j : j + min(13, len(w))])) for (i, _), w in zip(BENCH, words, strict=True) if w for j in range(len(w) - min(13, len(w)) + 1)]
    clean = set()
    for d, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        hit, items = set(), set()
        for i, k in windows:
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit |= set(range(j, j + len(k)))
                    if i is not None:
                        items.add(str(i))
        r = found[d]
        bad = bool(hit) and 20 * len(hit) >= len(w)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bad)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        if not bad:
            clean.add(d)
    kept = decontam.drop_contaminated(docs, bench, part_bytes)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    empty = bench.limit(0)
    assert decontam.drop_contaminated(docs, empty).count() == len(texts)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_equals_brute_force(spark, docs, texts, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False).ids) + 1
        for p, s in enumerate(range(0, n, capacity)):
            want[(i, p, s, min(capacity, n - s))] += 1
    rows = packing.pack(docs, vocabulary_path(), capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    open_bins = []
    for n in sorted((k[3] for k in want.elements()), reverse=True):
        fits = [(r, i) for i, r in enumerate(open_bins) if r >= n]
        if fits:
            open_bins[min(fits)[1]] -= n
        else:
            open_bins.append(capacity - n)
    assert len(bins) == len(open_bins)


CLEAN = "The quick unit {0} holds a load of {1} under the usual conditions, and the {2} test {0} confirms that it works well for every {1} part number {0}"
JUNK = "{0}### win%%% $$$ now {1}*** click&&& |{2}| {0}%%% buy### {1}$$$ more*** free&&& {2}### {0}$$$ deal*** {1}%%% here&&& {2}*** {1}### last%%% {0}&&&"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9)))
    texts = [(CLEAN if i % 3 else JUNK).format(word(), word(), word()) for i in range(240)] + [None, "", "x"]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(1, 1, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, texts


def test_classifier(spark, labelled):
    docs, labels, texts = labelled
    rows = {r["doc_id"]: r for r in nbsvm.classify(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert np.mean([rows[i]["predicted"] == int(i % 3 > 0) for i in range(200, 240)]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    alone = nbsvm.classify(docs, labels.where("quality = 1"))
    assert {r["score"] for r in alone.collect()} == {0.5}


def test_held_out_labels_are_not_used(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda y: {r["doc_id"]: r["score"] for r in nbsvm.classify(docs, y).collect()}
    assert score(labels) == score(flipped)


def test_quality_rules(spark, labelled):
    docs, labels, texts = labelled
    rows = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    for i in range(200, 240):
        assert not rows[i]["base_failed"] and rows[i]["kept"] == bool(i % 3)
    assert all(rows[i]["base_failed"] and not rows[i]["kept"] for i in range(240, 243))
    kept = rules.kept_rows(docs, rules.train(docs, labels))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    assert rules.kept_rows(docs, rules.train(docs, labels.limit(0))).count() == 240


def test_licenses(spark):
    notice = {"m": "Released under the MIT License.", "g": "This work is licensed under the GNU General Public License, version 3."}
    rows = [
        (1, "a/LICENSE", notice["m"]), (2, "a/b/x.txt", "code"), (3, "a/b/c/y.txt", f"code\n  {notice['g']}\nmore"), (4, "z.txt", "plain the license of words"),
        (5, "a/q/COPYING.txt", notice["g"]), (6, "a/q/r/s.txt", None), (7, None, notice["m"]), (8, None, ""), (9, "a", "a file named as a directory"), (6, "a/q/r/s.txt", None), (10, "h/f.txt", notice["m"] + "\nbody"), (11, "h/g.txt", "body"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir_", F.lit(1))
    got = sorted((r["doc_id"], r["licence"] or "", r["how"], r["from_path"] or "") for r in licenses.scan(files).collect())
    assert got == [
        (1, "MIT", "own", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"), (3, "GPL-3.0", "own", "a/b/c/y.txt"), (4, "", "none", ""), (5, "GPL-3.0", "own", "a/q/COPYING.txt"),
        (6, "GPL-3.0", "inherited", "a/q/COPYING.txt"), (6, "GPL-3.0", "inherited", "a/q/COPYING.txt"), (7, "MIT", "own", ""), (8, "", "none", ""), (9, "", "none", ""), (10, "MIT", "own", "h/f.txt"), (11, "MIT", "inherited", "h/f.txt"),
    ]


def test_only_licence_files_are_inherited(spark):
    code = "\n".join(f"value{i} = call{i}()" for i in range(30))
    bsd = "Licensed under the BSD 2-Clause License.\n" + code
    rows = [
        (1, "a/f.py", bsd), (2, "a/g.py", code), (3, "a/e.py", "// SPDX-License-Identifier: EUPL-1.2\n" + code), (4, "b/LICENSE", "MIT License\n\nmore"), (5, "b/e.py", "// SPDX-License-Identifier: EUPL-1.2\n" + code),
        (6, "b/f.py", code), (7, "c/x.py", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nprint(1)"), (8, "c/y.py", code), (9, "d/x", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n"),
        (10, "e/x", "License: MIT"), (11, "f/x", "Licensed under the MIT license. See LICENSE file in the project root for full license information.\n" + code),
        (12, "g/x", "SPDX-License-Identifier: GPL-2.0-only\nprint(1)"), (13, "g/y", "SPDX-License-Identifier: GPL-2.0-or-later\nversion = 3"),
    ]
    got = {r["doc_id"]: (r["licence"], r["how"], r["spdx"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("BSD-2-Clause", "own", None), 2: (None, "none", None), 3: (None, "none", "EUPL-1.2"), 4: ("MIT", "own", None), 5: (None, "none", "EUPL-1.2"), 6: ("MIT", "inherited", None),
        7: ("MIT OR Apache-2.0", "own", "MIT OR Apache-2.0"), 8: (None, "none", None), 9: ("Apache-2.0 AND MIT", "own", None), 10: ("MIT", "own", None), 11: ("MIT", "own", None),
        12: ("GPL-2.0", "own", "GPL-2.0"), 13: ("GPL-2.0", "own", "GPL-2.0"),
    }


def licences_of(spark, texts):
    files = spark.createDataFrame([(i, f"d{i}/f.c", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return [r["licence"] for r in licenses.scan(files).orderBy("doc_id").collect()]


def test_templates_and_relatives_are_told_apart(spark):
    """Every template as a line of a file, as its first lines, and alone; then notices as projects write them."""
    body = "\n\n" + "\n".join(f"value{i} = call{i}(other{i})" for i in range(60))
    wrapped = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    for form in (lambda t: f"intro words\n{t}{body}", lambda t: f"/*\n{wrapped(t)}\n */{body}", lambda t: t):
        assert licences_of(spark, [form(t) for _, t in licence_texts.TEMPLATES]) == [name for name, _ in licence_texts.TEMPLATES]
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
    bsd = next(t for name, t in licence_texts.TEMPLATES if name == "BSD-3-Clause" and "DAMAGE" in t)
    cases = [
        ("GPL-2.0", wrapped("Copyright (C) 2001 A. Person\n" + gnu.format("General Public License", 2)) + body),
        ("GPL-3.0", wrapped(gnu.format("General Public License", 3)) + body),
        ("AGPL-3.0", wrapped(gnu.format("Affero General Public License", 3)) + body),
        ("LGPL-2.1", wrapped(gnu.format("Lesser General Public License", "2.1")) + body),
        ("LGPL-3.0", wrapped(gnu.format("Lesser General Public License", 3).replace("program", "library")) + body),
        ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "text of it " * 50),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nbody"),
        ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nbody"),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nbody"),
        ("BSD-3-Clause", "Copyright (c) 2010, The Authors. All rights reserved.\n" + wrapped(bsd)),
        ("BSD-2-Clause", "Copyright (c) 2010, The Authors. All rights reserved.\n" + wrapped(bsd.replace(bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")], ""))),
        ("BSD-2-Clause", bsd[: bsd.index(" 1. ")] + "\n" + bsd[bsd.index("1. Red") : bsd.index("3. Neither")] + body),
        ("ISC", "Copyright 2020 X\n" + wrapped("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")),
        ("MIT", "The MIT License (MIT)\nCopyright (c) 2015 Some One\n" + wrapped(next(t for name, t in licence_texts.TEMPLATES if name == "MIT" and "LIABLE" in t))),
        ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
        ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License\n\nBy exercising"),
        ("CC-BY-NC-ND-3.0", "x\nLicensed under CC BY-NC-ND 3.0.\ny"),
        ("LGPL-3.0", "x\n// SPDX-License-Identifier: LGPL-3.0-or-later\ny"),
        ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only" + body),
        (None, "// SPDX-License-Identifier: GPL-4.0" + body),
        (None, "This work is licensed under a Creative Commons Attribution 9.1 International License."),
        (None, "The licence of this version of the work is general and public.\nThe software is provided with a copy of the manual."),
    ]
    assert licences_of(spark, [t for _, t in cases]) == [name for name, _ in cases]


def test_cosines_equal_brute_force(spark):
    texts = ["alpha mit license released under the the", "under the mit license", "alpha beta beta", None, "", "released under MIT license released", "the beta alpha zeta zeta zeta mit license", "mit"]
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    idf = lambda w: np.log((1 + len(texts)) / (1 + sum(w in ws for ws in words))) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    want = []
    for ws in words:
        v, best = vector(ws), 0.0
        for name, t in licence_texts.TEMPLATES:
            u = vector(re.findall(r"[a-z0-9]+", t.lower()))
            if name == "MIT" and ws:
                best = max(best, sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u))
        want.append(round(best, 4) if best >= 0.3 else None)
    files = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["cosine"] for r in licenses.scan(files, threshold=0.3).collect() if r["licence"] in ("MIT", None)}
    assert {i: c and round(c, 4) for i, c in got.items()} == {i: want[i] for i in got} and sum(c is not None for c in got.values()) > 3


def test_clashing_columns_and_hot_directories(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", 2)
    notice = "Released under the MIT License."
    rows = [(i, f"big/f{i}", "x", "mine", 1.0, "d") for i in range(40)] + [(90, "big/LICENSE", notice, "mine", 1.0, "d"), (91, "o/x", "y", "mine", 1.0, "d"), (92, None, "y", "mine", 1.0, "d")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string, cosine double, dir string").withColumns({c: F.lit(7) for c in ("n_lines", "heads", "inherited", "above", "n_files", "carried", "a.b")})
    got = licenses.scan(files)
    assert sorted(got.columns) == sorted({*files.columns, "how", "from_path"} - {"text"})
    found = {r["doc_id"]: (r["licence"], r["how"], r["dir"], r["heads"], r["inherited"], r["a.b"]) for r in got.collect()}
    assert found == {i: ("MIT", "inherited", "d", 7, 7, 7) for i in range(40)} | {90: ("MIT", "own", "d", 7, 7, 7), 91: (None, "none", "d", 7, 7, 7), 92: (None, "none", "d", 7, 7, 7)}


def test_wrapped_notices_lead_long_files(spark):
    code = "\n\n" + "\n".join(f"value{i} = call{i}(other{i})" for i in range(400))
    mit, bsd = (next(t for name, t in licence_texts.TEMPLATES if name == k and len(t) > 100).split() for k in ("MIT", "BSD-3-Clause"))
    wrapped = lambda words: "\n".join("# " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    rows = [(1, "a/x.py", wrapped(mit) + code), (2, "b/x.py", "\n\n" + wrapped(bsd).replace("\n", "\r\n") + "\r\n \r\n" + code), (3, "c/x.py", "first words" + code), (4, "d/x.py", None), (5, "e/x.py", "")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(files).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: None, 4: None, 5: None}


def test_licence_folders_grow_with_documents(spark, tmp_path):
    for n in (1000, 4000):
        frame(spark, ["some words"] * n).write.parquet(str(tmp_path / str(n) / "documents.parquet"))
    folders = [len({r["path"].rpartition("/")[0] for r in queries.op6_licenses(spark, str(tmp_path / str(n))).collect()}) for n in (1000, 4000)]
    assert folders[1] > 3 * folders[0]


def test_warc(spark, tmp_path):
    rows = [(3, "http://a", "<p>x"), (1, None, "<p>x"), (2, "u", None), (5, "u", ""), (7, "u", "only"), (1, "v", "<p>x"), (None, "u", "only"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("data", F.lit("clash"))
    archives = warc.write_pages(pages)
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read_archives(archives).collect())
    assert got == sorted([(3, 4, "revisit", 1), (1, 4, "response", 0), (1, 4, "response", 0), (2, 0, "response", 0), (5, 0, "revisit", 2), (7, 4, "response", 0), (0, 4, "revisit", 7), (0, 5, "response", 0)])
    for i, r in enumerate(archives.collect()):
        (tmp_path / f"{i}.warc.zst").write_bytes(r["data"])
    assert warc.read_files(spark, str(tmp_path)).count() == len(rows)
    short = warc.read_archives(warc.write_pages(pages, min_bytes=5)).collect()
    assert {r["record_type"] for r in short} == {"response"}
    assert warc.read_archives(warc.write_pages(pages.limit(0))).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "a ### b: </turn> \\h"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"),
        (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, None, "y"), (4, None, "assistant", "é" * 5000),
    ]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.chat_examples(conversations)
    by = {(r["conv_id"], r["example"]): r for r in examples.collect()}
    assert len(by) == 3 + 1 + 2 + 1 + 1
    assert by[1, 0]["n_context"] == 1 and by[1, 1]["n_context"] == 3 and by[1, 2]["target"] is None
    assert all(r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == r["target"] for r in by.values() if r["target"] is not None)
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t if t is not None else -1, role or "", text or ""))
    for r in chat.chat_digest(examples).collect():
        own = sorted(turns[r["conv_id"]])
        said = "".join(x for _, role, x in own if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.chat_digest(chat.chat_examples(conversations.limit(0))).count() == 0


def test_main_text(spark):
    rows = [(1, "http://h/1", "<body><article><p>one"), (2, "http://H/2", None), (3, None, "<p>x &lt; y"), (1, "http://h/1", "<body><article><p>one"), (4, "http://h/3", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmlmain.main_text(pages).collect())
    assert got == [(1, "one", 3), (1, "one", 3), (2, "", 0), (3, "x < y", 5), (4, "", 0)]


@pytest.mark.parametrize("large", [1, 512])
def test_host_votes_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(htmlmain, "LARGE_HOSTS", large)
    rng = random.Random(6)
    rows = []
    for i in range(120):
        box = rng.choice(["div class='story n%d'" % i, "section id='s'", "div class='pane'"])
        said = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(3, 60)))
        more = " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice(["http://a.org/x", "https://A.org/y", "http://b.org", None, "no url"]), f"<body><nav>top</nav><{box}><p>{said}</p></{box.split()[0]}><div class='pane'><p>{more}</p></div>"))
    tally = defaultdict(Counter)
    for _, url, html in rows:
        for path, n in htmlmain.votes(html):
            tally[htmlmain.host(url)][path] += n
    winner = {h: min(c, key=lambda p: (-c[p], p)) for h, c in tally.items()}  # noqa: B023
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmlmain.main_text(pages).collect()}
    want = {i: htmlmain.extracted(html, winner[htmlmain.host(url)]) for i, url, html in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert any(t != htmlmain.extracted(html, None) for (_, _, html), t in zip(rows, want.values(), strict=True))


def test_empty_tables(spark, labelled):
    docs, labels, _ = labelled
    none, bench = docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        nbsvm.classify(none, labels), rules.quality_rules(none, labels), simhash.near_duplicates(none), simhash.one_of_each(none), substrings.dedup(none), substrings.digest(none),
        decontam.contamination(none, bench), decontam.drop_contaminated(none, bench), packing.pack(none, vocabulary_path()), htmlmain.main_text(pages),
        licenses.scan(none.select("doc_id", F.col("source").alias("path"), "text")),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path, labelled):
    _, labels, _ = labelled
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9)))
    sentence = lambda: CLEAN.format(word(), word(), word())
    passage = " ".join(word() for _ in range(70))
    item = " ".join(word() for _ in range(20))
    clean = [sentence() + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    texts = clean + [clean[3], clean[4], JUNK.format("a", "b", "c"), clean[5] + "\n" + passage, clean[6] + " " + passage, " ".join(word() for _ in range(30)) + " " + item, None, ""]
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labelled[0].select(docs.columns).withColumn("doc_id", F.col("doc_id") + 1000).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    assert 42 not in seen["quality_rules"] and set(range(40)) <= set(seen["quality_rules"])
    near = set(seen["simhash_near_dedup"])
    assert {3, 4} <= near and not {40, 41} & near
    kept = seen["substring_dedup"]
    assert passage in kept[43]["text"] and passage.split()[5] not in kept[44]["text"] and kept[44]["n_chars"] == len(kept[44]["text"])
    assert 45 in kept and 45 not in seen["decontamination"] and set(range(40)) <= set(seen["decontamination"])
    total = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert total == set(seen["decontamination"])


def test_stages_with_nulls_clashes_and_nothing(spark, tmp_path, labelled):
    """Every stage takes null ids, texts and columns, repeated rows, extra columns of its own names, and no rows at all."""
    base, labels, _ = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(9999)}" for _ in range(3000))
    other = " ".join(f"v{rng.randrange(9999)}" for _ in range(40))
    odd = [(None, None), (None, ""), (7, None), (None, long), (500, long), (None, other), (501, other + " " + other), (502, other), (502, other), (503, "\n \n")]
    docs = base.unionByName(spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in odd], DOCS))
    for c in ("words", "node", "label", "score", "a", "b", "s0", "first", "key", "all", "root", "kept", "anchor", "part", "items", "rank", "length", "a_b"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        for rows, folder in ((docs, tmp_path), (docs.limit(0), tmp_path), (docs, tmp_path / "none")):
            out = stage(spark, rows, str(folder))
            got = out.collect()
            assert len(got) == 0 if rows is not docs else len(got) > 0
            if name != "best_fit_packing":
                assert out.schema.names == docs.schema.names
                assert {(r["doc_id"], r["a_b"]) for r in got} <= {(r["doc_id"], None) for r in docs.collect()}
            if name == "simhash_near_dedup" and rows is docs:
                texts = Counter(r["text"] for r in got)
                assert texts[long] == texts[other + " " + other] == 1 and texts[other] == 0 and texts[None] + texts[""] + texts["\n \n"] == 1
            if name in ("substring_dedup", "decontamination") and rows is docs:
                assert len(got) >= docs.count() - len(odd)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
