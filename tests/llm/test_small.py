"""The operators' parts, on arrays and bytes, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from html import escape

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lexstrata.llm import decontam, htmlmain, labelled, licence_texts, licenses, nbsvm, packing, rules, simhash, substrings, warc
from lexstrata.llm.nbsvm import dual_coordinate_descent
from lexstrata.llm.shared import vocabulary_path
from lexstrata.llm.wordspans import FOLDED_WORDS, PLAIN_WORDS, RollingHash, text_blocks, whole_runs

PLAIN = re.compile("[^\x20\x09-\x0d]+")
FOLDED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXT = st.text(alphabet="aAbB éß \n\t.,#中0", max_size=60)
TEXTS = st.lists(st.one_of(st.none(), TEXT), max_size=8)


def words_of(block):
    raw = block.data.tobytes()
    return [[raw[block.starts[w] : block.ends[w]].decode() for w in range(block.word_at[i], block.word_at[i + 1])] for i in range(len(block))]


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 80))
def test_word_spans(texts, size):
    for table, pattern, fold in ((PLAIN_WORDS, PLAIN, False), (FOLDED_WORDS, FOLDED, True)):
        got = [w for b in text_blocks(pa.array(texts, pa.string()), table, fold, size) for w in words_of(b)]
        assert got == [pattern.findall((t or "").translate(LOWER) if fold else t or "") for t in texts]


def test_word_hashes_follow_words():
    long = "x" * 700_000
    texts = ["a bb a", "bb " + long + " a", long, "ab ba"]
    seen = {}
    for b in text_blocks(pa.array(texts), PLAIN_WORDS):
        h, flat = RollingHash(3).words(b), [w for ws in words_of(b) for w in ws]
        for w, x in zip(flat, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def brute_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=120, deadline=None)
@given(st.sampled_from([1, 7, 16, 100]), st.lists(st.integers(1, 100), max_size=120))
def test_plan_is_best_fit_decreasing(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    plan = packing.best_fit_decreasing(Counter(lengths), capacity)
    assert plan.n_bins == brute_bins(lengths, capacity)
    bins = {}
    for n, count in Counter(lengths).items():
        for s, o in zip(*(x.tolist() for x in plan.place(n, np.arange(count))), strict=True):
            bins.setdefault(s, []).append((o, n))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    texts = ["", "  It's  1234 ΣΑΣ é ́x\x1c<|endoftext|>a\u0085b we'll\n", "the the\tTHE", "中文 text", None]
    ids, at = packing.word_ids(vocabulary_path()).of(pa.array([t or "" for t in texts]))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    assert zlib.crc32(ids[:1].astype("<u4").tobytes()) == zlib.crc32(b"\0\0\0\0")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(1, 4))
def test_fm_index(symbols, size):
    index = decontam.FMIndex(np.array(symbols), 4)
    rows = np.array(sorted({tuple(symbols[i : i + size]) for i in range(len(symbols) - size + 1)} | {(1,) * size, (4,) * size}))
    lo, hi = index.search(rows)
    for row, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist(), strict=True):
        want = [i for i in range(len(symbols) - size + 1) if symbols[i : i + size] == row]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=13, max_size=60))
def test_deep_nodes(symbols):
    starts = np.arange(len(symbols) - 12)
    node = substrings.deep_nodes(np.array(symbols), starts)
    runs = [tuple(symbols[i : i + 13]) for i in starts]
    rank = {r: i for i, r in enumerate(sorted(set(runs)))}
    assert node.tolist() == [rank[r] for r in runs]
    order, lcp = substrings.suffix_tree(np.array(symbols), starts)
    assert [runs[i] for i in order] == sorted(runs) and lcp[0] == 0
    shared = lambda a, b: next((k for k in range(13) if a[k] != b[k]), 13)
    assert lcp[1:].tolist() == [shared(runs[a], runs[b]) for a, b in zip(order[:-1], order[1:], strict=True)]


def test_every_fingerprint_has_one_own_anchor_and_linked_ones_meet():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            y[i] ^= 1 << int(b)
    meet = np.zeros(len(x), bool)
    for part in range(3):
        row, anchor, own = simhash.anchors_of(x, part, 1)
        assert (np.bincount(row[own], minlength=len(x)) == 1).all()
        home = anchor[own]
        row2, anchor2, _ = simhash.anchors_of(y, part, 1)
        reach = [set() for _ in y]
        for r, a in zip(row2.tolist(), anchor2.tolist(), strict=True):
            reach[r].add(a)
        meet |= np.array([h in s for h, s in zip(home.tolist(), reach, strict=True)])
    assert meet.all()


def test_fingerprints():
    texts = [None, "", " \n", "One two", "a b c d", "A  b\tc d e f g", "a b c d " * 40, "é ß x y z"]
    want = []
    for t in texts:
        w = PLAIN.findall((t or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    for size in (10, 1 << 20):
        assert [int(f) for b in text_blocks(pa.array(texts, pa.string()), PLAIN_WORDS, True, size) for f in simhash.fingerprints(b)] == want


def brute_counts(t):
    w = PLAIN.findall(t)
    grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    hit = [False] * len(w)
    for j in range(len(w) - 7):
        if grams[tuple(w[j : j + 8])] > 1:
            hit[j : j + 8] = [True] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        if PLAIN.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(alphabet="a \n", max_size=80)), min_size=1, max_size=6))
def test_rule_counts(texts):
    got = []
    for b in text_blocks(pa.array(texts), PLAIN_WORDS, block_bytes=50):
        c = rules.counts(b)
        got += np.stack([c[k] for k in rules.COUNTS], 1).tolist()
    assert got == [brute_counts(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé中𝄞 \u07ff\uffff\U0010ffff", max_size=12), st.text(max_size=12)), max_size=6))
def test_characters(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = [points[i:j].tolist() for b in text_blocks(pa.array(texts, pa.string()), PLAIN_WORDS, block_bytes=20) for points, at in [rules.characters(b)] for i, j in zip(at[:-1], at[1:], strict=True)]
    assert got == [[ord(c) for c in t or ""] for t in texts]


def the_block(texts):
    return next(text_blocks(pa.array(texts, pa.string()), PLAIN_WORDS))


def shares(block):
    """(bucket, share) arrays of each text, counted one by one."""
    found = [Counter() for _ in range(len(block))]
    for k, (text, bucket) in enumerate(rules.grams(block)):
        n = Counter(text.tolist())
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[t][(k << rules.BITS) + b] += 1 / n[t]
    return [(np.array(sorted(c), np.int32), np.array([c[x] for x in sorted(c)], np.float32)) for c in found]


def test_probabilities_equal_brute_force():
    rng = np.random.default_rng(4)
    rule = rules.Rule(rng.normal(size=(5 << rules.BITS) + 1), 1.3, -0.2)
    texts = ["", "x", "déjà vu déjà vu", "one two  three one two\nthree", "中文 𝄞 text", "ab"]
    one = lambda gram, kind: int(rules.grams(the_block([gram]))[kind][1][0])
    want = []
    for t in texts:
        total, words = rule.weight[-1], t.split()
        for kind, n in enumerate((1, 2, 2, 3, 4)):
            grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if kind < 2 else [t[i : i + n] for i in range(len(t) - n + 1)]
            total += np.mean([rule.weight[(kind << rules.BITS) + one(g, kind)] for g in grams]) if grams else 0
        want.append(1 / (1 + np.exp(-(1.3 * total - 0.2))))
    assert np.allclose(rule.probabilities(the_block(texts)), want, atol=1e-9)


def test_logistic_regression_is_at_the_optimum_and_calibrated():
    rng = random.Random(8)
    common, good, bad = [f"c{i}" for i in range(30)], [f"g{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    label = np.array([rng.random() < 0.4 for _ in range(900)], int)
    texts = [" ".join(rng.choice((good if rng.random() < (0.62 if y else 0.38) else bad) if rng.random() < 0.3 else common) for _ in range(24)) for y in label]
    rows = shares(the_block(texts))
    weight = rules.logistic_regression(rows[:300], label[:300], 5 << rules.BITS, epochs=300)
    mean = np.full(5 << rules.BITS, rules.LEAST_SHARE)
    for key, share in rows[:300]:
        mean[key] += share / 300
    pull, bias = np.zeros(5 << rules.BITS), 0.0
    for (key, share), y in zip(rows[:300], label[:300], strict=True):
        cost = rules.COST * 300 / (2 * (label[:300] == y).sum())
        side = 1 if y else -1
        force = cost * side / (1 + np.exp(side * (weight[key] @ share + weight[-1])))
        pull[key] += force * share / mean[key]
        bias += force
    assert np.abs(weight[:-1] - pull).max() < 0.05 * np.abs(weight[:-1]).max() and abs(weight[-1] - bias) < 0.02 * max(1, abs(bias))
    rule = rules.fit(rows[:600], label[:600])
    p = 1 / (1 + np.exp(-(rule.slope * rules.margins(rule.weight, rows[600:]) + rule.shift)))
    truth = label[600:]
    assert ((p >= 0.5) == truth).mean() > 0.6 and abs(p.mean() - truth.mean()) < 0.08
    order = np.argsort(p)
    for part in np.array_split(order, 3):  # what is said to be likely is as frequent as that
        assert abs(p[part].mean() - truth[part].mean()) < 0.15


def test_classifier_equals_brute_force():
    """Features, ratios, margins and scores counted in plain Python; the weights are at the hinge loss's optimum."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("Alpha beta gam9 d-1 beta" if i % 2 else "one Two 22 three: two").split() + ["the", "of", "a"]) for _ in range(rng.randint(0, 12))) for i in range(120)]
    label = np.array([i % 2 if i % 9 else 1 - i % 2 for i in range(120)])
    block = the_block(texts)
    shape = lambda w: re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w.replace("A", "\0"))).replace("\0", "A")))
    text, bucket = labelled.distinct(labelled.word_and_shape_grams, block)
    rows = [bucket[text == i].astype(np.int32) for i in range(len(texts))]
    for r, t in zip(rows, texts, strict=True):
        w = t.split()
        shapes = [(shape(x), i > 0 and w[i - 1] == x) for i, x in enumerate(w)]
        assert len(r) == len({("w", x) for x in w} | {("s", x) for x in shapes} | {("ww", *p) for p in zip(w, w[1:], strict=False)} | {("ss", *p) for p in zip(shapes, shapes[1:], strict=False)})
    keep = list(range(80))
    ratio = nbsvm.log_count_ratios([rows[i] for i in keep], label[keep])
    n = [Counter(b for i in keep if label[i] == k for b in rows[i].tolist()) for k in (0, 1)]
    size = 1 << labelled.BITS
    total = [sum(c.values()) + size for c in n]
    for b in set(n[0]) | set(n[1]):
        assert abs(ratio[b] - (np.log((n[1][b] + 1) / total[1]) - np.log((n[0][b] + 1) / total[0]))) < 1e-9
    values = [ratio[rows[i]] / max(1e-12, np.sqrt((ratio[rows[i]] ** 2).sum())) for i in keep]
    sign, cost = np.where(label[keep] == 1, 1.0, -1.0), np.ones(80)
    w = nbsvm.dual_coordinate_descent([rows[i] for i in keep], values, sign, cost, size, epochs=3000)
    x = np.zeros((80, size // 64 + 1))  # only the buckets in use
    used = sorted(set(n[0]) | set(n[1]))
    for k, (i, v) in enumerate(zip(keep, values, strict=True)):
        x[k, [used.index(b) for b in rows[i].tolist()]] = v
    x = np.hstack([x[:, : len(used)], np.ones((80, 1))])
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    found = np.append(w[used], w[-1])
    best, now = loss(found), np.zeros(len(used) + 1)
    for t in range(1, 4000):  # plain subgradient steps never get below it
        now -= (now - x.T @ (cost * sign * (sign * (x @ now) < 1))) / (t + 10)
        assert loss(now) > best * (1 - 1e-3)
    assert loss(now) < best * 1.05
    model = nbsvm.fit(rows, label)
    margin = [sum(float(model.ratio[b]) * float(model.weight[b]) for b in r) / max(1e-12, np.sqrt(sum(float(model.ratio[b]) ** 2 for b in r))) + model.weight[-1] for r in rows]
    want = 1 / (1 + np.exp(-(model.slope * np.array(margin) + model.shift)))
    assert np.allclose(model.scores(text, bucket, len(texts)), want, atol=1e-9)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(np.arange(k * 5, k * 5 + 8), 4, replace=False)) for k in (0, 1) for _ in range(30)]
    sign = np.array([-1.0] * 30 + [1.0] * 30)
    w = dual_coordinate_descent(rows, [np.ones(4) / 2] * 60, sign, np.ones(60), 20)
    assert np.mean([np.sign(w[r].sum() / 2 + w[-1]) == s for r, s in zip(rows, sign, strict=True)]) > 0.8


def test_archive_round_trip_and_damage():
    rng = random.Random(1)
    payloads = [b"", "é<p>".encode() * 50, bytes(rng.randrange(256) for _ in range(3000)), b"\r\n\r\n"]
    records = [warc.record_bytes(i, f"http://x/{i}", p, None) for i, p in enumerate(payloads * 5)] + [warc.record_bytes(None, None, payloads[1], 1)]
    data = warc.write_archive(records)
    read = list(warc.read_archive(data))
    assert [r["payload"] for r in read[:20]] == payloads * 5
    assert read[-1] == {"page_id": None, "payload_bytes": len(payloads[1]), "payload_digest": warc.payload_digest(payloads[1]), "record_type": "revisit", "refers_to": 1, "record_id": "urn:lexstrata:page:-", "refers_to_id": "urn:lexstrata:page:1", "url": None, "payload": None}
    for bad in (data[:-1], data[:-200] + b"x" * 200, data[:6], b"\0" * 10):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    good = records[1]
    for bad in (good.replace(b"Content-Length: ", b"Content-Length: 9"), good.replace(b"sha1:", b"sha1:A"), good.replace(b"WARC-Type", b"WARC-Tipe"), good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parsed_record(bad)
    assert list(warc.read_archive(b"")) == []


def foreign_record(kind, block, *more, uuid="0"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid}>", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_archives_of_other_writers():
    """Built by hand, without the writer: warcinfo, uuids, frames without a size, compressed dictionaries, folded headers, chunked bodies."""
    body = b"<p>" + b"word " * 400
    chunks = b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    records = [
        foreign_record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", uuid="info"),
        foreign_record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        foreign_record("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, "Content-Type: application/http;", " msgtype=response", "WARC-Target-URI: http://e/\xff", f"WARC-Payload-Digest: sha1:{sha1(body)}", uuid="a"),
        foreign_record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks, f"WARC-Payload-Digest: sha1:{sha1(b'hello world')}"),
        foreign_record("response", b"a dns answer", "Content-Type: text/dns", f"WARC-Block-Digest: sha1:{hashlib.sha1(b'a dns answer').hexdigest()}", "WARC-Payload-Digest: md5:0"),
        foreign_record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Refers-To: <urn:uuid:a>"),
        foreign_record("revisit", b"", "WARC-Refers-To-Target-URI: http://e/"),
    ]
    content = zstandard.train_dictionary(2000, [bytes([i % 251]) * 5 + body + str(i).encode() * 9 for i in range(300)]).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content))
    frames = []
    for r in records:
        one = packer.compressobj()
        frames.append(one.compress(r) + one.flush())  # sizeless
    for stored in (content, zstandard.ZstdCompressor(write_content_size=False).compress(content)):
        data = struct.pack("<II", 0x184D2A5D, len(stored)) + stored + frames[0] + struct.pack("<II", 0x184D2A50, 3) + b"any" + b"".join(frames[1:])
        got = list(warc.read_archive(data))
        assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "revisit"]
        assert [r["payload"] for r in got] == [b"software: x\r\n", b"GET / HTTP/1.1\r\n\r\n", body, chunks, b"a dns answer", None, None]
        assert got[0]["record_id"] == "urn:uuid:info" and got[2]["page_id"] is None and got[2]["payload_bytes"] == len(body)
        assert (got[5]["refers_to_id"], got[6]["refers_to_id"], got[5]["payload_bytes"]) == ("urn:uuid:a", None, None)
        with pytest.raises(warc.WarcError, match="more than 100 bytes"):
            list(warc.read_archive(zstandard.compress(records[2]), most=100))
    assert [r["record_type"] for r in warc.read_archive(b"".join(zstandard.compress(r) for r in records))][:2] == ["warcinfo", "request"]
    for bad in (records[2].replace(b"word", b"ward"), records[4].replace(b"dns a", b"dnsxa"), records[0].replace(b"WARC-Type", b"WARC-Kind"), records[0].replace(b"WARC/1.0\r\n", b"WARC/1.0\r\nno colon\r\n"), records[3].replace(b"hello", b"jello")):
        with pytest.raises(warc.WarcError):
            warc.parsed_record(bad)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<body><p>a<script>x</p></script><p>b", "a\n\nb"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>one <b>two</b>&nbsp; three<p>four<br>five</article><footer>f</footer>", "T\n\none two three\n\nfour five"),
        ("<body><div class='cookie-notice'>c</div><main><article><header><h1>T</h1><p>by me</p></header><div class='entry-content'><p>first paragraph</p><div class=ad>buy</div><p>second paragraph</p></div><section class='comments'><p>nice article, thanks a lot for it</p></section></article></main><aside>side</aside>", "T\n\nfirst paragraph\n\nsecond paragraph"),
        ("<body><article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><pre>p  q</pre></article>", "x\n\ny\n\n1\n\n2\n\n3\n\np q"),
        ("<body><!-- <p>no</p> --><p title='a>b'>yes</p><form><p>mail</p></form>", "yes"),
    ],
)
def test_extraction(html, text):
    assert htmlmain.extracted(html, None) == text


def test_winning_path_adds_to_the_own_container():
    longer = "some other text, and it is longer " * 9 + "by far"
    page = f"<body><div class='x'><p>short but right</p></div><div class='y'><p>{longer}</p></div><div class='z'>small</div>"
    path = next(p for p, _ in htmlmain.votes("<body><div class='x'><p>words of the article go here</p></div>") if p.endswith("div.x"))
    assert htmlmain.extracted(page, None) == longer
    assert htmlmain.extracted(page, path) == f"short but right\n\n{longer}"
    assert htmlmain.extracted(page, ">no>such") == htmlmain.extracted(page, None)
    assert htmlmain.host("HTTP://user@Ex.org:80/a") == "ex.org:80" and htmlmain.host(None) == ""


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 100_000 + "x", "<blockquote>" * 100_000 + "x", "<b>" * 100_000 + "x", "<li>x" * 100_000, "<a" * 500_000, "<a b=\"> " * 100_000 + "'", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x",
        "<p>" + "<b>" * 50_000 + "<hr>" * 50_000 + "x", "<!--" * 300_000, "<script>" * 100_000, "&" * 1_000_000, "< " * 300_000, "<div class='a b c'>" * 100_000 + "x", "</p>" * 200_000 + "x",
    ],
)
def test_hostile_pages_take_linear_time(html):
    began = time.perf_counter()
    assert htmlmain.extracted(html, htmlmain.votes(html)[0][0] if "x" in html else None) is not None
    assert time.perf_counter() - began < 15


WORD = st.text(alphabet="abcdé&<>\"'", min_size=1, max_size=6)
SENTENCE = st.lists(WORD, min_size=1, max_size=8).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "blockquote", "pre"]), SENTENCE), min_size=1, max_size=6), st.booleans(), st.sampled_from([" ", "\n", "\t \n"]))
def test_article_blocks_come_back(blocks, nested, gap):
    body = "".join(f"<{t}>{gap}" + gap.join(f"<em>{escape(w)}</em>" for w in s.split(" ")) + f"{gap}</{t}>" for t, s in blocks)
    inner = f"<div class='wrap'>{body}</div>" if nested else body
    page = f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><a href='/'>home</a></nav><!-- no --><article><header><p>by me</p></header>{inner}<form>mail <input></form><div class='share-bar'>share</div></article><aside>more</aside><footer>end</footer><script>x('<p>no</p>')</script></body></html>"
    assert htmlmain.extracted(page, None) == "\n\n".join(s for _, s in blocks)


def test_winning_path_drops_no_part_of_an_article():
    page = "<body><main><article><p>four of ten words are here</p></article><section><p>and the six others of the page are in this one</p></section></main>"
    path = next(p for p, _ in htmlmain.votes("<body><main><article><p>words of the article go here</p></article></main>") if p.endswith("main>article"))
    assert htmlmain.extracted(page, path) == "four of ten words are here\n\nand the six others of the page are in this one"


def test_ids_and_formulas_of_an_article_stay():
    page = (
        "<body><article><p>first words</p><section id='discussion'><h2 id='related-work'>Related</h2><p id='comment'>said here</p></section><h3 id='copyright'>Rights</h3>"
        "<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p><div id='comments'>me too</div><section class='related'>more</section></article><section id='discussion'>outside</section>"
    )
    assert htmlmain.extracted(page, None) == "first words\n\nRelated\n\nsaid here\n\nRights\n\nso x+1 holds"


LONG = "words of the article that go on for long. " * 10
WRAPPERS = ["sidebar-right", "layout-sidebar", "page header-fixed", "site-search-page", "two-col rail", "content-comment-page", "post legal", "banner", "widget notice"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("inner", ["<main><h1>T</h1><p>{}</p></main>", "<article><h1>T</h1><p>{}</p></article>", "<div><h1>T</h1><p>{}</p></div>"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_an_article_stays_whatever_its_wrappers_are_called(name, inner, kind):
    long = LONG.strip()
    page = f"<body><nav>home</nav><div {kind}='{name}'><div class='ad'>buy</div>{inner.format(long)}</div><div id='x'><p>Powered by</p></div><div class='comments'><p>me too</p></div></body>"
    assert htmlmain.extracted(page, None) == f"T\n\n{long}"
    tiny = f"<body><div {kind}='{name}'>{inner.format('tiny')}</div></body>"
    assert htmlmain.extracted(tiny, None) == "T\n\ntiny"


PARTS_OF_ARTICLES = ["<div class='legal-analysis'>{}</div>", "<p class='share-price'>{}</p>", "<div class='related-work'>{}</div>", "<div class='search-results'>{}</div>", "<p class='comment-free'>{}</p>", "<div class='has-sidebar no-comments'>{}</div>", "<p>{}</p>", "<table><tr><td class='header-cell'>{}</table>"]
BOILERPLATE = ["<div class='ad'>{}</div>", "<div class='comments'><p>{}</p></div>", "<aside>{}</aside>", "<form>{}</form>", "<nav>{}</nav>", "<div class='share-buttons'>{}</div>", "<div id='cookie-banner'>{}</div>", "<ul class='related-posts'><li>{}</ul>", "<div class='newsletter'>{}</div>", "<div class='commentList'>{}</div>", "<div class='ad-slot-3'>{}</div>"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 10)), min_size=1, max_size=12), st.sampled_from(WRAPPERS), st.sampled_from(["main", "article", "div"]), st.randoms(use_true_random=False))
def test_parts_of_articles_stay_and_boilerplate_goes(parts, wrapper, tag, rng):
    """The page is made of blocks that say themselves whether they are the article's."""
    body, want = [f"<h1>Title</h1><p>{LONG * 3}</p>"], ["Title", (LONG * 3).strip()]
    for k, (mine, which) in enumerate(parts):
        text = " ".join(f"{rng.choice(['one', 'two', 'three'])}{k}" for _ in range(rng.randint(1, 20)))
        body.append((PARTS_OF_ARTICLES[which % len(PARTS_OF_ARTICLES)] if mine else BOILERPLATE[which % len(BOILERPLATE)]).format(text))
        if mine:
            want.append(text)
    page = f"<html><body><header>site</header><div class='{wrapper}'><{tag}>{''.join(body)}</{tag}></div><footer>end</footer></body></html>"
    assert htmlmain.extracted(page, None) == "\n\n".join(want)


def test_text_beside_the_best_container_stays():
    a, b = ("first part of the text. " * 20).strip(), ("second part of the text. " * 8).strip()
    links = "<a href='/'>an old story of ours</a> " * 9
    for one, two in (("<article>{}</article>", "<section>{}</section>"), ("<div class='post'>{}</div>", "<div class='post'>{}</div>"), ("<article>{}</article>", "<p>{}</p>"), ("<section>{}</section>", "<td>{}</td>")):
        page = f"<body>{one.format('<p>' + a)}{two.format(b)}<div>{links}</div><div>Powered by</div></body>"
        assert htmlmain.extracted(page, None) == f"{a}\n\n{b}"
        page = f"<body>{one.format('<p>' + b)}{two.format(a)}<div>{links}</div><div>Powered by</div></body>"
        assert htmlmain.extracted(page, None).startswith(f"{b}\n\n{a}")
    page = f"<body><main><article><p>{a}</p></article></main><div>{b}</div></body>"
    assert htmlmain.extracted(page, None) == a  # a page with main says what is outside


def test_winner_and_own_container_meet():
    a, b = ("what the host's path holds here. " * 4).strip(), ("what is longest in this page. " * 12).strip()
    page = f"<body><div class='page'><div class='x'><p>{a}</p></div><p>between</p><div class='y'><p>{b}</p></div></div><div>Powered by</div></body>"
    path = next(p for p, _ in htmlmain.votes(f"<body><div class='page'><div class='x'><p>{a}</p></div></div></body>") if p.endswith("div.x"))
    assert htmlmain.extracted(page, path) == f"{a}\n\nbetween\n\n{b}"


def test_forms_and_menus_around_a_whole_page():
    long = LONG.strip()
    assert htmlmain.extracted(f"<body><form action='x'><div><p>{long}</p></div><form><input>mail</form></form></body>", None).startswith(long)
    assert htmlmain.extracted(f"<body><nav>never closed <main><p>{long}</p></main></body>", None) == long
    assert htmlmain.extracted(f"<body><div class='post'><p>short text</p></div><div id='comments'><p>{long}</p></div></body>", None) == "short text"


def test_whole_runs():
    block = next(text_blocks(pa.array(["a b c", "d", "e f"]), PLAIN_WORDS))
    assert whole_runs(block, 2).tolist() == [0, 1, 4] and whole_runs(block, 9).tolist() == []


GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("tag", "said"),
    [
        ("MIT", "MIT"), (" mit */", "MIT"), ("(MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("GPL-2.0+ WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"),
        ("MIT and (isc or EUPL-1.2) -->", "MIT AND (ISC OR EUPL-1.2)"), ("LicenseRef-own", "LicenseRef-own"), ("MIT OR", "MIT"), ("MIT License", "MIT"), ("", None), ("*/", None), ("((MIT)", None), ("(MIT) OR (ISC)", "(MIT) OR (ISC)"), ("MIT-0", "MIT-0"),
    ],
)
def test_spdx_expressions(tag, said):
    assert licenses.expression(tag) == said
    assert licenses.tagged(f"x\n# SPDX-License-Identifier: {tag}\ny") == said


def brute_weights(files):
    """Document frequencies by bucket, without the operator's arrays."""
    n, seen = len(files), Counter()
    for f in files:
        seen.update({int(licenses.bucket_of(licenses._hashes([w]))[0]) for w in set(plain_words(f))})
    return lambda w: math.log((1 + n) / (1 + seen[int(licenses.bucket_of(licenses._hashes([w]))[0])])) + 1


def plain_words(text):
    return [w.translate(LOWER) for w in FOLDED.findall((text or "").translate(LOWER))]


def brute_best(words, idf):
    """The best template by cosine, among those whose name, version in place and marks the words have."""
    def vector(ws):
        return {w: c * idf(w) for w, c in Counter(ws).items()}

    mine, best = vector(words), (0.0, None)
    norm = math.sqrt(sum(v * v for v in mine.values()))
    beside = set(zip(words, words[1:]))
    for licence, text in licence_texts.TEMPLATES:
        ws = plain_words(text)
        version = re.search(r"-(\d+(?:\.\d+)*)$", licence)
        digits = version[1].split(".") if version else []
        need = {w for w in plain_words(licence) if w.isalpha()} | set(digits) | (set(plain_words(licence)) if "clause" in ws else set())
        if not (need & set(ws)) <= set(words):
            continue
        said = max(((n, -p) for p in range(1, len(ws)) for n in range(1, len(digits) + 1) if [ws[p].removeprefix("v"), *ws[p + 1 : p + n]] == digits[:n]), default=None)
        pairs = {(ws[-said[1] + i - 1], ws[-said[1] + i]) for i in range(said[0])} if said else set()
        if "clause" in ws:
            pairs.add((ws[ws.index("clause") - 1], "clause"))
        if not pairs <= beside:
            continue
        marks = [w for family, m in licence_texts.MARKS for w in m.split() if any(licence == f or licence.startswith(f + "-") for f in family.split()) or family == "CC" and licence.startswith("CC")]
        if any((w in ws) != (w in words) for w in marks):
            continue
        theirs = vector(ws)
        cosine = sum(v * theirs.get(w, 0) for w, v in mine.items()) / norm / math.sqrt(sum(v * v for v in theirs.values()))
        if round(cosine, 5) > round(best[0], 5):
            best = (cosine, licence)
    return best if best[0] >= licenses.THRESHOLD else (0.0, None)


def test_licences_equal_brute_force_over_all_templates():
    rng = random.Random(5)
    texts = [t for _, t in licence_texts.TEMPLATES]
    files = [t + "\n" + rng.choice(["x = 1", "x = 2\nversion = 3", "print(1)", "int main(void) { return 3; }", "plain words of some other kind"]) for t in texts]
    files += [rng.choice(texts)[: rng.randint(20, 200)] for _ in range(60)] + [GPL_NOTICE.format(v) for v in (1, 2, 3, 4)] + ["some text", "license"]
    block = next(text_blocks(pa.array(files), FOLDED_WORDS, True, 1 << 30))
    buckets = Counter()
    for f in files:
        buckets.update({int(b) for b in licenses.bucket_of(licenses._hashes(plain_words(f)))})
    weights = licenses.Weights.of(len(files), np.array(list(buckets)), np.array(list(buckets.values())))
    h = licenses._HASH.words(block)
    cosine, which = weights.best(h, licenses._KNOWN.terms(h), block.text_of_word(), len(files), licenses.THRESHOLD)
    idf = brute_weights(files)
    for f, c, k in zip(files, cosine, which, strict=True):
        want, licence = brute_best(plain_words(f), idf)
        assert abs(c - want) < 1e-4 and (licenses._KNOWN.licences[k] if k >= 0 else None) == licence, f
    found, *_ = licenses.chosen(weights, block, licenses.THRESHOLD)
    assert [x for x in found[: len(texts)]] == [name for name, _ in licence_texts.TEMPLATES]  # code under a notice changes nothing
