"""Quality rules: counts with fixed thresholds, and a learned rule.

The learned rule is a logistic regression on hashed n-grams of words and of
characters (relative frequencies), fitted on three quarters of the labelled
quality rows.  A logistic curve turns its margins into probabilities; the curve
is fitted to the same model's margins on the last quarter, which the model
hasn't seen.  Texts are measured and scored in Arrow batches; a text is kept if
it passes the count rules and its probability reaches the threshold.

Cases: null and empty texts have no words, so they fail the count rules; a
text with words but no 3-gram is scored by its words and the bias; repeated
rows are judged one by one; without labels of both classes the learned rule
lets everything pass; extra columns are ignored, and an empty table gives no
rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.labelled import SAMPLE_ROWS, labelled_sample, platt, sigmoid
from lexstrata.llm.memory import tidy
from lexstrata.llm.wordspans import PLAIN_WORDS, Block, RollingHash, _spans, mix, text_blocks, whole_runs

BITS = 17
COST = 1.0
EPOCHS = 40
#: Added to a bucket's mean share before shares are scaled by its root.
LEAST_SHARE = 1e-4
WORD_GRAMS = (1, 2)
CHAR_GRAMS = (2, 3, 4)
MIN_WORDS = 20
REPEAT_WORDS = 8
MAX_REPEAT_PERCENT = 30
MIN_PROBABILITY = 0.5

_HASH = RollingHash(0xC0DE)
#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(code points of a block's texts, n + 1 offsets of the texts in them)."""
    lead = (block.data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = block.data[at].astype(np.uint32)
    out = first.copy()
    follow = np.concatenate([block.data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        wide = np.flatnonzero((first >= low) & (first < (0x100 if size == 4 else low + (0x20 >> (size - 2)))))
        point = first[wide] & mask
        for k in range(1, size):
            point = point << np.uint32(6) | follow[at[wide] + k]
        out[wide] = point
    return out, np.concatenate([[0], np.cumsum(lead)])[block.text_at]


def grams(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram occurrence, one pair of arrays for each kind.

    Character n-grams are runs of code points from the first to the last one of
    a text, white space included.
    """
    out, words, text = [], _HASH.words(block), block.text_of_word()
    for n in WORD_GRAMS:
        at = whole_runs(block, n)
        key = _HASH.runs(words, n)[at] if len(at) else np.zeros(0, np.uint64)
        out.append((text[at], mix(key + np.uint64(n)) >> np.uint64(64 - BITS)))
    points, text_at = characters(block)
    owner = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(text_at))
    for n in CHAR_GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.uint32)))
            continue
        key = np.full(m, n, np.uint32)
        for j in range(n):
            key = (key ^ points[j : j + m]) * np.uint32(0x01000193) + (key >> np.uint32(17))
        inside = owner[:m] == owner[n - 1 :]
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        key = (key ^ (key >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append((owner[:m][inside], key[inside] >> np.uint32(32 - BITS)))
    return out


@dataclass
class Rule:
    weight: np.ndarray  # buckets of each kind of n-gram, one kind after another; then the bias
    slope: float = 1.0
    shift: float = 0.0

    def probabilities(self, block: Block) -> np.ndarray:
        total = np.full(len(block), float(self.weight[-1]))
        for k, (text, bucket) in enumerate(grams(block)):
            n = np.bincount(text, minlength=len(block))
            total += np.bincount(text, self.weight[(k << BITS) + bucket.astype(np.int64)], len(block)) / np.maximum(n, 1)
        return sigmoid(self.slope * total + self.shift)


def _features(rows: DataFrame) -> DataFrame:
    """(label, buckets BINARY int32, shares BINARY float32) of each labelled text."""

    def features(batches):
        for b in batches:
            for block in text_blocks(b.column("text"), PLAIN_WORDS):
                keys, shares, owners = [], [], []
                for k, (text, bucket) in enumerate(grams(block)):
                    n = np.bincount(text, minlength=len(block))
                    key, count = np.unique(text.astype(np.int64) << BITS | bucket.astype(np.int64), return_counts=True)
                    owners.append(key >> BITS)
                    keys.append((k << BITS) + (key & ((1 << BITS) - 1)))
                    shares.append(count / n[key >> BITS])
                owner = np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                key, share = np.concatenate(keys)[order].astype("<i4"), np.concatenate(shares)[order].astype("<f4")
                cut = np.searchsorted(owner[order], np.arange(len(block) + 1))
                pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column("label").slice(block.first_row, len(block)), pick(key), pick(share)], names=["label", "buckets", "shares"])

    return rows.select("label", "text").mapInArrow(tidy(features), "label int, buckets binary, shares binary")


def logistic_regression(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights and bias of min |w|^2 / 2 + sum of cost * log loss, by dual coordinate descent.

    rows: (bucket, share) arrays.  Shares are scaled by the root of a bucket's
    mean share, so that rare n-grams count beside frequent ones; the scales go
    into the weights.  Both classes weigh the same.
    """
    mean = np.full(size, LEAST_SHARE)
    for key, share in rows:
        mean[key] += share / len(rows)
    scale = 1 / np.sqrt(mean)
    values = [(share * scale[key]).astype(np.float32) for key, share in rows]
    square = [float(v @ v) + 1 for v in values]
    n1 = max(1, int(label.sum()))
    most = [cost * len(label) / (2 * (n1 if y else max(1, len(label) - n1))) for y in label]
    sign = np.where(label == 1, 1.0, -1.0).tolist()
    alpha = [c / 2 for c in most]
    w, bias = np.zeros(size), 0.0
    for (key, _), v, a, y in zip(rows, values, alpha, sign, strict=True):
        w[key] += a * y * v
        bias += a * y
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            key, v, q, c, a, y = rows[i][0], values[i], square[i], most[i], alpha[i], sign[i]
            # The dual's derivative is zero at new = c * sigmoid(t) with t + q * (new - a) + margin = 0.
            rest = y * (float(w[key] @ v) + bias) - q * a
            t = math.log(a / (c - a))
            for _ in range(12):
                s = 1 / (1 + math.exp(-max(-35.0, min(35.0, t))))
                step = (t + q * c * s + rest) / (1 + q * c * s * (1 - s))
                t -= step
                if abs(step) < 1e-6:
                    break
            new = min(max(c / (1 + math.exp(-max(-35.0, min(35.0, t)))), 1e-12 * c), c * (1 - 1e-12))
            if new != a:
                w[key] += (new - a) * y * v
                bias += (new - a) * y
                moved = max(moved, abs(new - a) / c)
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w * scale, bias)


def margins(weight: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([float(weight[key] @ share) + weight[-1] for key, share in rows])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Rule:
    """A model of three quarters of the rows, with the curve of its margins on the others."""
    size = (len(WORD_GRAMS) + len(CHAR_GRAMS)) << BITS
    if len(set(label.tolist())) < 2:
        return Rule(np.append(np.zeros(size), 40.0))
    part = np.arange(len(rows)) % 4
    keep, out = np.flatnonzero(part), np.flatnonzero(part == 0)
    if len(set(label[keep].tolist())) < 2 or len(set(label[out].tolist())) < 2:  # too few rows to set some aside
        return Rule(logistic_regression(rows, label, size))
    weight = logistic_regression([rows[i] for i in keep], label[keep], size)
    return Rule(weight, *platt(margins(weight, [rows[i] for i in out]), label[out]))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS // 2) -> Rule:
    found = _features(labelled_sample(documents, labels, "quality", sample_rows, held_out=False)).collect()
    found.sort(key=lambda r: (bytes(r["buckets"]), r["label"]))
    order = np.random.default_rng(7).permutation(len(found))
    rows = [(np.frombuffer(found[i]["buckets"], "<i4"), np.frombuffer(found[i]["shares"], "<f4")) for i in order]
    return fit(rows, np.array([int(found[i]["label"] > 0) for i in order]))


def counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of the rules for each text of a block."""
    n = len(block)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[block.text_at])
    data = block.data
    in_word = PLAIN_WORDS[data] & ((data & 0xC0) != 0x80)
    lines = _spans(data, block.text_at, _LINES, 0)
    first = np.searchsorted(block.starts, lines.starts)
    with_word = (first < len(block.starts)) & (np.append(block.starts, len(data) + 1)[first] < lines.ends)
    owner, line = lines.text_of_word()[with_word], _HASH.words(lines)[with_word]
    kinds = np.unique(np.stack([owner.astype(np.uint64), line], 1), axis=0)[:, 0].astype(np.int64) if len(line) else owner
    words, text = _HASH.words(block), block.text_of_word()
    at = whole_runs(block, REPEAT_WORDS)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        key = mix(_HASH.runs(words, REPEAT_WORDS)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.append(same, False) | np.insert(same, 0, False)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WORDS, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return {
        "n_words": block.counts(),
        "word_chars": per_text(in_word),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(kinds, minlength=n),
        "n_repeat_words": np.diff(repeated[block.word_at]),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(documents: DataFrame, rule: Rule, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of every document."""
    weight = rule.weight.astype(np.float32)
    small = Rule(weight, rule.slope, rule.shift)

    def judged(batches):
        for b in batches:
            for block in text_blocks(b.column("text"), PLAIN_WORDS):
                found, p = counts(block), small.probabilities(block)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
                values = [b.column("doc_id").slice(block.first_row, len(block)), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(~failed & (p >= min_probability)), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(judged), f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, probability double")


def kept_rows(documents: DataFrame, rule: Rule, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The documents' rows, all columns, that the rules keep."""
    names = documents.columns
    where = names.index("text")

    def filtered(batches):
        small = Rule(rule.weight.astype(np.float32), rule.slope, rule.shift)
        for b in batches:
            keep = [np.zeros(0, bool)]
            for block in text_blocks(b.column(where), PLAIN_WORDS):
                found = counts(block)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
                keep.append(~failed & (small.probabilities(block) >= min_probability))
            yield b.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(tidy(filtered), documents.schema)


def quality_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS // 2) -> DataFrame:
    return judge(documents, train(documents, labels, sample_rows))
