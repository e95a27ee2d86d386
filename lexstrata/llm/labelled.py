"""Labelled rows for fitting, hashed n-gram features, and calibration.

Cases: labels without an id or a value are left out; of several labels of an id
the largest counts; each text of a repeated doc_id is taken once; null and empty
texts have no n-grams; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.wordspans import PLAIN_WORDS, Block, RollingHash, mix, text_blocks, whole_runs

BITS = 18
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 20

_HASH = RollingHash(0x5EED)
#: Bytes to classes: letters, capitals, digits, and every other byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def in_fold(doc_id, fold: int = 1, folds: int = 3):
    """Whether crc32 of the id as text falls in the held-out fold; a null id doesn't."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample_rows: int, held_out: bool, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``sample_rows`` different labelled texts of at most ``sample_bytes`` in all, in the order of a hash of their ids.

    With ``held_out``, none of the fold that is scored as held out.  The ids
    are bounded by ``sample_rows``, so they are broadcast to the documents; of
    their texts the first are taken that fit, each once for its id.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if held_out:
        rows = rows.where(~in_fold(F.col("doc_id")))
    chosen = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("key", F.sha2("text", 256))
    sizes = found.groupBy("doc_id", "key").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size"))
    place = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("key")]
    first = sizes.where(F.col("size") <= sample_bytes).orderBy(*place).limit(sample_rows)
    fits = first.withColumn("so_far", F.sum("size").over(Window.orderBy(*place))).where(F.col("so_far") <= sample_bytes)
    of = fits.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"))
    return found.join(F.broadcast(of), (F.col("doc_id") == F.col("of_id")) & F.col("key").eqNullSafe(F.col("of_key"))).dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "label")


def distinct(keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram that a text has, once."""
    text, bucket = keys_of(block)
    key = np.unique(text.astype(np.int64) << BITS | bucket.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def word_and_shape_grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of 1- and 2-grams of words and of word shapes.

    A shape is the word's byte classes with repeats of a class left out; it
    also says whether the word equals the one before.
    """
    words, text = _HASH.words(block), block.text_of_word()
    shape = _HASH.words(_shapes(block))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shape = np.where(again, mix(shape + np.uint64(1)), shape)
    pair = whole_runs(block, 2)
    parts = [words, shape + np.uint64(0x9E3779B97F4A7C15)] + ([_HASH.runs(words, 2)[pair], _HASH.runs(shape, 2)[pair] + np.uint64(7)] if len(pair) else [])
    at = [text, text] + ([text[pair], text[pair]] if len(pair) else [])
    return np.concatenate(at), mix(np.concatenate(parts)) >> np.uint64(64 - BITS)


def _shapes(block: Block) -> Block:
    shape = _SHAPE[block.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[block.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return Block(shape[keep], at[block.text_at], at[block.starts], at[block.ends], block.word_at, block.first_row)


def binary_rows(rows: DataFrame) -> DataFrame:
    """(label, features BINARY): the distinct buckets of each text, as int32."""

    def features(batches):
        for b in batches:
            label = b.column("label")
            for block in text_blocks(b.column("text"), PLAIN_WORDS):
                text, bucket = distinct(word_and_shape_grams, block)
                cut = np.searchsorted(text, np.arange(len(block) + 1))
                raw = bucket.astype("<i4")
                yield pa.RecordBatch.from_arrays([label.slice(block.first_row, len(block)), pa.array([raw[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["label", "features"])

    return rows.select("label", "text").mapInArrow(tidy(features), "label int, features binary")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) fits the labels, by Newton's method.

    Targets are smoothed by the class counts; a stays positive, so the order
    of margins is kept.
    """
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[np.dot(w, margin * margin) + 1e-3, np.dot(w, margin)], [np.dot(w, margin), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [np.dot(g, margin) + 1e-3 * a, g.sum()])
        step = min(1.0, 5 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(float(a), 1e-3), float(b)
