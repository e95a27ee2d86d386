"""The corpus pipeline: filter, dedup, decontaminate and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``.  Between stages the rows are written to
the shared folder and read again, so each stage starts from a table.  ``run``
removes what a stage wrote on the way once its result is written, and each
stage's rows once the next stage's are.

Nulls, ties, repeated rows, empty tables and extra columns are handled as the
stages' operators say.  Near-dedup keeps one of the texts whose sets of 5-word
shingles are alike at 0.8 or more.  Substring dedup keeps the rows of documents
it empties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm import decontam, packing, rules, simhash, substrings
from lexstrata.llm.shared import mark, remove_stored, stored, table, vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the learned rule is fitted on labelled rows."""
    return rules.kept_rows(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies (5-word shingles alike at 0.8 or more)."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in a document with a smaller doc_id."""
    out = substrings.dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents left."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the learned rule or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        remove_stored(spark, since, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
