"""A training corpus from raw documents, in five stages; each reads what the one before has kept.

1. ``quality classifier``: documents whose predicted quality is below 0.3 go.
2. ``quality rules``: documents that fail the base rules or the likelihood ratio go.
3. ``line dedup``: lines that many documents share go, except in one document.
4. ``near duplicates``: of every group of similar documents the one with the largest id stays.
5. ``packing``: the rest is packed into token sequences.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard_join, line_dedup, packing, quality_rules, subword_classifier
from kindred.llm.bloom import rows_without_ids
from kindred.llm.common import stored, table
from kindred.llm.queries import packed_pieces, quality_labels


#: columns that stages read or change
OWN = ["doc_id", "text", "n_chars"]


def beside_own(stage):
    """The stage with all other columns carried along under plain names, so that none can clash with its own."""

    @wraps(stage)
    def guarded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"column_{i}" for i, c in enumerate(docs.columns)}
        inner = docs.toDF(*names.values())
        return stage(spark, inner, sf_dir).select(*names.values()).toDF(*names)

    return guarded


@beside_own
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fifth; empty texts are scored like any other."""
    model = subword_classifier.fit(docs, quality_labels(spark, sf_dir))
    return subword_classifier.score(docs, model).where("_score >= 0.3")


@beside_own
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, trusted).where("_kept")


@beside_own
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the shortened text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))


@beside_own
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies and documents linked over any number of steps are one group, of which one row stays whatever the ids."""
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-documents", compression="zstd")
    found = jaccard_join.similar_rows(docs, "row")
    return rows_without_ids(docs, "row", found.where("row <> group_row").select("row")).drop("row")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, its ids' digest, its sequence and its place there."""
    return packed_pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: a learned score and token ids are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each stage returns is written out and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
