"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax on top.

Every bucket of words and of character n-grams has a learned vector. A document is the mean of the
vectors of all its words and n-grams; a softmax layer turns it into class probabilities. Vectors and
layer are learned together by stochastic gradient descent in numpy.

Training uses at most ``MAX_TRAIN`` labelled documents (those with the smallest hashes of their id), as
sparse counts of at most ``2 ** BITS`` buckets each; that bound holds at every corpus size and is the
only sampling. Scoring reads every document in one scan without any exchange. Since the mean
and the layer are linear, the layer is applied to the vectors once, and a document's logit is the mean
of one number per word and n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import Block, char_grams, row_blocks
from kindred.llm.common import Batches, columns_ddl, in_arrow, without

#: buckets, as a power of two: the lower half for words, the upper for character n-grams
BITS = 16
GRAMS = (3, 4)
#: documents to learn from, at most
MAX_TRAIN = 4000
DIM, EPOCHS, RATE, BATCH, SEED = 12, 12, 0.6, 8, 7


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and character n-grams, and their texts."""
    half = 1 << (BITS - 1)
    start, end, docs = block.words()
    buckets, of = [(block.hashes(start, end) >> np.uint64(65 - BITS)).astype(np.int64)], [docs]
    points, offsets = block.code_points()
    for n in GRAMS:
        bucket, docs = char_grams(points, offsets, n, BITS - 1)
        buckets.append(bucket + half)
        of.append(docs)
    return np.concatenate(buckets), np.concatenate(of)


def sparse_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and its distinct buckets (``_bucket``, 16-bit) with their shares (``_share``, 32-bit)."""
    kept = [c for c in docs.columns if c != text]

    def rows(batches: Batches) -> Batches:
        for batch, block in row_blocks(batches, text):
            bucket, of = features(block)
            key, count = np.unique((of << BITS) | bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(block.n + 1) << BITS)
            total = np.maximum(block.per_doc(of), 1)
            share = (count / total[key >> BITS]).astype(np.float32)
            bucket = (key & ((1 << BITS) - 1)).astype(np.uint16)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (bucket, share)],
                [*kept, "_bucket", "_share"],
            )

    return in_arrow(docs, rows, f"{columns_ddl(docs.drop(text))}, _bucket binary, _share binary")


@dataclass
class Model:
    """One number per bucket (the difference of the two logits) and a bias."""

    weight: np.ndarray
    bias: float

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """Learn from (label, buckets, shares). Without rows of both classes the score is the share of label 1, or 0.5."""
    labels = np.array([r[0] for r in rows], int)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.log(np.array([1 - prior, prior])).astype(np.float32)
    if len(set(labels.tolist())) == 2:
        steps = epochs * len(rows)
        step = 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                rate = RATE * (1 - step / steps)
                step += 1
                label, bucket, share = rows[i]
                mean = share @ vectors[bucket]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = layer @ p
                layer -= rate * np.outer(mean, p)
                bias -= 0.1 * rate * p
                # shares are small; the vectors' rate is scaled so that a document moves its own mean by a fixed part
                norm = float(share @ share)
                vectors[bucket] -= np.outer(share * (rate / max(norm, 1e-6) * 0.2), back)
    effect = layer[:, 1] - layer[:, 0]
    return Model((vectors @ effect).astype(np.float64), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, text: str = "text") -> DataFrame:
    """(_label, _bucket, _share) of at most ``limit`` labelled documents.

    ``labels`` is (doc_id, label). An id with several label rows has the smallest of them; null labels and
    ids do not count. The chosen ids are at most ``limit`` rows, so they are sent to every task.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_labelled"), F.col("label").cast("int").alias("_label"))
        .where("_labelled is not null and _label in (0, 1)")
        .groupBy("_labelled").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_labelled", F.lit(SEED)), "_labelled").limit(limit)
    )
    found = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    return sparse_features(found.select("doc_id", "_label", "_text"), "_text")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, text: str = "text") -> Model:
    """Learn from the bounded sample; rows are put in id order first, so the result does not depend on partitions."""
    rows = training_rows(docs, labels, limit, text).toPandas().sort_values("doc_id", kind="stable")
    rows = rows.drop_duplicates("doc_id")
    return train([
        (int(y), np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float32))
        for y, b, s in zip(rows["_label"], rows["_bucket"], rows["_share"], strict=True)
    ])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of the documents, and ``_score``, the probability of label 1.

    A null or empty text has no features and gets the probability the bias alone gives.
    A column ``_score`` of the input is replaced.
    """
    weight, bias = model.weight, model
    docs = without(docs, "_score")

    def rows(batches: Batches) -> Batches:
        for batch, block in row_blocks(batches, text):
            bucket, of = features(block)
            mean = block.per_doc(of, weight[bucket]) / np.maximum(block.per_doc(of), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bias.probability(mean))], [*batch.schema.names, "_score"])

    return in_arrow(docs, rows, f"{columns_ddl(docs)}, _score double")
