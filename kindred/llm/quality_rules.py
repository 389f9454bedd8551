"""Quality rules: base counts, and a likelihood ratio between a trusted and the raw corpus.

Character n-grams are hashed into a fixed number of buckets. Two multinomials are counted over them:
one over all documents (raw), one over the trusted documents (target). A document's score is the
mean over its n-grams of ln(target(b) / raw(b)); it is kept if it passes the base rules and the score
reaches a fixed threshold. Nothing is sampled: equal texts always get equal verdicts. Words are an
open class, so with a growing corpus every bucket of words fills with rare ones and the ratios
fade; short character sequences are nearly closed, and the same threshold separates at any size.

Plan: one scan of all texts and one of the trusted ones leave one vector of counts per task, which are
added up chunk by chunk. Which texts are trusted is settled by a join on the id, behind a
Bloom filter of the trusted ids, so that other texts are not exchanged. The finished table of log ratios
has ``2 ** bits`` entries whatever the corpus holds; it goes to the tasks of the last scan with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import Block, char_grams, mix, repeated, row_blocks
from kindred.llm.bloom import rows_with_ids
from kindred.llm.common import CHUNK, Batches, added, columns_ddl, count_chunks, in_arrow, without

#: hashed n-gram buckets, as a power of two
BITS = 16
#: characters of an n-gram
GRAM = 4
#: smallest mean log ratio of a kept document
THRESHOLD = -0.35
#: n-grams at the raw rate that every bucket of the target is given beforehand; what was seen only
#: a few times says little about either side
PRIOR = 4.0
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def repeat_words(words: np.ndarray, docs: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Words by text that lie in a window found at least twice in the same text."""
    places = len(words) - window + 1
    if places < 1:
        return np.zeros(n_docs, np.int64)
    key = np.zeros(places, np.uint64)
    for k in range(window):
        key = mix(key + words[k : k + places])
    at = np.flatnonzero(docs[:places] == docs[window - 1 :])
    many, _ = repeated(mix(key[at] + docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[many], 1)
    np.add.at(edge, at[many] + window, -1)
    return np.bincount(docs[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def base_counts(block: Block, words: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, docs = words
    chars = block.chars()
    symbol = np.flatnonzero(np.isin(block.data, np.frombuffer(SYMBOLS, np.uint8)))
    first, last, line_docs = block.lines()
    n_before = np.searchsorted(start, np.stack([first, last]))
    worded = n_before[1] > n_before[0]
    first, last, line_docs = first[worded], last[worded], line_docs[worded]
    _, again = repeated(mix(block.hashes(first, last) + line_docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return [
        block.per_doc(docs),
        block.per_doc(docs, (chars[end] - chars[start]).astype(float)).astype(np.int64),
        block.per_doc(block.docs_of(symbol)),
        block.per_doc(line_docs[again]),
        repeat_words(hashes, docs, block.n),
    ]


def bucket_counts(docs: DataFrame, trusted: DataFrame, bits: int = BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Corpus counts (target, chunk, counts) over all documents and, with ``target`` true, over all trusted ones.

    ``trusted`` holds ids; repeated ones count once, unknown and null ones not at all.
    """
    ids = trusted.select(F.col(doc_id))
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def count(batches: Batches) -> Batches:
        total = np.zeros(1 << bits, np.int64)
        for _, block in row_blocks(batches, "_text"):
            bucket, _ = char_grams(*block.code_points(), GRAM, bits)
            total += np.bincount(bucket, minlength=1 << bits)
        chunks = list(count_chunks(total))
        if chunks:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in chunks], pa.int32()), "counts": [x for _, x in chunks]})

    def counted(rows: DataFrame, target: bool) -> DataFrame:
        return in_arrow(rows.select("_text"), count, "chunk int, counts binary").withColumn("target", F.lit(target))

    both = counted(source, False).unionByName(counted(rows_with_ids(source, "_id", ids), True))
    return added(both, ["target", "chunk"])


def log_ratios(counts: DataFrame, bits: int = BITS, prior: float = PRIOR) -> np.ndarray:
    """The table ln(target / raw) of all ``2 ** bits`` buckets; zero everywhere without trusted text."""
    sums = np.zeros((2, 1 << bits))
    for target, chunk, part in counts.select("target", "chunk", "counts").toPandas().itertuples(index=False):
        sums[int(target), chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(part, np.int64)
    raw, target = sums
    if not target.sum():
        return np.zeros(1 << bits)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def score_rules(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of the documents, and a struct ``_rules`` with the base counts and the mean log ratio.

    The log ratio of a text shorter than an n-gram is null.
    """
    bits = int(len(ratios)).bit_length() - 1
    docs = without(docs, "_rules", "_base_failed", "_kept")

    def score(batches: Batches) -> Batches:
        for batch, block in row_blocks(batches, text):
            start, end, at = block.words()
            counts = base_counts(block, (start, end, at), block.hashes(start, end))
            bucket, of = char_grams(*block.code_points(), GRAM, bits)
            n = block.per_doc(of)
            mean = block.per_doc(of, ratios[bucket]) / np.maximum(n, 1)
            fields = [pa.array(c.astype(np.int64)) for c in counts] + [pa.array(mean, mask=n == 0)]
            names = [f.split()[0] for f in RULES.split(", ")]
            rules = pa.StructArray.from_arrays(fields, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, rules], [*batch.schema.names, "_rules"])

    fields = ", ".join(f.replace(" ", ": ") for f in RULES.split(", "))
    return in_arrow(docs, score, f"{columns_ddl(docs)}, _rules struct<{fields}>")


def quality_rules(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The documents with ``_rules`` (base counts, ``llr``), ``_base_failed`` and ``_kept``.

    Every input row gives one row, all its columns unchanged (repeated rows included). A null text
    counts as empty; a text without words fails the base rules. Without trusted documents every ratio
    is 0, so only the base rules decide. Empty tables give empty results. Columns of
    the input with these three names are replaced.
    """
    ratios = log_ratios(bucket_counts(docs, trusted, bits, text, doc_id), bits)
    r = F.col("_rules")
    failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"])
    scored = score_rules(docs, ratios, text).withColumn("_base_failed", failed)
    return scored.withColumn("_kept", ~F.col("_base_failed") & (F.coalesce(r["llr"], F.lit(-1e9)) >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label row marks as good and none as bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
