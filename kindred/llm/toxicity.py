"""Toxicity by compression distance: windows of a text are compressed with a toxic and with an ordinary zstandard dictionary.

A window that gets shorter with the toxic dictionary holds what is typical of toxic text. Both dictionaries share a
part that zstandard trains on ordinary text, at the same distance from the window, so that everyday text compresses alike
under both. In front of it each has, in equal space, what sets its own class apart: zstandard's own training picks what is
frequent in a class, and that is the same language in both. Distinctive words are those whose documents differ between the
classes by the likelihood-ratio statistic, each held against a fixed value and not against the best word: what marks a rarer language, or is
spread over many words, is as telling in its documents; a document counts for a word only if it has the word in surroundings that no
document before it has, so copies of one text count once.

Half of the labelled sample makes the dictionaries, the other half calibrates: a logistic curve weighs, for every gain in bytes up to ``GAINS``,
whether a window reaches it and the share of those that do, and the number of windows. So short words and long
ones, and languages in which parts of words gain by chance, need not share one threshold. The sample has at most ``MAX_TRAIN`` documents (those with the smallest hashes of their id); that is
the only sampling. Every document is scored by all of its windows in one scan without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import Block, row_blocks, texts_of
from kindred.llm.common import Batches, columns_ddl, in_arrow, stored, without

#: bytes of a window, from one to the next, and of the blanks in front of it: with them every window shrinks, so that
#: none is stored as it is, and lengths change byte by byte
WINDOW, STEP, BLANKS = 64, 32, 64
#: bytes of the shared part of a dictionary, and at most of the own part
SHARED_BYTES, OWN_BYTES = 16 << 10, 2 << 10
#: labelled documents to learn from, at most; windows to train the shared part on, at most, and their bytes
MAX_TRAIN, TRAIN_WINDOWS, TRAIN_WINDOW = 10_000, 20_000, 256
#: a distinctive word's likelihood ratio, at least, and how often its rate in the other class it occurs
MIN_RATIO, TIMES = 20.0, 4.0
#: words of more bytes are no candidates; candidates of a class, at most
WORD_BYTES, MAX_WORDS = 40, 256
#: gains above this count as this
MAX_GAIN = 16
#: windows compressed in one call
TOGETHER = 20_000
#: gains that have a threshold of their own
GAINS = 8
SEED = 11


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of all windows; a text without bytes has none."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STEP) // STEP)), 0)
    of = np.repeat(np.arange(len(size)), count)
    start = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return start, np.minimum(WINDOW, offsets[of + 1] - start), of


def _lower(block: Block) -> Block:
    return Block(pa.array([t.lower() for t in block.texts.to_pylist()], pa.large_string()))


_compressors: dict[bytes, object] = {}


def _compressor(dictionary: bytes):
    """One compressor per dictionary and worker; content is used as it is, without entropy tables."""
    import zstandard

    if dictionary not in _compressors:
        options = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=options)
        _compressors[dictionary] = zstandard.ZstdCompressor(dict_data=content, compression_params=options)
    return _compressors[dictionary]


def framed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[bytes, bytes]:
    """All windows end to end, blanks in front and up to equal length, and their places."""
    size = BLANKS + WINDOW
    cells = np.full((len(start), size), 32, np.uint8)
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    cells[:, BLANKS:] = np.where(np.arange(WINDOW) < length[:, None], data[at], 32)
    places = np.stack([np.arange(len(start)) * size, np.full(len(start), size)], axis=1)
    return cells.tobytes(), places.astype("<u8").tobytes()


def compressed_lengths(cells: bytes, places: bytes, dictionary: bytes) -> np.ndarray:
    """Bytes of each window, compressed by itself with the dictionary."""
    import zstandard

    out = _compressor(dictionary).multi_compress_to_buffer(zstandard.BufferWithSegments(cells, places), threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def gain_counts(block: Block, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For every text, its windows by gain: bytes saved by the toxic dictionary, 0 (none) to ``MAX_GAIN``."""
    low = _lower(block)
    start, length, of = windows(low.offsets)
    counts = np.zeros(block.n * (MAX_GAIN + 1), np.int64)
    for k in range(0, len(start), TOGETHER):
        cells, places = framed(low.data, start[k : k + TOGETHER], length[k : k + TOGETHER])
        gain = compressed_lengths(cells, places, ordinary) - compressed_lengths(cells, places, toxic)
        counts += np.bincount(of[k : k + TOGETHER] * (MAX_GAIN + 1) + np.clip(gain, 0, MAX_GAIN), minlength=len(counts))
    return counts.reshape(block.n, MAX_GAIN + 1)


@dataclass
class Model:
    """Dictionaries, and the weights of 1, of each threshold being reached, of the windows' shares at each and of all windows."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * GAINS + 2))

    def features(self, counts: np.ndarray) -> np.ndarray:
        reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        at, size = reach[:, 1 : GAINS + 1], np.log1p(reach[:, :1])
        return np.hstack([np.ones((len(counts), 1)), np.minimum(at, 1), np.log1p(at) - size, size])

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ self.weights, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, label, calibrates, text) of at most ``limit`` labelled documents, written out.

    ``labels`` is (doc_id, label). An id with several label rows has the largest of them, and of documents that share an id the one with the largest
    text counts; null labels, ids and texts don't. The chosen ids are at most ``limit`` rows, so they are sent to every task.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(limit)
    )
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    one = found.groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    return stored(one.select("id", "label", (F.xxhash64("id", F.lit(SEED + 1)) % 2 != 0).alias("calibrates"), "text"), "labelled")


def word_surroundings(rows: DataFrame) -> DataFrame:
    """(id, label, word, around) of the distinct words and surroundings (a hash of both neighbours) of every text; long words are left out."""

    def found(batches: Batches) -> Batches:
        for batch in batches:
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            for id_, label, whole in zip(ids, labels, texts_of(batch.column("text")).to_pylist(), strict=True):
                block = Block(pa.array([whole.lower()], pa.large_string()))
                start, end, _ = block.words()
                own = block.hashes(start, end)
                sides = np.concatenate([[np.uint64(0)], own, [np.uint64(0)]])
                around = (sides[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ sides[2:]
                short = end - start <= WORD_BYTES
                keys, first = np.unique(np.stack([own, around], axis=1)[short], axis=0, return_index=True)
                begin, finish, data = start[short][first].tolist(), end[short][first].tolist(), bytes(block.data)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id_] * n, batch.column("id").type), pa.array([label] * n, pa.int32()), pa.array([data[a:b] for a, b in zip(begin, finish, strict=True)], pa.binary()), pa.array(keys[:, 1].view(np.int64))],
                    ["id", "label", "word", "around"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows.select("id", "label", "text"), found, f"id {kind}, label int, word binary, around long")


def distinctive_words(rows: DataFrame) -> dict[int, list[bytes]]:
    """By class, the words that set it apart, the most telling ones last."""
    seen = word_surroundings(rows)
    first = seen.groupBy("label", "word", "around").agg(F.min("id").alias("id"))
    docs = first.select("label", "word", "id").distinct()
    sizes = {r["label"]: r["n"] for r in docs.groupBy("label").agg(F.count_distinct("id").alias("n")).collect()}
    if len(sizes) < 2:
        return {0: [], 1: []}
    counts = docs.groupBy("word").agg(*[F.count_if(F.col("label") == k).cast("double").alias(f"c{k}") for k in (0, 1)])
    n0, n1 = float(sizes[0]), float(sizes[1])

    def side(k, n, p):
        def term(x, q):
            return F.when(x > 0, x * F.log(q)).otherwise(0.0)

        return term(k, k / n) + term(n - k, (n - k) / n) - term(k, p) - term(n - k, 1 - p)

    c0, c1 = F.col("c0"), F.col("c1")
    mean = (c0 + c1) / (n0 + n1)
    rated = counts.withColumn("ratio", 2 * (side(c0, F.lit(n0), mean) + side(c1, F.lit(n1), mean)))
    out = {}
    for k, (own, other) in {0: (c0 / n0, c1 / n1), 1: (c1 / n1, c0 / n0)}.items():
        best = rated.where((own > TIMES * other) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "word").limit(MAX_WORDS).collect()
        out[k] = [bytes(r["word"]) for r in best][::-1]
    return out


def training_windows(rows: DataFrame) -> list[bytes]:
    """At most ``TRAIN_WINDOWS`` pieces of ordinary text, those with the smallest hashes."""

    def cut(batches: Batches) -> Batches:
        for _, block in row_blocks(batches, "text"):
            for whole in _lower(block).texts.to_pylist():
                data = whole.encode()
                parts = [data[i : i + TRAIN_WINDOW] for i in range(0, len(data), TRAIN_WINDOW)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["piece"])

    pieces = in_arrow(rows.where("label = 0").select("text"), cut, "piece binary")
    return [bytes(r["piece"]) for r in pieces.orderBy(F.xxhash64("piece", F.lit(SEED)), "piece").limit(TRAIN_WINDOWS).collect()]


def dictionaries(words: dict[int, list[bytes]], pieces: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): own words, filled up to equal length with ordinary text, and the shared part."""
    import zstandard

    try:
        shared = zstandard.train_dictionary(SHARED_BYTES, pieces, k=64, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        shared = b" ".join(pieces)[:SHARED_BYTES]
    own = []
    for k in (1, 0):
        text = b" "
        for word in reversed(words[k]):
            if len(text) + len(word) + 1 <= OWN_BYTES:
                text = b" " + word + text
        own.append(text)
    size = max(map(len, own))
    return tuple((b" ".join(pieces)[: size - len(x)].ljust(size - len(x)) + x + shared) for x in own)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, drawn towards zero (but for the constant) as by one row of the data's spread."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    pull = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(len(w)), z.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w / scale


def calibrated(toxic: bytes, ordinary: bytes, labels: np.ndarray, counts: np.ndarray) -> Model:
    """The weights that fit the labels.

    Without both classes the score is the share of label 1 (with one document of each added).
    """
    model = Model(toxic, ordinary)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    model.weights[0] = np.log(prior / (1 - prior))
    if len(set(labels.tolist())) == 2:
        model.weights = _logistic(model.features(counts), labels.astype(float))
    return model


def _counted(batches: Batches, text: str, toxic: bytes, ordinary: bytes) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch, block in row_blocks(batches, text):
        yield batch, gain_counts(block, toxic, ordinary)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learn dictionaries and weights from the bounded sample; the result does not depend on partitions."""
    rows = sample(docs, labels, limit, text, doc_id)
    half = rows.where("not calibrates")
    toxic, ordinary = dictionaries(distinctive_words(half), training_windows(half))

    def counted(batches: Batches) -> Batches:
        for batch, counts in _counted(batches, "text", toxic, ordinary):
            cells = pa.array([c.tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), cells], ["id", "label", "counts"])

    kind = rows.schema["id"].dataType.simpleString()
    found = in_arrow(rows.where("calibrates").select("id", "label", "text"), counted, f"id {kind}, label int, counts binary").orderBy("id").collect()
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in found]).reshape(len(found), MAX_GAIN + 1)
    return calibrated(toxic, ordinary, np.array([r["label"] for r in found], int), counts)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of the documents, and ``_score``, the probability of label 1.

    A null or empty text has no windows and gets what the constant alone gives. Texts of any length are read whole, a block of about a
    megabyte at a time (a longer text is one block). Repeated rows get equal scores. A column ``_score`` of the input is replaced.
    """
    docs = without(docs, "_score")

    def rows(batches: Batches) -> Batches:
        for batch, counts in _counted(batches, text, model.toxic, model.ordinary):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(counts))], [*batch.schema.names, "_score"])

    return in_arrow(docs, rows, f"{columns_ddl(docs)}, _score double")
