"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a blank; n-grams without a letter are skipped.
Counts by language and bucket are made by every task for itself and added up chunk by chunk. The matrix of log probabilities has languages x ``2 ** BITS`` entries, a size that
does not follow the corpus; it travels with the scoring function, which goes through more than ``TOGETHER`` languages block by block. A block of texts is
scored by adding up one matrix column per n-gram.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import Block, char_grams, row_blocks
from kindred.llm.common import CHUNK, Batches, added, beside_plain_names, columns_ddl, count_chunks, in_arrow, stored, without

BITS, GRAMS, ALPHA, UNKNOWN = 15, (1, 2, 3), 0.5, "und"
#: languages whose log probabilities a worker holds together (64 MB); more are gone through in several passes
TOGETHER = 512


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their texts, and for each text whether it has a letter."""
    points, offsets = block.code_points(lower=True)
    letter = _letters()[points]
    before = np.concatenate([[0], np.cumsum(letter)])
    has = before[offsets[1:]] > before[offsets[:-1]]
    plain = np.where(letter, points, 32)
    buckets, of = [], []
    for n in GRAMS:
        bucket, docs = char_grams(plain, offsets, n, BITS)
        places = len(points) - n + 1
        if places > 0:
            row = np.repeat(np.arange(block.n), np.diff(offsets))
            inside = row[:places] == row[n - 1 :]
            some = (before[n:] > before[:places])[inside]
            bucket, docs = bucket[some], docs[some]
        buckets.append(bucket)
        of.append(docs)
    return np.concatenate(buckets), np.concatenate(of), has


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, counts) over the rows with a language; chunk -1 counts the documents with a letter."""

    def count(batches: Batches) -> Batches:
        cells: dict[str, tuple[np.ndarray, int]] = {}
        for batch, block in row_blocks(batches, "_text"):
            bucket, of, has = features(block)
            langs = batch.column("_lang").to_numpy(zero_copy_only=False)
            for name in set(langs.tolist()):
                mine = langs == name
                n = np.bincount(bucket[mine[of]], minlength=1 << BITS)
                total, documents = cells.get(name, (0, 0))
                cells[name] = (total + n, documents + int((mine & has).sum()))
        for name, (total, documents) in cells.items():
            chunks = [*count_chunks(total), (-1, np.array([documents], np.int64).tobytes())]
            names = pa.array([name] * len(chunks), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([c for c, _ in chunks], pa.int32()), pa.array([x for _, x in chunks], pa.binary())], ["lang", "chunk", "counts"]
            )

    rows = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang is not null")
    return added(in_arrow(rows, count, "lang string, chunk int, counts binary"), ["lang", "chunk"])


@dataclass
class Model:
    """Languages in alphabetical order; log probabilities with one row per language, in blocks of ``TOGETHER``; log priors."""

    languages: list[str]
    tables: list[np.ndarray]
    prior: np.ndarray

    @property
    def table(self) -> np.ndarray:
        return np.concatenate(self.tables) if self.tables else np.zeros((0, 1 << BITS), np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all rows given; rows without language or letters teach nothing."""
    rows = stored(language_counts(docs, text, lang), "languages")
    documents = {r["lang"]: int(np.frombuffer(r["counts"], np.int64)[0]) for r in rows.where("chunk = -1").select("lang", "counts").collect()}
    languages = sorted(name for name, n in documents.items() if n)
    tables = []
    for k in range(0, len(languages), TOGETHER):
        some = languages[k : k + TOGETHER]
        place = {name: i for i, name in enumerate(some)}
        counts = np.zeros((len(some), 1 << BITS))
        # languages are alphabetical, so a block of them is a range of names
        found = rows.where((F.col("chunk") >= 0) & F.col("lang").between(some[0], some[-1])).select("lang", "chunk", "counts").toPandas()
        for name, chunk, part in found.itertuples(index=False):
            if name in place:
                counts[place[name], chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(part, np.int64)
        grams = counts + ALPHA
        tables.append(np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32))
    prior = np.array([documents[name] + 1 for name in languages], float)
    return Model(languages, tables, np.log(prior / prior.sum()) if languages else prior)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of the documents, with ``_lang_pred`` and ``_lang_score`` (its posterior).

    A text that is null or without letters is ``und`` with score 0, as is everything under a model
    without languages. Ties go to the first language in alphabetical order.
    Columns of the input with these two names are replaced.
    """
    return beside_plain_names(without(docs, "_lang_pred", "_lang_score"), [text], lambda d: _identify(d, model, text))


def _identify(docs: DataFrame, model: Model, text: str) -> DataFrame:
    def block_of(first: int, logs: np.ndarray, last: bool):
        """Goes through one block of languages, with the best so far and the sum of likelihoods relative to it."""
        names, prior = np.array(model.languages[first : first + len(logs)], object), model.prior[first : first + len(logs)]

        def rows(batches: Batches) -> Batches:
            for batch, block in row_blocks(batches, text):
                bucket, of, has = features(block)
                own = batch.columns if not first else batch.columns[:-3]
                if first:
                    found, top, likelihood = (batch.column(batch.num_columns - 3 + i).to_numpy(zero_copy_only=False) for i in range(3))
                else:
                    found, top, likelihood = np.full(block.n, UNKNOWN, object), np.full(block.n, -np.inf), np.zeros(block.n)
                if len(names):
                    total = np.stack([block.per_doc(of, row[bucket]) for row in logs]) + prior[:, None]
                    here = total.max(axis=0)
                    found = np.where(here > top, names[total.argmax(axis=0)], found)
                    both = np.maximum(top, here)
                    likelihood = likelihood * np.exp(top - both) + np.exp(total - both).sum(axis=0)
                    top = both
                out = [pa.array(found, pa.string()), pa.array(top), pa.array(likelihood)]
                if last:
                    share = np.where(has & (likelihood > 0), 1 / np.maximum(likelihood, 1.0), 0.0)
                    out = [pa.array(np.where(has, found, UNKNOWN), pa.string()), pa.array(share)]
                yield pa.RecordBatch.from_arrays([*own, *out], [*names_of, *(["_lang_pred", "_lang_score"] if last else ["_lang_pred", "_top", "_likelihood"])])

        return rows

    names_of, own = docs.columns, columns_ddl(docs)
    tables = model.tables or [np.zeros((0, 1 << BITS), np.float32)]
    first = 0
    for k, logs in enumerate(tables):
        last = k == len(tables) - 1
        docs = in_arrow(docs, block_of(first, logs, last), f"{own}, _lang_pred string, " + ("_lang_score double" if last else "_top double, _likelihood double"))
        first += len(logs)
    return docs
