"""Line deduplication by sorted line hashes, with keep bitmaps instead of text.

A line's key is the line trimmed of blanks (0x20, 0x09-0x0D) and lower-cased (A-Z only). Keys of at least
``MIN_CHARS`` code points that occur in at least ``MIN_DOCS`` documents lose all lines except those
in the largest document id that holds them.

Every long enough line becomes a row (128-bit hash, document, position); no text is exchanged for
the search. The rows are range-partitioned and sorted by hash, document (descending) and position, so a
line that a third of all documents share is cut by document over many tasks. A task streams through
its rows: the first document of a hash keeps its lines, those of later documents go as soon as a fifth
document is seen. Only the first and the last hash of a task can continue in a neighbour; for these the task
leaves a summary, at most two rows, by which the rows still open are decided. What is
dropped is gathered per document into a compressed bitmap, and texts meet their bitmaps by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.blocks import row_blocks
from kindred.llm.common import Batches, beside_plain_names, columns_ddl, in_arrow, stored, without

MIN_CHARS, MIN_DOCS = 40, 5
_DROP, _OPEN, _EDGE = 0, 1, 2
_STREAM = "kind int, h1 long, h2 long, doc long, text_hash long, pos int, part int, n long, last_doc long"


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, text_hash, pos) of every line whose key is long enough; docs: (doc, text_hash, text)."""

    def rows(batches: Batches) -> Batches:
        for batch, block in row_blocks(batches, "text"):
            first, last, of = block.lines()
            start, end = block.trimmed(first, last)
            chars = block.chars()
            begins = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
            pos = np.arange(len(of)) - np.flatnonzero(begins)[of] if len(of) else of
            long = chars[end] - chars[start] >= min_chars
            start, end, of, pos = start[long], end[long], of[long], pos[long]
            plain = block.lowered()
            yield pa.RecordBatch.from_arrays(
                [pa.array(plain.hashes(start, end, k).view(np.int64)) for k in (0, 1)]
                + [batch.column(c).take(pa.array(of)) for c in ("doc", "text_hash")]
                + [pa.array(pos.astype(np.int32))],
                ["h1", "h2", "doc", "text_hash", "pos"],
            )

    return in_arrow(docs, rows, "h1 long, h2 long, doc long, text_hash long, pos int")


class _Run:
    """The rows of one hash as they stream by, largest document first."""

    def __init__(self, key: tuple[int, int], inherits: bool):
        self.key, self.inherits = key, inherits
        self.n, self.first, self.last, self.held = 0, 0, 0, []


def _streamed(batches: Batches, min_docs: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(kind, rows) of one sorted partition."""
    part, run, fresh = TaskContext.get().partitionId(), None, True

    def edge(run: _Run) -> tuple[int, dict[str, np.ndarray]]:
        one = {"h1": run.key[0], "h2": run.key[1], "doc": run.first, "part": part, "n": run.n, "last_doc": run.last}
        return _EDGE, {k: np.array([v]) for k, v in one.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "text_hash", "pos")}
        n = batch.num_rows
        new = np.ones(n, bool)
        new[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
        begin = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= x["doc"][1:] != x["doc"][:-1]
        seen = np.cumsum(other)
        finish = np.append(begin[1:], n)
        # runs inside the batch are decided together; the first may continue one and the last is carried on
        inner = np.arange(1, len(begin) - 1)
        if len(inner):
            docs = seen[finish[inner] - 1] - seen[begin[inner]] + 1
            rows = np.zeros(n, bool)
            for a, b in zip(begin[inner][docs >= min_docs], finish[inner][docs >= min_docs], strict=True):
                rows[a:b] = x["doc"][a:b] != x["doc"][a]
        ends = [(begin[0], finish[0])] + ([(begin[-1], n)] if len(begin) > 1 else [])
        for k, (a, b) in enumerate(ends):
            if k and len(inner) and rows.any():
                yield _DROP, {c: v[rows] for c, v in x.items()}
            key = (int(x["h1"][a]), int(x["h2"][a]))
            if run is None or run.key != key:
                if run is not None and run.inherits:
                    yield edge(run)
                # the first run of the partition may have begun in the one before
                run, fresh = _Run(key, fresh), False
                run.first = int(x["doc"][a])
                run.last = run.first
                run.n = 1
            docs = x["doc"][a:b]
            run.n += int((docs[1:] != docs[:-1]).sum()) + int(docs[0] != run.last)
            run.last = int(docs[-1])
            piece = {c: v[a:b] for c, v in x.items()}
            if run.inherits:
                yield _OPEN, piece
                continue
            run.held.append({c: v[docs != run.first] for c, v in piece.items()})
            if run.n >= min_docs:
                for rest in run.held:
                    yield _DROP, rest
                run.held = []
    if run is not None:
        yield edge(run)
        for rest in run.held:
            yield _OPEN, rest


def _stream(sorted_rows: DataFrame, min_docs: int) -> DataFrame:
    names = [f.split()[0] for f in _STREAM.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64()}
    kinds = [types[f.split()[1]] for f in _STREAM.split(", ")]

    def rows(batches: Batches) -> Batches:
        for kind, part in _streamed(batches, min_docs):
            n = len(part["doc"])
            if n:
                full = part | {"kind": np.full(n, kind)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[c].astype(t.to_pandas_dtype())) if c in full else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)],
                    names,
                )

    return in_arrow(sorted_rows, rows, _STREAM)


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, pos) of the lines to drop, once each."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_hash"), F.col("pos")]
    found = stored(_stream(lines.repartitionByRange(*order).sortWithinPartitions(*order), min_docs), "lines")
    # a hash has one summary for each task it passes through; a document on both sides of a cut counts once
    along = Window.partitionBy("h1", "h2").orderBy("part")
    verdict = (
        found.where(F.col("kind") == _EDGE)
        .withColumn("again", (F.col("doc") == F.lag("last_doc").over(along)).cast("long"))
        .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("again").alias("again"), F.max("doc").alias("top"))
        .where(F.col("n") - F.coalesce("again", F.lit(0)) >= min_docs).select("h1", "h2", "top")
    )
    # at most two summaries a task
    open_ = found.where(F.col("kind") == _OPEN).join(F.broadcast(verdict), ["h1", "h2"]).where("doc <> top")
    keys = ["doc", "text_hash", "pos"]
    return found.where(F.col("kind") == _DROP).select(keys).unionByName(open_.select(keys))


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, n_dropped, keep) for every document that loses lines.

    ``keep`` is a zlib-compressed bitmap, first line in the highest bit; lines beyond its end are kept.
    """
    rows = docs.select(_doc_key(doc_id).alias("doc"), _text_key(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gone = dropped_lines(line_rows(rows, min_chars), min_docs)
    lists = gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            maps = []
            for where in batch.column("pos"):
                where = np.asarray(where.values)
                bits = np.ones(-8 * (-(int(where.max()) + 1) // 8), np.uint8)
                bits[where] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            n = pa.array([len(p) for p in batch.column("pos")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"), n, pa.array(maps, pa.binary())], ["doc", "text_hash", "n_dropped", "keep"]
            )

    return in_arrow(lists, pack, "doc long, text_hash long, n_dropped long, keep binary")


def _doc_key(doc_id: str):
    """A null id counts as one document below all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def _text_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns with the text reduced, plus ``_n_lines`` (before) and ``_n_dropped``.

    A null text is one empty line, and comes back empty; a text all of whose lines go becomes empty.
    A line that repeats within one document counts that document once, and all its copies go or stay.
    Rows that repeat an id are one document for counting, each with its own text. Columns of the
    input with the names of the two counts are replaced.
    """
    return beside_plain_names(without(docs, "_n_lines", "_n_dropped"), [text, doc_id], lambda d: _drop_lines(d, text, doc_id, min_chars, min_docs))


def _drop_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    maps = keep_bitmaps(docs, text, doc_id, min_chars, min_docs)
    maps = maps.select(F.col("doc").alias("_map_doc"), F.col("text_hash").alias("_map_hash"), F.col("keep").alias("_keep"))
    met = docs.join(maps, (_doc_key(doc_id) == F.col("_map_doc")) & (_text_key(text) == F.col("_map_hash")), "left")
    met = met.select(*[docs[f"`{c}`"] for c in docs.columns], "_keep")
    names = docs.columns
    at = names.index(text)

    def apply(batches: Batches) -> Batches:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for whole, keep in zip(batch.column(at), batch.column(len(names)), strict=True):
                whole, keep = whole.as_py() or "", keep.as_py()
                if keep is None:
                    texts.append(whole)
                    n_lines.append(whole.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                lines = whole.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
                stay = [line for line, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :]
                texts.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"]
            )

    return in_arrow(met, apply, f"{columns_ddl(docs)}, _n_lines long, _n_dropped long")
