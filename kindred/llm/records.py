"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed as: length (unsigned 64-bit), masked checksum of the length, data, masked checksum of the
data (unsigned 32-bit each, all little-endian); the checksum is CRC-32C, masked by rotation and an added
constant, the framing of TFRecord files. The data is the document id (signed 64-bit) and the ids.

Documents are range-partitioned and sorted by id, so files follow each other in id order, and each task
streams its documents into files of its own name in a shared folder. What it wrote is one index row per
record; the index is a Parquet table, committed by Spark, so files of lost or repeated attempts are never
referred to. Any record can be read by its index row, in any order; a plain scan of the index reads the
files back in large ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.blocks import row_blocks
from kindred.llm.common import Batches, in_arrow
from kindred.llm.tokens import BLOCK_BYTES, encoder

#: a file is closed when it has reached this size; bytes read at a time
FILE_BYTES, READ_BYTES = 256 << 20, 4 << 20
#: bytes before and after the data of a record
HEAD, FOOT = 12, 4
_STRIDE = 256


def _crc_table() -> np.ndarray:
    """CRC-32C (reflected polynomial 0x82F63B78) of single bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(0x82F63B78), np.uint32(0))
    return t


_TABLE = _crc_table()


def _advance_tables() -> np.ndarray:
    """What ``_STRIDE`` zero bytes do to a checksum, as one table per byte of it."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_STRIDE):
        state = (state >> np.uint32(8)) ^ _TABLE[state & 255]
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte][(np.arange(256) >> bit) & 1 == 1] ^= state[8 * byte + bit]
    return out


_ADVANCE = _advance_tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """Checksums of byte strings of at least four bytes each.

    All strings advance side by side, cut into strides: leading zeros do not change a checksum that starts
    at zero, so each string is filled up in front, and the start value goes into its first four bytes.
    """
    if not parts:
        return np.zeros(0, np.uint32)
    size = np.array([len(p) for p in parts])
    strides = -(-size // _STRIDE)
    first = np.concatenate([[0], np.cumsum(strides)])
    data = np.zeros(first[-1] * _STRIDE, np.uint8)
    begin = first[1:] * _STRIDE - size
    flat = np.frombuffer(b"".join(parts), np.uint8)
    source = np.concatenate([[0], np.cumsum(size)])
    for a, b, n in zip(begin.tolist(), source[:-1].tolist(), size.tolist(), strict=True):
        data[a : a + n] = flat[b : b + n]
    for k in range(4):
        data[begin + k] ^= 255
    columns = np.ascontiguousarray(data.reshape(-1, _STRIDE).T)
    crc = np.zeros(first[-1], np.uint32)
    for column in columns:
        crc = (crc >> np.uint32(8)) ^ _TABLE[(crc ^ column) & 255]
    total = np.zeros(len(parts), np.uint32)
    order = np.argsort(-strides, kind="stable")
    for k in range(int(strides.max())):
        on = order[: int((strides > k).sum())]
        was = total[on]
        moved = _ADVANCE[0][was & 255] ^ _ADVANCE[1][(was >> np.uint32(8)) & 255] ^ _ADVANCE[2][(was >> np.uint32(16)) & 255] ^ _ADVANCE[3][was >> np.uint32(24)]
        total[on] = moved ^ crc[first[on] + k]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(parts: list[bytes]) -> list[bytes]:
    """Each byte string as a record."""
    lengths = [len(p).to_bytes(8, "little") for p in parts]
    head, foot = (masked(crc32c(x)).astype("<u4").tobytes() for x in (lengths, parts))
    return [b"".join((n, head[4 * i : 4 * i + 4], p, foot[4 * i : 4 * i + 4])) for i, (n, p) in enumerate(zip(lengths, parts, strict=True))]


def unframed(records: list[bytes]) -> list[bytes]:
    """The data of records; a wrong length or checksum is an error."""
    data = [r[HEAD:-FOOT] for r in records]
    head = masked(crc32c([r[:8] for r in records])).astype("<u4").tobytes()
    foot = masked(crc32c(data)).astype("<u4").tobytes()
    for i, (record, own) in enumerate(zip(records, data, strict=True)):
        if record[:HEAD] != len(own).to_bytes(8, "little") + head[4 * i : 4 * i + 4] or record[-FOOT:] != foot[4 * i : 4 * i + 4]:
            raise ValueError("damaged record")
    return data


@dataclass
class Records:
    """A folder of record files and its index: (doc_id, part, file, offset, size, n_tokens, before)."""

    folder: str
    dtype: str
    index: DataFrame


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, glue: bool = True, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES
) -> Records:
    """Encode every document, followed by ``end_id``, and write it below ``folder`` in ascending id order.

    ``folder`` is a path or URI that all executors reach. A null or empty text is ``end_id`` alone. Rows with
    the same id follow each other in the order of a hash of their text; a null id comes first and is stored as
    the smallest integer. An empty table gives an index without rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]

    def write(batches: Batches) -> Batches:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, glue)
        store, at = fs.FileSystem.from_uri(folder)
        out, name, position, before = None, "", 0, 0
        try:
            for batch, block in row_blocks(batches, "text", BLOCK_BYTES):
                if out is None:
                    name, position = f"part-{part:05d}-{uuid.uuid4().hex}.rec", 0
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}")
                ids, offsets = enc.encode(block, end_id)
                n = np.diff(offsets)
                keys = batch.column("doc_id").to_numpy()
                data = ids.astype(enc.dtype)
                records = frames([int(k).to_bytes(8, "little", signed=True) + data[a:b].tobytes() for k, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True)])
                out.write(b"".join(records))
                size = np.array([len(r) for r in records], np.int64)
                end = position + np.cumsum(size)
                rows = len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(rows, part, np.int32)), pa.array([name] * rows), pa.array(end - size), pa.array(size),
                     pa.array(n), pa.array(before + offsets[:-1])],
                    ["doc_id", "part", "file", "offset", "size", "n_tokens", "before"],
                )
                position, before = int(end[-1]), before + int(offsets[-1])
                if position >= file_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()

    schema = "doc_id long, part int, file string, offset long, size long, n_tokens long, before long"
    written = in_arrow(source.repartitionByRange(*order).sortWithinPartitions(*order), write, schema)
    written.write.parquet(f"{folder}/index")
    return Records(folder, encoder(tokenizer, glue).dtype.str, open_index(spark, folder))


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(records: Records) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all records, checked; ``start`` counts the ids of all documents before."""
    folder, dtype = records.folder, np.dtype(records.dtype)
    index = records.index
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per writing task
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def ranges(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """Rows of one file that follow each other and are not too long together."""
        file, offset, size = (batch.column(c).to_pylist() for c in ("file", "offset", "size"))
        a = 0
        for b in range(1, len(file) + 1):
            if b == len(file) or file[b] != file[a] or offset[b] != offset[b - 1] + size[b - 1] or offset[b] + size[b] - offset[a] > READ_BYTES:
                yield a, b
                a = b

    def read(batches: Batches) -> Batches:
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for a, b in ranges(batch):
                some = batch.slice(a, b - a)
                offset, size = (some.column(c).to_pylist() for c in ("offset", "size"))
                with store.open_input_file(f"{at}/{some.column('file')[0].as_py()}") as file:
                    whole = file.read_at(offset[-1] + size[-1] - offset[0], offset[0])
                data = unframed([whole[o - offset[0] : o - offset[0] + s] for o, s in zip(offset, size, strict=True)])
                keys = [int.from_bytes(d[:8], "little", signed=True) for d in data]
                n = [(len(d) - 8) // dtype.itemsize for d in data]
                if keys != some.column("doc_id").to_pylist() or n != some.column("n_tokens").to_pylist():
                    raise ValueError("the index does not belong to these records")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), some.column("part"), some.column("before"), pa.array(n, pa.int64()), pa.array([d[8:] for d in data], pa.binary())],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )

    rows = in_arrow(index, read, "doc_id long, part int, before long, n_tokens long, ids binary").join(F.broadcast(parts), "part")
    doc_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id")
    return rows.select(doc_id, (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
