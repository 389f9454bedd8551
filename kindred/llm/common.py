"""What the operators share: running array code on Spark, tables in the shared folder, folds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import scratch_path, ship_package

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: bytes of an Arrow batch between Spark and the workers, at most
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers.

    A batch is held several times over, on both sides, so the session's limit for batches is lowered to
    ``BATCH_BYTES``; a lower limit stays.
    """
    spark = df.sparkSession
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(setting, None)
    if limit is None or _bytes(limit) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def _bytes(size: str) -> float:
    """A size as Spark writes it, in bytes; no limit is infinite."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return float(number) * 1024 ** " kmgtp".index(unit or " ") if int(number) > 0 else float("inf")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The table written below ``spark.checkpoint.dir`` and read back; later jobs do not recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: counts in one row of a table of count vectors
CHUNK = 1024


def count_chunks(counts: np.ndarray) -> Iterable[tuple[int, bytes]]:
    """A vector of counts as (chunk, bytes), without empty chunks."""
    for at in range(0, len(counts), CHUNK):
        part = counts[at : at + CHUNK]
        if part.any():
            yield at // CHUNK, part.astype(np.int64).tobytes()


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the count vectors (column ``counts``) of equal keys.

    Vectors arrive in key order and are added in a stream, so a task holds one of them, not one per
    task before it.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys, "counts").schema)
    kinds = [parts.schema[k].dataType.simpleString() for k in keys]
    types = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k] for k in kinds]

    def merge(batches: Batches) -> Batches:
        def row(key: tuple, total: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([k], t) for k, t in zip(key, types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total.tobytes()], pa.binary())], [*keys, "counts"])

        at, total = None, None
        for batch in batches:
            for *key, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(counts, np.int64)
                if key == at:
                    total = total + counts
                    continue
                if at is not None:
                    yield row(at, total)
                at, total = key, counts
        if at is not None:
            yield row(at, total)

    return in_arrow(parts.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys), merge, schema)


def fold(doc_id: Column, k: int) -> Column:
    """The documented split: crc32 of the id's text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def columns_ddl(df: DataFrame) -> str:
    """The columns of a table as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that have one of the names (in any case): room for an operator's own."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c.replace('`', '``')}`"] for c in df.columns if c.lower() not in taken])


def beside_plain_names(docs: DataFrame, own: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the table whose columns other than ``own`` have plain names for the time, so that none can clash with names used inside.

    ``work`` keeps all columns and may add some.
    """
    inner = [c if c in own else f"column_{i}" for i, c in enumerate(docs.columns)]
    out = work(docs.toDF(*inner))
    back = dict(zip(inner, docs.columns, strict=True))
    return out.toDF(*[back.get(c, c) for c in out.columns])


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Each row with the columns of its group; ``groups`` has unique keys and the group's number of rows.

    Groups of more than a 200th of the ``total`` rows are fewer than 200 and are sent to all tasks, so
    their rows stay where they are; the rest meet by an ordinary join.
    """
    hot = F.broadcast(groups.where(F.col(size) > max(total // 200, 1000)).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, keys, "left")
    rest = met.where("_hot is null").select(*rows.columns).join(groups, keys)
    return met.where("_hot").drop("_hot").unionByName(rest)
