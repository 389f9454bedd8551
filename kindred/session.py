"""Session helpers: where intermediate tables may be written, and size limits."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: upper bound, in bytes, for anything the library asks Spark to broadcast
BROADCAST_LIMIT = 64 * 1024 * 1024


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table below ``spark.checkpoint.dir``.

    The folder has to be visible to every executor, so outside local mode an
    unset ``spark.checkpoint.dir`` is an error instead of a silent local path.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: bytes of an Arrow batch of rows that each hold a tile or a matrix, about
WIDE_BATCH = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches by bytes; a lower limit stays. Rows of megabytes would else travel thousands at a time."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(setting, None)
    plain = limit.removesuffix("b") if limit else ""
    if not plain.isdigit() or int(plain) > WIDE_BATCH:
        if limit is None or plain.lstrip("-").isdigit():
            spark.conf.set(setting, f"{WIDE_BATCH}b")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Does what ``spark-submit --py-files`` does, once per application, for
    sessions started without it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
