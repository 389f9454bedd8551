import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def random_cov(dim, seed, scale=1.0, first=None):
    """Symmetric matrix with eigenvalues drawn from U(0.5, 2); optionally one is given."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    w = rng.uniform(0.5, 2, dim)
    if first is not None:
        w[0] = first
    return scale * (q * w) @ q.T


def gram_frame(spark, matrices):
    """``{layer: matrix}`` as a Gram table."""
    rows = [
        (name, i, j, float(m[i, j])) for name, m in matrices.items() for i in range(len(m)) for j in range(len(m))
    ]
    return spark.createDataFrame(rows, "layer string, i int, j int, v double")


def matrices_of(df):
    """A Gram table as ``{layer: matrix}``."""
    out = {}
    for layer, rows in df.toPandas().groupby("layer"):
        m = np.full((rows.i.max() + 1, rows.j.max() + 1), np.nan)
        m[rows.i, rows.j] = rows.v
        out[layer] = m
    return out
