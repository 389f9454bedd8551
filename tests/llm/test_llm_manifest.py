import hashlib
import random

import pytest
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F

from kindred.llm import manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, fanout):
    """Levels of digests up to the root, and a path of (place, siblings) per leaf."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + fanout]) for i in range(0, len(now), fanout)])
    paths = []
    for k in range(len(digests)):
        path, at = [], k
        for now in levels[:-1]:
            first = at - at % fanout
            path.append((at - first, [d for i, d in enumerate(now[first : first + fanout]) if first + i != at]))
            at //= fanout
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, altered, fanout):
    """Sorted (leaf, subroot, root, proof digest, folded root) by definition."""
    sources = {}
    for row, other in zip(rows, altered):
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(other)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rows_ in sources.values():
        rows_.sort()
    below = {s: tree([r[2] for r in sources[s]], fanout) for s in order}
    root, upper = tree([below[s][0] for s in order], fanout)
    out = []
    for s, over in zip(order, upper):
        for (_, _, own, other), path in zip(sources[s], below[s][1]):
            digest = other
            for place, siblings in path + over:
                digest = h(*siblings[:place], digest, *siblings[place:])
            out.append((own, below[s][0], root, h(*[d for _, x in path + over for d in x]), digest))
    return sorted(out)


def found(df):
    cols = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")]
    return sorted(tuple(r) for r in df.select(*cols, M.proof_digest(F.col("path")), F.lower(F.hex(M.folded_root(F.col("altered_leaf"), F.col("path"))))).collect())


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_against_brute_force_with_edge_rows(spark, fanout):
    docs = documents(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    changed = [(*r[:4], None if r[4] is None else r[4].replace("\n", "")) for r in rows]
    got = found(M.document_manifest(docs, fanout, altered={"text": F.translate("text", "\n", "")}))
    want = brute(rows, changed, fanout)
    assert got == want and len(got) == len(edge_rows())
    assert any(w[4] != w[2] for w in want)


def test_sources_of_all_sizes_and_a_null_source(spark):
    rng = random.Random(2)
    sizes = {None: 4, "": 1, "a": 28, "ä": 9, "b": 2, "hot": 120, "z": 3}
    rows = [(rng.randrange(1000), s, None, i, f"text {i}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = found(M.document_manifest(df))
    assert got == brute(rows, rows, 3) and all(g[4] == g[2] for g in got)


def test_one_row_no_row_and_a_wrong_fan_out(spark):
    docs = documents(spark)
    assert M.document_manifest(docs.where("false")).count() == 0
    one = [(5, "s", "en", 1, "x")]
    df = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(M.document_manifest(df)) == [(leaf(one[0]),) * 3 + (h(""), leaf(one[0]))]
    with pytest.raises(ValueError):
        M.build(docs.select(F.lit("t").alias("tree"), F.lit(1).alias("key"), F.lit(b"").alias("digest")), 1)
