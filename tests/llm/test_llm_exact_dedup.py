import hashlib
from collections import Counter

import numpy as np
from llm_cases import documents, edge_rows

from kindred.llm import bloom
from kindred.llm.exact_dedup import exact_duplicates


def test_groups_match_brute_force(spark):
    rows = edge_rows() + [(1000 + i, "hot") for i in range(1500)] + [(7000, "hot")]
    low = lambda d: -(2**63) if d is None else d
    size = Counter((t or "") for _, t in rows)
    top = {}
    for d, t in rows:
        top[t or ""] = max([top.get(t or "", None), d], key=lambda x: low(x))
    for bits in (1 << 28, 1 << 16):
        got = exact_duplicates(documents(spark, rows), max_bits=bits).collect()
        sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        want = Counter((d, top[t or ""], size[t or ""], sha(t)) for d, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(size)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(spark):
    assert exact_duplicates(documents(spark).where("false")).count() == 0


def test_filter_has_no_false_negatives(spark):
    values = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    rows = spark.createDataFrame([(int(v),) for v in [*values, *values[:100]]] + [(None,)], "h long").repartition(5)
    once, twice = bloom.build(rows, "h", 1 << 16)
    assert bloom.may_contain(once, values).all() and bloom.may_contain(twice, values[:100]).all()
    assert bloom.may_contain(twice, values[100:]).mean() < 0.05
    ids = rows.limit(50)
    wanted = {r.h for r in ids.collect()}
    inside = bloom.rows_with_ids(rows, "h", ids).collect()
    outside = bloom.rows_without_ids(rows, "h", ids).collect()
    assert {r.h for r in inside} == wanted - {None} and len(inside) + len(outside) == 3101
    assert not {r.h for r in outside} & (wanted - {None})
