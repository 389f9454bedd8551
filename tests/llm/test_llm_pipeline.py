import os

import pytest
from llm_cases import CLASHES, documents
from test_llm_jaccard_join import brute as similar
from test_llm_jaccard_join import repeated_ids, similar_rows
from test_llm_line_dedup import brute as dropped
from test_llm_line_dedup import lined_rows
from test_llm_quality_rules import base
from test_llm_quality_rules import base

import __spark_entry__ as entry
import corpus_pipeline as P
from kindred.llm.queries import all_queries, all_sql

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def folder(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "line dedup", "near duplicates", "packing"]
    assert set(all_queries()) | {"pipeline"} <= set(entry.queries()) and set(all_sql()) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in all_queries()) == list(range(1, 14))


def test_stages_match_brute_force(spark, tmp_path):
    rows = lined_rows(7) + similar_rows(40)
    docs = documents(spark, rows)
    sf_dir = folder(spark, tmp_path, [(d, 1, 0) for d, _ in rows if d is not None] + [(None, 1, 0), (1, None, None)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "line dedup":
            want = dropped(before)
            assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), t) for (d, t, _, _), n in want.items() for _ in range(n))
            assert all(r.n_chars == len(r.text) for r in got if r.text and r.doc_id != 52)
        elif name == "near duplicates":
            keep = {(d, g) for d, _, _, _, g in similar(before)}
            assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in before if (d, d) in keep)
        else:
            left = sorted((str(r.doc_id), str(r.text)) for r in got)
            may = sorted((str(d), str(t)) for d, t in before)
            if name == "quality rules":
                counts = {t: base(t) for _, t in may}
                may = [(d, t) for d, t in may if t != "None" and counts[t][0] >= 20 and 100 * counts[t][4] <= 30 * counts[t][0]]
            # every label is good, so clean documents stay
            assert set(left) <= set(may) and len(left) >= 0.9 * len(may)
        assert all(r[c].startswith("own") for r in got for c in CLASHES)
        docs = spark.createDataFrame(got, docs.schema)
    places = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in places} == {r.doc_id for r in got}


def test_near_duplicates_go_row_by_row_whatever_their_ids(spark, tmp_path):
    docs = documents(spark, repeated_ids())
    got = [(r.doc_id, r.text) for r in dict(P.STAGES)["near duplicates"](spark, docs, str(tmp_path)).collect()]
    rows = repeated_ids()
    assert sorted(got, key=str) == sorted([rows[k] for k in (3, 4, 7, 8, 10, 11)], key=str)


def test_no_documents(spark, tmp_path):
    docs = documents(spark).where("false")
    sf_dir = folder(spark, tmp_path, [])
    assert all(stage(spark, docs, sf_dir).count() == 0 for _, stage in P.STAGES)


@needs_data
def test_run_and_queries_over_the_small_tables(spark):
    pieces = P.run(spark, SF)
    n = pieces.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * docs < n and pieces.select("doc_id").distinct().count() < docs
    for name, query in all_queries().items():
        table = "pages" if "page" in name else "embeddings" if "whitening" in name else "documents"
        rows = query(spark, SF)
        assert rows.select(rows.columns[0]).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name
    held = entry.queries()["op5_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.where("lang is not null").count()


@needs_data
@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_sql(spark, name):
    from oracle_check import connect, difference

    assert difference(all_queries()[name](spark, SF).toPandas(), connect(SF).sql(all_sql()[name]).df()) is None
