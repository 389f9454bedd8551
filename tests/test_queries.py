import os

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from kindred.plans.oracles import all_sql
from kindred.plans.queries import all_queries
from kindred.plans.registry import MEASURES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

SAMPLE = [
    "acts_long", "document_catalog", "stored_activations", "gram_sales", "gram_centroids", "gram_stored",
    "gram_validate", "add_noise_weighted", "dist_matrix", "two_families", "kl_to_ideal", "scalar_rules",
    "pairs_remaining", "stored_distances", "run_lengths", "noise_by_run", "voxel_reliability", "zscore_voxel",
    "noise_grid", "grouped_trials", "loglik_voxel_weights", "log_posterior", "discount_winners",
    "logpost_boxplot", "document_split", "scatter_volume", "streamed_statistics", "layers_wasserstein",
    "gram_orders", "coordinates_tvd", "coordinates_jsd", "streamed_comparisons", "scaled_kldiv", "scaled_cka", "scaled_wasserstein", "offset_rsacorr", "wide_rsacorr", "sales_kldiv_means",
    "sales_mahalanobis_means", "noise_grid_fixed", "loglik_with_mean", "registered_measure", "layers_nbs_unit", "layers_rsarank", "layers_jaccard", "sales_procrustes", "sales_rsacorr", "coordinates_nbs",
]


def test_every_query_has_sql_except_the_sampled_measures():
    queries, sql = all_queries(), all_sql()
    assert set(queries) == set(sql)
    assert not set(sql) - set(queries)
    assert all(f"{side}_{m}" in queries for side in ("layers", "sales") for m in MEASURES)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 28 * 3


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).sql(entry.oracle_sql()[name]).df()) is None


@needs_data
@pytest.mark.parametrize("name", ["streamed_activations", "streamed_statistics"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    for table in ("embeddings", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert difference(got, connect(SF).sql(entry.oracle_sql()[name]).df()) is None
