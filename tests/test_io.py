import io
import pickle
from collections import Counter

import numpy as np
import pytest
from conftest import gram_frame, random_cov
from pyspark.sql import functions as F

from kindred.operators import gram as G
from kindred.operators import sampling
from kindred.operators.gram_compare import compare_gram
from kindred.operators.reliability import cell_stats
from kindred.plans.registry import MEASURES, forget_measure, register_measure
from kindred.session import scratch_path
from kindred.sources import activations as A
from kindred.sources import tables as T
from kindred.sources.matrices import cells, read_matrices
from kindred.streaming import incremental as I


def small_layers(spark, lo=0, hi=10):
    df = spark.range(lo, hi).select(
        F.col("id").alias("stim"), F.array(*[(F.col("id") * (f + 1)).cast("double") for f in range(4)]).alias("x")
    )
    return A.extract(df, "stim", {"first": F.slice("x", 1, 3), "last": F.col("x")[3]})


def test_layer_functions_flatten_and_select(spark):
    nested = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[5.0, 6.0], [7.0, 8.0]])], "stim long, t array<array<double>>")
    layers = A.extract(nested, "stim", {"t": F.col("t"), "s": F.col("t")[0][0]}, output=("output", F.col("t")[1]))
    assert layers.names == ["t", "s", "output"] and dict(layers.widths) == {"t": 4, "s": 1, "output": 2}
    assert {(r.layer, r.stim): list(r.features) for r in layers.select("t").long().collect()} == {("t", 1): [1, 2, 3, 4], ("t", 2): [5, 6, 7, 8]}
    with pytest.raises(KeyError):
        layers.select("none")
    kept = A.extract(nested, "stim", {"t": F.col("t"), "s": F.col("t")[0][0]}, keep="s")
    assert kept.names == ["s"]


def test_catalog_and_uneven_layers(spark):
    rows = {r.layer: (r.n_stim, r.n_feat) for r in A.catalog(small_layers(spark)).collect()}
    assert rows == {"first": (10, 3), "last": (10, 1)}
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "stim long, x array<double>")
    with pytest.raises(Exception, match="uneven"):
        A.catalog(A.extract(ragged, "stim", {"x": F.col("x")})).collect()


def test_coverage_finds_missing_double_and_strange_stimuli(spark):
    acts = [("full", 1), ("full", 2), ("twice", 1), ("twice", 2), ("twice", 2), ("short", 1), ("odd", 1), ("odd", 2), ("odd", 3)]
    found = A.coverage(spark.createDataFrame(acts, "layer string, stim long"), spark.createDataFrame([(1,), (2,)], "stim long"))
    assert {r.layer: r.complete for r in found.collect()} == {"full": True, "twice": False, "short": False, "odd": False}


def test_layers_picked_by_their_neighbours(spark):
    names = ["conv", "add_1", "relu_1", "conv_2", "relu_2", "add_2", "relu_3", "pool"]
    frame = spark.createDataFrame([("m", i, n) for i, n in enumerate(names)], "model string, ord int, layer string")
    assert sorted(r.layer for r in A.between(frame, ["model"], "ord", "layer", "relu", "add", "").collect()) == ["relu_1", "relu_3"]
    assert [r.layer for r in A.between(frame, ["model"], "ord", "layer", "relu", "add", "conv").collect()] == ["relu_1"]


def test_wrong_width_is_an_error_not_a_wrong_result(spark):
    from kindred.operators.layer_compare import compare_layers

    ragged = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [1.0], 2.0)], "stim long, x array<double>, z double").coalesce(1)
    layers = A.extract(ragged, "stim", {"x": F.col("x"), "z": F.col("z")}, widths={"x": 2, "z": 1})
    with pytest.raises(Exception, match="must hold"):
        compare_layers(layers, "cka").collect()


def test_two_families_side_by_side(spark):
    one = small_layers(spark)
    two = A.extract(spark.range(5, 20), "id", {"square": (F.col("id") * F.col("id"))})
    both = one.concat(two)
    assert both.names == ["first", "last", "square"] and both.df.count() == 5
    with pytest.raises(ValueError, match="twice"):
        one.concat(one)


def test_mock_inputs_are_seeded(spark):
    one, two = (A.mock_inputs(spark, 6, (2, 3), seed=5).orderBy("stim").collect() for _ in range(2))
    assert one == two and len(one) == 6 and all(len(r.x) == 6 for r in one)


def test_activation_table_is_created_once_then_appended(spark, tmp_path):
    path = str(tmp_path / "acts")
    T.write_activations(small_layers(spark, 0, 5), path)
    with pytest.raises(Exception, match="(?i)exist"):
        T.write_activations(small_layers(spark, 0, 5), path)
    T.write_activations(small_layers(spark, 5, 10), path, first=False, compact=True)
    back = T.read_activations(spark, path)
    assert back.count() == 20 and T.read_activations(spark, path, "last").select("stim").distinct().count() == 10
    plan = T.read_activations(spark, path, "last")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    out = str(tmp_path / "gram")
    T.write_grams(spark, path, out)
    direct = G.gram_from_features(A.features_long(small_layers(spark)))
    gap = G.max_relative_difference(direct, T.read_grams(spark, out)).collect()
    assert len(gap) == 2 and all(r.max_abs == 0 for r in gap)


def test_matrix_files(spark, tmp_path):
    covs = np.stack([random_cov(3, s) for s in range(4)])
    np.save(tmp_path / "stack.npy", covs)
    np.savez(tmp_path / "named.npz", a=covs[0], b=covs[1])
    (tmp_path / "array.pkl").write_bytes(pickle.dumps(covs))
    (tmp_path / "list.pickle").write_bytes(pickle.dumps([c for c in covs]))
    (tmp_path / "dicts.pkl").write_bytes(pickle.dumps([{"x": covs[0], "y": covs[1]}, {"x": covs[2], "y": covs[3]}]))
    (tmp_path / "one.pkl").write_bytes(pickle.dumps({"x": covs[0], "y": covs[1]}))
    got = {}
    for r in read_matrices(spark, str(tmp_path)).collect():
        got.setdefault(r.source, []).append((r.ord, r.layer, np.reshape(r.m, (r.dim, r.dim))))
    assert {k: len(v) for k, v in got.items()} == {"stack": 4, "named": 2, "array": 4, "list": 4, "dicts": 4, "one": 2}
    for name in ("stack", "array", "list", "dicts"):
        assert np.array_equal(np.stack([m for _, _, m in sorted(got[name], key=lambda t: t[0])]), covs)
    assert [l for _, l, _ in sorted(got["dicts"], key=lambda t: t[0])] == ["0/x", "0/y", "1/x", "1/y"]
    one = cells(read_matrices(spark, str(tmp_path / "one.pkl")))
    assert {r.layer for r in compare_gram(one, "cka").select(F.explode(F.array("a", "b")).alias("layer")).collect()} == {"one:x", "one:y"}


def test_one_job_from_layers_to_matrices(spark, tmp_path):
    acts, out = str(tmp_path / "acts"), str(tmp_path / "gram")
    parts = [small_layers(spark, 0, 6), small_layers(spark, 6, 10)]
    kept = T.gram_job(parts, acts, out, layers="first")
    assert T.read_activations(spark, acts).count() == 20 and {r.layer for r in kept.select("layer").distinct().collect()} == {"first"}
    whole = T.gram_job(small_layers(spark), str(tmp_path / "other"), str(tmp_path / "all"), keep_activations=False)
    assert not (tmp_path / "other").exists()
    same = {(r.i, r.j): r.v for r in whole.where("layer = 'first'").collect()}
    assert same == {(r.i, r.j): r.v for r in kept.collect()} and len(same) == 100 and whole.count() == 200
    with pytest.raises(ValueError, match="no stimuli"):
        T.gram_job([], acts, out)


def test_other_files_and_unsafe_pickles_are_refused(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"1")
    with pytest.raises(Exception, match="expected one of"):
        read_matrices(spark, str(tmp_path / "x.txt")).collect()

    class Call:
        def __reduce__(self):
            return (print, ("called",))

    buffer = io.BytesIO()
    pickle.dump([Call()], buffer)
    (tmp_path / "y.pkl").write_bytes(buffer.getvalue())
    with pytest.raises(Exception, match="not allowed"):
        read_matrices(spark, str(tmp_path / "y.pkl")).collect()


def test_results_are_resumed_and_keyed_by_their_parameters(spark, tmp_path):
    path = str(tmp_path / "dist")
    covs = {n: random_cov(4, s) for s, n in enumerate("abcd")}
    T.compare_to_table(gram_frame(spark, {n: covs[n] for n in "abc"}), "covs", path, ["cka", "TVD"], samples=200)
    first = T.read_distances(spark, path).toPandas()
    assert Counter(first.measure) == {"cka": 3, "tvd": 3}
    T.compare_to_table(gram_frame(spark, covs), "covs", path, ["cka", "TVD"], samples=200)
    second = T.read_distances(spark, path).toPandas()
    assert Counter(second.measure) == {"cka": 6, "tvd": 6} and not second.duplicated(["run", "measure", "a", "b"]).any()
    files = sorted(p for p in (tmp_path / "dist").rglob("*.parquet"))
    T.compare_to_table(gram_frame(spark, covs), "covs", path, ["cka", "TVD"], samples=200)
    assert sorted(p for p in (tmp_path / "dist").rglob("*.parquet")) == files
    T.compare_to_table(gram_frame(spark, covs), "covs", path, "cka", b=0.5)
    # measures that share their parameters share a run; another b is another run
    runs = T.read_distances(spark, path).groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [6, 12]


@pytest.mark.parametrize("route", ["layers", "gram"])
def test_a_second_run_evaluates_missing_pairs_only(spark, tmp_path, route):
    calls = spark.sparkContext.accumulator(0)

    def counted(pair, params):
        calls.add(1)
        return float(pair.s1.trace())

    own = register_measure(f"counted {route}", counted)
    try:
        rng = np.random.default_rng(1)
        rows = [(i, rng.standard_normal(8).tolist()) for i in range(20)]
        layers = A.slices(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", width=2, total=8)
        gram = G.gram_from_features(A.features_long(layers))
        first = layers.select(layers.names[:3])
        part = first if route == "layers" else gram.where(F.col("layer") < layers.names[3])
        whole = layers if route == "layers" else gram
        path, name = str(tmp_path / "dist"), f"counted{route}"
        T.compare_to_table(part, "s", path, [name, "cka"])
        assert calls.value == 3
        T.compare_to_table(whole, "s", path, [name, "rsarank"])
        assert calls.value == 6
        T.compare_to_table(whole, "s", path, [name, "rsarank", "cka"])
        assert calls.value == 6
        stored = T.read_distances(spark, path)
        assert {r.measure: r["count"] for r in stored.groupBy("measure").count().collect()} == {name: 6, "rsarank": 6, "cka": 6}
    finally:
        forget_measure(own)


def test_undefined_values_are_not_queued_again(spark, tmp_path):
    path = str(tmp_path / "dist")
    singular = {"a": np.ones((3, 3)), "b": np.diag([1.0, 2.0, 3.0])}
    frame = gram_frame(spark, singular)
    T.compare_to_table(frame, "s", path, "kldiv", b=0, normalize=False)
    stored = T.read_distances(spark, path)
    assert stored.count() == 1 and stored.first().value is None
    run = stored.first().run
    assert T.pending(stored, T.all_pairs(frame), run, ["kldiv"]).isEmpty()


def test_samples_and_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("label"))
    one, two = (sorted(r.id for r in sampling.seeded_sample(df.repartition(p), "id", 200, 1).collect()) for p in (1, 7))
    assert one == two and len(set(one)) == 200
    assert one != sorted(r.id for r in sampling.seeded_sample(df, "id", 200, 2).collect())
    split = {p: {(r.id, r.part) for r in sampling.stratified_split(df.repartition(p), "label", "id", 0.8, 3, bins).collect()} for p, bins in ((1, 4096), (7, 4))}
    assert split[1] == split[7] and len(split[1]) == 1000
    labels = {r.id: r.label for r in df.collect()}
    assert Counter(labels[i] for i, part in split[1] if part == "train") == {"big": 560, "c0": 80, "c1": 80, "c2": 80}


def test_epoch_metrics_weigh_by_batch_size(spark):
    rows = [(1, 2.0, 1, 0, 0), (1, 4.0, 3, 1, 0), (2, 1.0, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "epoch int, loss double, n int, pred int, target int")
    assert {r.epoch: (r.mean_loss, r.accuracy) for r in sampling.epoch_metrics(frame, "epoch").collect()} == {1: (3.5, 0.5), 2: (1.0, 1.0)}


def test_streamed_trials_merge_to_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(v), f"s{int(s)}", float(x)) for v, s, x in zip(rng.integers(0, 3, 60), rng.integers(0, 2, 60), rng.standard_normal(60))]
    source = str(tmp_path / "in")
    trials = spark.createDataFrame(rows, "voxel long, stim string, v double")
    trials.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(trials.schema).option("maxFilesPerTrigger", 1).parquet(source)
    I.run_to_end(lambda: I.trial_statistics(stream, str(tmp_path / "out"), str(tmp_path / "offsets")))
    # at least three batches, but never more than two snapshots of one row per voxel and stimulus
    assert len(list((tmp_path / "offsets" / "commits").glob("[0-9]*"))) >= 3 and len(list((tmp_path / "out").glob("turn=*"))) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * len({r[:2] for r in rows})
    merged = {(r.voxel, r.stim): (r.n, r.mean, r.ss) for r in I.merged_statistics(spark, str(tmp_path / "out")).collect()}
    direct = {(r.voxel, r.stim): (r.n, r.mean, r.ss) for r in cell_stats(trials).collect()}
    assert merged.keys() == direct.keys() and all(np.allclose(merged[k], direct[k]) for k in direct)


def test_arriving_matrices_trigger_only_new_comparisons(spark, tmp_path):
    source, grams, dist = (str(tmp_path / n) for n in ("in", "grams", "dist"))
    covs = {n: random_cov(3, s) for s, n in enumerate("abc")}
    gram_frame(spark, {n: covs[n] for n in "ab"}).coalesce(1).write.parquet(source)
    schema = gram_frame(spark, covs).schema
    start = lambda: I.compare_arrivals(
        spark.readStream.schema(schema).parquet(source), grams, dist, str(tmp_path / "offsets"), "s", ["cka", "kldiv"]
    )
    I.run_to_end(start)
    assert T.read_distances(spark, dist).count() == 2
    gram_frame(spark, {"c": covs["c"]}).coalesce(1).write.mode("append").parquet(source)
    I.run_to_end(start)
    stored = {(r.measure, r.a, r.b): r.value for r in T.read_distances(spark, dist).collect()}
    assert len(stored) == 6
    for r in compare_gram(gram_frame(spark, covs), ["cka", "kldiv"]).collect():
        assert stored[(r.measure, r.a, r.b)] == pytest.approx(r.value)
    # the cells of earlier batches are not read again
    (tmp_path / "grams" / "batch=0").rename(tmp_path / "away")
    gram_frame(spark, {"d": random_cov(3, 9)}).coalesce(1).write.mode("append").parquet(source)
    I.run_to_end(start)
    assert T.read_distances(spark, dist).count() == 12


def test_arrivals_take_every_measure(spark, tmp_path):
    source, grams, dist = (str(tmp_path / n) for n in ("in", "grams", "dist"))
    covs = {n: random_cov(7, s) for s, n in enumerate("abc")}
    gram_frame(spark, covs).coalesce(1).write.parquet(source)
    names = [m for m in MEASURES if m not in ("mahalanobis",)]
    stream = spark.readStream.schema(gram_frame(spark, covs).schema).parquet(source)
    I.run_to_end(lambda: I.compare_arrivals(stream, grams, dist, str(tmp_path / "offsets"), "s", names, lmbd=0.1, k=2))
    stored = {(r.measure, r.a, r.b): r.value for r in T.read_distances(spark, dist).collect()}
    want = {(r.measure, r.a, r.b): r.value for r in compare_gram(gram_frame(spark, covs), names, lmbd=0.1, k=2).collect()}
    assert stored.keys() == want.keys() and all(stored[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items())


def test_streamed_activations_equal_written_ones(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).select(F.col("id").alias("stim"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x")).write.parquet(source)
    stream = spark.readStream.schema("stim long, x array<double>").parquet(source)
    layers = A.slices(stream, "stim", "x", width=1, total=2)
    I.run_to_end(lambda: I.append_activations(layers, str(tmp_path / "out"), str(tmp_path / "offsets")))
    assert T.read_activations(spark, str(tmp_path / "out"), "slice_00").count() == 10


def test_scratch_lies_in_the_configured_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one.startswith(base) and one != two
