"""Named queries: each callable takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import evidence as E
from kindred.operators import gram as G
from kindred.operators import gram_compare as GC
from kindred.operators import reliability as R
from kindred.operators import sampling
from kindred.operators import tiled as TG
from kindred.operators.layer_compare import compare_layers
from kindred.operators.moments import outer_sums
from kindred.plans import datasets as D
from kindred.plans.registry import forget_measure, register_measure
from kindred.session import scratch_path, ship_package
from kindred.sources import activations as A
from kindred.sources import tables as T
from kindred.streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]

#: parameters shared with the SQL of the same queries
LMBD, K = 0.1, 10
NOISE, GRID = 0.4, 10
PORTABLE_SAMPLES, DRAWS = 150, 10_000
BETAS = ((2.5, 1.0), (2.0, 3.0))


def _round(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round the floating-point columns; adding zero turns -0.0 into 0.0."""
    def shown(name: str, dtype: str) -> Column:
        if dtype == "double" and (not columns or name in columns):
            return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
        return F.col(name)

    return df.select(*[shown(n, t) for n, t in df.dtypes])


def _layers(measure: str, **options) -> Query:
    return lambda spark, sf: _round(compare_layers(D.embedding_layers(spark, sf), measure, **options))


def _coords(measure: str, **options) -> Query:
    return lambda spark, sf: _round(compare_layers(D.coordinate_layers(spark, sf), measure, **options))


def _sales(measure: str, **options) -> Query:
    return lambda spark, sf: _round(GC.compare_gram(D.sales_gram(spark, sf), measure, **options))


def _gram(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _round(transform(D.sales_gram(spark, sf)))


# --- layers and Gram matrices -------------------------------------------------


def acts_long(spark, sf):
    return A.features_long(D.embedding_layers(spark, sf))


def layer_catalog(spark, sf):
    return A.catalog(D.embedding_layers(spark, sf))


def document_catalog(spark, sf):
    return A.catalog(D.document_layers(spark, sf))


def activation_rows(spark, sf):
    docs = D.document_layers(spark, sf)
    return docs.select(["vowels", "length"]).long().select("layer", "stim", F.explode("features").alias("v")).groupBy(
        "layer", "stim"
    ).agg(F.sum("v").alias("total"))


def stored_activations(spark, sf):
    """Write the activations partitioned by layer, read two of them back."""
    path = scratch_path(spark, "acts")
    layers = D.document_layers(spark, sf)
    T.write_activations(layers.select("vowels"), path)
    T.write_activations(layers.select(["size", "length"]), path, first=False)
    back = T.read_activations(spark, path, ["vowels", "size"])
    return back.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_stim"),
        F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)), 3).alias("total"),
    )


def activation_coverage(spark, sf):
    """Do the layers cover the documents, and do the labels?"""
    docs = D.document_layers(spark, sf)
    labels = D.table(spark, sf, "labels").select(F.lit("labels").alias("layer"), F.col("doc_id").alias("stim"))
    acts = docs.long().select("layer", "stim").unionByName(labels)
    return A.coverage(acts, D.table(spark, sf, "documents").select(F.col("doc_id").alias("stim")))


def turns_between(spark, sf):
    """Answers between two questions, the way layers are picked by their neighbours."""
    turns = D.table(spark, sf, "conversations")
    return A.between(turns, ["conv_id"], "turn", "role", "assist", "user", "user").select("conv_id", "turn")


def gram_sales(spark, sf):
    return _round(D.sales_gram(spark, sf))


def gram_orders(spark, sf):
    """Orders against orders: a matrix of many thousand stimuli, summed up by tiles of 1,024."""
    acts = G.materialize(D.order_activations(spark, sf), "acts")
    index = G.materialize(G.stimulus_index(acts), "index")
    cells = G.gram_cells(acts, index, index.count()).where("v <> 0")
    tile = [F.floor(F.col(c) / 1024).cast("int").alias(f"tile_{c}") for c in "ij"]
    return _round(
        cells.groupBy("layer", *tile).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")), 3
    )


def wide_moments(spark, sf):
    """Second moments of 5,120 dense features, summed up by tiles of 1,024; cells beside the diagonal count for both triangles."""
    cells = outer_sums(D.product_features(spark, sf), "x", 5120)
    tile = [F.floor(F.col(c) / 1024).cast("int").alias(f"tile_{c}") for c in "ij"]
    twice = F.when((F.col("i") != F.col("j")) & (F.floor(F.col("i") / 1024) == F.floor(F.col("j") / 1024)), 2).otherwise(1)
    return _round(cells.groupBy(*tile).agg(F.sum(F.col("s") * twice).alias("total"), F.sum(F.col("s") * F.col("s") * twice).alias("squares")), 3)


def _agreement(measure: str) -> Query:
    """Values by integration, and whether estimates from 10,000 draws are within four standard deviations at most."""

    def compared(found: Callable[..., DataFrame], source: str) -> DataFrame:
        exact, estimate = found(measure), found(measure, samples=DRAWS, seed=5).withColumnRenamed("value", "estimate")
        both = exact.join(estimate, ["measure", "a", "b"])
        near = F.abs(F.col("estimate") - F.col("value")) <= 4 / DRAWS**0.5
        return both.select(F.lit(source).alias("source"), "measure", "a", "b", "value", near.alias("agrees"))

    def query(spark: SparkSession, sf: str) -> DataFrame:
        layers, gram = D.embedding_layers(spark, sf), D.sales_gram(spark, sf)
        one = compared(lambda m, **o: compare_layers(layers, m, **o), "layers")
        return _round(one.unionByName(compared(lambda m, **o: GC.compare_gram(gram, m, **o), "sales")))

    return query


def gram_centroids(spark, sf):
    """Gram of the classes' mean embeddings, per slice of eight coordinates."""
    rows = D.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    acts = rows.groupBy(F.col("label").alias("stim"), "pos").agg(F.avg("x").alias("v")).select(
        F.format_string("slice_%02d", F.expr("cast(pos div 8 as int)")).alias("layer"), "stim", (F.col("pos") % 8).alias("feat"), "v"
    )
    return _round(G.gram_from_features(acts), 8)


def gram_stored(spark, sf):
    """The batch job: store activations, then build and store the Gram per layer, and remove the activations."""
    acts_path, out = scratch_path(spark, "acts"), scratch_path(spark, "gram")
    rows = D.table(spark, sf, "documents").groupBy(F.col("lang")).agg(
        *[F.sum(F.regexp_count(F.lower("text"), F.lit(c))).cast("double").alias(c) for c in "aeiouxyz"]
    )
    index = G.stimulus_index(rows, "lang").select(F.col("stim").alias("lang"), F.col("i").cast("long").alias("position"))
    wide = rows.join(index, "lang")
    layers = A.extract(
        wide,
        "position",
        {"vowels": F.array(*"aeiou"), "rare": F.array(*"xyz")},
        widths={"vowels": 5, "rare": 3},
    )
    return T.gram_job(layers, acts_path, out, keep_activations=False)


def gram_validate(spark, sf):
    return _round(G.validate(G.trace_norm(D.sales_gram(spark, sf))))


def gram_agreement(spark, sf):
    """Whole Gram against the sum of the Grams of the two halves of the features."""
    acts = D.sales_activations(spark, sf)
    index = D.nation_index(spark, sf)
    whole = G.gram_from_features(acts, index)
    part = F.when(F.pmod(F.xxhash64("feat"), F.lit(2)) == 0, "x").otherwise("y")
    split = G.gram_from_features(acts.withColumn("layer", F.concat_ws("|", "layer", part)), index)
    merged = split.groupBy(F.substring_index("layer", "|", 1).alias("layer"), "i", "j").agg(F.sum("v").alias("v"))
    diff = G.max_relative_difference(whole, merged)
    return diff.select("layer", (F.col("max_rel") < 1e-4).alias("agrees"))


def add_noise_weighted(spark, sf):
    gram = G.trace_norm(D.sales_gram(spark, sf))
    return _round(G.add_noise(gram, NOISE, weights=D.nation_weights(spark, sf)))


def sim_to_dist(spark, sf):
    return _round(GC.distance_form(GC.symmetrize(GC.compare_gram(D.sales_gram(spark, sf), "cka"))))


def dist_matrix(spark, sf):
    found = compare_layers(D.embedding_layers(spark, sf), ["kldiv", "cka", "rsa_arccos"])
    return _round(GC.symmetrize(found))


def matrix_products(spark, sf):
    """Frobenius products of the raw matrices, the building block of the entrywise measures."""
    return _round(GC.cell_products(D.sales_gram(spark, sf)).select("a", "b", "n", "sxy", "sxx", "syy"), 3)


def mean_cell_product(spark, sf):
    centred = G.double_center(G.trace_norm(D.sales_gram(spark, sf)))
    return _round(GC.cell_products(centred).select("a", "b", (F.col("sxy") / F.col("n")).alias("dcov2")))


def two_families(spark, sf):
    """Layers of two models side by side: nation sales and order counts by priority."""
    sales = D.sales_gram(spark, sf)
    orders = D.table(spark, sf, "orders").join(
        D.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("stim")), "o_custkey"
    )
    acts = orders.groupBy(F.lit("orders").alias("layer"), "stim", F.col("o_orderpriority").alias("feat")).agg(
        F.count(F.lit(1)).cast("double").alias("v")
    )
    index = D.nation_index(spark, sf)
    counts = G.gram_from_features(acts, index, index.count())
    return _round(GC.compare_gram(sales.unionByName(counts), "cka"))


def kl_to_ideal(spark, sf):
    both = D.sales_gram(spark, sf).unionByName(D.region_gram(spark, sf))
    targets = G.materialize(both, "grams")
    todo = targets.select(F.col("layer").alias("a")).distinct().where("a <> 'ideal'").withColumn("b", F.lit("ideal"))
    return _round(GC.compare_gram(targets, "kldiv", todo=todo))


def measure_names(spark, sf):
    part = D.table(spark, sf, "part")
    return part.groupBy(S.simplified(F.col("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def scalar_rules(spark, sf):
    """The numeric guards applied to every line item's discount and tax around a threshold."""
    lines = D.table(spark, sf, "lineitem")
    gap = (F.col("l_discount") - F.col("l_tax")) * 1e-6
    cosine = 1 + (F.col("l_discount") - 0.05) * 2e-6
    return lines.groupBy("l_returnflag").agg(
        F.count_if(S.zero_small_negative(gap) == 0).alias("n_zeroed"),
        F.count_if(S.clamp_cosine(cosine) == 1).alias("n_clamped"),
        F.round(F.sum(F.array_min(S.clip_eigenvalues(F.array(gap, F.col("l_tax"))))), 6).alias("lowest"),
        F.round(F.sum(S.log_add_exp(F.col("l_tax"), F.col("l_discount"))), 4).alias("log_add"),
    )


def pairs_remaining(spark, sf):
    """Comparisons left after a first run over a subset of the measures."""
    layers = D.embedding_layers(spark, sf)
    path = scratch_path(spark, "dist")
    T.compare_to_table(layers, "embeddings", path, ["cka", "rsa_cos"])
    run = T.run_key("embeddings", {"b": 0.01, "noise_var": None, "normalize": True}, {})
    return T.pending(T.read_distances(spark, path), T.all_pairs(layers), run, ["cka", "rsacos", "kldiv"])


def stored_distances(spark, sf):
    """Fill the result table in two runs; the second computes what the first left out."""
    layers = D.embedding_layers(spark, sf)
    path = scratch_path(spark, "dist")
    T.compare_to_table(layers.select(layers.names[:5]), "embeddings", path, ["cka", "kldiv"], b=[0.01, 0.05])
    T.compare_to_table(layers, "embeddings", path, ("cka", "kldiv"), b=[0.01, 0.05])
    return _round(T.read_distances(spark, path).select("measure", "a", "b", "value"))


# --- trials, reliability, evidence -------------------------------------------


def run_lengths(spark, sf):
    return _round(_round(R.run_lengths(D.trials(spark, sf)), 9, "mean"), 6, "ss")


def stim_repetitions(spark, sf):
    return R.repetitions(D.event_stats(spark, sf))


def mean_response(spark, sf):
    return _round(D.event_stats(spark, sf).select("voxel", "stim", F.col("mean").alias("y"), F.col("n").alias("n_reps")), 9)


def noise_estimation(spark, sf):
    return _round(R.noise_estimation(D.event_stats(spark, sf)))


def noise_by_run(spark, sf):
    return _round(R.noise_estimation(R.run_lengths(D.trials(spark, sf))))


def _reliability(stats: DataFrame) -> DataFrame:
    # a mean of two-decimal values can end in exactly half a millionth
    return _round(_round(R.voxel_reliability(stats), 9, "mean"), 6, "noise_var", "total_var", "reliability")


def voxel_reliability(spark, sf):
    return _reliability(D.event_stats(spark, sf))


def supplier_reliability(spark, sf):
    lines = D.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("voxel"), F.concat("l_returnflag", "l_linestatus").alias("stim"), F.col("l_quantity").alias("v")
    )
    return _reliability(R.cell_stats(lines))


def zscore_voxel(spark, sf):
    trials = D.trials(spark, sf)
    return _round(R.zscore(trials, R.voxel_reliability(R.cell_stats(trials))))


def zscore_response(spark, sf):
    return _round(R.zscore_stats(D.event_stats(spark, sf)))


def beta_noise_fit(spark, sf):
    return _round(R.fit_noise(D.discount_channels(spark, sf)))


def beta_neg_loglik(spark, sf):
    return _round(R.beta_loglik(D.discount_channels(spark, sf), 2.0))


def noise_grid(spark, sf):
    return _round(R.fitted_noise_grid(D.discount_channels(spark, sf), GRID))


def grouped_trials(spark, sf):
    return R.group_by_first_appearance(D.trials(spark, sf)).select("voxel", "stim", "trial", "position")


def _event_scores(spark, sf, channels: DataFrame | None = None, **noise) -> DataFrame:
    # decomposed models: 3 x stimuli² x 8 bytes, known before the join
    index = D.event_index(spark, sf)
    n = index.count()
    channels = D.event_channels(spark, sf, index).drop("w") if channels is None else channels
    scores = E.loglik(channels, D.event_models(spark, sf, index), model_bytes=3 * n * n * 8, **noise)
    return _round(scores.select("voxel", "model", "ll"))


def loglik_single_noise(spark, sf):
    return _event_scores(spark, sf, noise_var=NOISE)


def loglik_voxel_noise(spark, sf):
    return _event_scores(spark, sf)


def loglik_weighted(spark, sf):
    return _event_scores(spark, sf, weights=D.presentation_weights(spark, sf))


def loglik_voxel_weights(spark, sf):
    return _event_scores(spark, sf, D.event_channels(spark, sf))


def loglik_signal(spark, sf):
    return _event_scores(spark, sf, noise_var=NOISE, signal_var=0.9)


def _discount_scores(spark, sf, index: DataFrame | None = None, **noise) -> DataFrame:
    index = D.discount_index(spark, sf) if index is None else index
    n = index.count()
    channels = D.discount_channels(spark, sf, index).drop("w")
    return E.loglik(channels, D.discount_models(spark, sf, index), model_bytes=3 * n * n * 8, **noise)


def discount_loglik(spark, sf):
    return _round(_discount_scores(spark, sf).select("voxel", "model", "ll"))


def _on_grid(spark, sf) -> DataFrame:
    index = D.discount_index(spark, sf)
    return _discount_scores(spark, sf, index, grid=R.fitted_noise_grid(D.discount_channels(spark, sf, index), GRID))


def noise_grid_fixed(spark, sf):
    """Noise levels of every supplier: its total variance times the quantiles of two given distributions."""
    response = F.col("l_extendedprice") * F.col("l_discount")
    totals = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("voxel")).agg(F.var_samp(response).alias("total_var"))
    grids = [R.beta_noise_grid(spark, a, b, GRID).select(F.lit(f"{a:g},{b:g}").alias("beta"), "noise_id", "noise_var") for a, b in BETAS]
    return _round(totals.join(F.broadcast(grids[0].unionByName(grids[1]))).select("voxel", "beta", "noise_id", (F.col("total_var") * F.col("noise_var")).alias("noise")), 2)


def loglik_with_mean(spark, sf):
    """Evidence of the event models after a mean response, a fifth of the position, is taken off."""
    index = D.event_index(spark, sf)
    n = index.count()
    channels = D.event_channels(spark, sf, index).drop("w")
    channels = channels.withColumn("mu", F.transform("y", lambda _, i: (i / 5).cast("double")))
    scores = E.loglik(channels, D.event_models(spark, sf, index), noise_var=NOISE, model_bytes=3 * n * n * 8)
    return _round(scores.select("voxel", "model", "ll"))


def _uncentred_alignment(pair, params) -> float:
    rest = pair.extra * pair.floor**2
    dots = [float((x * y).sum()) + rest for x, y in ((pair.s1, pair.s2), (pair.s1, pair.s1), (pair.s2, pair.s2))]
    return dots[0] / (dots[1] * dots[2]) ** 0.5


def registered_measure(spark, sf):
    """A measure that is not built in: alignment without centring."""
    own = register_measure("uncentred alignment", _uncentred_alignment, similarity=True)
    try:
        return _round(compare_layers(D.embedding_layers(spark, sf), "Uncentred-Alignment"))
    finally:
        forget_measure(own)


def loglik_noise_grid(spark, sf):
    return _round(_on_grid(spark, sf))


def loglik_noise_marginal(spark, sf):
    return _round(E.marginal(_on_grid(spark, sf)))


def log_posterior(spark, sf):
    return _round(E.log_posterior(E.marginal(_on_grid(spark, sf))))


def log_posterior_joint(spark, sf):
    return _round(E.log_posterior(_on_grid(spark, sf)).drop("ll"))


def log_posterior_per_noise(spark, sf):
    return _round(E.log_posterior(_on_grid(spark, sf), ["voxel", "noise_id"]).drop("ll"))


def posterior_sum_check(spark, sf):
    posts = E.posterior(E.log_posterior(_on_grid(spark, sf)))
    return _round(posts.groupBy("voxel").agg(F.sum("post").alias("total"), F.count(F.lit(1)).alias("n")))


def _event_posterior(spark, sf) -> DataFrame:
    index = D.event_index(spark, sf)
    n = index.count()
    channels = D.event_channels(spark, sf, index).drop("w")
    scores = E.loglik(channels, D.event_models(spark, sf, index), noise_var=NOISE, model_bytes=3 * n * n * 8)
    return E.log_posterior(scores)


def winner_counts(spark, sf):
    return E.winner_counts(_event_posterior(spark, sf))


def discount_winners(spark, sf):
    return E.winner_counts(E.log_posterior(E.marginal(_on_grid(spark, sf))))


def logpost_boxplot(spark, sf):
    posts = G.materialize(_event_posterior(spark, sf).select("model", "log_post"), "logpost")
    return _round(E.boxplot(posts, models=3))


# --- sampling, regions, streams ----------------------------------------------


def seeded_sample(spark, sf):
    return sampling.seeded_sample(D.table(spark, sf, "embeddings"), "vec_id", 200, seed=42).select("vec_id", "label")


def stratified_split(spark, sf):
    split = sampling.stratified_split(D.table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.8, seed=42)
    return split.select("vec_id", "label", "part")


def document_split(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.stratified_split(docs, "lang", "doc_id", 0.8, seed=7).select("doc_id", "lang", "part")


def region_trials(spark, sf):
    """Shipments of the suppliers of one region, scaled."""
    lines = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("voxel"), F.col("l_quantity").alias("v"))
    members = (
        D.table(spark, sf, "supplier")
        .join(D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
        .join(D.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    )
    asia = members.where(F.col("r_name") == "ASIA").select(F.col("s_suppkey").alias("voxel"))
    return _round(R.in_region(lines, asia, 300).groupBy("voxel").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


def scatter_volume(spark, sf):
    """Posterior of one model at every customer's key; 0 where a customer has no events."""
    coordinates = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("voxel"), "c_nationkey")
    posts = E.posterior(_event_posterior(spark, sf)).where(F.col("model") == "hour")
    return _round(R.scatter(coordinates, posts, ["post"]))


def epoch_metrics(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    labels = D.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("pred"), (1 - F.col("toxic")).alias("target"))
    rows = docs.join(labels, "doc_id").withColumn("loss", F.pow(F.col("pred") - F.col("target"), 2).cast("double"))
    return _round(sampling.epoch_metrics(rows, "lang"))


def streamed_statistics(spark, sf):
    """Noise per user from trial statistics collected by a stream."""
    source = D.table_stream(spark, sf, "events")
    trials = source.select(F.col("user_id").alias("voxel"), F.col("event_type").alias("stim"), F.col("value").alias("v"))
    path = scratch_path(spark, "stats")
    I.run_to_end(lambda: I.trial_statistics(trials, path, scratch_path(spark, "offsets")))
    return _round(R.noise_estimation(I.merged_statistics(spark, path)))


def streamed_activations(spark, sf):
    source = D.table_stream(spark, sf, "embeddings")
    layers = A.slices(source, "vec_id", "embedding", width=8, total=64)
    path = scratch_path(spark, "acts")
    I.run_to_end(lambda: I.append_activations(layers, path, scratch_path(spark, "offsets")))
    stored = T.read_activations(spark, path)
    norm = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x)
    return _round(stored.groupBy("layer").agg(F.count(F.lit(1)).alias("n_stim"), F.sum(norm).alias("trace")))


def streamed_comparisons(spark, sf):
    """Matrices that arrive in two batches; each batch fills in the comparisons it makes possible."""
    source, grams, out = (scratch_path(spark, name) for name in ("arriving", "grams", "dist"))
    gram = D.sales_gram(spark, sf)
    for state in ("layer < 'N'", "layer >= 'N'"):
        gram.where(state).write.mode("append").parquet(source)
        stream = spark.readStream.schema("layer string, i int, j int, v double").parquet(source)
        I.run_to_end(lambda: I.compare_arrivals(stream, grams, out, f"{out}-offsets", "sales", ["cka", "gulp"], lmbd=LMBD))
    return _round(T.read_distances(spark, out).select("measure", "a", "b", "value"))


def _tiled(measure: str) -> Query:
    """Customers against customers by their orders: matrices of all customers, by moments of their few features."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        acts = D.customer_activations(spark, sf)
        index = G.stimulus_index(acts)
        return _round(TG.compare_features(acts, index, index.count(), measure))

    return query


#: measures and the options their queries use
OPTIONS = {"gulp": {"lmbd": LMBD}, "jaccard": {"k": K}}
ALGEBRAIC = ("kldiv", "bhattacharyya", "hellinger", "wasserstein", "gulp", "procrustes", "nbs")
ENTRYWISE = ("cka", "distcorr", "rsacorr", "rsacos", "rsaarccos", "rsarank", "jaccard")
SAMPLED = ("tvd", "jsd")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        f.__name__: f
        for f in (
            acts_long, layer_catalog, document_catalog, activation_rows, stored_activations, activation_coverage, turns_between, gram_sales, gram_orders, wide_moments,
            gram_centroids, gram_stored, gram_validate, gram_agreement, add_noise_weighted, sim_to_dist,
            dist_matrix, matrix_products, mean_cell_product, two_families, kl_to_ideal, measure_names,
            scalar_rules, pairs_remaining, stored_distances, run_lengths, stim_repetitions, mean_response,
            noise_estimation, noise_by_run, voxel_reliability, supplier_reliability, zscore_voxel,
            zscore_response, beta_noise_fit, beta_neg_loglik, noise_grid, noise_grid_fixed, loglik_with_mean, registered_measure, grouped_trials, loglik_single_noise,
            loglik_voxel_noise, loglik_weighted, loglik_voxel_weights, loglik_signal, discount_loglik, discount_winners, loglik_noise_grid,
            loglik_noise_marginal, log_posterior, log_posterior_joint, log_posterior_per_noise,
            posterior_sum_check, winner_counts, logpost_boxplot, seeded_sample, stratified_split,
            document_split, region_trials, scatter_volume, epoch_metrics, streamed_statistics,
            streamed_activations, streamed_comparisons,
        )
    }
    found |= {
        "trace_norm": _gram(G.trace_norm),
        "add_noise": _gram(lambda g: G.add_noise(G.trace_norm(g), NOISE, signal_var=0.0)),
        "condition_b": _gram(G.condition),
        "condition_noise_only": _gram(lambda g: G.condition(g, b=0.05, normalize=False)),
        "condition_norm_only": _gram(lambda g: G.condition(g, b=0.0)),
        "condition_raw": _gram(lambda g: G.condition(g, b=0.0, normalize=False)),
        "condition_noise_var": _gram(lambda g: G.condition(g, noise_var=NOISE)),
        "double_center": _gram(lambda g: G.double_center(G.trace_norm(g))),
        "rdm_sqeuclid": _gram(lambda g: G.squared_distances(G.trace_norm(g))),
        "cos_sim": _gram(lambda g: G.cosine_similarity(G.condition(g))),
        "minmax_scale": _gram(G.minmax),
        "ideal_representation": lambda spark, sf: D.region_gram(spark, sf),
        "neighbour_sets": lambda spark, sf: GC.neighbours(G.condition(D.sales_gram(spark, sf)), 3).select(
            "layer", "i", F.concat_ws(",", "neighbours").alias("neighbours")
        ),
    }
    for m in (*ALGEBRAIC, *ENTRYWISE, *SAMPLED, "mahalanobis"):
        found[f"layers_{m}"] = _layers(m, **OPTIONS.get(m, {}))
        sales = {"k": 3} if m == "jaccard" else OPTIONS.get(m, {})
        found[f"sales_{m}"] = _sales(m, **sales)
    for m in ("kldiv", "cka", "wasserstein"):
        found[f"scaled_{m}"] = lambda spark, sf, m=m: _round(compare_layers(D.scaled_layers(spark, sf), m))
    for m in SAMPLED:
        found[f"coordinates_{m}"] = _coords(m, portable=True, samples=PORTABLE_SAMPLES, seed=11)
        found[f"exact_coordinates_{m}"] = _coords(m)
        found[f"sampled_{m}"] = _agreement(m)
    for m in ("kldiv", "bhattacharyya", "hellinger"):
        found[f"tiled_{m}"] = _tiled(m)
    found["layers_nbs_unit"] = _layers("nbs", nbs_unit=True)
    for m in ("jaccard", "rsarank"):
        found[f"named_{m}"] = lambda spark, sf, m=m: _round(compare_layers(D.named_layers(spark, sf), m, **OPTIONS.get(m, {})))
    found["offset_rsacorr"] = lambda spark, sf: _round(compare_layers(D.offset_layers(spark, sf), "rsacorr"))
    found["wide_rsacorr"] = lambda spark, sf: _round(compare_layers(D.product_layers(spark, sf), "rsacorr"))
    for m in ("kldiv", "mahalanobis"):
        found[f"sales_{m}_means"] = lambda spark, sf, m=m: _round(GC.compare_gram(D.sales_gram(spark, sf), m, means=D.sales_means(spark, sf)))
    for m in ALGEBRAIC:
        found[f"coordinates_{m}"] = _coords(m, **OPTIONS.get(m, {}))
    return {name: _shipped(query) for name, query in found.items()}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
