"""The inputs of the named queries, built from the given tables.

* embedding layers: the 64 embedding coordinates cut into eight layers of eight
  features, or taken as 64 layers of one; every embedding is a stimulus.
* sales layers: stimuli are the suppliers' nations, features the parts, layers
  the line item states, values the quantities sold.
* trials: users are channels, event types stimuli, events single trials.
* event models: the same event types described by hour, weekday and key.
* discount trials: suppliers are channels, discount rates stimuli, line items
  single trials, and the discounted amount is the response.
* discount models: the discount rates described by rate, item state and quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import gram as G
from kindred.operators import reliability as R
from kindred.operators.evidence import channel_profiles
from kindred.sources.activations import Layers, extract, slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files.

    The path is a pattern that only the table's name fits: a filter of file names would match no file of a folder, and a plain path has to be a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def embedding_layers(spark: SparkSession, sf_dir: str) -> Layers:
    return slices(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", width=8, total=64)


def named_layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The embedding layers with names for ids, in the order of the ids."""
    named = table(spark, sf_dir, "embeddings").select(F.format_string("vector %012d", "vec_id").alias("name"), "embedding")
    return slices(named, "name", "embedding", width=8, total=64)


#: factors and offset of the layers that test the independence of scale and origin
SLICE_SCALES = {2: 1e4, 5: 1e-3}
OFFSET = 1e5


def scaled_layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The embedding layers in units of their own: some slices in much larger or smaller numbers."""
    factor = F.lit(1.0)
    for layer, scale in SLICE_SCALES.items():
        factor = F.when(F.floor(F.col("i") / 8) == layer, F.lit(scale)).otherwise(factor)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    cells = F.sort_array(F.collect_list(F.struct("i", (F.col("x") * factor).alias("x"))))
    return slices(rows.groupBy("vec_id").agg(cells.alias("c")).select("vec_id", F.col("c.x").alias("embedding")), "vec_id", "embedding", width=8, total=64)


def offset_layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The embedding layers far away from the origin."""
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + OFFSET)
    return slices(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("embedding")), "vec_id", "embedding", width=8, total=64)


def product_layers(spark: SparkSession, sf_dir: str) -> Layers:
    """A layer of 3,025 features, the products of 55 coordinates, beside one of the other nine coordinates."""
    one = F.slice(F.col("embedding").cast("array<double>"), 1, 55)
    products = F.flatten(F.transform(one, lambda x: F.transform(one, lambda y: x * y)))
    rest = F.slice(F.col("embedding").cast("array<double>"), 56, 9)
    return extract(table(spark, sf_dir, "embeddings"), "vec_id", {"products": products, "rest": rest}, widths={"products": 3025, "rest": 9})


def product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, x)``: 5,120 products of the 64 coordinates with the coordinates and the squares of the first 16."""
    whole = F.col("embedding").cast("array<double>")
    factors = F.concat(whole, F.transform(F.slice(whole, 1, 16), lambda z: z * z))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.transform(factors, lambda u: F.transform(whole, lambda x: u * x))).alias("x"))


def order_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(layer, stim, feat, v)``: orders as stimuli, parts as features, return flags as layers."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("layer"), F.col("l_orderkey").alias("stim"), F.col("l_partkey").alias("feat")).agg(
        F.sum("l_quantity").alias("v")
    )


def customer_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(layer, stim, feat, v)``: customers as stimuli, years and priorities of their orders as features, order states as layers."""
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("layer"), F.col("o_custkey").alias("stim"), F.concat(F.year("o_orderdate").cast("string"), "o_orderpriority").alias("feat")
    ).agg(F.count(F.lit(1)).cast("double").alias("v"))


def sales_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(layer, mu)``: a mean response per nation, from the average quantity per part."""
    acts = sales_activations(spark, sf_dir).join(nation_index(spark, sf_dir), "stim")
    per = acts.groupBy("layer", "i").agg((F.avg("v") / 100).alias("m"))
    return per.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("layer", F.col("c.m").alias("mu"))


def coordinate_layers(spark: SparkSession, sf_dir: str) -> Layers:
    return slices(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", width=1, total=64, prefix="coord")


def document_layers(spark: SparkSession, sf_dir: str) -> Layers:
    """Surface features of whole texts: two layers over the documents."""
    docs = table(spark, sf_dir, "documents")
    vowels = [F.regexp_count(F.lower("text"), F.lit(v)).cast("double") for v in "aeiou"]
    size = [F.length("text").cast("double"), F.size(F.split("text", " ")).cast("double")]
    return extract(
        docs,
        "doc_id",
        {"vowels": F.array(*vowels), "size": F.array(*size)},
        output=("length", F.col("n_chars")),
        widths={"vowels": 5, "size": 2, "length": 1},
    )


def sales_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        lines.join(suppliers, "l_suppkey")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("layer"),
            F.col("s_nationkey").alias("stim"),
            F.col("l_partkey").alias("feat"),
        )
        .agg(F.sum("l_quantity").alias("v"))
    )


def nation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stimulus_index(table(spark, sf_dir, "supplier"), "s_nationkey")


def sales_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gram_from_features(sales_activations(spark, sf_dir), nation_index(spark, sf_dir))


def nation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(i, w)``: suppliers per nation, as presentation counts."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stim"))
    counts = suppliers.groupBy("stim").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return counts.join(nation_index(spark, sf_dir), "stim").select("i", "w")


def region_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-region indicator over the nations with suppliers."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stim"), F.col("n_regionkey").alias("label"))
    present = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stim"))
    return G.same_class(nations.join(present, "stim", "left_semi"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("voxel"),
        F.col("event_type").alias("stim"),
        F.col("event_id").alias("trial"),
        F.col("value").alias("v"),
    )


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stimulus_index(table(spark, sf_dir, "events"), "event_type")


def event_models(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Trace-normalised Grams of three descriptions of the event types, from one scan."""
    key = F.get_json_object("props", "$.k")
    entries = F.array(
        F.struct(F.lit("hour").alias("layer"), F.hour("ts").cast("string").alias("feat"), F.lit(1.0).alias("v")),
        F.struct(F.lit("weekday").alias("layer"), F.dayofweek("ts").cast("string").alias("feat"), F.lit(1.0).alias("v")),
        F.struct(F.lit("key").alias("layer"), key.alias("feat"), F.col("value").alias("v")),
    )
    acts = (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("stim"), F.inline(entries))
        .groupBy("layer", "stim", "feat")
        .agg(F.sum("v").alias("v"))
    )
    return G.trace_norm(G.gram_from_features(acts, event_index(spark, sf_dir) if index is None else index))


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_stats(trials(spark, sf_dir))


def event_channels(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """z-scored mean responses of each user to the event types, with the user's own noise."""
    index = event_index(spark, sf_dir) if index is None else index
    return channel_profiles(event_stats(spark, sf_dir), index, index.count())


def presentation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(i, w)``: mean number of presentations of each event type per user."""
    totals = event_stats(spark, sf_dir).groupBy("stim").agg(F.avg("n").alias("w"))
    return totals.join(event_index(spark, sf_dir), "stim").select("i", "w")


def _percent() -> Column:
    return F.round(F.col("l_discount") * 100).cast("int")


def discount_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stimulus_index(table(spark, sf_dir, "lineitem").select(_percent().alias("stim")))


def discount_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("voxel"),
        _percent().alias("stim"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("v"),
    )
    return R.cell_stats(trials)


def discount_channels(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """z-scored mean discount amount of each supplier at each discount rate."""
    index = discount_index(spark, sf_dir) if index is None else index
    return channel_profiles(discount_stats(spark, sf_dir), index, index.count())


def discount_models(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Trace-normalised Grams of three descriptions of the discount rates, from one scan."""
    entries = F.array(
        F.struct(F.lit("rate").alias("layer"), F.lit("rate").alias("feat"), F.col("l_discount").alias("v")),
        F.struct(F.lit("state").alias("layer"), F.concat("l_returnflag", "l_linestatus").alias("feat"), F.lit(1.0).alias("v")),
        F.struct(F.lit("quantity").alias("layer"), F.col("l_quantity").cast("string").alias("feat"), F.col("l_tax").alias("v")),
    )
    acts = (
        table(spark, sf_dir, "lineitem")
        .select(_percent().alias("stim"), F.inline(entries))
        .groupBy("layer", "stim", "feat")
        .agg(F.sum("v").alias("v"))
    )
    return G.trace_norm(G.gram_from_features(acts, discount_index(spark, sf_dir) if index is None else index))
