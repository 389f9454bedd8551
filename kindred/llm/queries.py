"""The queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from kindred.llm import exact_dedup, jaccard_join, language_id, line_dedup, manifest, packing, page_diff, quality_rules, records, sampled_pieces, subword_classifier, toxicity, whitening
from kindred.llm.common import Batches, fold, in_arrow, table
from kindred.session import scratch_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, trusted).select(
        "doc_id", "_rules.n_words", "_rules.word_chars", "_rules.n_symbols", "_rules.n_dup_lines", "_rules.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rules.llr").alias("llr"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: those outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return labels.select("doc_id", F.col("quality").alias("label"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subword_classifier.fit(docs, quality_labels(spark, sf_dir))
    return subword_classifier.score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score")
    )


def _id_crc(batches: Batches, dtype: str, column: str = "ids") -> Batches:
    """The batches with the ids replaced by the crc32 of their unsigned 32-bit little-endian form."""
    for batch in batches:
        at = batch.schema.names.index(column)
        crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, f"{column}_crc32", pa.array(crc, pa.int64()))


def packed_pieces(packed: packing.Packing) -> DataFrame:
    """Where each piece lies, with a digest of its ids instead of the ids."""
    dtype = packed.dtype
    kind = packed.pieces.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    digests = in_arrow(packed.pieces, lambda batches: _id_crc(batches, dtype), schema)
    return digests.join(packed.places, "row").drop("row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed_pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = sampled_pieces.decode(sampled_pieces.encode(docs, model), model)
    return decoded.select(
        "doc_id", F.size("_ids").alias("n_pieces"), F.col("_ids").alias("ids"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = records.write_records(docs, scratch_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    dtype = written.dtype
    return in_arrow(
        records.read_records(written), lambda batches: _id_crc(batches, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return whitening.whiten(vectors, model).select("vec_id", "_deviation", F.posexplode("_whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        "whitened", F.get(explained.cast("array<double>"), F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest.document_manifest(docs, altered={"text": tampered})
    found = manifest.folded_root(F.col("altered_leaf"), F.col("path"))
    out = rows.withColumn("found", found)
    return out.select(
        "doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        F.lower(F.hex("found")).alias("folded_root"), (F.col("found") == F.col("root")).alias("verified"),
    )


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: those outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return labels.select("doc_id", F.col("toxic").alias("label"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxic_labels(spark, sf_dir))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality_rules, op2_line_dedup, op3_quality_classifier, op4_jaccard_join, op5_language_id, op6_packing, op7_sampled_pieces, op8_exact_dedup, op9_page_diff, op10_token_records, op11_whitening, op12_manifest, op13_toxicity]
    return {f.__name__: f for f in named}


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END)) AS s FROM words),
classes AS (SELECT s, max(doc_id) AS class_id, count(*) AS class_size FROM sets GROUP BY s),
entries AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM entries a JOIN entries b ON a.x = b.x AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
tops AS (SELECT a, max(b) AS group_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT sets.doc_id, c.class_id, c.class_size, coalesce(d.n_links, 0) AS n_links, t.group_id
FROM sets JOIN classes c ON sets.s = c.s JOIN tops t ON t.a = c.class_id LEFT JOIN degrees d ON d.a = c.class_id
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP12_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS d, lang, CAST(n_chars AS VARCHAR) AS c, text,
    -- the lowest bit of crc32, which a final complement turns round
    1 - (list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) & 1) AS odd
  FROM documents),
texts AS (SELECT *, CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM fields),
parts AS (SELECT *, list_transform([d, source, lang, c, text, altered], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS p FROM texts),
digests AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(p[1] || p[2] || p[3] || p[4] || p[5]) AS leaf,
         sha256(p[1] || p[2] || p[3] || p[4] || p[6]) AS altered_leaf FROM parts),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER () AS id FROM digests),
lower_nodes(lvl, tree, number, h, n) AS (
  SELECT 0, tree, number, leaf, n FROM leaves UNION ALL
  SELECT lvl + 1, tree, number // 3, sha256(string_agg(h, '' ORDER BY number)), (any_value(n) + 2) // 3
  FROM lower_nodes WHERE n > 1 GROUP BY lvl, tree, number // 3),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
upper_nodes(lvl, number, h, n) AS (
  SELECT 0, number, h, n FROM subroots UNION ALL
  SELECT lvl + 1, number // 3, sha256(string_agg(h, '' ORDER BY number)), (any_value(n) + 2) // 3
  FROM upper_nodes WHERE n > 1 GROUP BY lvl, number // 3),
nodes AS (
  SELECT 0 AS part, lvl, tree, number, h, n FROM lower_nodes UNION ALL SELECT 1, lvl, '', number, h, n FROM upper_nodes),
siblings AS (
  SELECT a.part, a.lvl, a.tree, a.number,
         coalesce(string_agg(b.h, '' ORDER BY b.number) FILTER (b.number < a.number), '') AS lefts,
         coalesce(string_agg(b.h, '' ORDER BY b.number) FILTER (b.number > a.number), '') AS rights
  FROM nodes a JOIN nodes b ON a.part = b.part AND a.lvl = b.lvl AND a.tree = b.tree AND a.number // 3 = b.number // 3
  WHERE a.n > 1 GROUP BY ALL),
places AS (
  SELECT l.id, 0 AS part, l.tree, l.number FROM leaves l UNION ALL
  SELECT l.id, 1, '', s.number FROM leaves l JOIN subroots s ON l.tree = s.tree),
steps AS (
  SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY s.part, s.lvl) AS k, s.lefts, s.rights
  FROM places p JOIN siblings s ON p.part = s.part AND p.tree = s.tree AND s.number = p.number // CAST(pow(3, s.lvl) AS BIGINT)),
proofs AS (SELECT id, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof, count(*) AS n_steps FROM steps GROUP BY id),
folds(id, k, h) AS (
  SELECT id, CAST(0 AS BIGINT), altered_leaf FROM leaves UNION ALL
  SELECT f.id, f.k + 1, sha256(s.lefts || f.h || s.rights) FROM folds f JOIN steps s ON f.id = s.id AND s.k = f.k + 1)
SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM upper_nodes WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON l.tree = r.tree LEFT JOIN proofs p ON l.id = p.id JOIN folds f ON f.id = l.id AND f.k = coalesce(p.n_steps, 0)
"""


def all_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op12_manifest": OP12_SQL}
