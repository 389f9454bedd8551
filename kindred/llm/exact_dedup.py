"""Exact deduplication: two passes of Bloom filtering, then only possible repeats are exchanged.

Texts are reduced to their SHA-256 in one scan; the rest works on narrow rows (id, digest). The first
pass fills a filter that knows which bits at least two rows have set. In the second pass a row whose
bits are not all of that kind is certainly unique and goes straight to the result; the others
are grouped by digest, which settles false alarms. Groups are counted with map-side
aggregation; groups with more than 1/``HOT`` of all rows (fewer than ``HOT`` of them) are attached by broadcast,
so a text that makes up a third of the corpus is never sent to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bloom
from kindred.llm.common import stored

HOT = 200


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal if identical; null counts as empty. Of equal texts the row with the largest id stays
    (a null id is the smallest); of rows that also share the id exactly one stays. ``text_sha256`` is
    the lower-case digest of the UTF-8 text.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.unhex(digest).alias("sha"), F.monotonically_increasing_id().alias("row"))
        .withColumn("key", F.conv(F.hex(F.substring("sha", 1, 7)), 16, 10).cast("long")),
        "digests",
    )
    total = rows.count()
    _, twice = bloom.build(rows, "key", bloom.size_for(total, max_bits))
    marked = bloom.passing(rows, "key", twice, "maybe")
    result = [F.col("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]

    alone = marked.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    repeats = marked.where("maybe").select("doc_id", "sha", "row")
    groups = repeats.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("sha").alias("group_sha"), "last", "group_size")
    hot = groups.where(F.col("group_size") > max(total // HOT, 1000))
    found = repeats.join(F.broadcast(hot), F.col("sha") == F.col("group_sha"), "left")
    rest = found.where("group_sha is null").select("doc_id", "sha", "row")
    rest = rest.join(groups, F.col("sha") == F.col("group_sha"))
    settled = found.where("group_sha is not null").unionByName(rest).select(
        "doc_id", "sha", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept")
    )
    return alone.unionByName(settled).select(*result)
