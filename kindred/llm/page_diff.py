"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in order of their URL path, and every path is paired with its nearest
neighbour in that order, the one that shares the longer beginning with it. The text lines of a page and of its
neighbour are aligned by a longest common subsequence; shared lines belong to the frame of the site and
are deleted. Where the markup is plain about a line it is believed: what stands in an article element
is the article, what stands in menus, footers, adverts, forms or comments is not, unless that is most of
the page's text. Differencing decides about all other lines, those beside an article included.

Pages are parsed once into narrow rows. Only the line hashes of one page per path are sorted by URL, over
all tasks together, so a large host is no hot key; where a host has one path only, its pages are told apart by query; the first and last path of a task meet their
neighbours in the next task through a small table of paths, and only then their hashes. Pages whose markup settles everything
pass straight through; the text of the others is exchanged, cut into parts where a path or a page holds many rows.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import Batches, columns_ddl, in_arrow, stored
from kindred.llm.markup import BESIDE, MAYBE, YES, lines_of

#: parts of a key that holds many rows, and the rows below which a key is never cut
PARTS, HOT = 64, 1000
_URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?")


def host_and_path(url: str) -> tuple[str, str]:
    """Lower-case host and path without query and fragment; empty for an empty URL."""
    host, path, _ = _URL.match(url).groups()
    return host.lower(), path


def query_of(url: str) -> str:
    """The query string, empty if there is none."""
    return _URL.match(url)[3] or ""


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``.

    Bit-parallel: a whole row of the usual table is one integer, a bit for each place of ``b`` where the length does not grow.
    """
    places: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    grows = np.unpackbits(np.frombuffer((full - row).to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(grows, dtype=np.int64)])


def shared_lines(a: list[int], b: list[int]) -> np.ndarray:
    """For each element of ``a`` whether it lies on a longest common subsequence of both lists.

    Divide and conquer (Hirschberg): the upper half of ``a`` takes a beginning of ``b`` and the lower half the rest, cut where both lengths add up to
    most. Memory follows the lists' lengths, however often lines repeat.
    """
    on = np.zeros(len(a), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, first, last = todo.pop()
        # equal lines at both ends belong to a longest subsequence
        while low < high and first < last and a[low] == b[first]:
            on[low] = True
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            on[high - 1] = True
            high, last = high - 1, last - 1
        if low == high or first == last:
            continue
        if high - low == 1:
            on[low] = a[low] in b[first:last]
            continue
        middle, rest = (low + high) // 2, b[first:last]
        upper = _common_lengths(a[low:middle], rest)
        lower = _common_lengths(a[middle:high][::-1], rest[::-1])[::-1]
        cut = first + int(np.argmax(upper + lower))
        todo += [(low, middle, first, cut), (middle, high, cut, last)]
    return on


def _hashes(lines: list[str]) -> bytes:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).tobytes()


def parsed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, host, path, query, hashes, text, lines, sure): ``text`` where the markup settles it, else the ``lines``.

    A line is null in ``lines`` if the markup rules it out, so that places match ``hashes``; ``sure`` has a byte per
    line that is 1 where the markup keeps it.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("host", "path", "query", "hashes", "text", "lines", "sure")}
            for address, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, path = host_and_path(address or "")
                lines, kinds = lines_of(page or "")
                out["host"].append(host)
                out["path"].append(path)
                out["query"].append(query_of(address or ""))
                out["hashes"].append(_hashes(lines))
                open_ = MAYBE in kinds or BESIDE in kinds
                out["text"].append(None if open_ else "\n\n".join(x for x, k in zip(lines, kinds, strict=True) if k == YES))
                out["lines"].append([x if k in (MAYBE, YES, BESIDE) else None for x, k in zip(lines, kinds, strict=True)] if open_ else None)
                out["sure"].append(bytes(k == YES for k in kinds) if open_ else None)
            kinds_ = {"hashes": pa.binary(), "lines": pa.list_(pa.string()), "sure": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *(pa.array(v, kinds_.get(k, pa.string())) for k, v in out.items())],
                ["page_id", "url", *out],
            )

    schema = f"{columns_ddl(source.select('page_id', 'url'))}, host string, path string, query string, hashes binary, text string, lines array<string>, sure binary"
    return in_arrow(source, rows, schema)


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def nearest(paths: DataFrame) -> DataFrame:
    """(host, path, other): the line hashes of the nearest neighbour; paths: (host, path, hashes), one row each."""

    def walk(batches: Batches) -> Batches:
        before, first = None, True
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "hashes")), strict=True))
            out = []
            for row in rows:
                if first:
                    out.append((True, *row, 0, 0))
                    first = False
                elif before[0] == row[0]:
                    n = _common(before[1], row[1])
                    out += [(False, *before[:2], row[2], n, 0), (False, *row[:2], before[2], n, 1)]
                before = row
            yield _pairs(out)
        if before is not None:
            yield _pairs([(True, *before, 0, 0)])

    order = ["host", "path"]
    schema = "border boolean, host string, path string, other binary, common int, before int"
    found = stored(in_arrow(paths.repartitionByRange(*order).sortWithinPartitions(*order), walk, schema), "neighbours")
    # the first and last path of every task, a lone path of a task being both: two rows a task go by host, without their hashes
    ends = found.where("border").dropDuplicates(order)
    along = Window.partitionBy("host").orderBy("path")
    edge = ends.select(*order)
    pairs = [edge.select(*order, look("path").over(along).alias("near"), F.lit(before).alias("before")) for before, look in ((1, F.lag), (0, F.lead))]

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            n = [_common(a, b) for a, b in zip(batch.column("path").to_pylist(), batch.column("near").to_pylist(), strict=True)]
            yield batch.append_column("common", pa.array(n, pa.int32()))

    pairs = pairs[0].unionByName(pairs[1]).where("near is not null")
    pairs = in_arrow(pairs, measure, "host string, path string, near string, before int, common int")
    pairs = pairs.join(ends.select("host", F.col("path").alias("near"), "other"), ["host", "near"]).select(*order, "other", "common", "before")
    every = found.where("not border").select("host", "path", "other", "common", "before").unionByName(pairs)
    return every.groupBy(order).agg(F.max_by("other", F.struct("common", "before")).alias("other"))


def nearest_query(rows: DataFrame, lone: DataFrame) -> DataFrame:
    """(host, path, hashes, q_other): the line hashes of the page with the nearest query; lone: the only (host, path) of hosts.

    Pages with equal lines stand at their first query, and one page of a query counts, so that neither copies nor
    versions of a page delete each other.
    """
    key = ["host", "path"]
    texts = rows.join(lone, key).groupBy(*key, "hashes").agg(F.min("query").alias("first"))
    places = texts.groupBy("host", F.col("first").alias("path")).agg(F.max("hashes").alias("hashes"))
    near = nearest(places).select("host", F.col("path").alias("first"), F.col("other").alias("q_other"))
    return texts.join(near, ["host", "first"]).select(*key, "hashes", "q_other")


def met_in_parts(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], counted: DataFrame, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (unique keys) in which no key holds a task up; ``counted`` has the keys of the ``total`` rows.

    A key with more than a 200th of all rows is cut into ``PARTS`` by a hash of the columns ``spread``, and its group is sent to each part. Only
    64-bit digests of such keys, fewer than 200, reach all tasks; keys of equal digest are cut alike, which changes no result.
    """
    digest = F.xxhash64(*keys)
    counts = counted.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > max(total // 200, HOT)).select("_digest", F.lit(PARTS).alias("_parts")))
    cut = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(PARTS))).cast("int")
    left = rows.withColumn("_digest", digest).join(hot, "_digest", "left").withColumn("_part", cut).drop("_digest", "_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    right = groups.withColumn("_digest", digest).join(hot, "_digest", "left").withColumn("_part", every).drop("_digest", "_parts")
    return left.join(right, [*keys, "_part"], "left").drop("_part")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("border", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("other", pa.binary()), ("common", pa.int32()), ("before", pa.int32())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row.

    Blocks are trimmed, their white space is collapsed, and they are joined by two newlines in page order. A null or
    empty page has an empty text. A page alone on its host has no neighbour and loses nothing by
    differencing; pages of one path have the same neighbour, so copies do not delete each other. If the host has no
    other path, the neighbour is the page with the nearest query and other lines. Of two
    equally near neighbours the one before counts. A null URL is an empty host and path.
    """
    rows = stored(parsed(pages, page_id, url, html), "pages", compression="zstd")
    paths = rows.groupBy("host", "path").agg(F.max_by("hashes", F.struct("page_id", "hashes")).alias("hashes"))
    open_ = rows.where("sure is not null").drop("text")
    near = stored(nearest(paths), "nearest")
    lone = open_.select("host", "path").distinct().join(near, ["host", "path"], "left_anti")
    queries = nearest_query(rows.select("host", "path", "query", "hashes"), lone)
    total, apart = open_.count(), ["page_id", "url"]
    met = met_in_parts(open_, near, ["host", "path"], apart, open_, total)
    met = met_in_parts(met, queries, ["host", "path", "hashes"], apart, open_, total)
    met = met.select("page_id", "url", "lines", "sure", "hashes", F.coalesce("other", "q_other").alias("other"))

    def differ(batches: Batches) -> Batches:
        for batch in batches:
            texts = []
            for lines, sure, mine, other in zip(*(batch.column(c).to_pylist() for c in ("lines", "sure", "hashes", "other")), strict=True):
                shared = np.zeros(len(lines), bool)
                if other is not None:
                    shared = shared_lines(np.frombuffer(mine, np.uint64).tolist(), np.frombuffer(other, np.uint64).tolist())
                texts.append("\n\n".join(x for x, y, s in zip(lines, sure, shared, strict=True) if x is not None and (y or not s)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = rows.where("sure is null").select("page_id", "url", "text")
    return out.unionByName(in_arrow(met, differ, columns_ddl(out)))
