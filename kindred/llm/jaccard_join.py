"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of word shingles. Equal sets form a class, and classes are what is compared.

1. One scan computes class key, MinHash band keys and a byte per MinHash value for every document.
2. Classes that share a band key are candidates. With 40 bands of 5 values a pair at the threshold 0.8
   shares none with probability 1.2e-7. Candidates hang together in components.
3. Components are cut into blocks of at most about ``BLOCK`` classes by hash; a task holds two blocks. It
   compares the MinHash bytes of all its pairs, a few more values at a time, and drops a pair as
   soon as the posterior probability (uniform prior) that it reaches the threshold is below
   ``TOLERANCE``. The survivors are verified on the shingle sets.
4. A task reports for each class the number of its links and one representative it is connected with;
   no pair leaves a task, so a group of n similar texts gives rows in proportion to n per block.

Only texts of candidate classes are exchanged, found with a Bloom filter of their ids. A class is known by the number
of one of its rows, given in the one scan and stored with the signatures, so null and repeated ids are no matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.blocks import Block, mix, row_blocks
from kindred.llm.bloom import rows_with_ids
from kindred.llm.common import Batches, attach_groups, in_arrow, stored
from kindred.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 40, 5
#: MinHash values compared at a time, and the probability below which a pair is dropped
STEP, TOLERANCE = 20, 1e-9
#: classes of a block
BLOCK = 256
_N = BANDS * ROWS
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and the offsets of the texts.

    A text with fewer words than a shingle has all its words as its only shingle; one without words has none.
    """
    start, end, docs = block.words()
    words = block.hashes(start, end)
    n_words = block.per_doc(docs)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    key = np.zeros(len(words), np.uint64)
    fits = np.ones(len(words), bool)
    at = np.arange(len(words)) - first[docs]
    for k in range(size):
        there = at + k < n_words[docs]
        key[there] = mix(key[there] + words[np.flatnonzero(there) + k])
        fits &= there
    fits |= (at == 0) & (n_words[docs] < size)
    key, of = key[fits], docs[fits]
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], np.searchsorted(of[new], np.arange(block.n + 1))


def minhashes(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text with shingles."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(starts):
        return np.zeros((0, _N), np.uint64)
    return np.stack([np.minimum.reduceat(keys * a, starts) for a in _FACTORS], axis=1)


def class_keys(keys: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Two hashes of every shingle set."""
    n = np.diff(offsets)
    some = n > 0
    starts = offsets[:-1][some]
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(n), np.uint64)
        if len(starts):
            sums[some] = np.add.reduceat(mix(keys + np.uint64(salt)), starts)
        out.append(pa.array(mix(sums + n.astype(np.uint64)).view(np.int64)))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, row, c1, c2, n, bands, sig) for (doc, row, text): class key, set size, 40 band keys, 200 bytes."""

    def rows(batches: Batches) -> Batches:
        for batch, block in row_blocks(batches, "text"):
            keys, offsets = shingles(block)
            n = np.diff(offsets)
            some = n > 0
            values = minhashes(keys, offsets)
            bands = np.zeros((len(values), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands + values[:, k::ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            sig = (mix(values) & np.uint64(255)).astype(np.uint8)
            at = np.cumsum(some) - 1
            packed = [[x[i].tobytes() if ok else b"" for i, ok in zip(at, some, strict=True)] for x in (bands, sig)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("row"), *class_keys(keys, offsets), pa.array(n.astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed)],
                ["doc", "row", "c1", "c2", "n", "bands", "sig"],
            )

    return in_arrow(docs, rows, "doc long, row long, c1 long, c2 long, n int, bands binary, sig binary")


def bucket_edges(reps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all classes of a bucket; reps: (row, bands).

    Band keys are sorted over all tasks together with the class, so a large bucket is cut. Inside a
    task every class is tied to the first of its bucket there; the first and last buckets of the tasks,
    two rows each at most, tie the parts of a bucket together.
    """

    def explode(batches: Batches) -> Batches:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            docs = np.repeat(batch.column("row").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(docs)], ["key", "doc"])

    def tie(batches: Batches) -> Batches:
        key, top, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, docs = (batch.column(c).to_numpy() for c in ("key", "doc"))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            tops = docs[np.flatnonzero(new)]
            if key == keys[0]:
                tops = tops.copy()
                tops[0] = top
            of = tops[np.cumsum(new) - 1]
            other = docs != of
            yield _edges(np.zeros(other.sum(), bool), of[other], docs[other])
            if first:
                yield _edges([True], [keys[0]], [tops[0]])
                first = False
            key, top = keys[-1], tops[-1]
        if key is not None:
            yield _edges([True], [key], [top])

    rows = in_arrow(reps.where(F.length("bands") > 0).select("row", "bands"), explode, "key long, doc long")
    found = in_arrow(rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc"), tie, "border boolean, u long, v long")
    found = stored(found, "ties")
    along = Window.partitionBy("u")
    borders = found.where("border").select(F.min("v").over(along).alias("u"), "v").where("u <> v")
    return found.where("not border").select("u", "v").unionByName(borders)


def _edges(border, u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(border, pa.bool_()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["border", "u", "v"])


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For 0 to 200 compared values the fewest matches with which a pair may stay.

    A match of bytes has probability p = s + (1 - s) / 256 at similarity s. With a uniform prior on p the
    posterior after m matches of k is Beta(m + 1, k - m + 1), whose upper tail is a binomial sum.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for k in range(_N + 1):
        terms = [math.comb(k + 1, i) * p**i * (1 - p) ** (k + 1 - i) for i in range(k + 2)]
        # P(Beta(m+1, k-m+1) >= p) = P(Binomial(k+1, p) <= m)
        total, m = 0.0, 0
        while m <= k:
            total += terms[m]
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def candidate_pairs(left: np.ndarray, right: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that survive the incremental comparison of MinHash bytes."""
    i, j = (np.triu_indices(len(left), 1)) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    matches = np.zeros(len(i), np.int32)
    for k in range(0, _N, STEP):
        if not len(i):
            break
        for cut in range(0, len(i), 1 << 16):
            at = slice(cut, cut + (1 << 16))
            matches[at] += (left[i[at], k : k + STEP] == right[j[at], k : k + STEP]).sum(axis=1)
        stay = matches >= least[k + STEP]
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """For each pair whether its exact similarity reaches the threshold; sets are sorted arrays."""
    if not len(i):
        return np.zeros(0, bool)
    _, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(s) for s in [*left, *right]])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    up, down = threshold
    good = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        one, pairs = i[order[a]], order[a:b]
        mine = ids[offsets[one] : offsets[one + 1]]
        mark[mine] = 1
        # a bounded number of elements at a time
        for c in range(0, len(pairs), 512):
            some = pairs[c : c + 512]
            other = j[some] + len(left)
            n = sizes[other]
            ends = np.cumsum(n)
            flat = np.repeat(offsets[other] - (ends - n), n) + np.arange(ends[-1])
            both = np.add.reduceat(mark[ids[flat]], ends - n)
            good[some] = both * (up + down) >= up * (n + sizes[one])
        mark[mine] = 0
    return good


def _rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the first node it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(blocks: DataFrame, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, n_links, root) of every class with a link in a pair of blocks.

    blocks: (part, a, b, mine, doc, sig, set), sorted by (part, a, b): the classes of block ``a`` and of block
    ``b`` of a component, ``mine`` being the block a row belongs to.
    """
    least = least_matches(threshold[0] / threshold[1], tolerance)

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        same = rows[0][1] == rows[0][2]
        sides = [[r for r in rows if same or r[3] == r[1]], [r for r in rows if not same and r[3] == r[2]]]
        sig = [np.frombuffer(b"".join(r[5] for r in side), np.uint8).reshape(len(side), _N) for side in sides]
        sets = [[np.frombuffer(r[6], np.uint64) for r in side] for side in sides]
        other = 0 if same else 1
        i, j = candidate_pairs(sig[0], sig[other], same, least)
        good = verified(i, j, sets[0], sets[other], threshold)
        i, j = i[good], j[good] + (0 if same else len(sides[0]))
        docs = np.array([r[4] for side in sides for r in side], np.int64)
        n = np.bincount(i, minlength=len(docs)) + np.bincount(j, minlength=len(docs))
        some = n > 0
        root = docs[_rooted(len(docs), i, j)]
        return pa.RecordBatch.from_arrays([pa.array(docs[some]), pa.array(n[some]), pa.array(root[some])], ["doc", "n_links", "root"])

    def groups(batches: Batches) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def rows(batches: Batches) -> Batches:
        for group in groups(batches):
            yield compare(group)

    return in_arrow(blocks, rows, "doc long, n_links long, root long")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, group_id) for every row.

    ``class_id`` is the largest id with the same shingle set, ``n_links`` the number of other classes whose
    similarity reaches the threshold (a fraction of at least 4/5), ``group_id`` the largest id that
    is connected through such links. Null and empty texts and texts without words have the empty set: they are
    one class without links. A text of fewer words than a shingle is equal to its like only. Rows that
    repeat an id, or have none, are compared each with its own text; a null id is the smallest.
    """
    found = similar_rows(docs.withColumn("_row", F.monotonically_increasing_id()), "_row", text, doc_id, threshold, block)
    return found.select("doc_id", "class_id", "class_size", "n_links", "group_id")


def similar_rows(docs: DataFrame, row: str, text: str = "text", doc_id: str = "doc_id", threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The columns of the join with ``row`` and ``group_row``, the row that stands for the group: the last of its largest id."""
    if 5 * threshold[0] < 4 * threshold[1]:
        raise ValueError("the bands find similarities of 0.8 and more")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    source = docs.select(doc.alias("doc"), F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stored(signatures(source), "signatures")
    total = rows.count()
    classes = rows.groupBy("c1", "c2").agg(F.max(F.struct("doc", "row")).alias("rep"), F.count("*").alias("class_size"))
    reps = stored(
        rows.join(classes.select(F.col("rep.row").alias("rep_row")), F.col("row") == F.col("rep_row")).select("doc", "row", "c1", "c2", "n", "bands", "sig"),
        "classes",
    )
    parts = components(bucket_edges(reps))
    links = stored(_links(source, reps, parts, threshold, block), "links")
    found = links.groupBy("doc").agg(F.sum("n_links").alias("n_links"))
    groups = components(links.where("doc <> root").select(F.col("doc").alias("u"), F.col("root").alias("v")))
    groups = groups.join(reps.select("row", F.struct("doc", "row").alias("rep")), F.col("node") == F.col("row")).select("node", "label", "rep")
    top = groups.groupBy("label").agg(F.max("rep").alias("top"))
    groups = groups.join(top, "label").select(F.col("node").alias("g_row"), "top")
    last = F.coalesce("top", "rep")
    known = (
        classes.join(found.select(F.col("doc").alias("l_row"), "n_links"), F.col("rep.row") == F.col("l_row"), "left")
        .join(groups, F.col("rep.row") == F.col("g_row"), "left")
        .select(
            "c1", "c2", F.col("rep.doc").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            last["doc"].alias("group_id"), last["row"].alias("group_row"),
        )
    )
    out = attach_groups(rows.select("doc", "row", "c1", "c2"), stored(known, "known"), ["c1", "c2"], "class_size", total)
    null = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(null("doc").alias("doc_id"), null("class_id").alias("class_id"), "class_size", "n_links", null("group_id").alias("group_id"), "row", "group_row")


def _links(source: DataFrame, reps: DataFrame, parts: DataFrame, threshold: tuple[int, int], block: int) -> DataFrame:
    sizes = parts.groupBy("label").agg(F.count("*").alias("size")).withColumnRenamed("label", "part")
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    members = (
        parts.join(sizes, F.col("label") == F.col("part"))
        .withColumn("blocks", n_blocks)
        .select(F.col("node").alias("row"), "part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"), "blocks")
    )
    candidates = stored(reps.drop("bands").join(members, "row"), "candidates")
    texts = rows_with_ids(source.select("doc", "text"), "doc", candidates.select("doc"))

    key = ["c1", "c2"]

    def to_sets(batches: Batches) -> Batches:
        for batch, whole in row_blocks(batches, "text"):
            keys, offsets = shingles(whole)
            sets = [keys[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *class_keys(keys, offsets), pa.array(sets, pa.binary())], ["doc", *key, "set"])

    sets = in_arrow(texts.select("doc", "text"), to_sets, "doc long, c1 long, c2 long, set binary").dropDuplicates(["doc", *key])
    full = candidates.join(sets, ["doc", *key])
    paired = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", F.col("row").alias("doc"), "sig", "set"
    )
    return linked(paired.repartition("part", "a", "b").sortWithinPartitions("part", "a", "b"), threshold)
