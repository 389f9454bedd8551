import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import documents, edge_rows, sentence

from kindred.llm import jaccard_join as J
from kindred.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(rows, threshold=Fraction(4, 5)):
    classes = defaultdict(list)
    for d, t in rows:
        classes[shingle_set(t)].append(-(2**63) if d is None else d)
    items = [(max(v), s) for s, v in classes.items()]
    links = defaultdict(set)
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            both = len(x & y)
            if both and Fraction(both, len(x) + len(y) - both) >= threshold:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for a, _ in items:
        if a not in group:
            seen, todo = {a}, [a]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            group |= dict.fromkeys(seen, max(seen))
    null = lambda d: None if d == -(2**63) else d
    return sorted(
        ((d, null(max(v)), len(v), len(links[max(v)]), null(group[max(v)])) for s, v in classes.items() for d in map(null, v)),
        key=str,
    )


def similar_rows(n=120, seed=2):
    """One group of near copies with similarities on both sides of the threshold, chains, and strangers."""
    rng = random.Random(seed)
    seed_words = sentence(rng, 150).split()
    rows = []
    for d in range(n):
        w = list(seed_words)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + d, " ".join(w)))
    chain = [f"c{i}" for i in range(300)]
    rows += [(3000 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(12)]
    rows += [(4000 + k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))) for k in range(40)]
    # exactly the threshold: 40 shared shingles of 50, and one less
    base = [f"t{i}" for i in range(49)]
    rows += [(5000, " ".join(base)), (5001, " ".join(base[:44] + ["u1", "u2", "u3", "u4", "u5"])), (5002, " ".join(base[:43] + [f"v{i}" for i in range(6)]))]
    return rows


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [256, 7])
def test_links_and_groups_match_brute_force(spark, block):
    rows = similar_rows() + edge_rows()
    assert rows_of(J.jaccard_join(documents(spark, rows), block=block)) == brute(rows)


def repeated_ids():
    """Ids that are null or stand for several texts, near copies of other rows among them, and whole rows twice."""
    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    return [(None, a), (None, b), (None, b + " tail"), (3, a + " tail"), (7, b + " end"), (7, c), (7, d), (8, d + " tail"), (9, c + " tail"), (9, c + " tail"), (9, "x y z"), (None, "x y")]


def test_ids_that_are_null_or_repeated_lose_no_links(spark):
    rows = repeated_ids()
    # the same rows with ids of their own in the same order, and back
    ids = {k: 1000 * (d or 0) + k for k, (d, _) in enumerate(rows)}
    old = {i: rows[k][0] for k, i in ids.items()}
    want = [(old[i], old[c], n, m, old[g]) for i, c, n, m, g in brute([(ids[k], t) for k, (_, t) in enumerate(rows)])]
    assert rows_of(J.jaccard_join(documents(spark, rows))) == sorted(want, key=str)


def test_empty_table_and_only_blanks(spark):
    assert J.jaccard_join(documents(spark).where("false")).count() == 0
    assert rows_of(J.jaccard_join(documents(spark, [(1, None), (2, " "), (3, "")]))) == [(1, 3, 3, 0, 3), (2, 3, 3, 0, 3), (3, 3, 3, 0, 3)]


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        J.jaccard_join(documents(spark), threshold=(1, 2))


def test_pruning_keeps_pairs_at_the_threshold():
    least = J.least_matches(0.8)
    assert all(a <= b <= k for k, (a, b) in enumerate(zip(least, least[1:], strict=False), 1)) and least[200] > 110
    rng = np.random.default_rng(0)
    left = rng.integers(0, 256, (400, 200), dtype=np.uint8)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 256, left.shape)).astype(np.uint8)
    i, j = J.candidate_pairs(left, right, False, least)
    assert {(k, k) for k in range(400)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 410


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)]
    edges += [(7, 7), (8, 7), (7, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in real}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
