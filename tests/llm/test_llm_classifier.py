import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_cases import WORDS, documents, edge_rows

from kindred.llm import subword_classifier as C
from kindred.llm.blocks import Block


def labelled(seed=3, n=400):
    """Good documents are lower-case prose, bad ones shout; a tenth of the labels is wrong."""
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        rows.append((d, " ".join(w if good or rng.random() < 0.3 else w.upper() + "!!" for w in words)))
        labels.append((d, int(good) if rng.random() > 0.1 else int(not good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = documents(spark, rows)
    train = spark.createDataFrame(labels[:300] + [(5, None), (None, 1), (9999, 0)], "doc_id long, label int")
    model = C.fit(docs, train)
    got = {r.doc_id: r["_score"] for r in C.score(docs, model).collect()}
    truth = {d: t == t.lower() for d, t in rows}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[d] >= 0.5) == truth[d] for d in range(300, 400)]) >= 0.97


def test_the_model_does_not_depend_on_partitions_and_the_sample_is_bounded(spark):
    rows, labels = labelled(4, 120)
    docs, train = documents(spark, rows), spark.createDataFrame(labels * 2, "doc_id long, label int")
    one, two = (C.fit(docs.repartition(k), train, limit=50) for k in (1, 5))
    assert np.array_equal(one.weight, two.weight) and one.bias == two.bias
    assert C.training_rows(docs, train, limit=50).count() == 50


def test_edge_rows_get_scores_and_keep_their_columns(spark):
    rows, labels = labelled(5, 100)
    docs = documents(spark, rows + [(1000 + i, t) for i, (_, t) in enumerate(edge_rows())])
    model = C.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    got = C.score(docs, model).collect()
    assert len(got) == len(rows) + len(edge_rows()) and all(0 <= r["_score"] <= 1 for r in got)
    empty = {r["_score"] for r in got if not r.text}
    assert len(empty) == 1 and abs(empty.pop() - 1 / (1 + np.exp(-model.bias))) < 1e-12
    assert all(r["part"].startswith("own") for r in got)


def test_without_rows_or_second_class(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert C.score(docs.where("false"), C.fit(docs, none)).count() == 0
    assert {round(r["_score"], 3) for r in C.score(docs, C.fit(docs, none)).where("text is null").collect()} == {0.5}
    only = C.fit(docs, spark.createDataFrame([(i, 1) for i in range(10, 20)], "doc_id long, label int"))
    assert C.score(docs, only).where("_score < 0.8").count() == 0


def slow_buckets(text):
    """The buckets of a text, word by word and n-gram by n-gram, with their counts."""
    found = Counter()
    for word in re.findall("[^\x20\x09-\x0d]+", text):
        block = Block(pa.array([word], pa.large_string()))
        start, end, _ = block.words()
        found[int(block.hashes(start, end)[0] >> np.uint64(65 - C.BITS))] += 1
    for n in C.GRAMS:
        for i in range(len(text) - n + 1):
            points = np.array([ord(c) for c in text[i : i + n]], np.uint32)
            found[int(C.char_grams(points, np.array([0, n]), n, C.BITS - 1)[0][0]) + (1 << (C.BITS - 1))] += 1
    return found


def slow_train(rows, epochs):
    """The same descent in double precision, one bucket after the other."""
    rng = np.random.default_rng(C.SEED)
    start = rng.uniform(-1 / C.DIM, 1 / C.DIM, (1 << C.BITS, C.DIM)).astype(np.float32)
    layer = [[float(v) for v in row] for row in rng.normal(0, 0.3, (C.DIM, 2)).astype(np.float32)]
    vectors = {}
    labels = [label for label, _ in rows]
    prior = (sum(labels) + 1) / (len(labels) + 2)
    bias = [math.log(1 - prior), math.log(prior)]
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = C.RATE * (1 - step / steps)
            step += 1
            label, counts = rows[i]
            total = sum(counts.values())
            shares = {k: c / total for k, c in counts.items()}
            for k in shares:
                vectors.setdefault(k, [float(v) for v in start[k]])
            mean = [sum(s * vectors[k][d] for k, s in shares.items()) for d in range(C.DIM)]
            z = [sum(mean[d] * layer[d][c] for d in range(C.DIM)) + bias[c] for c in (0, 1)]
            top = [math.exp(v - max(z)) for v in z]
            p = [v / sum(top) for v in top]
            p[label] -= 1
            back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(C.DIM)]
            for d in range(C.DIM):
                for c in (0, 1):
                    layer[d][c] -= rate * mean[d] * p[c]
            for c in (0, 1):
                bias[c] -= 0.1 * rate * p[c]
            norm = sum(s * s for s in shares.values())
            for k, s in shares.items():
                for d in range(C.DIM):
                    vectors[k][d] -= s * rate / max(norm, 1e-6) * 0.2 * back[d]
    effect = [layer[d][1] - layer[d][0] for d in range(C.DIM)]
    return {k: sum(v[d] * effect[d] for d in range(C.DIM)) for k, v in vectors.items()}, bias[1] - bias[0]


def test_learning_and_scores_against_brute_force(spark):
    rows, labels = labelled(9, 40)
    rows = [(d, t[:200] if d % 4 else "Été 漢字 " + t[:90]) for d, t in rows]
    docs = documents(spark, rows)
    model = C.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    counts = {d: slow_buckets(t) for d, t in rows}
    weight, bias = slow_train([(label, counts[d]) for d, label in labels], C.EPOCHS)
    assert abs(model.bias - bias) < 1e-3 and max(abs(model.weight[k] - w) for k, w in weight.items()) < 5e-3 * max(map(abs, weight.values()))
    for r in C.score(docs, model).collect():
        own = counts[r.doc_id]
        mean = sum(c * model.weight[k] for k, c in own.items()) / sum(own.values())
        assert abs(r["_score"] - 1 / (1 + math.exp(-mean - model.bias))) < 1e-9
