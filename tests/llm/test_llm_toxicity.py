import random

import numpy as np
import pyarrow as pa
import zstandard
from llm_cases import WORDS, documents, edge_rows

from kindred.llm import toxicity as T
from kindred.llm.blocks import Block

BAD = ["villainous", "rotten", "wretched", "nasty"]


def labelled(seed=3, n=600):
    """A quarter of the documents has some bad words in any case; a twentieth of the labels is wrong."""
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(15, 90))]
        bad = rng.random() < 0.25
        for _ in range(rng.randrange(2, 6) * bad):
            words[rng.randrange(len(words))] = rng.choice(BAD).upper() if d % 3 else rng.choice(BAD)
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad) if rng.random() > 0.05 else int(not bad)))
    return rows, labels


def holds_bad(text):
    return any(b in text.lower().split() for b in BAD)


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = documents(spark, rows)
    train = spark.createDataFrame(labels[:450] + [(5, None), (None, 1), (9999, 0)], "doc_id long, label int")
    got = {r.doc_id: r["_score"] for r in T.score(docs, T.fit(docs, train)).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = rows[450:]
    assert np.mean([(got[d] >= 0.5) == holds_bad(t) for d, t in held]) >= 0.95


def test_words_of_copies_count_once(spark):
    rows, labels = labelled(4, 200)
    copied = "in a strange tongue quux everywhere quux again"
    rows += [(1000 + i, copied) for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    sample = T.sample(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, label int"))
    words = T.distinctive_words(sample)
    assert set(words[1]) == {b.encode() for b in BAD} and words[0] == []


def test_words_of_a_rarer_language_are_found_beside_commoner_ones(spark):
    rng, rare = random.Random(7), [f"qu{a}{b}xo" for a in "aeio" for b in "ln"]
    rows, labels = labelled(7, 2400)
    for d in range(5000, 5300):
        words = ["ny" + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(15, 90))]
        bad = d % 3 == 0
        for _ in range(4 * bad):
            words[rng.randrange(len(words))] = rng.choice(rare)
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    docs = documents(spark, rows)
    model = T.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, label int"))
    got = {r.doc_id: r["_score"] for r in T.score(docs, model).where("doc_id >= 5000 and doc_id % 4 = 0").collect()}
    assert np.mean([got[d] >= 0.5 for d in got if d % 3 == 0]) >= 0.9
    assert np.mean([got[d] < 0.5 for d in got if d % 3]) >= 0.95


def test_the_model_does_not_depend_on_partitions_and_the_sample_is_bounded(spark):
    rows, labels = labelled(5, 300)
    docs, train = documents(spark, rows), spark.createDataFrame(labels * 2, "doc_id long, label int")
    one, two = (T.fit(docs.repartition(k), train, limit=200) for k in (1, 5))
    assert one.toxic == two.toxic and one.ordinary == two.ordinary and np.array_equal(one.weights, two.weights)
    assert len(one.toxic) == len(one.ordinary) and one.toxic != one.ordinary
    assert T.sample(docs, train, limit=50).count() == 50


def test_windows_and_lengths_against_plain_calls():
    texts = ["", "short", "x" * 64, "y" * 65, "Ä wörd " * 40, " ".join(WORDS * 9)]
    block = Block(pa.array(texts, pa.large_string()))
    start, length, of = T.windows(block.offsets)
    want = []
    for k, text in enumerate(texts):
        data = text.encode()
        at = 0
        while data and (at == 0 or at + T.WINDOW - T.STEP < len(data)):
            want.append((k, data[at : at + T.WINDOW]))
            at += T.STEP
    data = bytes(block.data)
    assert [(k, data[a : a + n]) for a, n, k in zip(start.tolist(), length.tolist(), of.tolist())] == want
    dictionary = " ".join(WORDS).encode()
    cells, places = T.framed(block.data, start, length)
    plain = T._compressor(dictionary)
    expected = [len(plain.compress(b" " * T.BLANKS + w.ljust(T.WINDOW))) for _, w in want]
    assert T.compressed_lengths(cells, places, dictionary).tolist() == expected
    assert isinstance(plain, zstandard.ZstdCompressor)
    counts = T.gain_counts(block, dictionary, b" " * len(dictionary))
    assert counts.sum(axis=1).tolist() == np.bincount(of, minlength=len(texts)).tolist() and counts[5, 1:].sum() > 0


def test_edge_rows_get_scores_and_keep_their_columns(spark):
    rows, labels = labelled(6, 200)
    docs = documents(spark, rows + [(10000 + i, t) for i, (_, t) in enumerate(edge_rows())])
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + len(edge_rows()) and all(0 <= r["_score"] <= 1 for r in got)
    empty = {r["_score"] for r in got if not r.text}
    assert len(empty) == 1 and abs(empty.pop() - 1 / (1 + np.exp(-model.weights[0]))) < 1e-12
    assert all(r["part"].startswith("own") for r in got)


def test_without_rows_or_second_class(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert T.score(docs.where("false"), T.fit(docs, none)).count() == 0
    assert {round(r["_score"], 3) for r in T.score(docs, T.fit(docs, none)).collect()} == {0.5}
    only = T.fit(docs, spark.createDataFrame([(i, 1) for i in range(10, 40)], "doc_id long, label int"))
    assert T.score(docs, only).where("_score < 0.8").count() == 0
