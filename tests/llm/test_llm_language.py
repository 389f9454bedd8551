import math
import random
from collections import Counter

import numpy as np
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F

from kindred.llm import language_id as L

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["ñe", "cio", "los", "que"]}


def spoken(seed=1, n=90):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(sorted(SOUNDS))
        rows.append((d, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 30))).title(), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(spark):
    rows = spoken()
    model = L.fit(frame(spark, rows[:60]))
    got = L.identify(frame(spark, rows[60:]), model).collect()
    assert all(r.lang == r["_lang_pred"] and 0.9 < r["_lang_score"] <= 1 for r in got)


def test_posterior_matches_brute_force(spark):
    rows = [(1, "abab", "x"), (2, "ab ba", "x"), (3, "baba!", "y"), (4, "42", "y")]
    model = L.fit(frame(spark, rows))
    got = L.identify(frame(spark, [(9, "Aba", None)]), model).first()

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return Counter(t[i : i + n] for n in L.GRAMS for i in range(len(t) - n + 1) if t[i : i + n].strip())

    score = {}
    for lang, prior in (("x", 3), ("y", 2)):
        own = sum((grams(t) for _, t, k in rows if k == lang), Counter())
        total = own.total() + L.ALPHA * 2**L.BITS
        score[lang] = prior / 5 * math.exp(sum(k * math.log((own[g] + L.ALPHA) / total) for g, k in grams("Aba").items()))
    best = max(score, key=score.get)
    assert got["_lang_pred"] == best and abs(got["_lang_score"] - score[best] / sum(score.values())) < 1e-5


def test_edge_rows(spark):
    model = L.fit(documents(spark, [(d, t) for d, t, _ in spoken()]))
    got = L.identify(documents(spark), model).collect()
    assert len(got) == len(edge_rows()) and all(r["row"].startswith("own") for r in got)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["_lang_pred"] == "und") == (not letters) and (r["_lang_score"] == 0) == (not letters)


def test_more_languages_than_a_worker_holds(spark, monkeypatch):
    rows = spoken(2)
    whole = L.fit(frame(spark, rows))
    want = sorted((r.doc_id, r["_lang_pred"], round(r["_lang_score"], 9)) for r in L.identify(frame(spark, rows), whole).collect())
    monkeypatch.setattr(L, "TOGETHER", 1)
    cut = L.fit(frame(spark, rows))
    assert len(cut.tables) == 3 and np.array_equal(cut.table, whole.table)
    got = L.identify(frame(spark, rows).withColumn("_top", F.lit("own")), cut).collect()
    assert sorted((r.doc_id, r["_lang_pred"], round(r["_lang_score"], 9)) for r in got) == want and all(r["_top"] == "own" for r in got)


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    model = L.fit(docs.where("lang is null"))
    assert {(r["_lang_pred"], r["_lang_score"]) for r in L.identify(docs, model).collect()} == {("und", 0.0)}
    assert L.identify(docs.where("false"), L.fit(docs)).count() == 0


def test_ties_go_to_the_first_language(spark):
    model = L.fit(frame(spark, [(1, "same words", "zz"), (2, "same words", "bb")]))
    assert L.identify(frame(spark, [(3, "same", None)]), model).first()["_lang_pred"] == "bb"
