import math
import re
from collections import Counter

import numpy as np
from llm_cases import CLASHES, documents, edge_rows

from kindred.llm.quality_rules import PRIOR, THRESHOLD, quality_rules, trusted_ids

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeat |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_counts_and_ratios_match_brute_force(spark):
    rows = [*edge_rows(), (60, "# a | b\n# a | b\n&& <x> *$%"), (61, "one two three four five six seven eight " * 3)]
    docs = documents(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in [*range(10, 30), 10, 999, None]], "doc_id long")
    got = quality_rules(docs, trusted, bits=22).collect()
    assert len(got) == len(rows) and set(CLASHES) - {"_rules", "_kept"} <= set(got[0].asDict())
    grams = lambda t: Counter(t[i : i + 4] for i in range(len(t) - 3))
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw += grams(t or "")
        if d is not None and 10 <= d < 30:
            target += grams(t or "")
    share = target.total() / raw.total()
    for r in got:
        text = r.text or ""
        n = base(text)
        assert (r["_rules"].n_words, r["_rules"].word_chars, r["_rules"].n_symbols, r["_rules"].n_dup_lines, r["_rules"].n_repeat_words) == n
        assert r["_base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        if len(text) < 4:
            assert r["_rules"].llr is None and not r["_kept"]
            continue
        own = grams(text)
        llr = sum(k * math.log((target[g] + PRIOR) / (raw[g] * share + PRIOR)) for g, k in own.items()) / own.total()
        assert abs(r["_rules"].llr - llr) < 1e-3
        if abs(llr - THRESHOLD) > 1e-3:
            assert r["_kept"] == (not r["_base_failed"] and llr >= THRESHOLD)


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    trusted = docs.select("doc_id").where("doc_id > 20")
    key = lambda r: (str(r.doc_id), str(r.text))
    one, two = (sorted(quality_rules(docs.repartition(n), trusted).select("doc_id", "text", "_rules", "_kept").collect(), key=key) for n in (1, 7))
    assert [(r["_rules"].n_words, r["_kept"]) for r in one] == [(r["_rules"].n_words, r["_kept"]) for r in two]
    assert np.allclose([r["_rules"].llr or 0 for r in one], [r["_rules"].llr or 0 for r in two])


def test_without_rows_or_trust(spark):
    docs = documents(spark)
    none = docs.select("doc_id").where("false")
    assert quality_rules(docs.where("false"), none).count() == 0
    got = quality_rules(docs, none).collect()
    assert all(r["_kept"] != r["_base_failed"] for r in got) and all(not r["_rules"].llr for r in got)


def test_trusted_ids(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (4, None)], "doc_id long, quality int")
    assert [r[0] for r in trusted_ids(labels).collect()] == [2]
