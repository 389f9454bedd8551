import random
from collections import Counter, defaultdict

import pytest
from llm_cases import CLASHES, documents, edge_rows

from kindred.llm.line_dedup import drop_lines, keep_bitmaps

AZ = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(AZ)


def brute(rows, min_chars=40, min_docs=5):
    low = lambda d: -(2**63) if d is None else d
    holds = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holds[key(x)].add(low(d))
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holds[key(x)]) >= min_docs and max(holds[key(x)]) != low(d))]
        out[d, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return out


def lined_rows(seed=1):
    rng = random.Random(seed)
    common = [f"line number {i} that many documents of the corpus hold " + "é" * i for i in range(6)]
    rows = edge_rows()
    for d in range(100, 220):
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper().lower() if rng.random() < 0.5 else x.title().replace("É", "é")) for x in common if rng.random() < 0.3]
        lines += [common[0]] * rng.randrange(3) + [f"own line {d} {k} which nobody else has at all" for k in range(3)] + ["short"] * 2
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    # four and five holders, and a document that repeats an id with another text
    rows += [(300 + k, "four documents hold this line of forty characters") for k in range(4)]
    rows += [(310 + k, "five documents hold this line of forty characters\nrest") for k in range(5)] + [(314, "other\n" + common[1])]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_lines_match_brute_force(spark, parts):
    rows = lined_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = drop_lines(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r.text, r["_n_lines"], r["_n_dropped"]) for r in got) == brute(rows)
    assert {r.doc_id: r.lang for r in got if r.doc_id == 100} and all(r[c].startswith("own") for r in got for c in CLASHES if c != "_n_lines")


def test_bitmaps_only_for_documents_that_lose_lines(spark):
    rows = lined_rows(2)
    maps = keep_bitmaps(documents(spark, rows)).collect()
    lose = {d for d, _, _, n in brute(rows) if n}
    assert {r.doc for r in maps} == {-(2**63) if d is None else d for d in lose}


def test_empty_table(spark):
    assert drop_lines(documents(spark).where("false")).count() == 0
