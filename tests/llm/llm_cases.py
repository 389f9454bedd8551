"""Rows that every operator has to take: nulls, blanks, long texts, repeats and clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: names that operators use inside, as columns of the input
CLASHES = ["_rules", "_kept", "_score", "_ids", "_keep", "_n_lines", "_text", "_near", "doc", "row", "part", "sha", "set", "n", "text_hash", "h1", "_map_doc", "_map_hash", "_key", "_top", "_x", "_digest1", "tree", "number", "label", "id"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    plain = [(i, "\n".join(sentence(rng, 12) for _ in range(rng.randrange(1, 6)))) for i in range(10, 40)]
    same = sentence(rng, 60)
    return [
        (1, None), (2, ""), (3, " \t\n\r "), (4, "x"), (5, "été ñ 漢字 🙂▁ ."), (6, "\n\n\n"), (7, "a\x00b \x0b\x0c c"),
        (8, sentence(rng, 9000)), (9, "z" * 70000), (None, "row without an id " * 30), (50, same), (51, same), (52, same), (52, same),
        (53, same + " tail"), (54, " ".join(["again"] * 400)), *plain,
    ]


def documents(spark, rows=None, clashes=True):
    """(doc_id, text, lang, source, n_chars) and, if wanted, columns with the names operators use themselves."""
    rows = edge_rows() if rows is None else rows
    full = [(d, t, ["en", "fr", None][i % 3], f"s{i % 2}", None if t is None else len(t), *([f"own{i}"] * len(CLASHES) * clashes)) for i, (d, t) in enumerate(rows)]
    extra = "".join(f", `{c}` string" for c in CLASHES) if clashes else ""
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{extra}").repartition(3)
