"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, token long, node long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def documents(spark, extra=()):
    rng = random.Random(5)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 7) for i in range(120))
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base.replace(" ", " \t\n")), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n "), (7, "Hello  World"),
        (8, "hello world"), (9, LONG), (9, LONG), (10, "a b c d"), (11, "A b C d"), (12, "\x1c odd\x85space\xa0here"), (None, "no id"), (13, "été Ünï 日本"),
    ]
    sources = ["a", "b", None, "c", "é"]
    rows = [(i, t, "en" if t else None, sources[k % 5], None, 3, True, 0.5, 1, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOC_SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
