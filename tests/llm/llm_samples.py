"""Odd inputs every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, id long, score string, target string"


def odd_documents(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma.", "delta", "eps,", "zeta!", "été", "x", "\U0001F600", "ÉTÉ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_text = "\n".join(text(40) for _ in range(1500))
    same = text(60)
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, "en", "b", None),
        (4, "", None, None, 0), (None, text(30), "en", "a", 3), (None, None, None, None, None), (5, long_text, "en", "b", 9),
        (6, " \t\n ", "fr", "", 3), (7, "one", "fr", "é", 3), (8, text(5), "fr", "z", 3), (9, same.upper(), "de", "a", 3),
    ]
    return spark.createDataFrame([(*r, 7, "r", 8, "s", "t") for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
