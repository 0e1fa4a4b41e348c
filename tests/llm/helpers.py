"""Small tables of awkward rows, and plain versions of the operators to compare with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "re", "ti", "on", "es", "th", "or", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)


def awkward(spark, extra: bool = False):
    """Nulls in each column, empty and blank texts, ties, repeated rows, one long text, other scripts."""
    rows = [
        (1, prose(1, 120), "en", "a", 10),
        (2, prose(1, 120), "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "xx", "b", 3),
        (6, "one", "fr", "b", 3),
        (7, prose(2, 3000), "de", None, None),
        (8, "é ü ñ 漢字 😀 the\x85end\u00a0x  a   b\n \nc", "es", "c", 5),
        (8, "é ü ñ 漢字 😀 the\x85end\u00a0x  a   b\n \nc", "es", "c", 5),
        (9, "same same same same same same\nsame same same same same same\n" * 10, "en", "a", 1),
        (10, "x <|endoftext|> y", "en", "z", 1),
        (None, "no id at all", "en", "a", 1),
        *((20 + i, prose(100 + i, 60 + i), "en", "hot", 1) for i in range(20)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("size", "skey", "fp", "score", "w", "part", "start", "row", "w0", "key", "position", "taken", "toxic", "spans"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
