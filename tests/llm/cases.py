"""Small tables with the awkward rows that every operator must take."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def awkward():
    """(doc_id, text) with nulls, empty and very long texts, ties and repeated rows."""
    rows = [(1, "The cat sat on the mat. It was a good day for a cat."), (2, None), (3, ""), (4, "   \t\n "), (None, "no id here"), (5, LONG), (6, "x" * 50_000), (7, "The cat sat on the mat. It was a good day for a cat."), (7, "The cat sat on the mat. It was a good day for a cat."), (8, "é́ 東京 😀 <|endoftext|> it's \x1c\x85 end"), (9, "one"), (10, "und " * 300)]
    return rows


def prose(n=120, seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "ru", "sa") for b in ("ra", "ne", "to", "li", "s", "")]
    out = []
    for i in range(n):
        text = ". ".join(" ".join(r.choice(words) for _ in range(r.randint(3, 15))).capitalize() for _ in range(r.randint(1, 12)))
        out.append((i, text + "."))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def clashing(df):
    """The same table with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(0).alias(c) for c in ("chunk", "_chunk", "keys", "fp", "label", "quality", "keep", "ids", "at", "row", "kind", "n_words", "component_id", "fingerprint", "score", "bucket")])
