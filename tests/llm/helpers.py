"""Small tables for the operators' tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower_az(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sentence(seed: int, n: int = 60) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ki", "lo", "mu", "ne", "ta", "ri"]) for _ in range(r.randint(1, 4)))
                    for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long
    text, characters of one to four bytes, control strings."""
    a, b = sentence(1, 120), sentence(2, 90)
    return [
        (1, a, "en", "s", 5), (2, a, "en", "s", 5), (2, a, "en", "s", 5), (3, None, "en", "s", None), (4, "", None, None, 0),
        (5, " \t\n\x0b\x0c\r ", "de", "s", 1), (None, b, "en", "s", 2), (None, None, None, None, None), (6, b.upper(), "en", "s", 1),
        (7, "Ünï çödé 漢字 😀 x", "fr", "s", 3), (8, "one two", "en", "s", 3), (9, "ONE\ntwo", "en", "s", 3),
        (10, sentence(3, 20_000), "en", "s", 3), (11, "a b c d\na b c d\n\n\nx #*$%&|<> a b c d a b c d", "en", "s", 3),
        (12, "<|endoftext|> <|im_end|>   x  y  z\n\n q ", "en", "s", 3), (13, "\n", "en", "s", 3),
    ]


def docs(spark, rows=None):
    """The documents table plus columns whose names operators use inside."""
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(c) for c in ("key", "size", "score", "label", "n", "start", "chunk", "quality", "toxic",
                                                  "component_id", "shard", "hash", "item_id", "_row", "_file", "_place", "_no", "_c0",
                                                  "_spans", "row", "file", "place", "no", "c0", "spans", "part", "text_")})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
