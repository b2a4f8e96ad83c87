"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, one letter, white space, repeated and accented text, null id, repeated id, and a very long text.
ODD = [
    (1, None), (2, ""), (3, "a"), (4, " \t\n "), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "no id here at all"),
    (7, "Ünïcödé 日本語 🙂 text"), (7, "Ünïcödé 日本語 🙂 text"), (9, "word " * 40_000), (10, "<>&\"'\\ \x00 \x0b odd"),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(df):
    """With further columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    names = "k n id key key2 block score found base more component component_id shingle row rank share tokens usable mix_probability probability topic draw cell_source cell_topic doc_tokens fingerprint tail sums salt text_ held_out lang_pred"
    return df.withColumns({c: F.lit("x") for c in (*names.split(), "a.b`c")})


def prose(n: int, words: int = 60, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]
