"""Hand-made tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string"
#: Columns whose names clash with those that operators use inside, and nulls in them.
CLASHING = "doc_id long, text string, score double, n_tokens long, bucket int, group_id long, __kept string, __rank int, items array<long>, __items int, hash string, part int"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Null ids, null, empty, blank, wordless and very long texts, repeated rows, ties."""
    long = " ".join(words(30_000, 1))
    return [(None, "an orphan text of some words here and there"), (1, None), (2, ""), (3, " \t\n"), (4, "?!... --"), (5, long), (6, "one two three four five six seven eight nine ten"), (6, "one two three four five six seven eight nine ten"), (7, "one two three four five six seven eight nine ten"), (8, "naïve 北京 \U0001f600 straße")]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, None, 7, "x", None, [1], None, None, 3) for i, t in rows], CLASHING)
