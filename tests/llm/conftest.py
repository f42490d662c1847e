import random

import pytest

#: Columns of callers whose names the operators use themselves.
CLASHING = ["key", "node", "n", "th", "size", "fp", "h1", "pos", "copies", "target", "sig", "b_", "k_", "d_", "t_", "s_"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows, extra=True):
    """(doc_id, text, source, lang) rows as documents, with clashing columns beside them."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, s, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING]) if extra else df


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, very long, repeated and nearly repeated texts, with null ids, sources and languages."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = words(rng, 30_000)
    rows = [
        (1, None, "a", "en"), (2, "", "a", "en"), (3, " \t\n \r\n", None, "en"), (4, "one", "b", None), (5, "two words", "b", "en"), (6, base, "a", "en"), (7, base, "a", "en"),
        (8, " ".join(near), "c", "en"), (9, long, "c", "de"), (10, base + "\n" + base, "a", "en"), (11, "x " * 80, "b", "en"), (12, "\n".join(["Same line here, of some length."] * 3), None, "fr"),
        (13, words(rng, 90), "c", "en"), (14, "é ü ñ ß 中文 🙂 " * 12, "d", "xx"), (6, base, "a", "en"), (None, words(rng, 70), "a", "en"), (None, None, None, None),
    ]
    return rows
