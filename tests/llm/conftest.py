import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): copies, near copies, shared passages, nulls, empty and long
    texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "Ünder", "größe"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = text(70), text(300)
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n", 3)), (4, text(120) + " " + passage + " " + text(40)),
            (5, passage + " " + text(200)), (6, text(30) + "\t" + passage), (7, None), (8, ""), (9, "   \n"), (10, "one two"),
            (11, "one  two"), (12, text(20_000)), (13, "again and " * 200), (14, "again and " * 200), (None, base), (None, None)]
    for k in range(30):  # near copies with one to eight changed words
        w = base.split()
        for _ in range(1 + k % 8):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((20 + k, " ".join(w)))
    rows += [(1, base), (7, None)]
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for c in ("n_words", "score", "component_id", "rate", "kept", "first", "anchor", "label", "rep", "span_of"):
        df = df.withColumn(c, F.lit("own"))
    return rows, df.repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
