import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ["row", "mark", "key", "t", "size", "block", "id", "h", "list", "recipe", "copies", "times", "html", "score", "sha", "z", "_key", "_mark", "_nth", "_times", "norm", "chunks"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "ba", "ce", "do", "er", "fi", "go", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Documents with nulls, empty and very long texts, repeated rows and ids, copies, near copies and shared passages."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = words(rng, 70)
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(100, base[0], "en", "src1", 1), (101, base[0].upper(), "en", "src1", 1), (102, base[1], "de", None, 1)]
    for k in (2, 3):
        w = base[k].split()
        w[4] = "changed"
        rows.append((110 + k, " ".join(w), "en", "src0", 1))
    rows += [(120 + k, words(rng, 20) + "\n" + passage + ". " + words(rng, 25), "fr", "src2", 1) for k in range(4)]
    rows += [(130, None, None, None, None), (131, "", "en", "src0", 0), (132, " \n\t ", "en", "src0", 4), (133, None, "en", "src1", None), (134, "one two", "en", "src1", 7), (135, "é ü ß 日本語 😀 naïve", "fr", "src2", 20)]
    rows += [(None, words(rng, 60), "en", "src0", 1), (None, base[5], "en", "src0", 1)]
    rows += [(140, base[6], "en", "src0", 1)] * 3 + [(141, words(rng, 40), "en", "src1", 1), (141, words(rng, 40), "en", "src1", 1)]
    rows.append((150, "a" * 1000 + words(rng, 30_000), "en", "src2", 1))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def docs(spark, awkward):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward, DOCS).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
