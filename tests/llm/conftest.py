import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHING = "key long, size long, fp long, row string, a string, b string, hash string, part int, first string, score string"
WORDS = "the of and a in stone river mill grain wheel water wall house field road bread salt iron oak ash".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids."""
    out = [(i, prose(i, 30 + 7 * i % 200), "en", f"s{i % 4}", 1) for i in range(40)]
    out += [(40, None, None, None, None), (41, "", "en", "s0", 0), (42, " \t\n ", "en", "s0", 3), (43, "one", "en", None, 3), (44, "x" * 5000, "en", "s1", 5000)]
    out += [(45, prose(1, 20_000), "en", "s2", 1), (46, "Grüße, <b>ça</b> 猫 [INST]  zwei Wörter", "de", "s3", 1), (47, prose(3, 51), "en", "s9", 1)]
    out += [(48, out[5][1], "en", "s1", 1), (None, "no id at all here", "en", "s1", 1), (None, "no id at all here", "en", "s1", 1), (None, None, None, None, None)]
    out += [(3, "another text with the id three", "en", "s3", 1), out[7], out[7], (49, out[6][1] + " oak", "en", "s2", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with more columns, whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in CLASHING.split(", ")))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
