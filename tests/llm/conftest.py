import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["th", "an", "er", "on", "re", "é", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null, empty and long texts, copies, near copies, repeated rows, a hot source, null ids and sources."""
    r = random.Random(7)
    base = [words(r, r.choice([3, 20, 60, 200])) for _ in range(60)]
    out = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[5], "en", "hot", 1) for i in range(12)]
    out += [(200 + i, base[11] + f" extra{i}", "en", "hot", 1) for i in range(6)]
    out += [(300, None, None, None, None), (301, "", "en", "hot", 0), (302, " \n\t ", "en", "s1", 4), (303, words(r, 6000), "en", "s2", None)]
    out += [(None, base[3], "en", "s3", None), (None, None, None, None, None), (7, base[7], "en", "hot", 3), (7, base[7], "en", "hot", 3), (8, "another text", "en", "hot", 3)]
    out += [(304, "cc by cc by General  Public\nLicense, all rights reserved. 中文 <|endoftext|> ok", "en", "s1", 9), (305, "x", "en", "s1", 1), (-5, "negative id", "en", "s1", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in ("score", "fp", "label", "text_hash", "kept_id", "mix_slot", "slot", "ids", "path", "k", "p", "spans", "Score_Text", "copies")])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
