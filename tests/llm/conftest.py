import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("h", T.LongType()), T.StructField("fp", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("part", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("word", T.StringType()), T.StructField("length", T.StringType()), T.StructField("content", T.StringType()),
    ]
)
WORDS = "the of and ing tion alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau été ñandú straße".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; edited copies and shared passages."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(20)]
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]
    rows += [(200 + i, t.replace(" ", "\n\t", 2)) for i, t in enumerate(base[:4])]
    rows += [(300 + i, f"{prose(rng, 12)} {passage} {prose(rng, i)}") for i in range(8)]
    for i, t in enumerate(base[8:14]):
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "two words"), (505, "a" * 3000), (506, "x " * 900), (507, prose(rng, 20_000)), (508, "<s> <|endoftext|> ▁▁ \x00 é 漢字 😀"), (509, None)]
    rows += [(0, base[0]), (0, base[0]), (300, rows[30][1]), (None, base[3]), (None, None), (None, f"{passage} {passage}")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as a table with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "i", "k", 7, "f", 3, "p", "d", "w", "l", "c") for i, t in odd_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
