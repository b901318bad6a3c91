import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the of and to in ent tion ing her ation ever all this that with from over under again once more time".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def put(spark, tmp_path_factory):
    """Write documents (and other tables) as Parquet and read them back: ids by storage place need a stored table."""

    def write(rows, schema=SCHEMA, name="documents"):
        at = tmp_path_factory.mktemp("t")
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        return spark.read.parquet(f"{at}/{name}.parquet")

    return write


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text and one long word."""
    long = prose(5, 30_000)
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7),
            (None, "text without an id", None, "b", 18), (5, long, "en", "a", len(long)), (6, "x" * 20_000, "en", "a", 20_000),
            (7, "Ünï cødé 你好 😀 ſ", "de", "b", 15), (8, prose(8, 60), "en", "b", 0), (9, prose(8, 60), "en", "b", 0)]
