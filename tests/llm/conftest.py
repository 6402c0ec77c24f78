import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30000))
BASE = " ".join(f"t{i}" for i in range(60))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls anywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, BASE.replace("t30", "x30"), "en", None, None), (4, None, "de", "b", 0), (5, "", None, "b", 0), (6, " \t\n", "en", "b", 3), (7, "one", "en", "c", 3), (8, "ONE", "en", "c", 3),
        (9, LONG, "en", "c", 9), (10, LONG + " tail", "fr", "c", 9), (None, "no id at all here", "en", "a", 1), (11, "same row", "en", "a", 8), (11, "same row", "en", "a", 8), (12, "Größe é ü ß", "de", "d", 5), (13, "a\u0000b c", "en", "e", 3),
        (14, " ".join(f"t{i}" for i in range(30)), "en", "a", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(7) for c in ("h", "host", "score", "bin", "key", "rep", "component_id", "size", "group", "shard", "_g", "n", "label")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.where("false")
