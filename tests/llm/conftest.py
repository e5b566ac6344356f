import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use for columns of their own.
        T.StructField("measures", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("vector", T.LongType()),
        T.StructField("block", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster names in this setting."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))


def prose(rng, n, words=400):
    return " ".join(rng.choice(["w%d", "Ab%d,", "é%d", "%d."]) % rng.randrange(words) + rng.choice(["", "", "", "\n"]) for _ in range(n))


def odd_texts():
    """Texts of every kind that a table may hold, ids in no order, repeated rows among them."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([3, 20, 60, 150])) for _ in range(14)]
    near = [" ".join(w if i % 97 else "changed" for i, w in enumerate(base[k].split())) for k in (0, 3, 5, 7)]
    passage = prose(rng, 60)
    rows = [
        *((100 - i, x) for i, x in enumerate(base)),
        *((200 + i, x) for i, x in enumerate(near)),
        *((300 + i, base[2]) for i in range(5)),
        *((400 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(4)),
        (500, None),
        (501, ""),
        (502, " \n\t "),
        (503, "one"),
        (504, "ONE"),
        (505, "x " * 300),
        (506, prose(rng, 9000)),
        (507, "中文 İstanbul ΑΣ \U0001f600 é  \x1c\x85" * 12),
        (508, "a#b$c%d " * 60),
        (None, base[1]),
        (None, None),
        (300, base[2]),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(5)
    rows = [
        (i, x, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if x is None else len(x), "m", "k", "t", 1, 2)
        for i, x in odd_texts()
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
