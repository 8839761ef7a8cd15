import random

import pytest

#: Names that operators use within; as extra columns they must do no harm.
CLASHING = ("id", "row", "n", "digest", "label", "at", "rule", "kept", "group", "shard", "tokens", "bucket", "node", "__text", "__stats")


def words(seed: int, n: int, stem: str = "") -> str:
    r = random.Random(seed)
    return " ".join(stem + "".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


LONG = words(99, 120_000)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, null ids and clashing names."""
    text = [words(1, 60), words(1, 60), words(1, 60) + " more", "", None, " \n\t ", "!!! ??? ...", LONG, "x", "漢字 ñandú 😀 d'été", words(2, 50), words(2, 50), None, "line\nline\nline\n", "it's  we'll\r\n\r\n end "]
    ids = [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, None, 11, 12]
    rows = [(i, t, "en" if k % 3 else None, None, None, *["z"] * len(CLASHING)) for k, (i, t) in enumerate(zip(ids, text))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3, "text").cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
