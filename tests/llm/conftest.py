import pytest
from pyspark.sql import functions as F

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat voluptua at vero eos accusam justo duo dolores ea rebum".split()
CLASHING = ["host", "kept", "class", "_key", "bucket", "root", "c0", "n_words", "spans", "ids", "features", "shard", "slot", "listed", "h1", "zones", "base", "label", "score"]


def sentence(n, start=0):
    return " ".join(WORDS[(start * 7 + i * i) % len(WORDS)] + str((start + i) % 5 or "") for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id and text: nulls, empty and blank texts, repeated rows, copies, ties, one very long text."""
    plain = sentence(60)
    return [
        (1, plain), (1, plain), (2, plain), (3, plain.upper()), (4, None), (5, ""), (6, " \n\t "), (None, sentence(50, 3)), (None, sentence(50, 3)), (None, None),
        (7, "one two"), (8, "one  TWO"), (9, sentence(60000, 11)), (10, sentence(60) + " tail"), (11, "äöü € 日本語 \u2581 x"), (-12, sentence(30, 9)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows as documents with further columns whose names operators use."""
    rows = spark.createDataFrame([(i, t, "en", None if n % 4 == 0 else "src", len(t or "")) for n, (i, t) in enumerate(odd_rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(7).alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
