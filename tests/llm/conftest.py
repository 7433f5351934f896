import pytest

from cohortlab.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and long texts, ties, repeated rows."""
    rows = [(None, None), (None, "a b c d e f"), (1, None), (1, ""), (2, " \n\t"), (3, "one"), (3, "one"), (4, "one"), (5, "x " * 4000)]
    rows += [(6, "y" * 50_000), (7, "Grün, weiß und 漢字 😀 café"), (8, "Grün, weiß und 漢字 😀 café "), (9, "a b c d e f"), (9, "other text")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names clash with those the operators use inside."""
    clash = ["size", "shard", "n", "h", "g", "node", "digest", "_sha", "_doc", "_key", "w", "rate", "p", "part", "score", "range", "doc_id2"]
    rows = [(i, t, "en", None, None, *range(len(clash))) for i, t in odd_rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame(rows, kinds).repartition(3)
