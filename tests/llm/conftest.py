import pytest

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, "b", 6),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 63),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 63),
    (5, "one two three four five six seven eight nine ten eleven twelve.", None, None, 63),
    (6, "été à la plage, où êtes-vous donc ? 123", "fr", "b", 39),
    (None, "a row that has no id at all but has a text", "en", "b", 42),
    (7, "lang word " * 12_000, "en", "a", 120_000),
    (8, "12345 67890 !!", "de", "a", 14),
    (9, "x", "de", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def crowded(odd):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "key sig rep band comp n_shingles kept score spans starts ends items part place guest piece length offset salt nth fingerprint lang_pred rejected quality label node row".split()
    return odd.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
