import pytest
from pyspark.sql import functions as F

#: Columns that operators use inside, here as extra input columns.
CLASHING = "score rank label band hub id key pos line th n first part block tie keep gone e kind value words ids n_links class_id n_copies __hash __id __th __gone __lines __found id_ th_ hash lines found kinds named K1 eight sample range copies e_ norm".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    texts = [None, "", " \n\t ", "one", "two words", "a line that is long enough to take part\nshort", "a line that is long enough to take part\nother", "word " * 60_000, "x" * 100_000, "same text in two rows of this table", "same text in two rows of this table", "漢字 ünïcödé 😀 " * 20]
    rows = [(k if k != 5 else None, t, None if k % 2 else "en", None, None) for k, t in enumerate(texts)]
    rows += [(9, texts[9], None, "s", 1), (9, "another text under an id that is there already", None, "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(None if k % 2 else name))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, None if k == 3 else k % 2, None if k == 4 else k % 2, "x") for k in [*range(12), 9, 9]] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
