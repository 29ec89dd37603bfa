"""Documents for the tests of text operators."""

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Columns of documents, and extra ones with names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, place string, token long, "
    "rep string, n int, order string, cut string, component long"
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def docs_of(spark, rows):
    """Documents of ``(doc_id, text[, lang[, source]])``, the extra columns filled with something."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *(None,) * (4 - len(row)))
        full.append((doc_id, text, lang, source, None, 7, "p", 1, "r", 3, "o", "c", 5))
    return spark.createDataFrame(full, SCHEMA)


#: Ids and texts that every operator must stand.
ODD = [
    (None, "a text without an id, of seven words"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "word"),
    (5, "same text twice in two rows here"), (6, "same text twice in two rows here"),
    (7, "one row, two times"), (7, "one row, two times"), (8, "é" * 20_000), (9, "word " * 50_000),
    (10, "あい \U0001f600 \x00   <|endoftext|> 12"),
]
