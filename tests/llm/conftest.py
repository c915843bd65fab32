import pytest

#: Odd rows that every operator takes: nulls, empties, ties, repeats, long texts.
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog, then left.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \n\t ", "de", "b"),
    (5, "the cat sat on the mat and looked at the dog, then left.", "en", "a"), (5, "the cat sat on the mat and looked at the dog, then left.", "en", "a"),
    (6, "Ein  Wort &amp; noch  eins\n\nEin Wort", "de", "é"), (7, "x " * 30000, "en", None), (None, "one two three four five six seven eight nine ten eleven", "en", "a"), (8, "1234 ?!", "fr", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, len(r[1] or ""), "extra", 1) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, h int").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
