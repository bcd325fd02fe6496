import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, words string, file string"

#: Texts that operators must stand: null, empty, blank, very long, one very long word, odd characters, repeated rows.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "a" * 40_000), (6, "9" * 20_000), (7, "Ünï çödé 漢字   x​ 😀   end"),
    (8, "the same text here twice over"), (8, "the same text here twice over"), (9, "the same text here twice over"), (None, "no id at all"),
    (10, "\x00 control \x7f & symbols ### $$$"), (11, "line one\nline one\nline two\n\nline one"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(d, t, "en", "s", None, "x", "y", "z", "f") for d, t in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
