import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LINE = "A line that several of the documents hold, word for word."
LONG = "\n".join(f"Paragraph {i} of a long text has the words {i * 7} and {i * i} in it." for i in range(4000))
BASE = " ".join(f"word{i * i % 83}x{i % 7}" for i in range(120))


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, near copies."""
    changed = BASE.replace("word4x2", "other")
    rows = [
        (1, LINE + "\n" + BASE, "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n\n \x0b", "en", None, 6),
        (5, LONG, "en", "a", len(LONG)),
        (6, "  " + LINE.upper() + "\t\nshort\nshort", "de", "Z", 10),
        (7, BASE, "en", "a", 1),
        (8, BASE, "en", None, 1),
        (9, changed, "fr", "é", 1),
        (9, changed, "fr", "é", 1),
        (10, "Ein Satz mit Wörtern, und 'nen 12345 Zahlen!!  x ß ﬁ İ \U0001F600", "de", "b", 2),
        (11, "one two", None, None, None),
        (12, "one two", "en", "b", 7),
        (13, "a" * 70000, "en", "b", 70000),
        (14, " " * 9000 + "end" + "\n" * 9000, "en", "b", 0),
        (15, LINE + "\n" + LINE + "\n" + LINE, "en", "a", 3),
        (16, "1234 5678 !!", "es", "a", 3),
        (17, "x y z " * 40, "es", "a", 3),
        (None, BASE + " tail", "en", "a", 9),
        (None, None, None, None, None),
        (-4, LINE + " \n" + "unique text before the rest of it", "en", "a", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with columns whose names operators use themselves."""
    schema = DOCUMENT + ", size bigint, key string, n bigint, component bigint, target string, bucket int, taken int"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "t", 4, None) for r in awkward_rows()], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest table of documents as it is."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
