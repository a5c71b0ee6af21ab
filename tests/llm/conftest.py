import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bin int, n long, sid string, t string, words string, spans string, taken string, cell string"
EXTRA = (7, "k", 1, 5, "s", "t", "w", "sp", "ta", "ce")


def odd_rows():
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9)))
    prose = [" ".join(word() for _ in range(60)) + ".\nsecond line " + word() for _ in range(8)]
    near = prose[0].split(" ")
    near[30] = "changed"
    long = " ".join(word() for _ in range(30_000))
    texts = [*prose, prose[0].upper(), " ".join(near), None, "", " \t\n ", "a b c", "A B C", "one", long, long + " tail", "x" * 5000, "0" * 3000, "é " * 300, "mail me: a.b@c.org, +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "\x01\x02 +12345678 \x01", "▁ odd ▁▁ text  \n\n "]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", None, "b", "")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose[1], "en", "a", 1), (None, None, None, None, None), (rows[5][0], "other text of the same id here", "en", "a", None)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
