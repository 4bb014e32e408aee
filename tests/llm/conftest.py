import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, places string, part int, words string, n int, kind string"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with what operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1.0, 7, "p", 3, "w", 9, "k") for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def messy(docs):
    return docs([(1, None), (2, ""), (3, "a b c d e f g h i j k l m n"), (3, "a b c d e f g h i j k l m n"), (None, "no id here, mail me at x.y@mail.example.com"), (None, None), (4, " \n\t "), (5, "word " * 30_000), (6, "x" * 50_000), (7, "Ünïcode ñandú 日本語 🙂 +1 (555) 010-9999"), (7, "other text of the same id")])


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "text") for r in rows], "doc_id long, quality int, toxic int, text string")

    return make


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))
