import duckdb
import pandas as pd
import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, fp bigint, kept boolean, ids string, "
    "value string, key string, gram int, n int, w string, stratum string, holes string, site string, start int, label int"
)
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near the old stone bridge at dawn "
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def edge_rows():
    texts = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b"),
        (3, None, None, None),
        (4, "", "de", "a"),
        (5, " \t\n ", "de", "a"),
        (None, "a row without an id, with enough words to pass the base rules here", None, "c"),
        (6, PASSAGE * 8 + "mail anna.berg@mail.example.com or +1 (555) 010-2030 from 10.1.2.3", "en", "a"),
        (7, "other start " + PASSAGE * 8, "en", "b"),
        (8, LONG, "en", "a"),
        (9, "emoji 😀 and ümlaut, tabs\tand\r\nlines\n\n  spaced  out ", "de", None),
        (10, "x" * 5000, "fr", "c"),
    ]
    return [(i, t, lang, src, 1, "d", 5, True, "i", "v", "k", 1, 2, "w", "s", "h", "t", 3, 0) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")


def duck(sql, tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        if isinstance(frame, str):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{frame}'")
        else:
            con.register(name, frame)
    return con.sql(sql).df()


def same_rows(left: pd.DataFrame, right: pd.DataFrame):
    """Equal as multisets of rows, columns by name."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if not isinstance(v, str) and v == int(v) else v

    def rows(frame):
        return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))

    assert rows(left) == rows(right)
