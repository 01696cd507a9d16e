import duckdb
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, or add.
CLASHES = (
    "part long, start string, score string, kept string, keep_id string, fp string, row string, h string, word string, "
    "__row string, __id string, __text_key string, text_key string, head string, maybe string, deal string, n string, "
    "threshold string, rejected string, __n string, __lines string, __words string"
)


def edge_rows():
    long_text = " ".join(f"word{i % 977} and-{i % 13}" for i in range(30_000)) + "\n" + "x" * 50_000
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, "The  same   text\nwith odd space ", "en", "a", 1),
        (5, "The  same   text\nwith odd space ", "de", "b", 2),
        (5, "The  same   text\nwith odd space ", "de", "b", 2),
        (None, "The  same   text\nwith odd space ", "de", "b", 2),
        (None, "no id, 12 words. é日本語 👍🏽 <|endoftext|>", "fr", "b", 3),
        (7, long_text, "en", "a", len(long_text)),
        (8, "one", "en", "a", 3),
        (9, "one two", "en", "a", 7),
        (10, "a line\na line\n\nUPPER case's end\x1c\x85.", None, None, None),
    ]
    return rows


@pytest.fixture
def edge_docs(spark):
    clashing = CLASHES.count(",")  # and one number
    return spark.createDataFrame([(*r, 1, *["9"] * clashing) for r in edge_rows()], f"{COLUMNS}, {CLASHES}")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHES}")


@pytest.fixture(scope="session")
def documents(sf_dir):
    """(doc_id, text) of the smallest table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
