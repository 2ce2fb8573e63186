import duckdb
import pytest
from tests_llm_data import AWKWARD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (id, text) rows, with columns whose names the operators use themselves."""

    def build(rows, clash=True):
        df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
        if clash:
            for c in ("n_words", "class", "size", "key", "bucket", "block", "_r", "_h", "component", "path", "host", "failed", "length", "id", "a", "b", "starts"):
                df = df.withColumn(c, df["source"])
        return df

    return build


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def texts(data_dir):
    """doc_id and text of the small table."""
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{data_dir}/documents.parquet'").fetchall()
