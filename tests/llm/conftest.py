import pytest
from odd_texts import ODD
from pyspark.sql import types as T

@pytest.fixture
def odd(spark):
    """Rows with odd texts, null ids and fields, repeated rows, and more columns than any operator asks for."""
    rows = [(i, t, None if i % 3 else "s", "en", float(i), i, "k", 1, True) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[5], rows[7], (None, "null id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double, n_words int, __key string, __id int, kept boolean")


@pytest.fixture
def folder(tmp_path, spark):
    """Writes tables as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
