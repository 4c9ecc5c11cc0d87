import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """A documents table from ``{id: text}`` or a list of (id, text)."""
    def make(rows, parts=3):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture
def folder(tmp_path):
    """A folder of tables: ``folder(documents=df, ..)`` gives its path."""
    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make
