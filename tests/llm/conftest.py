import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make_docs(spark):
    """Documents from texts; ids count from 0 unless pairs are given."""
    def make(texts, lang="en"):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "src0", len(t) if t else 0) for i, t in rows], DOC_SCHEMA)
    return make


@pytest.fixture()
def clashing():
    """Adds columns named like the operators' own results and helpers."""
    def add(df):
        from pyspark.sql import functions as F

        for name in ("row_key", "fp", "score", "size", "shard", "length", "piece", "rank", "h", "w", "bucket", "node",
                     "component_id", "spans", "n_tokens", "item_id", "gram", "turns", "label", "predicted"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df
    return add
