"""Small tables of documents."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts, source="s", **more) -> DataFrame:
    """Documents 0, 1, ... with these texts; a pair gives the id as well."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[k], len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def rows(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
