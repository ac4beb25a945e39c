"""From raw documents to packed sequences: each stage works on all that the one before kept.

Counted as part of the ``llm`` subpackage and removed with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import minhash, packing, secrets, substring, toxicity
from tallyward.llm.common import written
from tallyward.sources.files import table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, their place in the files that hold them."""
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return docs.select("*", place.alias("_row"))
    except AnalysisException:  # not a table of files as it is
        return written(docs, "rows").select("*", place.alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it learns from the labels of the tables.

    Null and empty texts are never rejected; rows that share an id, or repeat, are judged
    each on its own text; an empty table stays empty; other columns are only passed on.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.chain_for(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of smallest id, then of smallest place in the table.

    Rows are judged one by one: equal rows are a group, rows that share an id but not the
    text are not, and rows without an id take part (they stay only where no row with an id
    is in the group). Rows without words are in no group and all stay; an empty table stays
    empty; other columns are only passed on.
    """
    rows = _numbered(docs)
    # without an id: behind all ids, and equal texts alike
    behind = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    found = written(minhash.groups(rows.select(F.coalesce(F.col("doc_id").cast("long"), behind).alias("doc_id"), "text", "_row")).where("label is not null"), "groups")
    stays = found.groupBy("label").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    goes = found.join(stays, "label").where(F.col("_row") != F.col("first._row")).select("_row")
    return rows.join(goes, "_row", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has go; no document does.

    Null, empty and short texts, and rows without an id, lose nothing; rows that share an
    id never take each other's words; other columns are only passed on, but for ``n_chars``.
    """
    return _measured(substring.strip(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place.

    Null and empty texts have none; rows that share an id, or repeat, are scanned each on
    its own text; other columns are only passed on, but for ``n_chars``.
    """
    return _measured(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place.

    Null and empty texts are one piece of the end id; long ones are cut; ties go by id and
    piece; repeated rows are packed each; an empty table gives an empty result; other
    columns are not read.
    """
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Training and connected near-duplicate groups are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
