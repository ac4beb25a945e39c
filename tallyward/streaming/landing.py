"""Audit catalogs as their files land: each micro-batch of whole files is audited like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import audit
from ..operators.rules import Config
from ..operators.similarity import durable
from ..sources.catalog import parse, tables


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of files, one catalog each."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.col("path").alias("target_id"), F.lit("file").alias("server_id"), "content")


def start(spark: SparkSession, folder: str, out: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Audit new files; findings and summaries are written under ``out``, one folder for each batch.

    A batch that is run again overwrites its own folder, so results are there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        a = audit(tables(durable(parse(batch))), config)
        a.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        a.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")

    writer = landing(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/_progress")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
