"""Statistics over many audited catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 75, 90, 95, 99)


def percentiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles and the maximum, as whole numbers."""
    cols = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").cast("long").alias(f"p{p}") for p in PERCENTILES]
    return df.groupBy(*(by or [])).agg(*cols, F.max(value).cast("long").alias("max"))


def share(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves up."""
    return F.floor(1000.0 * part / whole + 0.5) / 10


def rule_table(findings: DataFrame) -> DataFrame:
    """Per rule: servers, findings, and a map of severities."""
    by = findings.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    maps = by.groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    return findings.groupBy("rule_id").agg(F.count_distinct("target_id").alias("servers"), F.count(F.lit(1)).alias("findings")).join(maps, "rule_id")


def exact_duplicates(tools: DataFrame, columns: list[str]) -> DataFrame:
    """(total, distinct, duplicates) of definitions equal in all of the columns."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return tools.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(digest).alias("distinct_definitions")).withColumn("duplicates", F.col("total") - F.col("distinct_definitions"))


def owners(servers: DataFrame, name: str = "target_id") -> DataFrame:
    """(owner, servers): the owner is what stands before the first slash."""
    return servers.groupBy(F.split_part(F.col(name), F.lit("/"), F.lit(1)).alias("owner")).agg(F.count(F.lit(1)).alias("servers"))


def listing(views: DataFrame) -> DataFrame:
    """Rows (name, use_count, view) of several listings as one row a name, most used first."""
    one = views.groupBy("name").agg(F.max("use_count").alias("use_count"), F.array_sort(F.collect_set("view")).alias("views"))
    return one.orderBy(F.desc("use_count"), "name")


def review_sample(findings: DataFrame, per_rule: int = 8, seed: int = 1) -> DataFrame:
    """Some findings of each rule, chosen by a seeded hash: the same ones every time."""
    w = Window.partitionBy("rule_id").orderBy(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "target_id", "server_id", "subject_name", "message")), "message")
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_rule).drop("_n")


def reviewed(labels: DataFrame, review: DataFrame, key: str = "id") -> DataFrame:
    """Labels joined with their review; a label without one is an error."""
    lost = labels.join(review, key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} labels have no review")
    return labels.join(review, key)


def label_counts(labels: DataFrame, column: str = "label") -> DataFrame:
    """(label, n): how often each label was given; labels that are missing count as null."""
    return labels.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def listed_in(catalogs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Catalogs (target_id, content) with the manifest row (sha1, ...) of the same bytes; none without one."""
    return catalogs.withColumn("sha1", F.sha1("content")).join(manifest, "sha1")


def census_rows(summary: DataFrame, findings: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """One row for each target: what an audit found, ready to be written as JSON lines."""
    found = findings.groupBy("target_id").agg(F.collect_list(F.struct("rule_id", "severity", "subject_name", "message", "detail")).alias("findings"))
    out = summary.select("target_id", "tools", "score", F.col("total_tokens").alias("tokens")).join(found, "target_id", "left")
    if tokens is not None:
        each = tokens.groupBy("target_id").agg(F.array_sort(F.collect_list("tokens")).alias("tool_tokens"))
        out = out.join(each, "target_id", "left")
    return out
