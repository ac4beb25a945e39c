"""The audit: all rules in order, overrides and ignores, completeness, summary, score and gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Tables
from .rules import FINDING, RULES, Config, Context, Rule, item_signals, schema_hits, text_hits, tokens_of
from .similarity import durable

WEIGHT = {"error": 10, "warning": 4, "info": 1}
UNCHECKED = "safety/unchecked"


@dataclass
class Audit:
    """Findings (after overrides and ignores) and one summary row for each target."""

    findings: DataFrame
    summary: DataFrame
    tokens: DataFrame | None
    tables: Tables


def prepare(tables: Tables, config: Config) -> Context:
    """Store what several rules read."""
    hits = durable(text_hits(tables))
    tokens = tokens_of(tables, config)
    return Context(tables, config, hits, durable(schema_hits(tables)), durable(item_signals(hits, tables.tools)), None if tokens is None else durable(tokens))


def _lost(c: Context, rule: Rule, e: Exception) -> DataFrame:
    """What stands in the place of a rule that did not finish: one finding for each target."""
    first = c.tables.servers.groupBy("target_id").agg(F.min("server_id").alias("server_id"))
    null = F.lit(None).cast("string")
    return first.select("target_id", F.lit(UNCHECKED).alias("rule_id"), F.lit("error").alias("severity"), "server_id", F.lit("server").alias("subject_kind"), F.col("server_id").alias("subject_name"), null.alias("field"), F.lit(f"{rule.id} did not finish ({type(e).__name__}).").alias("message"), null.alias("detail"), F.lit(None).cast("long").alias("item_ord"))


def raw_findings(c: Context, rules: list[Rule] = RULES) -> DataFrame:
    """All findings of all rules, stored. A rule that does not finish, in its plan or at run time, is reported, and the others go on."""
    plans: list[tuple[int, Rule, DataFrame]] = []
    for i, rule in enumerate(rules):
        if c.tokens is None and rule.category == "budget":
            continue
        try:
            plans.append((i, rule, rule.plan(c, rule)))
        except Exception as e:
            plans.append((i, rule, _lost(c, rule, e)))

    def union(found: list[tuple[int, DataFrame]]) -> DataFrame:
        out = c.tables.tools.sparkSession.createDataFrame([], FINDING).withColumn("rule_ord", F.lit(0))
        for i, df in found:
            out = out.unionByName(df.withColumn("rule_ord", F.lit(i)))
        return out

    try:
        return durable(union([(i, df) for i, _, df in plans]))
    except Exception:  # some rule failed in all of them: now each by itself
        found = []
        for i, rule, df in plans:
            try:
                found.append((i, durable(df)))
            except Exception as e:
                found.append((i, _lost(c, rule, e)))
        return union(found)


def graded(findings: DataFrame, config: Config) -> DataFrame:
    """Overrides replace even a raised severity; ``off`` and ignored rules (or rule:subject) go."""
    spark = findings.sparkSession
    over = spark.createDataFrame(list(config.severities.items()), "rule_id string, override string")
    drop = spark.createDataFrame([(x,) for x in config.ignore], "ignored string")
    out = findings.join(F.broadcast(over), "rule_id", "left").withColumn("severity", F.coalesce("override", "severity")).drop("override")
    out = out.where("severity <> 'off'").withColumn("_pair", F.concat_ws(":", "rule_id", "subject_name"))
    out = out.join(F.broadcast(drop), F.col("rule_id") == F.col("ignored"), "left_anti")
    return out.join(F.broadcast(drop), F.col("_pair") == F.col("ignored"), "left_anti").drop("_pair")


def scores(findings: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, score): items average what is left of 100, other findings and all safety findings are subtracted.

    Items of one server, kind and name count once; a finding that matches no item counts against its target.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), F.col("severity"))
    f = findings.withColumn("w", weight).withColumn("safety", F.col("rule_id").startswith("safety/"))
    keys = items.select("target_id", "server_id", F.col("kind").alias("subject_kind"), F.col("name").alias("subject_name")).distinct()
    quality = f.where("NOT safety").groupBy("target_id", "server_id", "subject_kind", "subject_name").agg(F.sum("w").alias("w"))
    on = ["target_id", "server_id", "subject_kind", "subject_name"]
    kept = keys.join(quality, on, "left").select("target_id", F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).alias("s"))
    base = kept.groupBy("target_id").agg(F.avg("s").alias("base"))
    other = quality.join(keys, on, "left_anti").groupBy("target_id").agg(F.sum("w").alias("other"))
    safety = f.where("safety").groupBy("target_id").agg(F.sum("w").alias("safety"))
    all_ = targets.join(base, "target_id", "left").join(other, "target_id", "left").join(safety, "target_id", "left")
    left = F.coalesce("base", F.lit(100.0)) - F.coalesce("other", F.lit(0)) - F.coalesce("safety", F.lit(0))
    return all_.select("target_id", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(left + 0.5))).cast("int").alias("score"))


def summaries(raw: DataFrame, findings: DataFrame, tables: Tables, tokens: DataFrame | None) -> DataFrame:
    """One row for each target: counts, tokens (null if one tool could not be counted), completeness and score."""
    targets = tables.servers.select("target_id").unionByName(tables.collection.select("target_id")).distinct()
    kinds = tables.items.groupBy("target_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("tool", "prompt", "resource")])
    by = findings.groupBy("target_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in WEIGHT])
    rules = findings.groupBy("target_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy("target_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"))
    gaps = tables.collection.groupBy("target_id").agg(F.count_if(F.col("status") == "incomplete").alias("gaps"))
    open_ = raw.where(F.col("rule_id") == UNCHECKED).groupBy("target_id").agg(F.count(F.lit(1)).alias("open"))
    out = targets
    for part in (kinds, by, rules, gaps, open_):
        out = out.join(part, "target_id", "left")
    if tokens is None:
        out = out.withColumn("total_tokens", F.lit(None).cast("long")).withColumn("uncounted", F.lit(0))
    else:
        sums = tokens.groupBy("target_id").agg(F.count_if(F.col("tokens").isNull()).alias("uncounted"), F.sum("tokens").alias("sum"))
        out = out.join(sums, "target_id", "left").withColumn("total_tokens", F.when(F.coalesce("uncounted", F.lit(0)) == 0, F.coalesce("sum", F.lit(0)))).drop("sum")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumn("complete", (zero("gaps") == 0) & (zero("open") == 0) & (zero("uncounted") == 0))
    out = out.join(scores(findings, tables.items, targets), "target_id")
    counts = [zero(c).alias(c) for c in ("tools", "prompts", "resources", "errors", "warnings", "infos") if c in out.columns]
    return out.select("target_id", *counts, "by_rule", "total_tokens", "complete", F.when(F.col("complete"), F.col("score")).alias("score"))


def audit(tables: Tables, config: Config | None = None) -> Audit:
    """Run everything over any number of targets."""
    config = config or Config()
    c = prepare(tables, config)
    raw = raw_findings(c)
    findings = graded(raw, config)
    return Audit(findings, summaries(raw, findings, tables, c.tokens), c.tokens, tables)


def subjects(findings: DataFrame) -> DataFrame:
    """(target_id, server_id, subject_kind, subject_name, findings, worst): the worst severity as its rank, 0 for errors."""
    rank = F.lit(len(WEIGHT))
    for i, s in enumerate(WEIGHT):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return findings.groupBy("target_id", "server_id", "subject_kind", "subject_name").agg(F.count(F.lit(1)).alias("findings"), F.min(rank).alias("worst"))


def rules_used(findings: DataFrame) -> DataFrame:
    """(rule_ord, rule_id, severity) of the rules that found something."""
    known = findings.sparkSession.createDataFrame([(i, r.id, r.severity) for i, r in enumerate(RULES)], "rule_ord int, rule_id string, severity string")
    return F.broadcast(known).join(findings.select("rule_id").distinct(), "rule_id", "left_semi")


def should_fail(summary: DataFrame, fail_on: str = "error") -> DataFrame:
    """(target_id, failed): an incomplete audit fails at any gate."""
    limit = {"error": F.col("errors"), "warning": F.col("errors") + F.col("warnings"), "info": F.col("errors") + F.col("warnings") + F.col("infos")}[fail_on]
    return summary.select("target_id", (~F.col("complete") | (limit > 0)).alias("failed"))


def top_offenders(tokens: DataFrame, n: int = 5) -> DataFrame:
    """The tools of most tokens; ties keep their order; uncounted ones are left out."""
    return tokens.where("tokens IS NOT NULL").orderBy(F.desc("tokens"), "target_id", "server_id", "ord").limit(n)


def audit_status(complete, errors, warnings):
    """In words, how an audit ended."""
    return F.when(~complete, "incomplete").when(errors > 0, "errors").when(warnings > 0, "warnings").otherwise("clean")
