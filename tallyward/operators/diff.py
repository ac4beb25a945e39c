"""Snapshots of catalogs: capture, validation, and comparison definition by definition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import JsonRefused, canonical, changed_fields, compact, read
from ..sources.catalog import LISTS, Tables
from .similarity import durable

FORMAT = "catalog-snapshot"
SCOPES = [*LISTS.values(), "file", "connection", "config"]
STATUSES = ["complete", "incomplete", "unsupported", "disabled"]


@dataclass
class Snapshot:
    """One side of a comparison."""

    servers: DataFrame  # server_id, value (JSON)
    collection: DataFrame  # server_id, scope, status, pages, received, retained, detail
    definitions: DataFrame  # server_id, scope, value (JSON)
    created_at: str = ""


@dataclass
class Comparison:
    changes: DataFrame  # server_id, scope, identity, status
    fields: DataFrame  # server_id, scope, identity, pointer, before_present, before, after_present, after
    issues: DataFrame  # server_id, scope, issue
    summary: DataFrame  # added, removed, changed, unchanged, unpaired, complete

    @property
    def exit_code(self) -> int:
        """0: complete and equal, 1: changes, 2: incomplete."""
        r = self.summary.first()
        return 2 if not r["complete"] else 1 if r["added"] + r["removed"] + r["changed"] else 0


def snapshot_of(tables: Tables, created_at: str) -> Snapshot:
    """The metadata of an audit; labels of how it was launched are left out."""
    server = F.to_json(F.struct(F.col("server_id").alias("id"), "instructions"))
    return Snapshot(tables.servers.select("server_id", server.alias("value")), tables.collection.drop("target_id"), tables.definitions.select("server_id", "scope", F.col("raw").alias("value")), created_at)


def to_text(s: Snapshot) -> str:
    """The envelope as canonical JSON (of one snapshot: small)."""
    names = {"server_id": "serverId"}
    rows = lambda df: [{names.get(k, k): v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
    value = {"format": FORMAT, "schemaVersion": 1, "createdAt": s.created_at, "servers": [read(r["value"]) for r in s.servers.collect()], "collection": rows(s.collection)}
    value["definitions"] = [{"serverId": r["server_id"], "scope": r["scope"], "value": read(r["value"])} for r in s.definitions.collect()]
    return canonical(value)


def stamp(text: str) -> str:
    return hashlib.sha256(canonical(read(text)).encode("utf-8", "surrogatepass")).hexdigest()


def from_text(spark: SparkSession, text: str, formats: tuple[str, ...] = (FORMAT,)) -> Snapshot:
    """Read an envelope; shape errors raise :class:`JsonRefused`, accounting errors show in :func:`problems`."""
    v = read(text)
    if not isinstance(v, dict) or set(v) - {"format", "schemaVersion", "createdAt", "servers", "collection", "definitions"}:
        raise JsonRefused("no snapshot")
    if v.get("format") not in formats or v.get("schemaVersion") != 1:
        raise JsonRefused("unknown snapshot format")
    if not isinstance(v.get("createdAt"), str) or pd.isna(pd.to_datetime(v["createdAt"], errors="coerce")):
        raise JsonRefused("createdAt is no date")
    if not all(isinstance(v.get(k), list) for k in ("servers", "collection", "definitions")) or not v["servers"]:
        raise JsonRefused("a snapshot has lists, and one server at least")
    known = {"servers": {"id", "serverInfo", "capabilities", "instructions"}, "collection": {"serverId", "scope", "status", "pages", "received", "retained", "detail"}, "definitions": {"serverId", "scope", "value"}}
    for part, fields in known.items():
        if any(not isinstance(x, dict) or set(x) - fields for x in v[part]):
            raise JsonRefused(f"{part} has an unknown shape")
    if any(not isinstance(x.get("id"), str) for x in v["servers"]) or any("value" not in x or not isinstance(x.get("serverId"), str) for x in v["definitions"]):
        raise JsonRefused("ids are strings")
    count = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None
    rows = [(x.get("serverId"), x.get("scope"), x.get("status"), *(count(x.get(k)) for k in ("pages", "received", "retained")), x.get("detail")) for x in v["collection"]]
    return Snapshot(
        spark.createDataFrame([(x["id"], canonical(x)) for x in v["servers"]], "server_id string, value string"),
        spark.createDataFrame(rows, "server_id string, scope string, status string, pages long, received long, retained long, detail string"),
        spark.createDataFrame([(x["serverId"], x.get("scope"), compact(x["value"])) for x in v["definitions"]], "server_id string, scope string, value string"),
        v["createdAt"],
    )


def problems(s: Snapshot) -> DataFrame:
    """(problem, server_id, scope) where the accounting of a snapshot does not add up; empty if it is sound."""
    row = lambda df, text: df.select(F.lit(text).alias("problem"), "server_id", "scope" if "scope" in df.columns else F.lit(None).cast("string").alias("scope"))
    ids = s.servers.select("server_id")
    c, key = s.collection, ["server_id", "scope"]
    counted = s.definitions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    against = c.where(F.col("scope").isin(list(LISTS.values()))).join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = (F.col("n") > F.col("received")) | ((F.col("status") == "complete") & ((F.col("n") != F.col("received")) | (F.col("retained") != F.col("n")))) | ((F.col("status") == "unsupported") & (F.col("n") + F.col("received") + F.col("retained") > 0))
    shape = ~F.coalesce(F.col("scope").isin(SCOPES) & F.col("status").isin(STATUSES) & F.col("pages").isNotNull() & (F.col("retained") <= F.col("received")), F.lit(False))
    parts = [
        row(ids.groupBy("server_id").count().where("count > 1"), "server twice"),
        row(c.where(shape), "coverage malformed"),
        row(c.join(ids, "server_id", "left_anti"), "coverage of an unknown server"),
        row(c.groupBy(*key).count().where("count > 1"), "scope twice"),
        row(ids.join(c, "server_id", "left_anti"), "server without coverage"),
        row(s.definitions.join(c, key, "left_anti"), "definition without coverage"),
        row(against.where(wrong), "counts disagree"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identity(scope, value):
    """The name, or the URI, or the template, by scope; null unless it is a string."""
    v = F.try_parse_json(value)
    field = F.when(scope == "resources/list", F.lit("$.uri")).when(scope == "resources/templates/list", F.lit("$.uriTemplate")).otherwise(F.lit("$.name"))
    pick = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    return F.when(field == "$.uri", pick("$.uri")).when(field == "$.uriTemplate", pick("$.uriTemplate")).otherwise(pick("$.name"))


def field_changes(rows: DataFrame) -> DataFrame:
    """Exploded differences of rows (server_id, scope, identity, l, r); JSON text, null for absent."""
    schema = "server_id string, scope string, identity string, pointer string, before_present boolean, before string, after_present boolean, after string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, scope, i, left, right in zip(b["server_id"], b["scope"], b["identity"], b["l"], b["r"], strict=True):
                found = [("", left, right)] if not isinstance(left, str) or not isinstance(right, str) else changed_fields(read(left), read(right))
                out += [(s, scope, i, p, isinstance(x, str), x, isinstance(y, str), y) for p, x, y in found]
            yield pd.DataFrame.from_records(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.select("server_id", "scope", "identity", "l", "r").mapInPandas(run, schema)


def canonical_values(df: DataFrame) -> DataFrame:
    """Add ``canon``, the canonical JSON of ``value``."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else canonical(read(t)))

    return df.withColumn("canon", text("value"))


def pair(before: DataFrame, after: DataFrame, comparable: DataFrame) -> DataFrame:
    """Full join of two sides (server_id, scope, identity, value, canon) by identity, with a verdict for each.

    ``comparable``: (server_id, scope, comparable). Verdicts: added, removed, changed, unchanged, unpaired.
    """
    key = ["server_id", "scope", "identity"]
    side = lambda df, c: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n{c}"), F.min("value").alias(c), F.min("canon").alias(f"c{c}"))
    both = side(before, "l").join(side(after, "r"), key, "full").join(comparable, ["server_id", "scope"], "left")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    one_sided = (nl == 0) | (nr == 0)
    verdict = F.when((nl > 1) | (nr > 1) | (one_sided & ~F.coalesce("comparable", F.lit(False))), "unpaired").when(nl == 0, "added").when(nr == 0, "removed").when(F.col("cl") == F.col("cr"), "unchanged").otherwise("changed")
    return both.select(*key, verdict.alias("status"), "l", "r", nl.alias("n_before"), nr.alias("n_after"))


def compare(before: Snapshot, after: Snapshot) -> Comparison:
    """Pair what can be paired; gaps never pass for additions or removals."""
    listed = F.col("scope").isin(list(LISTS.values()))
    usable = F.col("status").isin("complete", "unsupported")
    gaps = before.collection.unionByName(after.collection).where(~listed & ~usable).select("server_id").distinct()
    there = before.servers.select("server_id", F.lit(True).alias("in_l")).join(after.servers.select("server_id", F.lit(True).alias("in_r")), "server_id", "full")
    there = there.join(gaps.withColumn("gap", F.lit(True)), "server_id", "left").fillna(False, ["in_l", "in_r", "gap"])
    cover = lambda s, c: s.collection.where(listed).select("server_id", "scope", F.col("status").alias(c))
    status = cover(before, "sl").join(cover(after, "sr"), ["server_id", "scope"], "full").join(there, "server_id")
    fine = lambda c, inside: F.coalesce(F.col(c).isin("complete", "unsupported"), F.lit(False)) | ~F.col(inside)
    status = durable(status.withColumn("comparable", ~F.col("gap") & fine("sl", "in_l") & fine("sr", "in_r")))
    sides = []
    for s in (before, after):
        d = s.definitions.select("server_id", "scope", identity(F.col("scope"), F.col("value")).alias("identity"), "value")
        server = s.servers.join(there.where("NOT gap").select("server_id"), "server_id").select("server_id", F.lit("server").alias("scope"), F.col("server_id").alias("identity"), "value")
        sides.append(canonical_values(d.unionByName(server)))
    always = there.select("server_id", F.lit("server").alias("scope"), F.lit(True).alias("comparable"))
    pairs = durable(pair(*(x.where("identity IS NOT NULL") for x in sides), status.select("server_id", "scope", "comparable").unionByName(always)))
    nameless = sides[0].unionByName(sides[1]).where("identity IS NULL")
    changes = pairs.where("status IN ('added', 'removed', 'changed')")
    text = lambda df, t: df.select("server_id", "scope", F.lit(t).alias("issue") if isinstance(t, str) else t.alias("issue"))
    un = F.coalesce(F.col("sl") == "unsupported", F.lit(False))
    un_r = F.coalesce(F.col("sr") == "unsupported", F.lit(False))
    absent = (~F.col("in_l") | ~F.col("in_r")) & F.coalesce(F.coalesce("sl", "sr") == "unsupported", F.lit(False))
    issues = text(before.collection.unionByName(after.collection).where(~usable), F.concat(F.lit("coverage is "), F.col("status")))
    issues = issues.unionByName(text(status.where(~F.col("comparable") & ~(un & un_r) & ~absent), "what is absent cannot be told from what was not collected"))
    issues = issues.unionByName(text(pairs.where("n_before > 1 OR n_after > 1"), F.concat(F.lit("identity twice: "), F.col("identity")))).unionByName(text(nameless, "an entry without identity")).distinct()
    counts = pairs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")], F.coalesce(F.sum(F.when(F.col("status") == "unpaired", F.col("n_before") + F.col("n_after"))), F.lit(0)).alias("u"))
    extra = nameless.agg(F.count(F.lit(1)).alias("x")).crossJoin(there.where("gap").agg(F.count(F.lit(1)).alias("g")))  # single rows
    summary = counts.crossJoin(extra).crossJoin(issues.agg((F.count(F.lit(1)) == 0).alias("complete")))
    summary = summary.select("added", "removed", "changed", "unchanged", (F.col("u") + F.col("x") + F.col("g")).alias("unpaired"), "complete")
    return Comparison(changes.select("server_id", "scope", "identity", "status"), field_changes(changes), issues, summary)
