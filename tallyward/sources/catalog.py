"""Saved catalogs: files of JSON to tables of entries, with a record of what is missing or malformed.

Nothing is dropped in silence: a file that cannot be read, a list that is no list and an
entry that is malformed all leave a coverage row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import JsonRefused, compact, decode, read

ITEMS = 100_000
#: Rows that a pass in Python hands on at once.
ROWS = 1000
LISTS = {"tools": "tools/list", "prompts": "prompts/list", "resources": "resources/list", "resourceTemplates": "resources/templates/list"}
KIND = {"tools": "tool", "prompts": "prompt", "resources": "resource", "resourceTemplates": "resource"}

SCHEMA = (
    "target_id string, server_id string, what string, scope string, ord long, name string, title string, description string, "
    "input_schema string, output_schema string, annotations string, arguments string, uri string, uri_template string, mime_type string, "
    "raw string, instructions string, status string, pages long, received long, retained long, detail string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Tables:
    """The silver tables of any number of targets."""

    servers: DataFrame
    tools: DataFrame
    prompts: DataFrame
    resources: DataFrame
    collection: DataFrame
    definitions: DataFrame

    @property
    def items(self) -> DataFrame:
        """Tools, prompts and resources in one table, with their kind."""
        parts = [df.withColumn("kind", F.lit(k)) for k, df in (("tool", self.tools), ("prompt", self.prompts), ("resource", self.resources))]
        return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def gap(status: str, detail: str | None = None, pages: int = 0) -> dict:
    """The counts of a coverage row without entries."""
    return {"status": status, "detail": detail, "pages": pages} | dict.fromkeys(("received", "retained"), 0)


def _hint_issues(annotations: Any) -> list[str]:
    if annotations is None:
        return []
    if not isinstance(annotations, dict):
        return ["annotations must be an object"]
    out = [f"annotations.{k} must be a boolean" for k in ("readOnlyHint", "destructiveHint", "idempotentHint", "openWorldHint") if k in annotations and not isinstance(annotations[k], bool)]
    return out + (["annotations.title must be a string"] if "title" in annotations and not isinstance(annotations["title"], str) else [])


def _bad_argument(a: Any) -> bool:
    return not isinstance(a, dict) or not isinstance(a.get("name"), str) or ("description" in a and not isinstance(a["description"], str)) or ("required" in a and not isinstance(a["required"], bool))


def entries_of(key: str, values: list, base: dict, start: int = 0, most: int = ITEMS) -> Iterator[dict]:
    """Rows of one list: the definitions, the items, and its coverage row; numbers count from ``start``."""
    scope, kind = LISTS[key], KIND[key]
    row = base | {"scope": scope}
    malformed, first, unnamed, issues, retained = 0, -1, 0, [], 0
    for i, raw in enumerate(values[:most], start):
        yield row | {"what": "definition", "ord": i, "raw": compact(raw)}
        if not isinstance(raw, dict):
            malformed, first = malformed + 1, i if first < 0 else first
            continue
        text = lambda k, raw=raw: raw[k] if isinstance(raw.get(k), str) else None
        bad = not isinstance(raw.get("name"), str) or any(k in raw and not isinstance(raw[k], str) for k in ("title", "description"))
        item = row | {"what": kind, "ord": i, "name": text("name") if text("name") is not None else f"(unnamed {key} entry {i + 1})", "title": text("title"), "description": text("description"), "raw": compact(raw)}
        if key == "tools":
            found = _hint_issues(raw.get("annotations")) if "annotations" in raw else []
            found = ["annotations must be an object"] if "annotations" in raw and raw["annotations"] is None else found
            bad |= bool(found)
            issues += [f"entry {i}: {', '.join(found)}"] if found and len(issues) < 3 else []
            item |= {"input_schema": compact(raw["inputSchema"]) if "inputSchema" in raw else None, "output_schema": compact(raw["outputSchema"]) if "outputSchema" in raw else None}
            item |= {"annotations": compact(raw["annotations"]) if isinstance(raw.get("annotations"), dict) else None}
        elif key == "prompts":
            arguments = raw.get("arguments")
            bad |= "arguments" in raw and (not isinstance(arguments, list) or any(map(_bad_argument, arguments)))
            if isinstance(arguments, list):
                kept = [{k: a[k] for k, t in (("name", str), ("description", str), ("required", bool)) if isinstance(a.get(k), t)} for a in arguments if isinstance(a, dict) and isinstance(a.get("name"), str)]
                item["arguments"] = compact(kept)
        else:
            need = "uri" if key == "resources" else "uriTemplate"
            if not isinstance(raw.get(need), str):
                bad, unnamed = True, unnamed + 1
            bad |= any(k in raw and not isinstance(raw[k], str) for k in ("uri", "uriTemplate", "mimeType"))
            item |= {"uri": text("uri"), "uri_template": text("uriTemplate"), "mime_type": text("mimeType")}
        retained += 1
        malformed, first = malformed + bad, i if bad and first < 0 else first
        yield item
    detail = []
    if malformed:
        detail.append(f"{malformed} malformed entries in {key}, the first at {first}.")
        detail += [f"{unnamed} without the identity that this list needs."] if unnamed else []
        detail += [f"Annotations: {'; '.join(issues)}."] if issues else []
    if len(values) > most:
        detail.append(f"Stopped after {most} entries.")
    status = "incomplete" if detail else "complete"
    yield row | {"what": "coverage", "status": status, "pages": 1, "received": len(values), "retained": retained, "detail": " ".join(detail) or None}


def list_result_issue(page: dict) -> str | None:
    """Why a page's result type leaves it unverified."""
    kind = page.get("resultType")
    if "resultType" not in page or kind == "complete":
        return None
    return "The result asks for input." if kind == "input_required" else "The result type is not known."


def entries(data: bytes | str, target_id: str, server_id: str, start: int = 0) -> Iterator[dict]:
    """All rows of one saved catalog, or of a part of one whose lists go on from entry ``start``."""
    base = {"target_id": target_id, "server_id": server_id}
    file = base | {"what": "coverage", "scope": "file"} | gap("incomplete")
    try:
        catalog = read(data if isinstance(data, str) else decode(bytes(data)))
    except JsonRefused as e:
        yield base | {"what": "server"}
        yield file | {"detail": str(e)}
        return
    catalog = {"tools": catalog} if isinstance(catalog, list) else catalog
    if not isinstance(catalog, dict) or not any(k in catalog for k in (*LISTS, "instructions")):
        yield base | {"what": "server"}
        yield file | {"detail": "No list of tools, prompts, resources or templates."}
        return
    instructions = catalog.get("instructions")
    yield base | {"what": "server", "instructions": instructions if isinstance(instructions, str) else None}
    for key, scope in LISTS.items():
        if key in catalog and isinstance(catalog[key], list):
            yield from entries_of(key, catalog[key], base, start)
        elif key in catalog:
            yield base | {"what": "coverage", "scope": scope} | gap("incomplete", f"{key} is no list.", 1)
    issues = [x for x in [list_result_issue(catalog)] if x]
    issues += ["A cursor is left: there are further pages."] if "nextCursor" in catalog else []
    issues += ["Instructions are no string."] if "instructions" in catalog and not isinstance(instructions, str) else []
    yield file | {"status": "incomplete" if issues else "complete", "detail": " ".join(issues) or "Only the saved catalog was read."}


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Rows as tables of ROWS at most, whatever the size of a catalog."""
    whole = ("ord", "pages", "received", "retained")
    while some := list(islice(rows, ROWS)):
        out = pd.DataFrame.from_records(some, columns=_COLUMNS)
        for c in whole:
            out[c] = out[c].astype("Int64")
        yield out.astype({c: object for c in _COLUMNS if c not in whole}).where(lambda d: d.notna(), None)


def parse(files: DataFrame) -> DataFrame:
    """Entries of files (target_id, server_id, content), content binary or string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, target, server in zip(b["content"], b["target_id"], b["server_id"], strict=True):
                yield from _frames(entries(data, target, server))

    return files.select("content", "target_id", "server_id").mapInPandas(run, SCHEMA)


def parse_parts(parts: DataFrame) -> DataFrame:
    """Entries of catalogs that come in parts (target_id, server_id, start, content), to be stored and put :func:`together`.

    Each part is a catalog of its own, whose lists go on from entry ``start``. A part is
    bounded, so a catalog need not be. ITEMS holds for a part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, target, server, start in zip(b["content"], b["target_id"], b["server_id"], b["start"], strict=True):
                yield from _frames(entries(data, target, server, int(start)))

    return parts.select("content", "target_id", "server_id", "start").mapInPandas(run, SCHEMA)


def together(rows: DataFrame) -> DataFrame:
    """Stored entries of parts in the shape that :func:`parse` gives, with one coverage row for each list."""
    rest = rows.where("what NOT IN ('coverage', 'server')")
    by = ["target_id", "server_id", "scope"]
    notes = F.concat_ws(" ", F.array_sort(F.collect_set("detail")))
    lists = rows.where("what = 'coverage'").groupBy(*by).agg(F.max("status").alias("status"), F.max("pages").alias("pages"), F.sum("received").alias("received"), F.sum("retained").alias("retained"), notes.alias("detail"))
    lists = lists.withColumn("what", F.lit("coverage")).withColumn("detail", F.when(F.col("detail") != "", F.col("detail")))
    servers = rows.where("what = 'server'").groupBy("target_id", "server_id").agg(F.max("instructions").alias("instructions")).withColumn("what", F.lit("server"))
    return rest.unionByName(lists, True).unionByName(servers, True).select(*_COLUMNS)


def tables(parsed: DataFrame) -> Tables:
    """Split entries into tables; ``parsed`` should be stored or cached, as every table reads it."""

    def of(what: str, *columns: str) -> DataFrame:
        return parsed.where(F.col("what") == what).select("target_id", "server_id", *columns)

    common = ("ord", "name", "title", "description")
    return Tables(
        servers=of("server", "instructions"),
        tools=of("tool", *common, "input_schema", "output_schema", "annotations", "raw"),
        prompts=of("prompt", *common, "arguments"),
        resources=of("resource", *common, "scope", "uri", "uri_template", "mime_type"),
        collection=of("coverage", "scope", "status", "pages", "received", "retained", "detail"),
        definitions=of("definition", "scope", "ord", "raw"),
    )


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (target_id, server_id, content); each is a target of its own, named by its path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("target_id"), F.lit("file").alias("server_id"), "content")


def merged(*parts: Tables) -> Tables:
    """The tables of several audits as one."""
    names = ("servers", "tools", "prompts", "resources", "collection", "definitions")

    def union(name: str) -> DataFrame:
        out = getattr(parts[0], name)
        for p in parts[1:]:
            out = out.unionByName(getattr(p, name))
        return out

    return Tables(**{n: union(n) for n in names})
