"""Lists saved page by page: which pages count, and what is left uncollected.

A page is the JSON of one result, with a list and perhaps ``nextCursor``. Pages are read in
order up to the one that ends the list; what came before an end that is no proper one
stays, and the list is incomplete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import JsonRefused, compact, read
from .catalog import ITEMS, LISTS, SCHEMA, entries_of, list_result_issue

#: Pages of one list.
PAGES = 1000
_READ = "target_id string, server_id string, key string, page long, n long, values string, cursor string, issue string"
_KEY = ["target_id", "server_id", "key"]
#: Ends of a list that leave it incomplete.
REPEATED, LEFT = "a cursor is there again", "further pages were not saved"
#: Capability that stands for a list.
OFFERED = {"tools": "tools", "prompts": "prompts", "resources": "resources", "resourceTemplates": "resources"}


def _page(key: str, content: str) -> tuple[int, str, str | None, str | None]:
    """(entries, their JSON, cursor, what ends the list here)."""
    try:
        result = read(content)
    except JsonRefused as e:
        return 0, "[]", None, f"no JSON ({e})"
    values = result.get(key) if isinstance(result, dict) else None
    if not isinstance(values, list):
        return 0, "[]", None, f"no list of {key}"
    cursor = result.get("nextCursor")
    odd = "a cursor is no string" if "nextCursor" in result and not isinstance(cursor, str) else None
    return len(values), compact(values), cursor if odd is None else None, list_result_issue(result) or odd


def page_ends(pages: DataFrame) -> DataFrame:
    """Pages (target_id, server_id, key, page, content) with their entries, those before, and ``end``.

    ``end`` is null where the list goes on, empty where it ends as it should, and says what is wrong otherwise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, s, k, p, *_page(k, c)) for t, s, k, p, c in b[[*_KEY, "page", "content"]].itertuples(index=False)]
            yield pd.DataFrame.from_records(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    found = pages.select(*_KEY, "page", "content").mapInPandas(run, _READ)
    order = Window.partitionBy(*_KEY).orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    again = F.count("cursor").over(Window.partitionBy(*_KEY, "cursor").orderBy("page")) > 1
    marked = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("no", F.row_number().over(order)).withColumn("again", again)
    more = F.lead("page").over(order).isNotNull()
    full = F.col("before") + F.col("n") > ITEMS
    end = (
        F.when(full, F.lit(f"more than {ITEMS} entries")).when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("cursor").isNull(), F.lit(""))
        .when(F.col("again"), F.lit(REPEATED)).when(F.col("no") >= PAGES, F.lit(f"more than {PAGES} pages")).when(~more, F.lit(LEFT))
    )
    return marked.withColumn("end", end).select(*_KEY, "page", "n", "before", "values", "end")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Entries of saved pages, in the shape that :func:`catalog.parse` gives, with one coverage row for each list."""
    ends = page_ends(pages)
    ended = F.max(F.col("end").isNotNull()).over(Window.partitionBy(*_KEY).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    counted = ends.withColumn("after", F.coalesce(ended, F.lit(False))).where("NOT after").drop("after")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    whole = ("ord", "pages", "received", "retained")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, s, key, page, _, start, values, end in b.itertuples(index=False):
                for row in entries_of(key, read(values)[: max(0, ITEMS - start)], {"target_id": t, "server_id": s}, start):
                    # the page stands in the place of the coverage's order until pages are put together
                    out.append(row | {"ord": page, "raw": end} if row["what"] == "coverage" else row)
            rows = pd.DataFrame.from_records(out, columns=names)
            for c in whole:
                rows[c] = rows[c].astype("Int64")
            yield rows.astype({c: object for c in names if c not in whole}).where(lambda d: d.notna(), None)

    rows = counted.mapInPandas(run, SCHEMA)
    covered = F.col("what") == "coverage"
    notes = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(" ", "detail", F.when(F.col("raw") != "", F.concat(F.lit("Ended early: "), F.col("raw"), F.lit("."))))))), lambda x: x["col2"])
    lists = rows.where(covered).groupBy("target_id", "server_id", "scope").agg(
        F.when(F.max((F.col("status") == "incomplete") | (F.col("raw") != "")), "incomplete").otherwise("complete").alias("status"),
        F.sum("pages").alias("pages"), F.sum("received").alias("received"), F.sum("retained").alias("retained"),
        F.concat_ws(" ", F.filter(notes, lambda x: x != "")).alias("detail"),
    )
    lists = lists.withColumn("what", F.lit("coverage")).withColumn("detail", F.when(F.col("detail") != "", F.col("detail")))
    servers = counted.select("target_id", "server_id").distinct().withColumn("what", F.lit("server"))
    return rows.where(~covered).unionByName(lists, True).unionByName(servers, True).select(*names)


def not_offered(servers: DataFrame) -> DataFrame:
    """Coverage rows of the lists whose capability a server (target_id, server_id, capabilities as JSON) does not name."""
    lists = servers.sparkSession.createDataFrame([(LISTS[k], c) for k, c in OFFERED.items()], "scope string, capability string")
    named = servers.select("target_id", "server_id", F.explode(F.coalesce(F.json_object_keys("capabilities"), F.array().cast("array<string>"))).alias("capability")).distinct()
    each = servers.select("target_id", "server_id").crossJoin(F.broadcast(lists))  # four rows
    gone = each.join(named, ["target_id", "server_id", "capability"], "left_anti")
    zero = F.lit(0).cast("long")
    return gone.select("target_id", "server_id", "scope", F.lit("unsupported").alias("status"), zero.alias("pages"), zero.alias("received"), zero.alias("retained"), F.concat(F.lit("The server does not offer "), F.col("capability"), F.lit(".")).alias("detail"))
