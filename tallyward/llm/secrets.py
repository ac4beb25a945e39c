"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds, leftmost matches without overlap: ``assign`` (a key word, a colon or equals
sign, a value of 12 characters or more), ``access`` (AKIA...), ``hex`` (16 or more).
Values are hashed and counted over the corpus by distinct repositories and distinct
owners. A value that several owners have, or that very many repositories of one owner
have (``SPREAD``), is a copied example; one that is not copied and that looks like a
credential (letters and digits mixed, many different characters, no placeholder word) is
live-looking. Beyond the base kinds the method adds a span ``owned`` for each long mixed
token of that sort that is not copied, outside of base spans.

Positions come from the lengths of what lies between matches: splitting at a pattern and
extracting its matches walk a text alike. Each text is scanned once; from then on only
lengths and hashes move. Values in very many rows are counted by partial aggregation.

Edge cases: null text is empty and has no spans; null owners count as one owner, null
repositories as none; rows with a null id, or that share one, are scanned each on its own;
matches next to each other, at the ends of a text and astral characters count in code
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: kind: pattern, group that holds the value, characters of that group at least
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs of fewer are dropped, and a run is one match
}
#: Tokens that the method looks at beside the base kinds.
EXTRA = r"[A-Za-z0-9+/_-]{20,}"
#: Owners of a value, from which on it is a copied example.
COPIED = 2
#: Repositories of a value, from which on it is a copied example even within one owner: an
#: owner's own credential is in a few of its repositories, an example or a header in dozens.
SPREAD = 50
#: What stands in place of a secret in a redacted text.
MASK = "[SECRET]"
_PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|x{4,}|1234|abcd"


def _found(text: Column, order: int, pattern: str, group: int) -> Column:
    """Array of (order, gap before, length, value) of all matches, good or not."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value"))
    # one gap more than matches: the last row has none
    rows = F.transform(rows, lambda x: F.struct(F.lit(order).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>"))


def _live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike(_PLACEHOLDER)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text: rows that agree on them have the same spans."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col))))


def matches(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(row, repo, owner, kind, start, end, value hash, live) of base spans and candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scans = [_found(text, i, p, g) for i, (p, g, _) in enumerate(BASE.values())] + [_found(text, len(BASE), EXTRA, 0)]
    found = docs.select(F.monotonically_increasing_id().alias("uid"), row_key(id_col, text_col).alias("row"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.concat(*scans).alias("m"))
    found = found.where(F.size("m") > 0).select("uid", "row", "repo", "owner", F.posexplode("m").alias("at", "m")).select("uid", "row", "repo", "owner", "at", "m.*")
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in BASE.values()], F.lit(0)), F.col("kind") + 1)
    w = Window.partitionBy("uid", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    placed = found.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    good = placed.where(F.length("value") >= least)
    return good.select("row", "repo", "owner", "kind", "start", "end", F.unhex(F.md5("value")).alias("hash"), _live(F.col("value")).alias("live")).where((F.col("kind") < len(BASE)) | F.col("live"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repos, owners): distinct repositories and owners of every value."""
    owner = F.coalesce("owner", F.lit(""))
    return found.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct(owner).alias("owners"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row for each row hash that has spans: sorted base spans, added spans, and counts."""
    found = written(matches(docs, id_col, text_col, owner_col, repo_col), "matches")
    once = found.dropDuplicates(["row", "kind", "start", "end"])  # repeated rows have the same spans
    # as merges at every size: neither side has a bound
    judged = once.join(ownership(found).hint("merge"), "hash")
    span = F.struct("start", "kind", "end")
    base = F.col("kind") < len(BASE)
    copied = (F.col("owners") >= COPIED) | (F.col("repos") >= SPREAD)
    counts = {f"n_{k}": F.count_if(F.col("kind") == i) for i, k in enumerate(BASE)}
    rows = judged.groupBy("row").agg(
        *[c.alias(n) for n, c in counts.items()],
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~base & ~copied, span))).alias("more"),
        F.count_if(base & F.col("live") & ~copied).alias("n_live"),
        F.count_if(base & copied).alias("n_copied"),
    )
    apart = F.filter("more", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return rows.withColumn("all", F.array_sort(F.concat("base", apart))).drop("more")


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in BASE], F.lit("owned"))
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row for every document: counts, digest of the base spans, all spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"))
    out = rows.join(spans(docs, id_col, text_col, owner_col, repo_col).hint("merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """The documents, with every span replaced by ``MASK``."""
    found = spans(docs, id_col, text_col, owner_col, repo_col).select(F.col("row").alias("_row"), F.col("all").alias("_all"))
    joined = docs.withColumn("_row", row_key(id_col, text_col)).join(found.hint("merge"), "_row", "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        between = F.substr(text, acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        fresh = F.concat(acc["out"], between, F.lit(MASK))
        # a span inside the one before adds nothing
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("_all", begin, put, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    out = joined.withColumn(text_col, F.when(F.size("_all") > 0, masked).otherwise(text))
    return out.select(*docs.columns)
