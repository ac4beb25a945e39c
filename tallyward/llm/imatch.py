"""I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits in lower case. A term belongs to the lexicon when
its inverse document frequency, ln(documents / document frequency), lies in a band.
Frequencies of terms are counted exactly, over all documents. The lexicon is handed on as
a filter of ``CELLS`` bits (128 KB), whatever the size of the corpus: every term of the
band is in it, and one beside the band is taken for one of them with probability of at
most (terms of the band) / CELLS, the same way in every document. For each of several
randomised subsets of the lexicon, of falling density, the document's distinct terms in
it are sorted and hashed; these hashes are the fingerprint. Likeness of two fingerprints
is the share of equal hashes among the subsets that either document has terms in.

The next document, in order of id, is found by range: rows go to ranges of consecutive
ids, cut at quantiles, the first rows of a range also to the one before, so a text is
shuffled once. Beyond RANGES * RANGE_ROWS rows the ranges grow; each is sorted on disk.

Edge cases: null text is taken as empty and has no terms: all its hashes are ``-``;
documents with no term in the band use all their terms; rows with a null id come first;
rows that share an id are ordered by their text's hash; the last document is followed
by the first, a single one by itself; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the filter that the lexicon is handed on as.
CELLS = 1 << 20
#: Band of inverse document frequency.
BAND = (0.7, 5.0)
#: Halvings of each lexicon subset: bits of a term's hash that are zero if the term is in it.
HALVINGS = tuple(k for k in (1, 2, 3, 4, 5, 6) for _ in range(4))
#: Seeds of the two hashes that the bits are taken from, by turns.
SALTS = (11, 12)
#: Documents of an id range, about, and the most ranges there are (their first ids are literals).
RANGE_ROWS, RANGES = 2000, 10_000
_SPLIT = r"[^\p{L}\p{N}]+"


def _hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), _SPLIT), ""), lambda x: F.xxhash64(x))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1).cast("long"))


def lexicon(docs: DataFrame, text_col: str, band: tuple[float, float] = BAND) -> list[int]:
    """Bitmap of the cells that hold a term of the band: CELLS / 64 longs."""
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("term"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    kept = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(idf.between(*band)).select(_cell(F.col("term")).alias("cell"))
    at = F.shiftright("cell", 6).cast("int")
    bit = F.expr("shiftleft(1L, cast(cell & 63 AS INT))")
    bitmap = [0] * (CELLS // 64)
    for row in kept.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():  # CELLS / 64 rows at most
        bitmap[row["at"]] = row["bits"]
    return bitmap


def _masks() -> list[tuple[str, int]]:
    """(hash, mask) of each subset: no two subsets share a bit."""
    free, out = [0] * len(SALTS), []
    for r, k in enumerate(HALVINGS):
        which = r % len(SALTS)
        out.append((f"h{which}", ((1 << k) - 1) << free[which]))
        free[which] += k
    return out


def fingerprint(text: Column, bitmap: list[int]) -> Column:
    """Array of one hash (8 hexadecimal digits) for each lexicon subset, ``-`` for none."""
    # one string, which is folded to an array once; as many literals would be a large plan
    bits = F.from_json(F.lit(f"[{','.join(map(str, bitmap))}]"), "array<bigint>")
    all_ = F.array_distinct(_hashes(text))
    inside = lambda h: F.getbit(F.element_at(bits, F.shiftright(_cell(h), 6).cast("int") + 1), _cell(h).bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    both = F.struct(F.filter(all_, inside).alias("banded"), all_.alias("all"))
    hashed = lambda x: F.struct(x.alias("t"), *[F.xxhash64(x, F.lit(s)).alias(f"h{i}") for i, s in enumerate(SALTS)])

    def one(terms: Column, name: str, mask: int) -> Column:
        some = F.transform(F.filter(terms, lambda x: x[name].bitwiseAND(F.lit(mask).cast("long")) == 0), lambda x: x["t"])
        return F.when(F.size(some) > 0, F.right(F.lpad(F.hex(F.xxhash64(some)), 16, "0"), F.lit(8))).otherwise(F.lit("-"))

    # arrays of one element: what is inside is made once, and serves all that reads it
    terms = F.transform(F.array(both), lambda b: F.array_sort(F.when(F.size(b["banded"]) > 0, b["banded"]).otherwise(b["all"])))
    return F.transform(F.transform(terms, lambda t: F.transform(t, hashed)), lambda t: F.array(*[one(t, n, m) for n, m in _masks()]))[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes, 0 to 1; equal fingerprints are 1."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.size(F.filter(both, lambda x: (x["a"] != "-") | (x["b"] != "-")))
    same = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != "-")))
    return F.when(a == b, F.lit(1.0)).when(some == 0, F.lit(0.0)).otherwise(same.cast("double") / some)


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in the order of key and tie (after the last: the first)."""
    lo, n = rows.agg(F.min(key), F.count(F.lit(1))).first()
    lo = 0 if lo is None else lo
    ranges = max(1, min(RANGES, math.ceil(n / RANGE_ROWS)))
    cuts = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    found = rows.agg(F.expr(f"approx_percentile({key}, array({cuts}), {20 * ranges})")).first()[0] if cuts else None
    bounds = F.array(*[F.lit(x) for x in sorted(set(found or []))]).cast("array<bigint>")  # RANGES at most
    # rows without a key come first; those of one key are in one range
    at = F.coalesce(F.size(F.filter(bounds, lambda x: x <= F.col(key))), F.lit(0))
    at = F.when(F.col(key).isNull(), F.lit(0)).otherwise(at)
    ranged = rows.withColumn("_at", at).withColumn("_key", F.coalesce(F.col(key), F.lit(lo) - 1))
    firsts = {r["_at"]: r["k"] for r in ranged.groupBy("_at").agg(F.min("_key").alias("k")).collect()}  # RANGES rows at most
    known = sorted(firsts)
    first, before = ["NULL"] * ranges, [0] * ranges
    for i, x in enumerate(known):
        first[x], before[x] = f"{firsts[x]}L", known[i - 1]
    leads = F.col("_key") == F.element_at(F.expr(f"array({', '.join(first)})").cast("array<bigint>"), F.col("_at") + 1)
    own = F.struct(F.col("_at").alias("to"), F.lit(False).alias("copy"), F.lit(False).alias("wrap"))
    copy = F.struct(F.element_at(F.expr(f"array({', '.join(map(str, before))})"), F.col("_at") + 1).alias("to"), F.lit(True).alias("copy"), (F.col("_at") == (known[0] if known else 0)).alias("wrap"))
    sent = ranged.withColumn("_", F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("_.to").orderBy("_.wrap", "_key", tie)
    out = sent.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.where(~F.col("_.copy")).drop("_", "_at", "_key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document and of its edited text (see the README), and their likeness."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bitmap = lexicon(own, "text", band)
    rows = with_next(own.withColumn("tie", F.xxhash64("text")).withColumn("fp", fingerprint(F.col("text"), bitmap)), "doc_id", "tie", ["text", "fp"])
    rows = rows.withColumn("n", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 2 AS INT)), substring(next_text, 1, cast(n div 2 AS INT)))"))
    rows = rows.select("doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited"), bitmap).alias("efp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat_ws(".", "fp").alias("fingerprint"), F.concat_ws(".", "efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
