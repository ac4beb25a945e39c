"""Language identification by averaged hashed subword embeddings and a linear softmax.

Texts are put in lower case; whatever is neither an ASCII letter nor beyond ASCII becomes
a border mark, and marks in a row are one. Subwords are the runs of one to four bytes of
the result, so they hold the borders of words; each is hashed to a row of an embedding
table. A text is the average of its subwords' rows; a linear softmax over that gives the
languages. Table and weights are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled texts; then a temperature is fitted on a part
that was held back, and the calibrated probability below which a prediction is marked as
rejected is set so that accepted ones reach the wanted precision.

For prediction the table and the weights fold into one score for each row and language;
whole texts are summed in numpy, many at a time.

Edge cases: null text and text without a letter give ``und`` with score 0; texts of any
length are read whole; without a labelled text everything is ``und``; rows with a null
id or repeated rows are predicted each on its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, chunks, spans

#: Rows of the table, its width, and the longest subword in bytes.
ROWS, WIDTH, LONGEST = 1 << 15, 8, 4
#: Labelled texts that training reads at most, and the longest that it takes.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
EACH = 50  # texts of each language that enter the sample before others
STEPS, RATE, BATCH, SCALE = 500, 0.15, 32, 30.0
PRECISION = 0.99
UNKNOWN = "und"

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subword: (row of each place, first place of each text); row ROWS is none."""
    raw = _KEEP[data[offsets[0] : offsets[-1]]]
    cuts = offsets - offsets[0]
    blank = raw == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    raw, cuts = raw[keep].astype(np.uint32), place[cuts]
    n = len(raw)
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(n)  # bytes to the end of the text
    h = np.zeros(n, np.uint32)
    for size in range(1, LONGEST + 1):
        m = max(0, n - size + 1)
        h = h[:m] * np.uint32(0x01000193) + raw[size - 1 :] + np.uint32(1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        rows = np.full(n, ROWS, np.int64)
        rows[:m] = np.where(left[:m] >= size, (mixed >> np.uint32(17)).astype(np.int64), ROWS)
        yield rows, cuts


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # (ROWS + 1, labels + 1): table times weights, and a one to count; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _column(texts) -> pa.Array:
    return as_bytes(pc.utf8_lower(texts))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, weights) of each text; the weights add up to SCALE."""
    offsets, data = spans(_column(pa.array(texts, pa.string())))
    out = []
    for lo, hi in chunks(offsets):
        parts = list(subwords(offsets[lo : hi + 1], data))
        for d in range(hi - lo):
            mine = np.concatenate([rows[cuts[d] : cuts[d + 1]] for rows, cuts in parts])
            rows, n = np.unique(mine[mine < ROWS], return_counts=True)
            out.append((rows, n * (SCALE / max(1, n.sum()))))
    return out


def train(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """Fit table, weights, temperature and threshold; a fifth of the texts is for the last two."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((ROWS + 1, 1)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    data = features(texts)
    order = rng.permutation(len(texts))
    cut = len(order) * 4 // 5 if len(order) > 9 else len(order)
    table, weights, bias = rng.normal(0, 0.1, (ROWS, WIDTH)), rng.normal(0, 0.5, (WIDTH, len(labels))), np.zeros(len(labels))
    queue = np.zeros(0, np.int64)
    for step in range(STEPS):
        rate = RATE * (1 - step / STEPS)
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(order[:cut])])
        at, queue = queue[:BATCH], queue[BATCH:]
        mean = np.stack([w @ table[r] for r, w in (data[i] for i in at)])
        wrong = softmax(mean @ weights + bias)
        wrong[np.arange(len(at)), y[at]] -= 1
        wrong /= len(at)
        back = wrong @ weights.T
        weights -= rate * mean.T @ wrong
        bias -= rate * wrong.sum(axis=0)
        for g, i in zip(back, at, strict=True):
            r, w = data[i]  # rows of a text are distinct
            table[r] -= rate * w[:, None] * g
    held = order[cut:] if cut < len(order) else order
    z = np.stack([w @ table[r] for r, w in (data[i] for i in held)]) @ weights + bias
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
    p = softmax(z / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    down = np.argsort(-best)
    precise = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION
    # where all are precise enough there is nothing to reject
    threshold = 1 / len(labels) if precise[-1] else float(best[down][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    scores = np.zeros((ROWS + 1, len(labels) + 1))
    scores[:ROWS, :-1], scores[:ROWS, -1] = SCALE * table @ weights, 1
    return Model(labels, scores, bias, temperature, threshold)


def probabilities(model: Model, column: pa.Array) -> np.ndarray:
    """Calibrated probabilities of every text."""
    offsets, data = spans(_column(column))
    out = [np.zeros((0, len(model.labels)))]
    for lo, hi in chunks(offsets):
        total = np.zeros((hi - lo, model.scores.shape[1]))
        for rows, cuts in subwords(offsets[lo : hi + 1], data):
            for k in range(total.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(model.scores[:, k][rows])])
                total[:, k] += sums[cuts[1:]] - sums[cuts[:-1]]
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        out.append(softmax((mean + model.bias) / model.temperature))
    return np.concatenate(out)


def sample(labelled: DataFrame, text_col: str, lang_col: str, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most ``most`` labelled texts of SAMPLE_CHARS characters at most: up to EACH of every language, then those of smallest hash."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(text_col, F.lit(5)).alias("h"))
    # texts are fetched once their hashes are known, so that only short rows are sorted; copies count once
    turn = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    ranked = rows.select("h", "l").distinct().withColumn("n", turn).where(F.col("n") <= most)
    chosen = ranked.orderBy(F.least("n", F.lit(EACH + 1)), "h", "l").limit(most).select("h", "l").collect()
    if not chosen:
        return [], []
    few = labelled.sparkSession.createDataFrame(chosen, "h long, l string")  # SAMPLE rows at most
    got = rows.join(F.broadcast(few), ["h", "l"]).dropDuplicates(["h", "l"]).collect()
    got.sort(key=lambda r: (r["h"], r["l"]))
    return [r["t"] for r in got], [r["l"] for r in got]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, letter = shared.value, regex.compile(r"\p{L}").search
        for b in batches:
            p = probabilities(model, b.column(1)) if model.labels else np.zeros((len(b), 1))
            some = np.array([t.is_valid and letter(t.as_py()) is not None for t in b.column(1)], bool) & bool(model.labels)
            names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1).tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(score < model.threshold)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, predict all."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(*sample(docs.where(~F.coalesce(held, F.lit(True))), "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
