"""Toxicity by a chain of linear classifiers.

Each category has a logistic model over the words of a text (in lower case, cut at
whatever is no letter) and over how they begin, so that inflected forms share a feature;
those that separate its sample best are kept. Further features are the probabilities
of the categories before it in the chain. For training those come out of folds: a model
that has not seen the text. So a later model meets in training what it meets later on.
Ridge-penalised Newton steps in numpy fit the models on a bounded, documented sample of
labelled texts; the threshold of each category maximises F1 out of folds.

Prediction is one pass over whole texts. The words of the models are a few hundred, so
the model is small whatever the corpus.

Edge cases: null or empty text has no words and is judged by the intercepts; without
labelled texts, or with one class only, a category's probability is its constant rate,
and nothing is rejected; rows with a null id and repeated rows are judged each on its
own; labels that are null are not used; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Labelled texts that training reads at most, and the longest that it takes.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
#: Words of a model, folds, ridge.
WORDS, FOLDS, RIDGE, STEPS = 300, 5, 1.0, 12
#: Bytes of a word's beginning that count as features.
BEGINNINGS = (5, 6, 7, 8)
#: A word is in so many texts at least, and separates the classes by so many deviations.
TEXTS, DEVIATIONS = 3, 4.0

_CUT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    """Distinct words of a text and, with a hyphen, their beginnings."""
    has = set(text.lower().encode().translate(_CUT).split())
    return has.union(*[{w[:n] + b"-" for w in has if len(w) >= n} for n in BEGINNINGS])


@dataclass
class Link:
    """One category: weights of words and of earlier probabilities."""

    name: str
    weights: dict[bytes, float]
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5

    def odds(self, has: set[bytes], before: Sequence[float]) -> float:
        w = self.weights
        return self.bias + sum(w[x] for x in has & w.keys()) + float(np.dot(self.earlier, before))


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression; the last column is the intercept, which is not penalised."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        z = np.clip(x @ beta, -30, 30)
        p = 1 / (1 + np.exp(-z))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


class Features:
    """Texts as lists of feature numbers; features in fewer than TEXTS texts are left."""

    def __init__(self, sets: list[set[bytes]]):
        place: dict[bytes, int] = {}
        flat = [np.fromiter((place.setdefault(w, len(place)) for w in has), np.int64, len(has)) for has in sets]
        sizes = [len(x) for x in flat]
        at, row = np.concatenate([np.zeros(0, np.int64), *flat]), np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(at, minlength=len(place)) >= TEXTS
        names = [w for w, ok in zip(place, often.tolist(), strict=True) if ok]
        order = np.argsort(np.array(names, object)) if names else np.zeros(0, np.int64)
        self.names = [names[i] for i in order]
        new = np.full(len(place), -1)
        new[np.flatnonzero(often)[order]] = np.arange(len(names))
        keep = often[at]
        self.at, self.row = new[at[keep]], row[keep]

    def select(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The features whose rates differ most between the classes of these rows (y: class of every text)."""
        used = np.zeros(len(y), bool)
        used[rows] = True
        mine = used[self.row]
        at, label = self.at[mine], y[self.row[mine]]
        n, one = len(rows), int(y[rows].sum())
        with_one = np.bincount(at[label == 1], minlength=len(self.names)).astype(float)
        count = np.bincount(at, minlength=len(self.names)).astype(float)
        rate = count / n
        gap = np.abs(with_one / one - (count - with_one) / (n - one)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / one + 1 / (n - one)))
        best = np.argsort(-gap, kind="stable")[:WORDS]
        return best[(gap[best] >= DEVIATIONS) & (count[best] >= TEXTS)]

    def matrix(self, chosen: np.ndarray, n: int) -> np.ndarray:
        column = np.full(len(self.names), -1)
        column[chosen] = np.arange(len(chosen))
        x = np.zeros((n, len(chosen)))
        hit = column[self.at] >= 0
        x[self.row[hit], column[self.at[hit]]] = 1
        return x


def _fit(name: str, features: Features, rows: np.ndarray, y: np.ndarray, before: np.ndarray) -> tuple[Link, np.ndarray]:
    """A model from these rows, and its log-odds for all texts."""
    one = int(y[rows].sum())
    if not 0 < one < len(rows):
        rate = (one + 0.5) / (len(rows) + 1)
        link = Link(name, {}, np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))), 2.0)
        return link, np.full(len(y), link.bias)
    chosen = features.select(rows, y)
    x = np.column_stack([features.matrix(chosen, len(y)), before, np.ones(len(y))])
    beta = _newton(x[rows], y[rows])
    weights = {features.names[j]: float(b) for j, b in zip(chosen.tolist(), beta, strict=False)}
    return Link(name, weights, beta[len(chosen) : -1], float(beta[-1])), x @ beta


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Half-way below the lowest probability that maximises F1."""
    down = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[down])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    lower = p[down][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[down][k] + lower) / 2, 0.15, 0.9))


def train(texts: list[str], labels: list[Sequence[int]], categories: Sequence[str], seed: int = 3) -> list[Link]:
    """The chain, in the order of the categories."""
    features = Features([words(t) for t in texts])
    n = len(texts)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    y_all = np.array(labels, np.int64).reshape(n, len(categories))
    before = np.zeros((n, 0))
    chain = []
    for k, name in enumerate(categories):
        y = y_all[:, k]
        link, _ = _fit(name, features, np.arange(n), y, before)
        out = np.zeros(n)
        for f in range(FOLDS):
            _, odds = _fit(name, features, np.flatnonzero(fold != f), y, before)
            out[fold == f] = odds[fold == f]
        probability = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        if link.threshold < 1:
            link.threshold = _threshold(probability, y)
        chain.append(link)
        before = np.column_stack([before, probability])
    return chain


def predict_one(chain: list[Link], text: str) -> list[float]:
    """Probability of each category."""
    has, before, out = words(text), [], []
    for link in chain:
        z = min(30.0, max(-30.0, link.odds(has, before)))
        out.append(1 / (1 + float(np.exp(-z))))
        before.append(out[-1])
    return out


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, most: int = SAMPLE) -> tuple[list[str], list[tuple[int, ...]]]:
    """At most ``most`` distinct labelled texts of SAMPLE_CHARS characters at most, those of smallest hash.

    ``categories``: SQL conditions over the columns of ``labels``.
    """
    marks = labels.select(F.col(id_col).alias("_id"), *[F.expr(c).cast("int").alias(f"_{i}") for i, c in enumerate(categories.values())]).dropna()
    # the hash order of ids is known without texts, so only the sample's ids meet the texts
    chosen = marks.orderBy(F.xxhash64("_id", F.lit(9)), *marks.columns).limit(most).collect()
    if not chosen:
        return [], []
    few = docs.sparkSession.createDataFrame(chosen, marks.schema)  # SAMPLE rows at most
    texts = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    got = {}
    for r in texts.join(F.broadcast(few), "_id").collect():
        got.setdefault(r["_text"], tuple(r[f"_{i}"] for i in range(len(categories))))
    ordered = sorted(got)
    return ordered, [got[t] for t in ordered]


def score(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ..., rejected) of every text; rejected: the last category is over its threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # WORDS a category
    names = [f"p_{x.name}" for x in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        for b in batches:
            p = [predict_one(links, t.as_py() or "") for t in b.column(1)]
            columns = [pa.array([x[k] for x in p], pa.float64()) for k in range(len(links))]
            bad = pa.array([x[-1] >= links[-1].threshold for x in p], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, bad], ["doc_id", *names, "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} double" for n in names], "rejected boolean"]))


def clean(docs: DataFrame, chain: list[Link], text_col: str = "text") -> DataFrame:
    """The documents that the chain does not reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        for b in batches:
            good = [predict_one(links, t.as_py() or "")[-1] < links[-1].threshold for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Categories of the tables at hand: conditions over labels(doc_id, quality, toxic), in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def chain_for(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    return train(*sample(docs, labels, categories, id_col, text_col), list(categories))
