"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. Each has a logistic model over the words of a text; from the second
on, a model also sees the log-odds that the earlier models give. While it is trained these are out-of-fold
predictions, so it learns from earlier outputs as wrong as they will be on new texts.

Words count once for each text, however long it is. A model keeps only words whose frequency differs between
the classes by ``least_z`` standard errors, so a long text does not gather weight from chance words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import coded, owners, parts, word_hashes

_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different word hashes of each text (A-Z lowered, punctuation off the ends), and their texts."""
    found, who = [], []
    for low, part in parts(texts):
        at, words, ends = coded(part)
        if len(at):
            hashes = word_hashes([w.lower().strip(_EDGES) for w in words])
            known, place = np.unique(hashes, return_inverse=True)
            cells = np.unique(owners(ends) * len(known) + place[at])
            found.append(known[cells % len(known)])
            who.append(cells // len(known) + low)
    return (np.concatenate(found), np.concatenate(who)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    chain: np.ndarray  # weight of each earlier category's log-odds
    bias: float
    limit: float  # probability from which a text counts as of the category

    def logit(self, hashes: np.ndarray, owner: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        hit = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return self.bias + np.bincount(owner[hit], self.weights[at[hit]], minlength=n) + earlier[:, : len(self.chain)] @ self.chain


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def select(hashes: np.ndarray, owner: np.ndarray, y: np.ndarray, least_docs: int, least_z: float) -> np.ndarray:
    """Hashes whose document frequency differs clearly between the classes."""
    words, place = np.unique(hashes, return_inverse=True)
    pos = np.bincount(place, y[owner], minlength=len(words))
    both = np.bincount(place, minlength=len(words))
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    rate = (both + 1) / (n0 + n1 + 2)
    z = np.abs(pos / n1 - (both - pos) / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    return words[(both >= least_docs) & (z >= least_z)]


def fit_one(hashes: np.ndarray, owner: np.ndarray, y: np.ndarray, earlier: np.ndarray, *, least_docs: int, least_z: float, penalty: float = 1.0, rounds: int = 400) -> Model:
    """Penalised logistic regression by full-batch Adam; the same on every machine."""
    n = len(y)
    words = select(hashes, owner, y, least_docs, least_z)
    at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
    hit = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
    col, row = at[hit], owner[hit]
    k, m = len(words), earlier.shape[1]
    w, rate = np.zeros(k + m + 1), np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], minlength=n) + earlier @ w[k : k + m]
        r = sigmoid(z) - y
        g = np.r_[np.bincount(col, r[row], minlength=k)[:k] + penalty * w[:k], earlier.T @ r + penalty * w[k : k + m], r.sum()]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(words, w[:k], w[k : k + m], float(w[-1]), 0.5)


def best_limit(p: np.ndarray, y: np.ndarray, floor: float = 0.25) -> float:
    """The limit with the best F1 on out-of-fold predictions, in the middle of its gap; at least ``floor``,
    so that labels without any sign in the words do not draw clean texts in."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    last = np.r_[p[order][1:] < p[order][:-1], True]
    k = int(np.argmax(np.where(last, f1, -1)))
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return max(floor, float((p[order][k] + after) / 2))


def fit_chain(hashes: np.ndarray, owner: np.ndarray, labels: np.ndarray, known: np.ndarray, folds: np.ndarray, *, least_docs: int, least_z: float, n_folds: int = 4) -> list[Model]:
    """Models of all categories. ``labels`` and ``known``: texts x categories; ``folds``: each text's fold."""
    n, kinds = labels.shape
    earlier, models = np.zeros((n, 0)), []
    for c in range(kinds):
        def sub(rows: np.ndarray) -> Model:
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            ok = place[owner] >= 0
            return fit_one(hashes[ok], place[owner[ok]], labels[rows, c], earlier[rows], least_docs=least_docs, least_z=least_z)

        own = np.flatnonzero(known[:, c])
        out = np.zeros(n)
        for f in range(n_folds):
            train, test = own[folds[own] != f], np.flatnonzero(folds == f)
            if len(train) and len(test):
                z = sub(train).logit(hashes, owner, n, earlier)
                out[test] = z[test]
        model = sub(own) if len(own) else Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(c), -30.0, 0.5)
        if len(own) and 0 < labels[own, c].sum() < len(own):
            model.limit = best_limit(sigmoid(out[own]), labels[own, c])
        models.append(model)
        earlier = np.c_[earlier, np.clip(out, -10, 10)]
    return models


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 10_000, least_docs: int = 5, least_z: float = 5.0) -> list[Model]:
    """Fit the chain to at most ``train_rows`` labelled documents: those with the smallest hash of their id.

    Texts with equal words and equal labels teach once, under their smallest id. Rows without a label in a category
    teach nothing in it. Texts become word hashes on the executors, where equal ones are merged before they meet; the
    driver fits, holding the hashes of at most ``train_rows`` texts even where many rows share an id.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]).where(" or ".join(f"y{k} is not null" for k in range(len(categories))))
    chosen = marks.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = features(batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist())
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            own = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(own, pa.binary())], [*batch.schema.names[:-1], "words"])

    kinds = "doc_id long, " + ", ".join(f"y{k} double" for k in range(len(categories)))
    marked = [f"y{k}" for k in range(len(categories))]
    hashed = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", *marked, "text").mapInArrow(hash_words, f"{kinds}, words binary")
    once = hashed.groupBy(*marked, "words").agg(F.min("doc_id").alias("doc_id")).select("doc_id", *marked, "words")
    rows = sorted(once.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("words")).limit(train_rows).collect(), key=lambda r: (r["doc_id"], bytes(r["words"])))
    if not rows:
        return [Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(k), -30.0, 0.5) for k in range(len(categories))]
    sets = [np.frombuffer(r["words"], "<u8") for r in rows]
    y = np.array([[np.nan if r[1 + k] is None else r[1 + k] for k in range(len(categories))] for r in rows])
    known = ~np.isnan(y)
    return fit_chain(np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets))), np.where(known, y > 0, 0).astype(float), known, np.arange(len(sets)) % 4, least_docs=least_docs, least_z=least_z)


def predict(docs: DataFrame, models: list[Model], categories: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and for each category ``<name>`` (boolean) and ``<name>_score`` (0 to 1).

    A null or empty text gets the scores of a text without known words. Repeated rows give repeated rows; an
    empty table gives an empty one; without training rows nothing is of a category. One narrow pass.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            hashes, owner = features(texts)
            earlier, columns = np.zeros((len(texts), 0)), [batch.column(0)]
            for m in models:
                z = m.logit(hashes, owner, len(texts), earlier)
                p = sigmoid(z)
                columns += [pa.array(p >= m.limit), pa.array(p)]
                earlier = np.c_[earlier, np.clip(z, -10, 10)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[x for c in categories for x in (c, f"{c}_score")]])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, " + ", ".join(f"`{c}` boolean, `{c}_score` double" for c in categories))
