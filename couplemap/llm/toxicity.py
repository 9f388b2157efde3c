"""Toxicity by a classifier chain.

Categories are predicted one after another.  Each has a linear (logistic)
model over the words and word beginnings of a text, a few features of its
style, and the probabilities of the categories before it.  While training,
those earlier probabilities come from out-of-fold models, so a later model
sees them as wrong as they will be on new texts.

Training takes at most ``train_rows`` labelled ids (those with the smallest
hash), with one text and one row of labels each.  Per category the ``n_features`` words and beginnings with
the highest chi-square against the label are kept; their counts are summed
by Spark.  The bounded training table is fitted in one task, and the model (a
few thousand weights) is broadcast.  Every document is scored over its whole
text.

Definitions.  Null and empty texts have no words and are scored from the
bias.  Rows with a null label or id do not train.  Of repeated label rows of an
id the smallest trains, of repeated documents the text with the smallest hash.
Without any labelled rows of both kinds (so with empty tables) a category's
probability is 0.  Rows come back one to one, repeated ids included; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_and_text, map_slices

TRAIN_ROWS = 20_000
N_FEATURES = 2_000
BEGINNINGS = (3, 4, 5, 6)
FOLDS = 4
_WORDS = regex.compile(r"\p{L}+").findall


def word_features(text: str) -> dict[int, set[str]]:
    """Distinct words (key 0) and their beginnings by length."""
    words = set(_WORDS(text.lower()))
    return {0: words, **{k: {w[:k] for w in words if len(w) > k} for k in BEGINNINGS}}


def style_features(text: str) -> list[float]:
    """Shares between 0 and 1: symbols, capitals, digits, doubled marks,
    cell bars, repeated words, shortness."""
    n = max(1, len(text))
    words = text.split()
    symbols = sum(text.count(c) for c in "#*$%&<>")
    capitals = sum(map(str.isupper, text)) / n
    return [
        min(1.0, 5 * symbols / n),
        capitals,
        sum(map(str.isdigit, text)) / n,
        min(1.0, 10 * (text.count("!!") + text.count("??")) / n),
        min(1.0, 10 * text.count("|") / n),
        1 - len(set(words)) / max(1, len(words)),
        1 / (1 + len(words) / 20),
    ]


N_STYLE = 7


# ---- training ---------------------------------------------------------------------------

def fit_logistic(rows: list[list[int]], dense: np.ndarray, label: np.ndarray, size: int, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 features, of dense ones, and the bias, by Adam
    on the whole (bounded) table."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
    by_column = np.argsort(column, kind="stable")
    row_of = np.repeat(np.arange(len(rows)), lengths)[by_column]
    used, first_of = np.unique(column[by_column], return_index=True)  # entries in order of the feature
    filled = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]  # entries in order of the row
    k = dense.shape[1]
    w = np.zeros(size + k + 1)
    rate = label.mean()
    w[-1] = math.log(rate / (1 - rate))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = dense @ w[size:size + k] + w[-1]
        if len(filled):
            z[filled] += np.add.reduceat(w[column], starts)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        grad = np.concatenate([np.zeros(size), dense.T @ error, [error.sum()]])
        if len(filled):
            grad[used] = np.add.reduceat(error[row_of], first_of)
        grad[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:size], w[size:size + k], float(w[-1])


def predict(model, rows: list[list[int]], dense: np.ndarray) -> np.ndarray:
    w, v, bias = model
    z = np.fromiter((sum(w[f] for f in r) for r in rows), float, len(rows)) + dense @ v + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_cut(p: np.ndarray, label: np.ndarray) -> float:
    """The probability that separates best (highest F1), halfway between
    the scores beside it."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + label.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(rows: list[list[int]], style: np.ndarray, labels: np.ndarray, fold: np.ndarray, size: int) -> list[dict | None]:
    """One model per column of ``labels``; earlier probabilities enter the
    later models out of fold."""
    models, dense = [], style
    for c in range(labels.shape[1]):
        label = labels[:, c]
        if not 0 < label.sum() < len(label):
            models.append(None)
            dense = np.column_stack([dense, np.zeros(len(label))])
            continue
        held = np.zeros(len(label))
        for k in range(FOLDS):
            out = fold == k
            train = label[~out]
            if out.any() and 0 < train.sum() < len(train):
                model = fit_logistic([rows[i] for i in np.flatnonzero(~out)], dense[~out], train, size)
                held[out] = predict(model, [rows[i] for i in np.flatnonzero(out)], dense[out])
            elif out.any():
                held[out] = label.mean()
        w, v, bias = fit_logistic(rows, dense, label, size)
        models.append({"w": w.tolist(), "v": v.tolist(), "bias": bias, "cut": min(0.9, max(0.1, best_cut(held, label)))})
        dense = np.column_stack([dense, held])
    return models


def _lists(features: dict[int, set[str]], index: dict[int, dict[str, int]]) -> list[int]:
    """Numbers of the chosen features that a text has."""
    out = []
    for k, chosen in index.items():
        out.extend(chosen[f] for f in features[k] & chosen.keys())
    return out


def _index(chosen: list[tuple[int, str]]) -> dict[int, dict[str, int]]:
    index: dict[int, dict[str, int]] = {k: {} for k in (0, *BEGINNINGS)}
    for number, (k, f) in enumerate(chosen):
        index[k][f] = number
    return index


def train_chain(documents: DataFrame, labels: DataFrame, categories: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text",
                train_rows: int = TRAIN_ROWS, n_features: int = N_FEATURES) -> dict:
    """``categories``: label column and the value that counts as positive,
    in the order of the chain.  The result is a plain dict."""
    complete = F.lit(True)
    for name, _ in categories:
        complete = complete & F.col(name).isNotNull()
    marks = [(F.col(name) == value).cast("int") for name, value in categories]
    y = F.array(*marks)
    # one row of labels per id; at most train_rows ids are small enough to send to every executor
    sample = labels.where(complete & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), y.alias("y")).groupBy("id").agg(F.min("y").alias("y"))
    sample = cut_lineage(sample.orderBy(F.xxhash64("id"), "id").limit(train_rows))
    # repeated documents of an id are reduced to one text before the shuffle
    texts = id_and_text(documents, id_col, text_col).join(F.broadcast(sample), "id")
    one = texts.groupBy("id", "y").agg(F.min_by("body", F.struct(F.xxhash64("body"), "body")).alias("body"))
    rows = cut_lineage(one.select("id", "body", "y"))

    def features(batch: pa.RecordBatch):
        tally: dict = {}
        for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for k, found in word_features(text).items():
                for f in found:
                    got = tally.setdefault((k, f), [0] * (1 + len(y)))
                    got[0] += 1
                    for c, mark in enumerate(y):
                        got[1 + c] += mark
        if tally:
            names, counts = list(tally), list(tally.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in names], pa.int32()), pa.array([f for _, f in names], pa.string()), pa.array([c[0] for c in counts], pa.int64()),
                 *[pa.array([c[1 + j] for c in counts], pa.int64()) for j in range(len(categories))]],
                names=["kind", "f", "n", *[f"p{j}" for j in range(len(categories))]])

    schema = "kind int, f string, n long, " + ", ".join(f"p{j} long" for j in range(len(categories)))
    sums = cut_lineage(map_slices(rows, features, schema).groupBy("kind", "f").agg(F.sum("n").alias("n"), *[F.sum(f"p{j}").alias(f"p{j}") for j in range(len(categories))]).where("n > 1"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col("y")[j]), F.lit(0)).alias(f"y{j}") for j in range(len(categories))]).first()
    least = 4 + 2 * math.log(max(1, sums.count()))  # about one word in all of them gets so far by chance
    chosen: dict[tuple[int, str], None] = {}
    for j in range(len(categories)):
        total, positive = float(size["n"]), float(size[f"y{j}"])
        if not 0 < positive < total:
            continue
        a, n = F.col(f"p{j}").cast("double"), F.col("n").cast("double")
        expected = n * positive / total
        chi = total * (a - expected) ** 2 / (expected * (total - positive) * (1 - n / total) + 1e-9)
        best = sums.select("kind", "f", chi.alias("chi")).where(F.col("chi") > least).orderBy(F.desc("chi"), "kind", "f").limit(n_features)
        chosen.update({(r["kind"], r["f"]): None for r in best.collect()})
    names = list(chosen)
    index = _index(names)

    def reduced(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_lists(word_features(t), index) for t in texts], kind), pa.array([style_features(t) for t in texts], pa.list_(pa.float64())), batch.column(2)],
            names=["id", "x", "style", "y"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")  # the same sums whatever order rows came in
        fold = (frame["id"].to_numpy() % 9973 * 7919 % 9973 % FOLDS).astype(int)
        models = fit_chain([sorted(x) for x in frame["x"]], np.array(frame["style"].tolist()).reshape(-1, N_STYLE), np.array(frame["y"].tolist(), float), fold, len(names))
        return pd.DataFrame({"model": [json.dumps(models)]})

    small = map_slices(rows, reduced, "id long, x array<int>, style array<double>, y array<int>")
    fitted = small.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "model string").collect()  # one bounded group
    return {"features": names, "chain": json.loads(fitted[0]["model"]) if fitted else [None] * len(categories), "categories": [name for name, _ in categories]}


def score_chain(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p array<double>, positive array<boolean>), by category."""
    shipped = documents.sparkSession.sparkContext.broadcast((_index(model["features"]), model["chain"]))

    def score(batch: pa.RecordBatch):
        index, models = shipped.value
        texts = batch.column(1).to_pylist()
        rows = [_lists(word_features(t), index) for t in texts]
        dense = np.array([style_features(t) for t in texts]).reshape(-1, N_STYLE)
        p, yes = [], []
        for part in models:
            one = np.zeros(len(texts)) if part is None else predict((part["w"], np.array(part["v"]), part["bias"]), rows, dense)
            p.append(one)
            yes.append(one >= (part["cut"] if part else 2))
            dense = np.column_stack([dense, one])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.column_stack(p).tolist(), pa.list_(pa.float64())), pa.array(np.column_stack(yes).tolist(), pa.list_(pa.bool_()))],
            names=["id", "p", "positive"])

    return map_slices(id_and_text(documents, id_col, text_col), score, "id long, p array<double>, positive array<boolean>")
