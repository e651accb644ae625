"""Toxicity by a chain of linear classifiers (operator 8).

The categories stand in a chain. Each has a logistic model over hashed words and word beginnings, and the models after
the first also get the log-odds that the earlier models give. In training these are out-of-fold: each row's value
comes from a model that didn't see the row, so later models learn how far to trust the earlier ones on new rows.
Scoring predicts category after category in one pass over whole texts, without a shuffle.

Training takes at most train_rows labelled documents with at most train_bytes of text, by a digest of id and text, so the
driver's part is bounded. Folds go by a hash of the id. A document is toxic if its probability reaches the cut that had
the best F1 on the out-of-fold predictions.

Cases: null and empty texts have only the models' intercepts; very long texts are scored whole, and learned from if
they fit in train_bytes; labels that are null count as 0, a document with several labels rows is learned from each, rows
alike in id, text and labels once; rows that repeat an id are scored one by one; equal probabilities at the cut
are all toxic; without labelled rows all probabilities are 0 and nothing is toxic; no documents give no rows. Only the
id and text columns and the label columns are read, so names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, fold_of, labelled_sample, slices
from weftline.llm.features import ids, words_of
from weftline.storage import discard

FOLDS = 5
#: Least chi-square, with one degree of freedom, of a word feature with a category. Of the training sample's 10**5
#: features hardly any passes by chance.
CHI2 = 20.0


class Linear:
    """Logistic regression over the word features that are associated with the category, and a few dense ones."""

    def __init__(self) -> None:
        self.ids = np.empty(0, np.uint64)
        self.w = np.empty(0)
        self.d = np.zeros(1)

    def fit(self, rows: np.ndarray, codes: np.ndarray, known: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 1e-3) -> Linear:
        self.d = np.zeros(dense.shape[1] + 1)
        if not use.any():
            return self
        chosen = use[rows]
        rows, codes = rows[chosen], codes[chosen]
        n, pos = use.sum(), y[use].sum()
        a = np.bincount(codes, y[rows], minlength=len(known))
        df = np.bincount(codes, minlength=len(known))
        c, top = pos - a, df - a
        rest = n - pos - top
        chi2 = n * (a * rest - c * top) ** 2 / np.maximum(pos * (n - pos) * df * np.maximum(n - df, 0.5), 1e-9)
        kept = chi2 >= CHI2
        self.ids, place = known[kept], np.cumsum(kept) - 1
        entry = kept[codes]
        rows, codes = rows[entry], place[codes[entry]]
        x = np.hstack([dense, np.ones((len(y), 1))])
        self.w = np.zeros(len(self.ids))
        positive = min(max(pos / n, 1e-3), 1 - 1e-3)
        self.d[-1] = np.log(positive / (1 - positive))
        gw, gd = np.full(len(self.w), 1e-8), np.full(len(self.d), 1e-8)
        for _ in range(rounds):
            p = sigmoid(np.bincount(rows, self.w[codes], len(y)) + x @ self.d)
            error = np.where(use, p - y, 0.0) / n
            g = np.bincount(codes, error[rows], len(self.w)) + l2 / n * self.w
            gw += g * g
            self.w -= rate / np.sqrt(gw) * g
            e = x.T @ error
            gd += e * e
            self.d -= rate / np.sqrt(gd) * e
        return self

    def logit(self, rows: np.ndarray, feats: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = dense @ self.d[:-1] + self.d[-1]
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, feats), len(self.ids) - 1)
            known = self.ids[at] == feats
            out = out + np.bincount(rows[known], self.w[at[known]], len(dense))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squash(logit: np.ndarray) -> np.ndarray:
    """Log-odds as later models get them."""
    return np.clip(logit, -8, 8) / 4


def design(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature numbers, one entry per distinct feature of a row; only those in `known`, if it is given."""
    codes, starts, words = words_of(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rows = np.repeat(np.arange(len(texts)), np.diff(starts))
    table = ids(words)
    if known is not None:
        table = np.where(np.isin(table, known), table, np.uint64(0))
        some = table.any(1)[codes]
        rows, codes = rows[some], codes[some]
    distinct, number = np.unique(table, return_inverse=True)
    pairs = np.unique(np.repeat(rows, table.shape[1]) * len(distinct) + number.reshape(table.shape)[codes].reshape(-1))
    rows, feats = pairs // len(distinct), distinct[pairs % len(distinct)]
    return (rows, feats) if known is None else (rows[feats > 0], feats[feats > 0])


def fit_chain(keys: list, texts: list[str | None], labels: np.ndarray, folds: int = FOLDS) -> tuple[list[Linear], float]:
    """The models of the categories (columns of labels, in the chain's order) and the cut of the last category. Rows with
    one key share a fold."""
    rows, feats = design(texts)
    known, codes = np.unique(feats, return_inverse=True)
    fold = np.array([fold_of(k, folds) for k in keys], int)
    dense, models, oof = np.empty((len(texts), 0)), [], np.zeros(len(texts))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        oof = np.zeros(len(y))
        for k in range(folds):
            out = fold == k
            oof[out] = Linear().fit(rows, codes, known, dense, y, ~out).logit(rows, feats, dense)[out]
        models.append(Linear().fit(rows, codes, known, dense, y, np.ones(len(y), bool)))
        dense = np.hstack([dense, squash(oof)[:, None]])
    return models, best_cut(sigmoid(oof), labels[:, -1])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on F1 is best; halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    best = int(f1.argmax()) if len(y) else 0
    return float((p[order][best] + (p[order][best + 1] if best + 1 < len(y) else 0)) / 2) if len(y) and y.any() else 1.1


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]], *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 3000, train_bytes: int = 64 << 20, seed: str = "toxic") -> tuple[list[Linear], float]:
    """Fit the chain on the bounded sample, on the driver."""
    names = [n for n, _ in categories]
    few = labels.select(F.col(id_col).alias("id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories]).where("id is not null")
    sample = labelled_sample(docs, few, id_col=id_col, text_col=text_col, most_rows=train_rows, most_bytes=train_bytes, seed=seed)
    got = sorted(sample.select("id", "text", *names).collect(), key=lambda r: (str(r[0]), r[1] or "", r[2:]))
    discard(sample)
    return fit_chain([r[0] for r in got], [r[1] for r in got], np.array([r[2:] for r in got], int).reshape(len(got), len(names)))


def score(docs: DataFrame, models: list[Linear], names: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the categories' probabilities p_<name>."""
    told = docs.sparkSession.sparkContext.broadcast(models)  # the features that passed, a few thousand a category
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([m.ids for m in told.value]))
        for batch in batches:
            for part in slices(batch, "text"):
                rows, feats = design(part.column("text").to_pylist(), known)
                dense, out = np.empty((part.num_rows, 0)), []
                for model in told.value:
                    logit = model.logit(rows, feats, dense)
                    out.append(sigmoid(logit))
                    dense = np.hstack([dense, squash(logit)[:, None]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out)], ["doc_id", *("p_" + n for n in names)])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}" + "".join(f", p_{n} double" for n in names))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", **options: object) -> DataFrame:
    """Per row: doc_id, p_low_quality, p_toxic_clean (toxic and well written), p_toxic, toxic. The chain goes from
    writing quality over toxic good writing to toxicity at large, which is the verdict."""
    low, bad = F.col(quality_col) == 0, F.col(toxic_col) == 1
    chain = [("low_quality", low), ("toxic_clean", bad & ~low), ("toxic", bad)]
    models, cut = train(docs, labels, chain, id_col=id_col, text_col=text_col, **options)
    names = [n for n, _ in chain]
    told = score(docs, models, names, id_col=id_col, text_col=text_col)
    return told.withColumn("toxic", F.col("p_toxic") >= F.lit(cut))
