"""Toxicity by a classifier chain.

Each category has a logistic model over words and word beginnings; every later
model also reads the probabilities of the categories before it.  For training,
those come from models that had not seen the row (out of fold); for scoring,
from the models fitted on all training rows.

Training takes at most `max_train` labelled rows, those with the smallest
hashes of their ids (of rows that share an id, the smallest text); everything
else reads all rows.

Nulls and special cases: null text has no features; a row whose label is null
trains no model of that category; a null id is scored like any other; repeated
rows get equal results; an empty table gives an empty result, and without
labelled rows of both kinds a category's probability is its (smoothed) rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._words import U64, Words, give_back_memory, pack, pieces, unpack

BITS = 22
PREFIXES = (4, 5, 6)


def features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and its beginnings, repeats included."""
    w = Words(rows, lower=True)
    sums = w.prefix()
    mask = U64((1 << BITS) - 1)
    parts = [(w.hashes(sums) & mask).astype(np.uint32)]
    length = w.ends - w.starts
    text = w.text_of()
    texts = [text]
    for n in PREFIXES:
        ok = length >= n
        h = w.hashes(sums, n)
        parts.append(((h[ok] + U64(n)) & mask).astype(np.uint32))
        texts.append(text[ok])
    return np.concatenate(texts), np.concatenate(parts)


@dataclass
class Linear:
    ids: np.ndarray
    weights: np.ndarray
    bias: float
    chain: np.ndarray

    def score(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + sums + (earlier @ self.chain if len(self.chain) else 0), -30, 30)))


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, earlier: np.ndarray, n_features: int = 4096, least_z: float = 4.0, penalty: float = 0.5, steps: int = 300) -> Linear:
    """Logistic regression on the features (distinct per row) that tell the classes apart best.

    Only features whose rates in the two classes differ by least_z standard errors count.
    """
    n, pos = len(y), int(y.sum())
    k = earlier.shape[1]
    rate = (pos + 0.5) / (n + 1)
    empty = Linear(np.empty(0, np.uint32), np.empty(0), float(np.log(rate / (1 - rate))), np.zeros(k))
    if pos < 5 or n - pos < 5:
        return empty
    row, feature = row[use := row >= 0], feature[use]
    both = np.bincount(feature, minlength=1 << BITS)
    seen = np.flatnonzero(both >= 5)
    b, o = both[seen], np.bincount(feature[y[row] > 0], minlength=1 << BITS)[seen]
    del both, use
    p = (b + 1) / (n + 2)
    z = (o / pos - (b - o) / (n - pos)) / np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)))
    best = np.argsort(-np.abs(z), kind="stable")[:n_features]
    ids = np.sort(seen[best[np.abs(z[best]) >= least_z]])
    at = np.full(1 << BITS, -1, dtype=np.int32)
    at[ids] = np.arange(len(ids))
    column = at[feature]
    ok = column >= 0
    r, c = row[ok], column[ok]
    del row, feature, column, ok, at
    weight, chain, bias = np.zeros(len(ids)), np.zeros(k), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(len(ids) + k + 1), np.zeros(len(ids) + k + 1)
    for t in range(1, steps + 1):
        score = bias + np.bincount(r, weights=weight[c], minlength=n) + earlier @ chain
        d = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        g = np.concatenate((np.bincount(c, weights=d[r], minlength=len(ids)) + penalty * weight, earlier.T @ d + penalty * chain, [d.sum()])) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weight, chain, bias = weight - step[: len(ids)], chain - step[len(ids) : -1], bias - step[-1]
    return Linear(ids.astype(np.uint32), weight, float(bias), chain)


class Chain:
    """Models in the order of the categories."""

    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models

    def predict(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Probabilities, a column per category; features may repeat in a row."""
        tables = self.__dict__.get("tables")
        if tables is None:
            tables = self.tables = []
            self.any = np.zeros(1 << BITS, dtype=bool)
            for x in self.models:
                self.any[x.ids] = True
            for x in self.models:
                t = np.zeros(1 << BITS, dtype=np.float32)
                t[x.ids] = x.weights
                tables.append(t)
        hit = np.flatnonzero(self.any[feature])
        pair = np.unique(row[hit].astype(np.uint64) << U64(32) | feature[hit])
        r, f = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
        out = np.zeros((n, len(self.models)))
        for k, x in enumerate(self.models):
            out[:, k] = x.score(np.bincount(r, weights=tables[k][f], minlength=n)[:n], out[:, :k])
        return out

    def __getstate__(self):
        return {"categories": self.categories, "models": self.models}


def _sample_rows(batches):
    give_back_memory()
    for batch in batches:
        blobs = []
        for _, rows in pieces(batch.column(0)):
            row, feature = features(rows)
            pair = np.unique(row.astype(np.uint64) << U64(32) | feature)
            cut = np.searchsorted(pair >> U64(32), np.arange(1, len(rows)))
            blobs += [pack(np.asarray(x & U64(0xFFFFFFFF), dtype=np.uint32)) for x in np.split(pair, cut)]
        yield pa.record_batch([*batch.columns[1:], pa.array(blobs, pa.binary())], names=[*batch.schema.names[1:], "blob"])


def train(docs: DataFrame, labels: DataFrame, categories: dict, id_col: str = "doc_id", text_col: str = "text", max_train: int = 6000, folds: int = 3) -> Chain:
    """Fit the chain; categories: name -> 0/1 expression over labels, in chain order."""
    give_back_memory()
    names = list(categories)
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *(F.expr(e).cast("int").alias(f"c{k}") for k, e in enumerate(categories.values())))
    chosen = known.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_train rows are sent
    joined = joined.groupBy("_id", *(f"c{k}" for k in range(len(names)))).agg(F.min("_text").alias("_text")).select("_text", *(f"c{k}" for k in range(len(names))))
    schema = ", ".join(f"c{k} int" for k in range(len(names))) + ", blob binary"
    got = joined.mapInArrow(_sample_rows, schema).toArrow()  # a row for each chosen id
    blobs = got.column("blob").to_pylist()
    # the order of rows from executors varies; that of their contents doesn't
    order = sorted(range(len(blobs)), key=lambda i: blobs[i])
    parts = [unpack(blobs[i])[0] for i in order]
    labels_of = [np.array([-1 if x is None else x for x in got.column(k).to_pylist()], dtype=np.int64)[order] if parts else np.empty(0, np.int64) for k in range(len(names))]
    del got, blobs
    n = len(parts)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in parts])
    feature = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    del parts
    fold = np.arange(n) % folds
    earlier, models = np.zeros((n, 0)), []

    def part(mask):
        to = np.full(n, -1, dtype=np.int32)
        to[mask] = np.arange(mask.sum())
        return to[row]

    for y in labels_of:
        have = y >= 0
        models.append(fit(part(have), feature, y[have].astype(float), earlier[have]))
        if len(models) < len(names):
            out = np.zeros(n)
            for f in range(folds):
                away = have & (fold != f)
                m = fit(part(away), feature, y[away].astype(float), earlier[away])
                table = np.zeros(1 << BITS)
                table[m.ids] = m.weights
                inside = fold == f
                r = part(inside)
                sums = np.bincount(r[r >= 0], weights=table[feature[r >= 0]], minlength=int(inside.sum()))
                out[inside] = m.score(sums, earlier[inside])
            earlier = np.column_stack([earlier, out])
    return Chain(names, models)


def _scores(chain: Chain):
    def run(batches):
        give_back_memory()
        for batch in batches:
            out = [chain.predict(len(rows), *features(rows)) for _, rows in pieces(batch.column(batch.num_columns - 1))]
            out = np.concatenate(out) if out else np.zeros((0, len(chain.categories)))
            yield pa.record_batch([*batch.columns[:-1], *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=[*batch.schema.names[:-1], *(f"p{k}" for k in range(out.shape[1]))])

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and p_<category> for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"p{k} double" for k in range(len(chain.categories)))
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_scores(chain), schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"p{k}").alias(f"p_{c}") for k, c in enumerate(chain.categories)))


#: The categories of the labels table, in chain order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories: dict | None = None, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The id, p_low_quality, p_toxic and is_toxic (p_toxic at least the threshold)."""
    chain = train(docs, labels, categories or CATEGORIES, id_col, text_col, **params)
    return score(docs, chain, id_col, text_col).withColumn("is_toxic", F.col("p_toxic") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs whose text isn't toxic, all columns kept, judged row by row."""
    chain = train(docs, labels, CATEGORIES, id_col, text_col, **params)

    def run(batches):
        give_back_memory()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            out = [chain.predict(len(rows), *features(rows))[:, -1] for _, rows in pieces(text)]
            yield batch.filter(pa.array((np.concatenate(out) if out else np.zeros(0)) < threshold))

    return docs.mapInArrow(run, docs.schema)
