"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (A-Z lower-cased) and their beginnings of a few lengths, hashed into 2**bits places, and
the rough length of the text as one term more; a term's value grows with the logarithm of its count. The model is a
bias, a weight for every place, and a short vector for every place whose inner products weigh pairs of terms that
occur together. It is trained by Adagrad on at most `sample` labelled texts, chosen by a hash of doc_id; scoring takes
every whole text, in Arrow batches, with the model (a fixed size) as a broadcast variable.

Null and empty texts have no words but the length term, and get a score too. Null labels are left out; a document
labelled twice counts once, as toxic if any label says so; of rows that repeat a doc_id one is learned from. Without both labels among the training rows every score is
their smoothed rate. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import arrow_rows, column, slices, strings
from .textvec import WORD, _LOWER, mix, runs, span_hashes

#: Bytes of the word beginnings that are terms besides the whole word.
BEGINNINGS = (4, 5, 6, 7)
_U = np.uint64


def terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and offsets by text of the terms of UTF-8 texts."""
    n = len(offsets) - 1
    lower = _LOWER[data]
    starts, stops, text = runs(lower, offsets, WORD)
    keys = [span_hashes(lower, starts, stops)]
    owners = [text]
    for size in BEGINNINGS:
        long = stops - starts > size
        keys.append(mix(span_hashes(lower, starts[long], starts[long] + size) + _U(size)))
        owners.append(text[long])
    words = np.bincount(text, minlength=n)
    keys.append(mix(np.log2(words + 1.0).astype(_U) + _U(1 << 40)))
    owners.append(np.arange(n))
    joint = (np.concatenate(owners).astype(_U) << _U(bits)) | (np.concatenate(keys) >> _U(64 - bits))
    joint.sort()
    new = np.flatnonzero(np.r_[True, joint[1:] != joint[:-1]])
    count = np.diff(np.r_[new, len(joint)])
    place = (joint[new] & _U((1 << bits) - 1)).astype(np.int32)
    rows = np.bincount((joint[new] >> _U(bits)).astype(np.int64), minlength=n)
    return place, np.log1p(count).astype(np.float32), np.r_[0, np.cumsum(rows)]


@dataclass
class Model:
    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, place: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bias, weights and pair terms of each row; every row has a term."""
        v = self.factors[place] * value[:, None]
        linear = np.add.reduceat(self.weights[place] * value, offsets[:-1])
        total = np.add.reduceat(v, offsets[:-1], axis=0)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), offsets[:-1]))

    def scores(self, place, value, offsets) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(place, value, offsets).astype(np.float64), -40, 40)))


def fit(place: np.ndarray, value: np.ndarray, offsets: np.ndarray, label: np.ndarray, bits: int, rank: int = 4, epochs: int = 16, rate: float = 0.1, decay: float = 2e-3, least: int | None = None, screen: float = 0.0, seed: int = 11) -> Model:
    """A model of rows of terms. Terms in fewer than `least` rows (a 250th of all, 3 at least) are not learned from, nor
    those whose rows are labelled 1 about as often as all rows are, by less than `screen` standard errors."""
    least = least or max(3, len(label) // 250)
    size = 1 << bits
    rate_of = (label.sum() + 1.0) / (len(label) + 2.0)
    model = Model(bits, float(np.log(rate_of / (1 - rate_of))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    if not 0 < label.sum() < len(label):
        return model
    of_term = np.bincount(place, minlength=size)
    above = np.bincount(place, np.repeat(label - label.mean(), np.diff(offsets)), minlength=size)
    used = (of_term >= least) & (np.abs(above) >= screen * np.sqrt(of_term * label.mean() * (1 - label.mean())))
    dense = np.cumsum(used) - 1
    rng, m = np.random.default_rng(seed), int(used.sum())
    w, f = np.zeros(m), rng.normal(0, 0.01, (m, rank))
    gw, gf, gb, bias = np.full(m, 1e-2), np.full((m, rank), 1e-2), 1e-2, model.bias
    keep = used[place]
    row = np.repeat(np.arange(len(label)), np.diff(offsets))[keep]
    place, value = dense[place[keep]], value[keep].astype(np.float64)
    begin = np.searchsorted(row, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            lens = begin[rows + 1] - begin[rows]
            ends = np.cumsum(lens)
            pick = np.repeat(begin[rows] - (ends - lens), lens) + np.arange(int(lens.sum()))
            j, x, r = place[pick], value[pick], np.repeat(np.arange(len(rows)), lens)
            v = f[j] * x[:, None]
            total = np.stack([np.bincount(r, v[:, c], len(rows)) for c in range(rank)], axis=1)
            pairs = 0.5 * ((total * total).sum(1) - np.bincount(r, (v * v).sum(1), len(rows)))
            margin = np.clip(bias + np.bincount(r, w[j] * x, len(rows)) + pairs, -40, 40)
            g = 1 / (1 + np.exp(-margin)) - label[rows]
            own, back = np.unique(j, return_inverse=True)
            g_row = g[r]
            d = np.bincount(back, g_row * x, len(own)) / len(rows) + decay * w[own]
            gw[own] += d * d
            w[own] -= rate * d / np.sqrt(gw[own])
            inner = (g_row * x)[:, None] * (total[r] - v)
            d = np.stack([np.bincount(back, inner[:, c], len(own)) for c in range(rank)], axis=1) / len(rows) + decay * f[own]
            gf[own] += d * d
            f[own] -= 0.3 * rate * d / np.sqrt(gf[own])
            gb += g.mean() ** 2
            bias -= rate * g.mean() / np.sqrt(gb)
    model.bias = float(bias)
    model.weights[used], model.factors[used] = w, f
    return model


def fit_calibrated(place: np.ndarray, value: np.ndarray, offsets: np.ndarray, label: np.ndarray, bits: int, threshold: float = 0.7, share: float = 0.4, **options) -> Model:
    """A model of the first rows whose bias is moved so that `threshold` is where the other rows are told apart best; a clean row lost counts twice."""
    cut = len(label) - int(share * len(label))
    model = fit(place[: offsets[cut]], value[: offsets[cut]], offsets[: cut + 1], label[:cut], bits, **options)
    rest = label[cut:]
    if rest.sum() < 10 or not model.weights.any():
        return model
    margin = model.margins(place[offsets[cut] :], value[offsets[cut] :], offsets[cut:] - offsets[cut]).astype(np.float64)
    order = np.argsort(margin)
    missed = np.r_[0, np.cumsum(rest[order])]
    wrong = (1 - rest).sum() - np.r_[0, np.cumsum(1 - rest[order])]
    cost = missed + 2 * wrong
    best = np.flatnonzero(cost == cost.min())
    edges = np.r_[margin[order[0]] - 1, margin[order], margin[order[-1]] + 1]
    at = float(np.mean([(edges[best[0]] + edges[best[0] + 1]) / 2, (edges[best[-1]] + edges[best[-1] + 1]) / 2]))
    model.bias += float(np.log(threshold / (1 - threshold))) - at
    return model


def _hashed(bits: int):
    def of(batches):
        for batch in batches:
            data, offsets = strings(column(batch, "text"))
            for i, j in slices(offsets):
                place, value, rows = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                yield pa.RecordBatch.from_pydict({
                    "label": column(batch, "label")[i:j],
                    "places": pa.array([place[a:b].tobytes() for a, b in zip(rows, rows[1:])], pa.binary()),
                    "values": pa.array([value[a:b].tobytes() for a, b in zip(rows, rows[1:])], pa.binary()),
                })

    return of


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, bits: int = 18, screen: float = 2.0, **options) -> Model:
    """labels: doc_id, label (0 or 1). Terms that tell nothing by `screen` standard errors are left out, else the many
    such terms of a long text outweigh the few that do. At most `sample` labelled texts' terms go to the driver, a few kilobytes each."""
    arrow_rows(docs.sparkSession, 1000)
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.select("label", "text").mapInArrow(_hashed(bits), "label double, places binary, values binary").toArrow()
    found = sorted(zip(rows["places"].to_pylist(), rows["values"].to_pylist(), rows["label"].to_pylist()), key=lambda r: (hashlib.md5(r[0]).digest(), *r))
    place = np.frombuffer(b"".join(p for p, _, _ in found), np.int32)
    value = np.frombuffer(b"".join(v for _, v, _ in found), np.float32)
    offsets = np.r_[0, np.cumsum([len(p) // 4 for p, _, _ in found])].astype(np.int64)
    label = np.array([y for _, _, y in found], np.float64)
    return fit_calibrated(place, value, offsets, label, bits, screen=screen, **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of docs (text among them), with score and predicted under the names given; columns of docs with those names go."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    shared = spark.sparkContext.broadcast(model)

    def of(batches):
        model = shared.value
        for batch in batches:
            data, offsets = strings(column(batch, "text"))
            out = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                out[i:j] = model.scores(*terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.bits))
            arrays = [column(batch, c) for c in kept] + [pa.array(out), pa.array((out >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    docs = docs.drop(*names)
    kept = docs.columns
    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return docs.mapInArrow(of, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; rows with crc32(doc_id) mod 3 = 1 are not learned from."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, labels.select("doc_id", F.col("toxic").alias("label")).where(remainder != 1))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")
