"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line with more than white space) is hashed to a wide vector: 16 lanes of SHAKE-128 output modulo 2**64,
and 256 lanes modulo 2**16 that hold a signed count sketch of its neighbouring word pairs, its ends included. A
document's fingerprint is the sum of its paragraphs' vectors, so it does not depend on their order, and paragraphs are
added or taken away without the rest of the text (`combine`). The wide lanes tell equality; the cosine of the sketch
lanes estimates how much of two texts' wording is shared.

Null and empty texts have the zero vector; two zero sketches are alike (1) if the fingerprints are equal, else 0. Rows
with a null doc_id come last; rows with equal doc_id follow each other by text. Columns besides doc_id and text are
ignored. The next document is found by streaming over sorted buckets of doc_id, so a task holds one Arrow batch and one
row more; the first row of a bucket is also sent to the bucket before it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, arrow_rows, column, key_splits, partitions, strings
from .textvec import WORD, mix, runs, span_hashes, _LOWER

EXACT, SKETCH = 16, 256
_U = np.uint64


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (n, 16) uint64 and sketch lanes (n, 256) uint16 of texts."""
    n = len(texts)
    exact, sketch = np.zeros((n, EXACT), _U), np.zeros((n, SKETCH), np.uint16)
    digests, owner = [], []
    for i, t in enumerate(texts):
        for p in (t or "").split("\n"):
            if p and not p.isspace():
                digests.append(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT))
                owner.append(i)
    if digests:
        lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, EXACT)
        owner = np.array(owner)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        exact[owner[first]] = np.add.reduceat(lanes, first, axis=0)
    begin = 0
    while begin < n:  # a few megabytes at a time
        end, size = begin, 0
        while end < n and (end == begin or size < 2 << 20):
            size += len(texts[end] or "")
            end += 1
        sketch[begin:end] = _sketch(texts[begin:end])
        begin = end
    return exact, sketch


def _sketch(texts: list[str | None]) -> np.ndarray:
    data, offsets = strings(pa.array(texts, pa.large_string()))
    n = len(texts)
    if not len(data):
        return np.zeros((n, SKETCH), np.uint16)
    lower = _LOWER[data]
    starts, stops, text = runs(lower, offsets, WORD)
    if not len(starts):
        return np.zeros((n, SKETCH), np.uint16)
    h = span_hashes(lower, starts, stops)
    line = np.searchsorted(np.flatnonzero(data == 10), starts) + 2 * text
    new = np.r_[True, line[1:] != line[:-1]]
    last = np.r_[new[1:], True]
    before = np.where(new, _U(1), np.r_[_U(1), h[:-1]])
    pairs = np.concatenate([mix(before * _U(0x9E3779B97F4A7C15) + h), mix(h[last] * _U(0x9E3779B97F4A7C15) + _U(2))])
    owner = np.concatenate([text, text[last]])
    place = owner * SKETCH + (pairs & _U(SKETCH - 1)).astype(np.int64)
    sign = np.where((pairs >> _U(32)) & _U(1), 1.0, -1.0)
    return np.bincount(place, weights=sign, minlength=n * SKETCH).astype(np.int64).reshape(n, SKETCH).astype(np.uint16)


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(e.astype("<u8").tobytes() + s.astype("<u2").tobytes()).decode() for e, s in zip(exact, sketch)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<u2")


def combine(fingerprint: str, other: str, delete: bool = False) -> str:
    """The fingerprint of both texts' paragraphs, or of the first's without the second's."""
    (e, s), (f, t) = decode(fingerprint), decode(other)
    return encode(*([[e - f], [s - t]] if delete else [[e + f], [s + t]]))[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From 0 to 1, row by row: 1 for equal fingerprints, else the sketches' cosine."""
    x, y = a[1].astype(np.int16).astype(np.float64), b[1].astype(np.int16).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    equal = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], bucket: list[int], own: list[bool], lanes) -> dict:
    """Rows for each own text with its successor; texts are in order, the last one has none yet."""
    at = [i for i in range(len(texts) - 1) if own[i] and bucket[i] == bucket[i + 1]]
    edited = []
    for i in at:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    now, then = (lanes[0][at], lanes[1][at]), vectors(edited)
    after = [i + 1 for i in at]
    return {
        "doc_id": pa.array([ids[i] for i in at], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(encode(*now), pa.string()),
        "edited_fingerprint": pa.array(encode(*then), pa.string()),
        "near_edited": pa.array(likeness(now, then), pa.float64()),
        "near_next": pa.array(likeness(now, (lanes[0][after], lanes[1][after])), pa.float64()),
    }


def _stream(batches):
    held = None
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            ids, texts = column(part, "doc_id").to_pylist(), [t or "" for t in column(part, "text").to_pylist()]
            bucket, own = column(part, "bucket").to_pylist(), [not p for p in column(part, "pos").to_pylist()]
            lanes = vectors(texts)
            if held:
                ids, texts, bucket, own = held[0] + ids, held[1] + texts, held[2] + bucket, held[3] + own
                lanes = tuple(np.concatenate([a, b]) for a, b in zip(held[4], lanes))
            out = _compare(ids, texts, bucket, own, lanes)
            if len(out["doc_id"]):
                yield pa.RecordBatch.from_pydict(out)
            held = (ids[-1:], texts[-1:], bucket[-1:], own[-1:], tuple(x[-1:] for x in lanes))


def fingerprint(docs: DataFrame, per_partition: int = 1) -> DataFrame:
    """SCHEMA, one row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    n = per_partition * partitions(spark)
    splits = key_splits(docs.where("doc_id IS NOT NULL"), "doc_id", n)
    # ascending cut points, descending order: the higher the ids, the lower the bucket
    home = F.pandas_udf(lambda key: pd.Series(len(splits) - np.searchsorted(splits, key.to_numpy(), "left")), "int")
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY))
    heads = docs.select(key.alias("key")).withColumn("bucket", home("key")).groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    before = {heads[i]["key"]: heads[i - 1]["bucket"] for i in range(len(heads))}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        own = len(splits) - np.searchsorted(splits, keys.to_numpy(), "left")
        return pd.Series([[int(b), before[k]] if k in before else [int(b)] for b, k in zip(own, keys)])

    rows = docs.select("doc_id", "text", key.alias("key")).select("doc_id", "text", "key", F.posexplode(places("key")).alias("pos", "bucket"))
    rows = rows.repartitionById(partitions(spark), "bucket").sortWithinPartitions("bucket", "pos", F.col("key").desc(), "text")
    return rows.select("doc_id", "text", "pos", "bucket").mapInArrow(_stream, SCHEMA)
