"""Lexical retrieval packing: documents beside their BM25 neighbours in sequences of a fixed length.

Every document is encoded whole and ended by an id. Full windows of a long document are sequences of their own; the
rest of each document (shorter than a window) goes to a shard by content: documents are put in order of their two most
telling terms that another document shares, over all partitions, and each run of `shard_docs` of them is a shard. It
holds an inverted index of its documents' token ids; frequencies and lengths are those of whole documents, over the
whole corpus. A seed asks the index with all terms of its document; the unused documents it returns fill the seed's window in order of
their BM25 score, the last one is cut at the window's end, and what is left of it is the next seed. A shard's last
window is cut into sequences whose lengths are powers of two, so no sequence needs padding.

Null and empty texts consist of the end id. Repeated rows and ids are documents of their own. An empty table gives no
sequences. Columns besides doc_id and text are ignored. Shards are streamed in sorted order, one at a time, and begin
anew after 8 MB of long documents' terms, so a task's memory is bounded whatever the rows are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column, concat_ranges, partitions, scratch_path, slices, strings
from .tokens import encoder, ended, vocabulary

#: The usual constants of BM25.
K1, B = 1.2, 0.75


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, vocab: str, end_id: int, window: int) -> DataFrame:
    """doc_id, n tokens, crcs of its full windows, the rest of its ids (16 bits each where the vocabulary allows), and the terms and counts of one with full windows, in a written table."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)

    def of(batches):
        codec = encoder(vocab)
        for batch in batches:
            for i, j in slices(strings(column(batch, "text"))[1]):
                part = batch.slice(i, j - i)
                ids, offsets = ended(*codec.encode(column(part, "text")), end_id)
                small = ids.astype("<u4" if codec.large else "<u2")
                n = np.diff(offsets)
                cuts = offsets[:-1] + n // window * window
                rest = [small[a:b].tobytes() for a, b in zip(cuts.tolist(), offsets[1:].tolist())]
                crcs = [[_crc(ids[k : k + window]) for k in range(a, b, window)] if a < b else [] for a, b in zip(offsets.tolist(), cuts.tolist())]
                whole = [np.stack(np.unique(ids[a:b], return_counts=True), 1).astype("<u4").tobytes() if b - a >= window else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(whole, pa.binary())], names=["doc_id", "n", "crcs", "rest", "whole"]
                )

    path = scratch_path(spark, "tokens")
    schema = "doc_id long, n long, crcs array<long>, rest binary, whole binary"
    docs.select("doc_id", "text").mapInArrow(of, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _terms(docs: list[np.ndarray], whole: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and count of every term of documents: of `whole` where it is given, else of docs; by owner and term."""
    lens = np.array([0 if w is not None else len(d) for d, w in zip(docs, whole)], np.int64)
    short = [d for d, w in zip(docs, whole) if w is None]
    joint = (np.repeat(np.arange(len(docs)), lens) << 32) | np.concatenate([np.zeros(0, np.int64), *short]).astype(np.int64)
    joint.sort()
    new = np.flatnonzero(np.r_[True, joint[1:] != joint[:-1]]) if len(joint) else np.zeros(0, np.int64)
    joint, tf = joint[new], np.diff(np.r_[new, len(joint)])
    known = [(i, np.frombuffer(w, "<u4").reshape(-1, 2)) for i, w in enumerate(whole) if w is not None]
    if known:
        joint = np.concatenate([joint, *[(i << 32) | pairs[:, 0].astype(np.int64) for i, pairs in known]])
        tf = np.concatenate([tf, *[pairs[:, 1] for _, pairs in known]])
        order = np.argsort(joint, kind="stable")
        joint, tf = joint[order], tf[order]
    return joint >> 32, joint & 0xFFFFFFFF, tf


def _of_batch(batch: pa.RecordBatch, kind: str):
    """Row ranges of a batch of tokenized() with a few megabytes of ids, and their documents' terms."""
    size = lambda name: pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
    for i, j in slices(np.r_[0, np.cumsum(size("rest") + size("whole"))]):
        rest, whole = (column(batch, c)[i:j].to_pylist() for c in ("rest", "whole"))
        yield i, j, _terms([np.frombuffer(x, kind) for x in rest], whole)


def statistics(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Ids met, how many documents hold each, mean length and number of the documents, over all of them and all their ids."""

    def of(batches):
        count, length, docs = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for i, j, (_, own, tf) in _of_batch(batch, kind):
                found = np.bincount(own, minlength=len(count))
                found[: len(count)] += count
                count, length, docs = found, length + int(tf.sum()), docs + j - i
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some], pa.int64()), pa.array(np.r_[docs, length, count[some]], pa.int64())], names=["term", "n"])

    rows = tokens.select("rest", "whole").mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))
    docs, length = found.pop(-2, 0), found.pop(-1, 0)
    terms = np.array(sorted(found), np.int64)
    return terms, np.array([found[t] for t in terms.tolist()], np.int64), length / docs if docs else 0.0, docs


class Shard:
    """An inverted index of documents (arrays of ids), asked for unused neighbours."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None, whole: list[bytes | None] | None = None):
        self.query_terms, self.n = query_terms, len(docs)
        self.owner, self.term, tf = _terms(docs, whole or [None] * self.n)
        lens = np.bincount(self.owner, tf, self.n)
        self.weight_of = idf[self.term]
        weight = self.weight_of * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.owner] / max(mean, 1.0)))
        self.asked = tf * self.weight_of
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.lists, self.weights = self.owner[order], weight[order]
        self.terms, begins = np.unique(self.term[order], return_index=True)
        self.begins = np.r_[begins, len(order)]

    def neighbours(self, seed: int, unused: np.ndarray):
        """Unused documents, the best first; those without a shared term come last, in order."""
        a, b = self.first[seed], self.first[seed + 1]
        pick = np.arange(a, b)
        if self.query_terms is not None and b - a > self.query_terms:
            pick = pick[np.argsort(-self.asked[a:b], kind="stable")[: self.query_terms]]
        at = np.searchsorted(self.terms, self.term[pick])
        spans = concat_ranges(self.begins[at], self.begins[at + 1] - self.begins[at])
        score = np.bincount(self.lists[spans], self.weights[spans], self.n)
        score[~unused] = -1.0
        k = 16
        while k < self.n:
            best = np.argpartition(-score, k)[:k]
            best = best[np.lexsort((best, -score[best]))]
            yield from best[score[best] >= 0].tolist()
            score[best] = -1.0
            if score.max() < 0:
                return
            k *= 4
        yield from (int(i) for i in np.lexsort((np.arange(self.n), -score)) if score[i] >= 0)


def windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, query_terms: int | None, whole: list[bytes | None] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, from, to) that hold every id of docs once; each is full or a power of two long."""
    shard, unused = Shard(docs, idf, mean, query_terms, whole), np.ones(len(docs), bool)
    out, now, room, nearest = [], [], window, iter(())
    seed, begin, k = None, 0, 0
    while True:
        if seed is None:  # the next document: a neighbour of this window's seed, or the first unused
            seed, begin = next((d for d in nearest if unused[d]), None), 0
            if seed is None:
                while k < len(docs) and not unused[k]:
                    k += 1
                if k == len(docs):
                    break
                seed = k
            unused[seed] = False
        if not now:
            nearest = shard.neighbours(seed, unused)
        take = min(room, len(docs[seed]) - begin)
        now.append((seed, begin, begin + take))
        room, begin = room - take, begin + take
        if begin == len(docs[seed]):
            seed = None
        if not room:
            out.append(now)
            now, room = [], window
    left = window - room
    while left:  # cut what is left at powers of two
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            d, a, b = now.pop(0)
            take = min(need, b - a)
            part.append((d, a, a + take))
            if a + take < b:
                now.insert(0, (d, a + take, b))
            need -= take
        out.append(part)
        left -= size
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str | None = None, end_id: int = 1, window: int = 2048, shard_docs: int = 512, query_terms: int | None = None) -> DataFrame:
    """PIECES of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    vocab = vocab or vocabulary("byte_bpe_50k.json")
    kind = "<u4" if encoder(vocab).large else "<u2"
    tokens = tokenized(docs, vocab, end_id, window)
    terms, frequency, mean, n = statistics(tokens, kind)
    idf = np.zeros(int(terms.max()) + 1 if len(terms) else 1)
    idf[terms] = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    shared = spark.sparkContext.broadcast(idf)  # one number for each id of the vocabulary
    shards = max(1, -(-n // shard_docs))
    lone = np.zeros(len(idf), bool)
    lone[terms[frequency < 2]] = True
    shared_lone = spark.sparkContext.broadcast(lone)

    def keyed(batches):
        idf, lone = shared.value, shared_lone.value
        for batch in batches:
            for i, j, (owner, term, tf) in _of_batch(batch, kind):
                asked = np.where(lone[term], 0.0, tf * idf[term])
                order = np.lexsort((term, -asked, owner))
                first = np.searchsorted(owner, np.arange(j - i))
                second = np.minimum(first + 1, np.searchsorted(owner, np.arange(j - i), "right") - 1)
                keys = [pa.array(np.where(asked[order[at]] > 0, term[order[at]], -1), pa.int64()) for at in (first, second)]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), *keys], names=[*batch.schema.names, "k1", "k2"])

    def of(batches):
        idf = shared.value
        rows, held, sequence, task = [], 0, 0, TaskContext.get().partitionId()

        def done():
            nonlocal sequence
            out, base = [], task << 40
            for doc_id, n, crcs, _, _ in rows:
                for w, crc in enumerate(crcs):
                    out.append((doc_id, window * w, window, crc, n, base + sequence, 0))
                    sequence += 1
            rests = [r for r in rows if len(r[3])]
            if rests:
                for pieces in windows([r[3] for r in rests], idf, mean, window, query_terms, [r[4] for r in rests]):
                    offset = 0
                    for d, a, b in pieces:
                        doc_id, n, crcs, ids, _ = rests[d]
                        out.append((doc_id, window * len(crcs) + a, b - a, _crc(ids[a:b]), n, base + sequence, offset))
                        offset += b - a
                    sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, n, crcs, rest, whole in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n", "crcs", "rest", "whole"))):
                if rows and (len(rows) >= shard_docs or held > 8 << 20):
                    yield done()
                    rows, held = [], 0
                rows.append((doc_id, n, crcs, np.frombuffer(rest, kind), whole))
                held += len(whole or b"")
        if rows:
            yield done()

    # a range partitioning sends a sample of its keys to the driver: a hash stands for the ids; doc_id is among the keys so that many like documents are no large partition
    order = ["k1", "k2", "doc_id", "n", "tie"]
    placed = tokens.mapInArrow(keyed, "doc_id long, n long, crcs array<long>, rest binary, whole binary, k1 long, k2 long").withColumn("tie", F.xxhash64("rest"))
    placed = placed.repartitionByRange(min(shards, partitions(spark)), *order).sortWithinPartitions(*order)
    return placed.select("doc_id", "n", "crcs", "rest", "whole").mapInArrow(of, PIECES)
