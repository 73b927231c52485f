"""Token ids in files of bit planes.

A file holds the documents of one range of doc_id in ascending order. Their ids are cut into blocks of a fixed size;
each block is transposed into bit planes (byte planes first, the eight bits of each by an 8 x 8 transposition), each
plane is compressed with zstandard, and a chunk index in the footer says where each plane lies. The footer also holds
doc_ids and token counts, and a crc32. Files are written under a name of their own and then renamed; the catalogue of
the files whose tasks ended well is what is read, so a task that runs again does no harm.

Null texts count as empty and have the end id only. Rows with a null doc_id come first, rows with equal doc_id follow
each other by text. An empty table writes no file. Columns besides doc_id and text are ignored. A task holds one Arrow
batch, one block and the footer of one file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_KEY, arrow_rows, column, key_splits, partitions, scratch_path
from .tokens import encoder, ended, vocabulary

MAGIC = b"NFBP1\n"
_STEPS = [(7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)]


def _transpose_bits(data: np.ndarray) -> np.ndarray:
    """Each eight bytes as an 8 x 8 matrix of bits, transposed; its own inverse."""
    x = data.view("<u8").astype(np.uint64)
    for shift, mask in _STEPS:
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x ^= t ^ (t << np.uint64(shift))
    return x.astype("<u8").view(np.uint8)


def pack_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Bit planes of a block, lowest bit first; ids are padded with zeros to a multiple of eight."""
    padded = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    padded[: len(ids)] = ids
    raw, out = padded.view(np.uint8).reshape(-1, 4), []
    for byte in range(width):
        out += [p.tobytes() for p in _transpose_bits(np.ascontiguousarray(raw[:, byte])).reshape(-1, 8).T]
    return out


def unpack_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.zeros((len(planes[0]) * 8 if planes else 0, 4), np.uint8)
    for byte in range(len(planes) // 8):
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes[8 * byte : 8 * byte + 8]], axis=1)
        raw[:, byte] = _transpose_bits(np.ascontiguousarray(rows).reshape(-1))
    return raw.reshape(-1).view("<u4")[:n]


class Writer:
    """One file on an open binary stream."""

    def __init__(self, out, block: int = 1 << 16, width: int = 2, level: int = 1):
        self.out, self.block, self.width = out, block, width
        self.zip = zstandard.ZstdCompressor(level=level)
        self.left, self.n_left, self.at = [], 0, 0
        self.chunks, self.docs, self.lens, self.total = [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self, all_of_it: bool = False) -> None:
        if not self.n_left:
            return
        ids, begin = np.concatenate(self.left), 0
        while len(ids) - begin >= self.block or all_of_it and begin < len(ids):
            some = ids[begin : begin + self.block]
            if int(some.max()) >> (8 * self.width):
                raise ValueError(f"id {int(some.max())} needs more than {self.width} bytes")
            start = self.at
            self.chunks.append([len(some), start, [self._put(self.zip.compress(p)) for p in pack_planes(some, self.width)]])
            begin += len(some)
        self.left, self.n_left = ([ids[begin:]], len(ids) - begin) if begin < len(ids) else ([], 0)

    def add(self, doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their counts and all their ids, one after the other."""
        self.docs += doc_ids
        self.lens += lens.tolist()
        self.total += len(ids)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.block:
            self._flush()

    def close(self) -> None:
        self._flush(all_of_it=True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        table = known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lens, "<u8").tobytes()
        head = json.dumps({"width": self.width, "block": self.block, "docs": len(self.docs), "total": self.total, "chunks": self.chunks}).encode()
        foot = self.zip.compress(struct.pack("<Q", len(head)) + head + table)
        self._put(foot)
        self._put(struct.pack("<QI", len(foot), zlib.crc32(foot)) + MAGIC)


class Reader:
    """A file's documents, and its ids block by block or at any place."""

    def __init__(self, source, size: int):
        self.source = source
        tail = struct.calcsize("<QI") + len(MAGIC)
        source.seek(size - tail)
        raw = source.read(tail)
        length, crc = struct.unpack("<QI", raw[:-len(MAGIC)])
        source.seek(size - tail - length)
        foot = source.read(length)
        if raw[-len(MAGIC) :] != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError("not a whole file of bit planes")
        self.zip = zstandard.ZstdDecompressor()
        foot = self.zip.decompress(foot)
        (n,) = struct.unpack("<Q", foot[:8])
        self.head, n_docs = json.loads(foot[8 : 8 + n]), 0
        table, n_docs = foot[8 + n :], self.head["docs"]
        self.known = np.frombuffer(table[:n_docs], np.uint8).astype(bool)
        self.docs = np.frombuffer(table[n_docs : 9 * n_docs], "<i8")
        self.lens = np.frombuffer(table[9 * n_docs :], "<u8").astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        n, start, sizes = self.head["chunks"][k]
        self.source.seek(start)
        raw, at, planes = self.source.read(sum(sizes)), 0, []
        for s in sizes:
            planes.append(self.zip.decompress(raw[at : at + s]))
            at += s
        return unpack_planes(planes, n)

    def documents(self):
        """The ids of each document in turn; one block more than the longest document is held."""
        left, k = np.zeros(0, "<u4"), 0
        for n in self.lens:
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            ids = np.concatenate(parts) if len(parts) > 1 else left
            left = ids[n:]
            yield ids[:n]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, vocab: str, end_id: int, per_partition: int = 1) -> DataFrame:
    """Writes the files below folder; returns their catalogue, bucket, path, n_docs and n_tokens, in a table of its own."""
    from .common import written

    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    splits = key_splits(docs.where("doc_id IS NOT NULL"), "doc_id", per_partition * partitions(spark))
    home = F.pandas_udf(lambda key: pd.Series(np.searchsorted(splits, key.to_numpy(), "right")), "int")
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY))

    def put(batches):
        files, path = _open(folder)
        codec, now, writer, stream, name = encoder(vocab), None, None, None, None

        def done():
            writer.close()
            stream.close()
            files.move(name + ".tmp", name)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

        for batch in batches:
            bucket = column(batch, "bucket").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
            for i, j in zip(edges, edges[1:]):
                if bucket[i] != now:
                    if writer:
                        yield done()
                    now = int(bucket[i])
                    name = f"{path}/ids-{now:07d}-{uuid.uuid4().hex}.bp"
                    files.create_dir(path, recursive=True)
                    stream = files.open_output_stream(name + ".tmp")
                    writer = Writer(stream)
                part = batch.slice(i, j - i)
                ids, offsets = ended(*codec.encode(column(part, "text")), end_id)
                writer.add(column(part, "doc_id").to_pylist(), np.diff(offsets), ids)
        if writer:
            yield done()

    rows = docs.select("doc_id", "text", key.alias("key")).withColumn("bucket", home("key"))
    rows = rows.repartitionById(partitions(spark), "bucket").sortWithinPartitions("bucket", "key", "text")
    return written(rows.select("doc_id", "text", "bucket").mapInArrow(put, "bucket int, path string, n_docs long, n_tokens long"), "catalogue")


def read(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the files alone."""
    found = catalogue.orderBy("bucket").collect()  # a row for each file
    start, rows = 0, []
    for r in found:
        rows.append((r["path"], start))
        start += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def get(batches):
        for batch in batches:
            for path, first in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist()):
                files, name = _open(path)
                with files.open_input_file(name) as source:
                    file = Reader(source, source.size())
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4", copy=False)) for ids in file.documents()), np.int64, len(file.lens))
                    begin = first + np.cumsum(file.lens) - file.lens
                    for i in range(0, len(crc), 10_000):
                        s = slice(i, i + 10_000)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.docs[s], pa.int64(), mask=~file.known[s]), "start": begin[s], "n_tokens": file.lens[s], "ids_crc32": crc[s]})

    return spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows))).mapInArrow(get, schema)


def round_trip(docs: DataFrame, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes all of docs to files in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "ids"), vocab or vocabulary("word_bpe_49k.json"), end_id))
