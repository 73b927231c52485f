"""Near-duplicate vectors of one label by an epsilon grid order join.

Vectors are unit-scaled and projected on leading principal dimensions (a basis fitted on a bounded sample; any
orthonormal basis gives the same result). Cosine >= t means a distance of at most epsilon = sqrt(2 - 2t), so grid cells
of that width on these dimensions order the vectors of a label lexicographically. The ordered sequence is cut into
blocks; two blocks are compared only if their bounding boxes come within epsilon, and within a pair of blocks the
sequence intervals are halved recursively, distant halves being skipped, down to leaves whose cosines are computed in
double precision.

Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label or null id, link
with nothing; only vectors of one length are compared. Exact copies are one vector with a count. A pair of blocks emits,
for each of its vectors, how many vectors it links to and one link towards its component, never all pairs. Repeated ids
count as further vectors; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column, concat_ranges, partitions, written
from .components import Forest, components

#: Vectors of a block, vectors of a leaf, principal dimensions.
BLOCK, LEAF, DIMS = 1024, 64, 8


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row has a label and a vector that is neither zero nor holds null or non-finite components; all components, and each row's first and count."""
    vectors = column(batch, "embedding")
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)  # a null component is not a number
    first = np.cumsum(lens) - lens
    some = np.flatnonzero(lens)
    good = np.zeros(batch.num_rows, bool)
    if len(some):
        good[some] = np.logical_and.reduceat(np.isfinite(values), first[some]) & np.logical_or.reduceat(values != 0, first[some])
    return good & column(batch, "label").is_valid().to_numpy(zero_copy_only=False), values, first, lens


def _valid(batches):
    """Rows with usable vectors as raw 32-bit floats."""
    for batch in batches:
        good, values, first, lens = _usable(batch)
        keep = np.flatnonzero(good)
        raw = values[concat_ranges(first[keep], lens[keep])]
        ends = pa.py_buffer(np.r_[0, np.cumsum(4 * lens[keep])].astype(np.int32).tobytes())
        ids, labels = (column(batch, c).take(pa.array(keep)).cast(pa.int64()) for c in ("vec_id", "label"))
        yield pa.RecordBatch.from_arrays([ids, labels, pa.Array.from_buffers(pa.binary(), len(keep), [None, ends, pa.py_buffer(raw.tobytes())])], names=["vec_id", "label", "vec"])


def unit(raw: bytes | list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(raw if isinstance(raw, bytes) else b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    # the largest component first, so that neither tiny nor huge vectors leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal columns: the leading principal dimensions of a sample."""
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, :dims]


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with at least that cosine; of one block with itself, each pair once."""
    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    found_a, found_b = [], []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        if same and m <= i:
            continue
        gap = np.maximum(0.0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if (gap * gap).sum() > reach:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= cosine)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            found_a.append(x)
            found_b.append(y)
        elif j - i >= m - k:
            mid = (i + j) // 2
            work += [(i, mid, k, m), (mid, j, k, m)]
        else:
            mid = (k + m) // 2
            work += [(i, j, k, mid), (i, j, mid, m)]
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, sample: int = 10_000) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    arrow_rows(spark, 2000)
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    valid = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(_valid, "vec_id long, label long, vec binary")
    keyed = written(valid.withColumn("key", F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), "vec"))), "vectors")
    classes = written(keyed.groupBy("key", "label", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", (F.length("vec") / 4).cast("int")), "classes")
    bases = {}
    picked = classes.orderBy("key").limit(sample).select("dim", "vec").toArrow()
    for dim in set(picked["dim"].to_pylist()):
        own = [v for d, v in zip(picked["dim"].to_pylist(), picked["vec"].to_pylist()) if d == dim]
        bases[dim] = principal(unit(own, dim), DIMS) if len(own) > 1 else np.eye(dim)[:, :DIMS]
    epsilon = float(np.sqrt(2 - 2 * cosine))

    def project(raw: list[bytes], dim: int) -> np.ndarray:
        p = unit(raw, dim) @ bases.get(dim, np.eye(dim)[:, :DIMS])
        return np.pad(p, ((0, 0), (0, DIMS - p.shape[1])))

    def cells(batches):
        """The place in grid order: three bits for each dimension."""
        for batch in batches:
            dims, raw = column(batch, "dim").to_numpy(), column(batch, "vec").to_pylist()
            order = np.zeros(len(raw), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell = np.clip(np.floor(project([raw[i] for i in at], int(d)) / epsilon).astype(np.int64) + 4, 0, 7)
                order[at] = (cell << (3 * np.arange(DIMS - 1, -1, -1))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order)], names=[*batch.schema.names, "place"])

    def blocks(batches):
        """One row for each block: ids, copies and vectors in order, and the box of its projections."""
        part, number = TaskContext.get().partitionId(), 0
        held = None

        def row(label, dim, ids, copies, raw):
            p = project(raw, dim)
            return {"block": [(part << 24) + number], "label": [label], "dim": [dim], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "vecs": [b"".join(raw)], "low": [p.min(0).tolist()], "high": [p.max(0).tolist()]}

        schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vecs", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        for batch in batches:
            label, dim, ids, copies = (column(batch, c).to_numpy() for c in ("label", "dim", "id", "copies"))
            raw = column(batch, "vec").to_pylist()
            edges = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]), True]) if len(raw) else []
            for i, j in zip(edges, edges[1:]):
                if held and held[:2] != (int(label[i]), int(dim[i])):
                    yield pa.RecordBatch.from_pydict(row(*held), schema=schema)
                    number, held = number + 1, None
                now = (ids[i:j].astype(np.int64), copies[i:j].astype(np.int64), raw[i:j])
                held = (int(label[i]), int(dim[i]), *(now if not held else (np.r_[held[2], now[0]], np.r_[held[3], now[1]], held[4] + now[2])))
                while len(held[2]) >= BLOCK:
                    yield pa.RecordBatch.from_pydict(row(*held[:2], held[2][:BLOCK], held[3][:BLOCK], held[4][:BLOCK]), schema=schema)
                    number, held = number + 1, (*held[:2], held[2][BLOCK:], held[3][BLOCK:], held[4][BLOCK:])
                if not len(held[2]):
                    held = None
        if held:
            yield pa.RecordBatch.from_pydict(row(*held), schema=schema)

    placed = classes.select("id", "label", "dim", "copies", "vec").mapInArrow(cells, "id long, label long, dim int, copies long, vec binary, place long")
    n = max(1, min(partitions(spark), -(-classes.count() // BLOCK)))
    ordered = placed.repartitionByRange(n, "label", "dim", "place", "id").sortWithinPartitions("label", "dim", "place", "id")
    packed = written(ordered.mapInArrow(blocks, "block long, label long, dim int, ids binary, copies binary, vecs binary, low array<double>, high array<double>"), "blocks")
    # pairs of blocks of one label that may hold near vectors
    box = packed.select("block", "label", "dim", "low", "high")
    other = box.select(F.col("block").alias("block2"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = lambda i: F.pow(F.greatest(F.lit(0.0), F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i]), 2)
    distance = sum((apart(i) for i in range(1, DIMS)), apart(0))
    pairs = box.join(other, ["label", "dim"]).where((F.col("block") <= F.col("block2")) & (distance <= epsilon * epsilon * (1 + 1e-9) + 1e-9)).select("block", "block2")
    second = packed.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("vecs").alias("vecs2"))
    both = pairs.join(packed.select("block", "dim", "ids", "copies", "vecs"), "block").join(second, "block2").repartition(max(n, partitions(spark)))

    def links(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, same = r["dim"], r["block"] == r["block2"]
                a = unit(r["vecs"], dim)
                ids, copies = (np.frombuffer(r[c], np.int64) for c in ("ids", "copies"))
                pa_ = project([r["vecs"]], dim)
                if same:
                    x, y = join_blocks(a, a, pa_, pa_, cosine, True)
                else:
                    x, y = join_blocks(a, unit(r["vecs2"], dim), pa_, project([r["vecs2"]], dim), cosine, False)
                    y = y + len(ids)
                    ids, copies = (np.r_[u, np.frombuffer(r[c], np.int64)] for u, c in ((ids, "ids2"), (copies, "copies2")))
                if not len(x):
                    continue
                count = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
                forest = Forest(len(ids))
                for i, j in zip(x.tolist(), y.tolist()):
                    forest.union(i, j)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(ids[forest.roots()[some]])], names=["id", "links", "root"])

    arrow_rows(spark, 8)  # two blocks in a row
    found = written(both.mapInArrow(links, "id long, links long, root long"), "pairs")
    arrow_rows(spark, 2000)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("key", "id", "copies").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = keyed.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.mapInArrow(_alone, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _alone(batches):
    """Ids of the rows that _valid leaves out."""
    for batch in batches:
        ids = column(batch, "vec_id")
        keep = np.flatnonzero(~_usable(batch)[0] | ids.is_null().to_numpy(zero_copy_only=False))
        if len(keep):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)).cast(pa.int64())], names=["vec_id"])
