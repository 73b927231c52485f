"""N-gram Jaccard join by T-occurrence search over sharded inverted lists.

A text's set holds the 64-bit hashes of its distinct 5-word shingles. Texts with equal sets are one class. Let n be a
set's size and t the least likeness: a linked class holds all but floor((1 - t) n) of the set's shingles. Three steps
keep the search exact and small.

1. Screening. A fixed share of the hash space is dealt to shards, each shard's inverted lists tell which shingles
   occur in two classes, and a class with more single shingles than floor((1 - t) n) can link to none.
2. Candidates. The sets left are dealt again, whole, and each shard returns how frequent every repeated shingle is
   (capped at 255, so that one batch with a very frequent shingle settles its level and sends one entry for it). Two
   linked sets share one of their floor((1 - t) n) + 1 rarest shingles; classes that share one are joined into blocks
   by connected components over star links, never by pairs.
3. Search. A block's sets are indexed in one task (a large block's in chunks of bounded size). Each set in turn is a
   query: of its lists, the longest are left aside, the short ones are merged, candidates that occur often enough and
   are not yet in the query's component are looked up in the long lists by binary search (DivideSkip), and those that
   reach the overlap are linked. Sets of a block's largest component need not be queries. A task emits a forest of links.

Null and empty texts, and texts without words, have empty sets and link with nothing, as do rows with a null doc_id,
whose component is null. Rows that repeat a doc_id with another text each get their own text's component. Extra
columns are ignored. Screening and candidates may only let too much through (hash collisions); the search decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column, concat_ranges, partitions, slices, strings, written
from .components import Forest, components, contract
from .textvec import mix, shingle_sets

#: The least likeness, 80 of 100, and the words of a shingle.
NUMERATOR, DENOMINATOR, WORDS = 80, 100, 5
#: Most classes and shingles of a chunk of a large block.
CHUNK_SETS, CHUNK_SHINGLES = 1024, 2_000_000
#: About as many sets of a large block are asked for in all of its chunks first.
PIVOTS = 64
_U = np.uint64
_LOW40 = _U((1 << 40) - 1)


def spare(n):
    """How many of n shingles a linked set may lack."""
    return n - -(-(n * NUMERATOR) // DENOMINATOR)


def _ref(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set."""
    n = np.diff(offsets)
    sums = np.zeros(len(n), _U)
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(mix(hashes), offsets[:-1][some])
    return mix(sums + n.astype(_U)).view(np.int64)


def _sets(batches, of):
    """Calls of(batch, i, j, hashes, offsets) for slices of each batch's texts."""
    for batch in batches:
        data, at = strings(column(batch, "text"))
        for i, j in slices(at, 8 << 20):
            yield from of(batch, i, j, *shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], WORDS))


def _summaries(batches):
    """doc_id, ref, n and the screened part's size of each text."""

    def of(batch, i, j, hashes, offsets):
        screened = np.r_[0, np.cumsum(hashes >> _U(63) == 0)]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id")[i:j].cast(pa.int64()), pa.array(_ref(hashes, offsets)), pa.array(np.diff(offsets)), pa.array(np.diff(screened[offsets]))], names=["doc_id", "ref", "n", "screened"]
        )

    return _sets(batches, of)


def _deal(refs: np.ndarray, hashes: np.ndarray, owner: np.ndarray, shards: int, cap: int) -> list[tuple[int, bytes]]:
    """Shard and packed postings; classes that share a shingle at least `cap` times here settle its level here."""
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(h)])
    often = np.repeat(count >= cap, count)
    settled_h, settled_o = h[often], o[often]
    marks = h[first[count >= cap]]
    h, o = h[~often], o[~often]
    out = []
    shard_of = lambda x: ((x >> _U(40)) & _U(0x7FFFFF)) % _U(shards)
    everything = np.concatenate([h, marks, settled_h])
    kind = np.repeat(np.array([0, 1, 2], np.uint8), [len(h), len(marks), len(settled_h)])
    who = np.concatenate([o, np.zeros(len(marks), o.dtype), settled_o])
    shard = shard_of(everything).astype(np.int64)
    order = np.lexsort((who, kind, shard))
    everything, kind, who, shard = everything[order], kind[order], who[order], shard[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
    for i, j in zip(edges, edges[1:]):
        parts = []
        for k in range(3):
            a, b = i + np.searchsorted(kind[i:j], k), i + np.searchsorted(kind[i:j], k, "right")
            begin = np.flatnonzero(np.r_[True, who[a + 1 : b] != who[a : b - 1]]) if b > a else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[begin, b - a]) if b > a else np.zeros(0, np.int64)
            low = np.ascontiguousarray(everything[a:b].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            parts.append(np.array([len(begin), b - a], np.int64).tobytes() + refs[who[a + begin]].tobytes() + sizes.astype(np.uint32).tobytes() + low)
        out.append((int(shard[i]), b"".join(parts)))
    return out


def _undeal(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For entries, marks and settled entries: refs and 40-bit hashes."""
    out, at = [], 0
    for _ in range(3):
        groups, total = np.frombuffer(blob, np.int64, 2, at)
        refs = np.frombuffer(blob, np.int64, groups, at + 16)
        sizes = np.frombuffer(blob, np.uint32, groups, at + 16 + 8 * groups)
        low = np.zeros((total, 8), np.uint8)
        low[:, :5] = np.frombuffer(blob, np.uint8, 5 * total, at + 16 + 12 * groups).reshape(-1, 5)
        out.append((np.repeat(refs, sizes), low.reshape(-1).view(_U)))
        at += int(16 + 12 * groups + 5 * total)
    return out


def _levels(blobs: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ref, 40-bit hash and level of every entry of a shard whose shingle occurs in two classes."""
    parts = [_undeal(b) for b in blobs]
    refs, low = (np.concatenate([p[0][k] for p in parts]) for k in (0, 1))
    marks = np.unique(np.concatenate([p[1][1] for p in parts]))
    order = np.lexsort((refs, low))
    refs, low = refs[order], low[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (refs[1:] != refs[:-1])] if len(low) else np.zeros(0, bool)
    refs, low = refs[new], low[new]
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(low)])
    count = np.where(np.isin(low[first], marks), cap, np.minimum(count, cap))
    level = np.repeat(count, np.diff(np.r_[first, len(low)]))
    keep = level >= 2
    settled = [np.concatenate([p[2][k] for p in parts]) for k in (0, 1)]
    return np.concatenate([refs[keep], settled[0]]), np.concatenate([low[keep], settled[1]]), np.concatenate([level[keep], np.full(len(settled[0]), cap)])


def _by_shard(batches, of):
    """Calls of(shard, blobs) for each shard of a partition sorted by shard."""
    now, blobs = None, []
    for batch in batches:
        for shard, blob in zip(column(batch, "shard").to_pylist(), column(batch, "blob").to_pylist()):
            if shard != now and blobs:
                yield from of(now, blobs)
                blobs = []
            now = shard
            blobs.append(blob)
    if blobs:
        yield from of(now, blobs)


def _first_of_each(refs: np.ndarray, hashes: np.ndarray, offsets: np.ndarray):
    """The sets of distinct refs that are not empty."""
    _, first = np.unique(refs, return_index=True)
    first = first[np.diff(offsets)[first] > 0]
    lens = np.diff(offsets)[first]
    return refs[first], hashes[concat_ranges(offsets[first], lens)], np.r_[0, np.cumsum(lens)]


def _blob_rows(dealt):
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in dealt], pa.int32()), pa.array([b for _, b in dealt], pa.binary())], names=["shard", "blob"])


def _by_ref(refs: np.ndarray, values: np.ndarray, buckets: int):
    """One row for each bucket of refs, with refs and values (64 bits each) packed."""
    bucket = (refs.view(_U) % _U(buckets)).astype(np.int64)
    order = np.lexsort((refs, bucket))
    refs, values, bucket = refs[order], values[order], bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
    return _blob_rows([(int(bucket[i]), np.array([j - i], np.int64).tobytes() + refs[i:j].tobytes() + values[i:j].tobytes()) for i, j in zip(edges, edges[1:])])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    refs, values = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        refs.append(np.frombuffer(blob, np.int64, n, 8))
        values.append(np.frombuffer(blob, _U, n, 8 + 8 * n))
    return np.concatenate(refs), np.concatenate(values)


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard")


def _screen(docs: DataFrame, shards: int) -> DataFrame:
    """ref and how many shingles of the screened share it may have in common with other classes (at least)."""

    def deal(batches):
        def of(batch, i, j, hashes, offsets):
            refs = _ref(hashes, offsets)
            take = hashes >> _U(63) == 0
            sums = np.r_[0, np.cumsum(take)]
            refs, hashes, offsets = _first_of_each(refs, hashes[take], sums[offsets])
            dealt = _deal(refs, hashes, np.repeat(np.arange(len(refs)), np.diff(offsets)), shards, 2)
            if dealt:
                yield _blob_rows(dealt)

        return _sets(batches, of)

    def collect(batches):
        def of(_, blobs):
            refs, _low, _level = _levels(blobs, 2)
            if len(refs):
                own, count = np.unique(refs, return_counts=True)
                yield _by_ref(own, count.astype(_U), shards)

        return _by_shard(batches, of)

    def add(batches):
        def of(_, blobs):
            refs, counts = _unpacked(blobs)
            own, place = np.unique(refs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(place, counts.astype(np.float64)).astype(np.int64))], names=["ref", "m"])

        return _by_shard(batches, of)

    dealt = _dealt(docs.select("text").mapInArrow(deal, "shard int, blob binary"), shards)
    return _dealt(dealt.mapInArrow(collect, "shard int, blob binary"), shards).mapInArrow(add, "ref long, m long")


def _rarest(sets: DataFrame, shards: int) -> DataFrame:
    """Links (a, b) between classes that share one of their rarest shingles: a star for each shingle."""

    def deal(batches):
        for batch in batches:
            raw = column(batch, "hashes").to_pylist()
            refs = column(batch, "ref").to_numpy()
            hashes = np.frombuffer(b"".join(raw), _U)
            owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            dealt = _deal(refs, hashes, owner, shards, 255)
            if dealt:
                yield _blob_rows(dealt)

    def collect(batches):
        def of(shard, blobs):
            refs, low, level = _levels(blobs, 255)
            if len(refs):
                yield _by_ref(refs, (level.astype(_U) << _U(56)) | (_U(shard & 0xFFFF) << _U(40)) | low, shards)

        return _by_shard(batches, of)

    def sizes(batches):
        for batch in batches:
            if batch.num_rows:  # level 0 marks a size
                yield _by_ref(column(batch, "ref").to_numpy(), column(batch, "n").to_numpy().astype(_U), shards)

    def stars(batches):
        """Rarest shingles of each class; classes of one bucket that share one are linked here, and one of them goes on."""

        def of(_, blobs):
            refs, values = _unpacked(blobs)
            order = np.lexsort((values, refs))
            refs, values = refs[order], values[order]
            new = np.r_[True, (refs[1:] != refs[:-1]) | (values[1:] != values[:-1])]
            refs, values = refs[new], values[new]
            begin = np.flatnonzero(np.r_[True, refs[1:] != refs[:-1]])  # the size comes first
            lens = np.diff(np.r_[begin, len(refs)]) - 1
            n = values[begin].astype(np.int64)
            take = np.clip(spare(n) + 1 - (n - lens), 0, lens)
            pick = concat_ranges(begin + 1, take)
            keys, owner = values[pick], refs[pick]
            if not len(keys):
                return
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            head = np.repeat(owner[first], np.diff(np.r_[first, len(keys)]))
            a, b = contract(owner, head)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys[first].view(np.int64), a]), pa.array(np.r_[owner[first], b]), pa.array(np.repeat([True, False], [len(first), len(a)]))], names=["a", "b", "is_key"])

        return _by_shard(batches, of)

    kind = "shard int, blob binary"
    dealt = _dealt(sets.select("ref", "hashes").mapInArrow(deal, kind), shards)
    back = dealt.mapInArrow(collect, kind).union(sets.select("ref", "n").mapInArrow(sizes, kind))
    found = written(_dealt(back, shards).mapInArrow(stars, "a long, b long, is_key boolean"), "stars")
    keyed = found.where("is_key").select(F.col("a").alias("key"), "b")
    heads = keyed.groupBy("key").agg(F.min("b").alias("head"))
    return found.where("NOT is_key").select("a", "b").union(keyed.join(heads, "key").where("b <> head").select(F.col("b").alias("a"), F.col("head").alias("b")))


def search(sizes: np.ndarray, hashes: np.ndarray, side: np.ndarray | None = None) -> Forest:
    """Components of sets (sizes, all hashes one after the other) under links of at least the likeness, by T-occurrence.

    Sets are asked for in turn until only sets of the largest component are left: a link from one of those to another
    component was found when the other's set was asked for, and links within a component add nothing.

    side: 0 and 1 for the sets of two chunks, of which only pairs across are looked for; those of side 1 are asked for.
    """
    m = len(sizes)
    forest = Forest(m)
    offsets = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(hashes, return_inverse=True)
    within = np.ones(len(code), bool) if side is None else side[owner] == 0
    order = np.flatnonzero(within)
    order = order[np.argsort(code[order], kind="stable")]  # inverted lists, each in ascending order of sets
    lists = owner[order]
    begins = np.searchsorted(code[order], np.arange(int(code.max()) + 2 if len(code) else 1))
    length = np.diff(begins)
    root, done = np.arange(m), np.zeros(m, bool)

    def ask(q: int) -> None:
        n = int(sizes[q])
        codes = code[offsets[q] : offsets[q + 1]]
        least = -(-n * NUMERATOR // DENOMINATOR)  # no linked set shares fewer
        lens = length[codes]
        by = np.argsort(lens, kind="stable")
        # DivideSkip: the more lists are left aside, the fewer entries are merged and the more candidates are probed
        longest = max(1, int(lens[by[-1]]))
        aside = min(least - 1, int(least / (0.05 * np.log2(longest) + 1)))
        short, long = codes[by[: n - aside]], codes[by[n - aside :]]
        count = np.bincount(lists[concat_ranges(begins[short], length[short])], minlength=m)
        found = np.flatnonzero(count >= max(1, least - aside))
        found = found[~done[found] & (root[found] != root[q])]
        found = found[(sizes[found] * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= sizes[found] * NUMERATOR)]
        while len(found):
            some, found = found[:16], found[16:]
            overlap = count[some].copy()
            for c in long:
                own = lists[begins[c] : begins[c + 1]]
                at = np.searchsorted(own, some)
                overlap += own[np.minimum(at, len(own) - 1)] == some if len(own) else 0
            linked = some[DENOMINATOR * overlap >= NUMERATOR * (n + sizes[some] - overlap)]
            if len(linked):
                for x in linked.tolist():
                    forest.union(q, x)
                mine = np.unique(root[np.r_[linked, q]])
                root[np.isin(root, mine)] = mine[0]
                found = found[root[found] != root[q]]

    if side is not None:
        for q in np.flatnonzero((side == 1) & (sizes > 0)).tolist():
            ask(q)
        return forest
    done[sizes == 0] = True
    while m:
        largest = int(np.bincount(root, minlength=m).argmax())
        left = np.flatnonzero(~done & (root != largest))
        if not len(left):
            break
        for q in left[:64].tolist():
            if root[q] != root[largest]:
                ask(q)
                done[q] = True
    return forest


def _search_task(key, table):
    """Links of one task's classes: each to the smallest of its component."""
    table = table.combine_chunks()
    if table.num_rows == 0:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    table = table.sort_by([("block", "ascending"), ("id", "ascending")])
    block, ids, side = (table[c].to_numpy() for c in ("block", "id", "side"))
    a, b = [], []
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        raw = table["hashes"][i:j].to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        roots = search(sizes, np.frombuffer(b"".join(raw), _U), side[i:j] if side[i] >= 0 else None).roots()
        other = np.flatnonzero(roots != np.arange(len(roots)))
        a.append(ids[i + other])
        b.append(ids[i + roots[other]])
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _searched(work: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the sets (ref) that lie in one task and block, in a written table."""
    rows = work.join(sets.select("ref", "hashes"), "ref").select("task", "block", "side", F.col("ref").alias("id"), "hashes")
    return written(rows.groupBy("task").applyInArrow(_search_task, "a long, b long"), "found")


def _search_large(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of blocks of several chunks (ref, n, block, sets, shingles, chunks, own).

    A few pivots of each block are asked for in each of its chunks; most near copies of one text then are in one
    component, the block's largest. Then every set that is not in it is asked for in each chunk. Links within the
    largest component add nothing, and each other link has an end that was asked for.
    """
    chunk = F.concat_ws(" ", "block", "own")
    share = F.least(F.lit(PIVOTS) / F.col("sets"), F.lit(CHUNK_SHINGLES) / F.col("shingles"))  # no more shingles than a chunk's
    pivots = large.where(F.pmod(F.xxhash64("ref", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    everywhere = pivots.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    work = large.select("ref", "block", chunk.alias("task"), F.lit(0).alias("side")).union(everywhere.select("ref", "block", chunk, F.lit(1)))
    first = _searched(work, sets)
    joined = large.join(components(first).withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    largest = joined.groupBy("block", "component").count().groupBy("block").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    rest = written(joined.join(largest, "block").where("component <> largest").drop("component", "largest"), "rest")
    parts = rest.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("parts"))
    task = F.concat_ws(" ", "block", "own", "part")
    asked = rest.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("ref", F.lit(2)), F.col("parts")).cast("int")).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    within = large.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = within.select("ref", "block", task.alias("task"), F.lit(0).alias("side")).union(asked.select("ref", "block", task, F.lit(1)))
    return first.union(_searched(work, sets))


def refs(text: pa.Array) -> pa.Array:
    """The class of each text, as classed() names it."""
    out = [np.zeros(0, np.int64)]
    for _ in _sets([pa.RecordBatch.from_arrays([text], names=["text"])], lambda batch, i, j, hashes, offsets: iter([out.append(_ref(hashes, offsets))])):
        pass
    return pa.array(np.concatenate(out))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return classed(docs).select("doc_id", "n_shingles", "component_id")


def classed(docs: DataFrame) -> DataFrame:
    """The columns of join(), and of every row the name of its text's class (ref) and one of its component's (component)."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    shards = min(partitions(spark), 65_536)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = written(texts.mapInArrow(_summaries, "doc_id long, ref long, n long, screened long"), "summaries")
    known = info.where("doc_id IS NOT NULL AND n > 0").groupBy("ref", "n", "screened").agg(F.min("doc_id").alias("id"))
    # 1: classes that may link to another
    lacking = F.col("screened") - F.coalesce("m", F.lit(0))
    room = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    left = written(known.join(_screen(texts.where("doc_id IS NOT NULL"), shards), "ref", "left").where(lacking <= room).select("ref", "id"), "screened")
    wanted = left.select(F.col("id").alias("doc_id"), F.col("ref").alias("own"))
    if left.count() <= 1_000_000:  # sixteen megabytes; more are joined by a shuffle
        wanted = F.broadcast(wanted)

    def whole(batches):
        def of(batch, i, j, hashes, offsets):
            refs, own = _ref(hashes, offsets), column(batch, "own")[i:j].to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(refs == own)  # a repeated doc_id may have another text
            yield pa.RecordBatch.from_arrays(
                [pa.array(refs[keep]), column(batch, "doc_id")[i:j].take(pa.array(keep)), pa.array(np.diff(offsets)[keep]), pa.array([hashes[offsets[k] : offsets[k + 1]].tobytes() for k in keep], pa.binary())],
                names=["ref", "id", "n", "hashes"],
            )

        return _sets(batches, of)

    sets = written(texts.join(wanted, "doc_id").mapInArrow(whole, "ref long, id long, n long, hashes binary").dropDuplicates(["ref"]), "sets")
    # 2: blocks of classes that share a rare shingle
    blocks = components(_rarest(sets, shards)).select(F.col("node").alias("ref"), F.col("component").alias("block"))
    sized = written(blocks.join(sets.select("ref", "n"), "ref"), "blocks")
    plan = sized.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    bins = max(1, int(-(-(sized.agg(F.sum("n")).first()[0] or 0) // CHUNK_SHINGLES)), -(-sized.count() // CHUNK_SETS), partitions(spark))
    placed = sized.join(plan.withColumn("chunks", chunks), "block")
    own = F.pmod(F.xxhash64("ref"), F.col("chunks")).cast("int")
    placed = written(placed.withColumn("own", own).select("ref", "n", "block", "sets", "shingles", "chunks", "own"), "placed")
    # 3: search within each task
    bundled = F.concat(F.lit("bin "), F.pmod(F.xxhash64("block"), F.lit(bins)).cast("string"))
    links = _searched(placed.where("chunks = 1").select("ref", "block", bundled.alias("task"), F.lit(-1).alias("side")), sets)
    large = placed.where("chunks > 1")
    if not large.isEmpty():
        links = links.union(_search_large(large, sets))
    found = written(components(links).select(F.col("node").alias("ref"), "component").join(sets.select("ref", "id"), "ref"), "components")
    smallest = found.groupBy("component").agg(F.min("id").alias("component_id"))
    found = found.join(smallest, "component").select("ref", "component", "component_id")
    classes = known.join(found, "ref", "left").select("ref", F.coalesce("component", "ref").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    whole_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = info.join(classes, "ref", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), whole_id).alias("component_id"), "ref", "component")
