"""Links between items of one table: candidates by shared keys, without all pairs of a group, and components.

Items that share a key may be linked; which are, a verifier decides. First each group is a star: one of its items with
each other. Verified stars give clusters. Then only pairs of one key but of different clusters are left, since a link
inside a cluster changes no component. A group of n near copies so costs about n verifications instead of n * n, and
no candidate between different clusters is dropped.

Nothing here brings all rows of a key to one task: keys are counted by sums that tasks make of what they read, and rows
meet these by joins, whose large partitions Spark splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, mix, release, sorted_set
from .scratch import Scratch

#: Keys of a share that are sent together, and of a range that are compared together.
SHARE, RANGE = 1_000_000, 1_000_000
#: Bits of keys, and of the filter of recurring keys.
KEY_BITS, FILTER_BITS = 40, 27
BUCKETS = 1 << 20


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): each item of an edge (a, b) and the least item it is connected with. Labels of neighbours and
    labels of labels are taken until none changes; every round is written and read again."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        further = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = new.join(further, "comp").select("id", "old", F.least("comp", "further").alias("comp"))
        new = scratch.save(new)
        labels = new.select("id", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels


def recurring(items: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """(key, id, kind) of rows (id, own, keys), ``total`` keys: those keys that different items may have. The first ``own`` keys
    of an item are of kind 1, others of kind 0.

    Prefixes of all keys are sent in ranges, sorted and as differences, with two bytes of the item; of what one share has
    for a key, two different items. A filter of fixed size of the prefixes that different items have leaves out most others."""
    bits = max(3, min(15, math.ceil(math.log2(max(1, total) / RANGE))))
    cut = U64(64 - KEY_BITS)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column("keys")
        return lists.flatten().to_numpy().view(U64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)

    def twice(prefix: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs, two at most of each prefix."""
        both = sorted_set(prefix << U64(16) | mark)
        prefix = both >> U64(16)
        again = np.zeros(len(prefix), bool)
        again[2:] = prefix[2:] == prefix[:-2]
        both = both[~again]
        return both >> U64(16), both & U64(0xFFFF)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, share, size = pa.Codec("zstd", 1), [], 0

        def out() -> pa.RecordBatch:
            prefix, mark = twice(*(np.concatenate(x) for x in zip(*share, strict=True)))
            of = (prefix >> U64(KEY_BITS - bits)).astype(np.int64)
            at = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).tolist() if len(of) else [0]
            blobs = [codec.compress(_planes(np.diff(prefix[i:j], prepend=U64(0))) + _planes(mark[i:j].astype(np.uint16)), asbytes=True) for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(of[at[:-1]].astype(np.int32)), pa.array(np.diff(at).astype(np.int32)), pa.array(blobs, pa.binary())], ["range", "size", "blob"])

        for batch in batches:
            keys, sizes = flat(batch)
            mark = mix(batch.column("id").to_numpy().view(U64)) >> U64(48)
            share.append((keys >> cut, np.repeat(mark, sizes)))
            size += len(keys)
            if size >= SHARE:
                yield out()
                share, size = [], 0
        if size:
            yield out()
            share = []
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, of, held = pa.Codec("zstd"), None, []

        def out() -> pa.RecordBatch:
            prefix, _ = twice(*(np.concatenate(x) for x in zip(*held, strict=True)))
            found = prefix[1:][prefix[1:] == prefix[:-1]]
            seen = sorted_set(found >> U64(KEY_BITS - FILTER_BITS)) & U64((1 << FILTER_BITS - bits) - 1)
            map_ = np.zeros(1 << FILTER_BITS - bits, bool)
            map_[seen.astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([pa.Codec("zstd", 1).compress(np.packbits(map_).tobytes(), asbytes=True)], pa.binary())], ["range", "map"])

        for batch in batches:
            for r, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != of:
                    if held:
                        yield out()
                    of, held = r, []
                data = codec.decompress(blob, n * 10, asbytes=True)
                held.append((np.cumsum(_unplaned(data[: 8 * n], U64), dtype=U64), _unplaned(data[8 * n :], np.uint16).astype(U64)))
        if held:
            yield out()
            held = []
        release()

    maps = items.select("id", "keys").mapInArrow(send, "range int, size int, blob binary").repartition(1 << bits, "range").sortWithinPartitions("range").mapInArrow(meet, "range int, map binary").toArrow()
    packed = np.zeros((1 << bits, 1 << FILTER_BITS - bits - 3), np.uint8)
    for r, m in zip(maps.column(0).to_pylist(), maps.column(1).to_pylist(), strict=True):
        packed[r] = np.frombuffer(pa.Codec("zstd").decompress(m, packed.shape[1], asbytes=True), np.uint8)
    seen = items.sparkSession.sparkContext.broadcast(packed.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = flat(batch)
            place = (keys >> U64(64 - FILTER_BITS)).astype(np.int64)
            ok = np.flatnonzero(seen.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
            begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
            kind = np.arange(len(keys)) - begin < np.repeat(batch.column("own").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), sizes)[ok]), pa.array(kind[ok].astype(np.int32))], ["key", "id", "kind"])
        release()

    return scratch.save(items.select("id", "own", "keys").mapInArrow(keep, "key long, id long, kind int"))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shared(items: DataFrame, scratch: Scratch, total: int | None = None) -> DataFrame:
    """(key, id, n): the keys of rows (id, own, keys) that different items have, one of them as a key of kind 1; n is the
    number of their rows. ``items`` are read twice; ``total`` is the number of their keys, if it is known."""
    if total is None:
        total = items.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    own = Scratch(scratch.spark, "keys")
    rows = recurring(items, own, total)
    counts = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("kind").alias("kind"), F.count("*").alias("n"))
    counts = own.save(counts.filter("lo < hi and kind = 1").select("key", "n"))
    out = scratch.save(rows.join(counts, "key").select("key", "id", "n").distinct())
    own.drop()
    scratch.free()
    return out


def stars(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): of each key of ``rows`` (key, id, n) its hub and each other item. The hub is the item whose keys have the most
    items in all, since the original of many copies shares all its keys with them, and a copy only those its own
    changes left; ties go to the least id."""
    weight = rows.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = rows.join(weight, "id").groupBy("key").agg(F.min_by("id", F.struct((-F.col("weight")).alias("w"), F.col("id"))).alias("a"))
    return rows.join(scratch.save(hubs), "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def mixed(rows: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``rows`` (key, id) with ``cluster``, of the keys that have different ones; items without a cluster are their own."""
    of = rows.select("key", "id").join(clusters.select("id", F.col("comp").alias("cluster")), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    own = Scratch(scratch.spark, "clusters")
    of = own.save(of)
    keys = own.save(of.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo < hi").select("key"))
    out = scratch.save(of.join(keys, "key"))
    own.drop()
    scratch.free()
    return out


def linked(rows: DataFrame, scratch: Scratch, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], star_rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect what all links of items of one key connect, and their components (id, comp).

    ``rows`` are (key, id, n) as of ``shared``; ``star_rows`` may be of fewer keys, for the stars. ``verify`` keeps the true
    links of (a, b). ``across`` makes links of rows (key, id, cluster) of keys with different clusters, as many as connect
    those clusters that a link connects.
    """
    first = scratch.save(verify(stars(rows if star_rows is None else star_rows, scratch)))
    scratch.free()
    clusters = components(first, scratch)
    rest = mixed(rows, clusters, scratch)
    second = scratch.save(across(rest).distinct())
    scratch.free()
    links = first.unionByName(second)
    return (links, clusters) if second.isEmpty() else (links, components(links, scratch))


def narrowed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be one of ``needed`` (id): those whose id shares a hash bucket with one. At most
    ``BUCKETS`` bucket numbers are broadcast, whatever the input, so the texts of other rows are not shuffled."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    few = needed.select(bucket.alias("bucket")).distinct()
    return docs.withColumn("bucket", bucket).join(F.broadcast(few), "bucket", "left_semi").drop("bucket")
