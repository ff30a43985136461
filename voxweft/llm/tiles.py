"""Comparison of the items of one key in tiles of bounded size, where they are.

Of a key's items those of its largest cluster and the others are cut into blocks of about ``size`` by a hash. Each pair of
blocks of the others, and each block of the others with one of the largest cluster, is a tile: a key of a third of all
rows becomes many tiles, no row of a large cluster is copied for another of that cluster, and no pair leaves a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import release
from .scratch import Scratch

SIZE = 512
#: Pairs that are made at a time, and elements of their sets that are compared at a time.
PAIRS, ELEMENTS = 1 << 18, 1 << 20


def tiles(rows: DataFrame, payload: DataFrame, scratch: Scratch, size: int = SIZE) -> DataFrame:
    """``rows`` (key, id, cluster) and the columns of ``payload`` (id, ...) with i, j and block, sorted by (key, i, j, id)."""
    sizes = rows.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    blocks = sizes.groupBy("key").agg(F.max(F.struct("n", "cluster")).alias("big"), F.sum("n").alias("n"))
    cut = lambda n: F.ceil(n / size).cast("int")
    blocks = blocks.select("key", F.col("big.cluster").alias("big"), cut(F.col("n") - F.col("big.n")).alias("others"), cut(F.col("big.n")).alias("bigs"))
    t = rows.join(scratch.save(blocks), "key")
    largest = F.col("cluster") == F.col("big")
    block = F.when(largest, F.col("others") + F.pmod(F.hash("id"), F.col("bigs"))).otherwise(F.pmod(F.hash("id"), F.greatest("others", F.lit(1))))
    t = t.withColumn("block", block)
    meets = F.transform(F.sequence(F.lit(0), F.col("others") - 1 + F.when(largest, 0).otherwise(F.col("bigs"))), lambda c: F.struct(F.least("block", c).alias("i"), F.greatest("block", c).alias("j")))
    t = t.filter("others > 0").select("key", "id", "cluster", "block", F.inline(meets)).join(payload, "id")
    return t.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")


def in_tiles(rows: DataFrame, payload: DataFrame, links_of: Callable[[list[dict]], list[tuple]], scratch: Scratch, size: int = SIZE) -> DataFrame:
    """(a, b): links that ``links_of`` finds in each tile of ``rows`` (key, id, cluster), with the columns of ``payload``
    (id, ...). It gets rows with key, i, j, id, cluster, block and those columns."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def out() -> pa.RecordBatch:
            found = links_of(held) if len({r["cluster"] for r in held}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for start in range(0, len(batch), 256):
                for row in batch.slice(start, 256).to_pylist():
                    if tile != (of := (row["key"], row["i"], row["j"])):
                        if len(held) > 1:
                            yield out()
                        tile, held = of, []
                    held.append(row)
        yield out()
        held = []
        release()

    return tiles(rows, payload, scratch, size).mapInArrow(compare, "a long, b long")


def with_partner(rows: DataFrame, payload: DataFrame, may_link: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], scratch: Scratch, size: int = SIZE, as_pairs: bool = False) -> DataFrame:
    """The rows (key, id, cluster) that ``may_link`` doesn't part from every row of their key of another cluster. It gets rows with
    the columns of ``payload`` and pairs of their numbers, and tells which of these may be links. With ``as_pairs`` those pairs
    (a, b), for items whose keys are so many that the pairs are fewer."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield found(t.slice(0, starts[-1]).combine_chunks(), np.append(starts[:-1], starts[-1]))
                left = t.slice(starts[-1])
            else:
                left = t
        if left is not None and len(left):
            yield found(left.combine_chunks(), np.array([0, len(left)]))
        left = None
        release()

    def found(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        key, id_, cluster, i, j, block = (t.column(c).to_numpy() for c in ("key", "id", "cluster", "i", "j", "block"))
        hit, lists = np.zeros(len(t), bool), []
        for x, y in pairs(starts):
            ok = (cluster[x] != cluster[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            x, y = x[ok], y[ok]
            ok = may_link(t, x, y)
            x, y = x[ok], y[ok]
            hit[x] = hit[y] = True
            lists.append(np.sort(np.stack([id_[x], id_[y]]), axis=0))
        if as_pairs:
            both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *lists], axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in both], ["a", "b"])
        at = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (key, id_, cluster)], ["key", "id", "cluster"])

    return tiles(rows, payload, scratch, size).mapInArrow(compare, "a long, b long" if as_pairs else "key long, id long, cluster long").distinct()


def pairs(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers inside tiles that begin at ``starts``, of which the last is the end; about ``PAIRS`` at a time."""
    n = np.diff(starts)
    for size in np.unique(n[n > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        of = starts[:-1][n == size]
        step = max(1, PAIRS // len(a))
        for k in range(0, len(of), step):
            yield (of[k : k + step, None] + a).ravel(), (of[k : k + step, None] + b).ravel()


def overlaps(values: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of sorted sets of small numbers (below 2 ** 20), one after another in ``values``, how many they share."""
    ends = np.cumsum((off[x + 1] - off[x]) + (off[y + 1] - off[y]))
    parts = np.searchsorted(ends, np.arange(ELEMENTS, ends[-1] + ELEMENTS, ELEMENTS), "right") if len(x) else []
    cut = np.unique([0, *parts, len(x)]).tolist()
    return np.concatenate([np.zeros(0, np.int64), *(_overlaps(values, off, x[i:j], y[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True))])


def _overlaps(values: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    keyed = []
    for of in (x, y):
        n = off[of + 1] - off[of]
        at = np.arange(int(n.sum())) + np.repeat(off[of] - (np.cumsum(n) - n), n)
        keyed.append(np.repeat(np.arange(len(of), dtype=np.int64) << 20, n) | values[at])
    p, q = keyed
    if not len(p) or not len(q):
        return np.zeros(len(x), np.int64)
    same = q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p
    return np.bincount(p[same] >> 20, minlength=len(x))


class Clusters:
    """Clusters of a tile's rows as links join them."""

    def __init__(self, rows: list[dict]):
        self.root = {r["cluster"]: r["cluster"] for r in rows}

    def find(self, c: int) -> int:
        root = self.root
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c


def comparable(rows: list[dict]) -> np.ndarray:
    """Which pairs of a tile's rows (first before second) are of different clusters, and of different blocks where the
    tile is of two."""
    cluster, block = (np.array([r[c] for r in rows]) for c in ("cluster", "block"))
    ok = np.triu(cluster[:, None] != cluster[None, :], 1)
    if rows[0]["i"] != rows[0]["j"]:
        ok &= block[:, None] != block[None, :]
    return ok


def jaccard_links(num: int, den: int, columns: int = 4096) -> Callable[[list[dict]], list[tuple]]:
    """Links of rows with sets ``s`` whose exact Jaccard index is num / den or more, as far as they join clusters.
    Intersections of all pairs are products of membership tables, so many elements at a time."""

    def links_of(rows: list[dict]) -> list[tuple]:
        sets = [np.array(r["s"], np.int64) for r in rows]
        size = np.array([len(s) for s in sets], np.float64)
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        kinds, element = np.unique(np.concatenate(sets), return_inverse=True)
        both = np.zeros((len(rows), len(rows)))
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        for a in range(0, len(kinds), columns):
            lo, hi = np.searchsorted(element, [a, a + columns])
            table = np.zeros((len(rows), min(columns, len(kinds) - a)), np.float32)
            table[owner[lo:hi], element[lo:hi] - a] = 1
            both += table @ table.T
        ok = comparable(rows) & (den * both >= num * (size[:, None] + size[None, :] - both))
        clusters, found = Clusters(rows), []
        for x, y in np.argwhere(ok).tolist():
            p, q = clusters.find(rows[x]["cluster"]), clusters.find(rows[y]["cluster"])
            if p != q:
                clusters.root[p] = q
                found.append((rows[x]["id"], rows[y]["id"]))
        return found

    return links_of
