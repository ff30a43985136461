"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are put into partitions by their number of shingles (powers of two). For a partition of at most u shingles every
document is read as windows of two neighbouring blocks of u shingles, so each contiguous occurrence of an item lies in
one window at most four times its size. An item that shares 0.8 of its shingles with such a window has a Jaccard index
of 0.19 at least; one of ``hashes`` minima being equal makes a candidate (bands of one row, tuned for recall: 64 miss
fewer than 2 of a million such). A candidate is verified over the whole document: the share of the item's distinct
shingles that the document holds, compared word by word.

Documents are read once for each block of items and never shuffled. Items are dealt to blocks by a hash, so that a block
holds half of ``BLOCK_BYTES`` on average (more where one item is longer, or repeated), whatever the number of items. Where
there are several blocks, each one's matches are written before the next is collected, so the driver holds one block.

Defined cases: null or empty texts and items have no shingle and match nothing; an item of fewer than k words is
searched as the one shingle of its own length; very long documents are read whole; repeated items or documents each
give their rows; empty tables give an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, shingles, slices, words
from .scratch import Scratch, read_table

BLOCK_BYTES = 16_000_000
LEAST_BLOCK = 8
_random = np.random.RandomState(7)
FACTORS = (_random.randint(1, 2**62, 256, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


def minima(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash function, 32 bits wide."""
    return ((h * FACTORS[j]) >> U64(32)).astype(np.uint32)


class Items:
    """The items of one block with shingles of k words: their distinct shingles, and minima by size partition."""

    def __init__(self, rows: np.ndarray, texts: pa.Array, k: int, hashes: int):
        self.k, self.hashes, self.rows = k, hashes, rows
        low, _, s, e, row, h = words(texts)
        sh, of, first = shingles(h, row, k, len(texts))
        self.content: list[dict[int, set[bytes]]] = [{} for _ in rows]
        for x, i, w in zip(sh.tolist(), of.tolist(), first.tolist(), strict=True):
            self.content[i].setdefault(x, set()).add(_shingle(low, s, e, w, k))
        self.sizes = [sum(map(len, c.values())) for c in self.content]
        self.known = [np.array(sorted(c), dtype=U64) for c in self.content]
        levels: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes):
            if n:
                levels.setdefault(max(LEAST_BLOCK, 1 << (n - 1).bit_length()), []).append(i)
        self.levels = []
        for u in sorted(levels):
            own = np.array(levels[u])
            values = np.stack([[minima(self.known[i], j).min() for j in range(hashes)] for i in own])
            order = np.argsort(values, axis=0, kind="stable")
            mins = np.take_along_axis(values, order, 0)
            seen = np.zeros((hashes, 65536), bool)
            for j in range(hashes):
                seen[j, mins[:, j] & 0xFFFF] = True
            self.levels.append((u, mins.T.copy(), own[order].T.copy(), seen))

    def candidates(self, h: np.ndarray, row: np.ndarray, rows: int) -> set[tuple[int, int]]:
        """(document row, item) pairs of which a window and the item have an equal minimum."""
        counts = np.bincount(row, minlength=rows)
        found: set[tuple[int, int]] = set()
        plans, width = [], 1
        for u, *rest in self.levels:
            step = u // width
            parts = -(-counts // step)
            ends = np.cumsum(parts)
            of = np.repeat(np.arange(rows), parts)
            nth = np.arange(len(of)) - np.repeat(ends - parts, parts)
            begins = np.repeat(np.cumsum(counts) - counts, parts) + nth * step
            plans.append((begins, of, np.flatnonzero(of[1:] == of[:-1]), rest))
            counts, width = parts, u
        for j in range(self.hashes):
            level = minima(h, j)
            for begins, of, pairs, (mins, own, seen) in plans:
                level = np.minimum.reduceat(level, begins)
                window = level.copy()
                window[pairs] = np.minimum(level[pairs], level[pairs + 1])
                at = np.flatnonzero(seen[j][window & 0xFFFF])
                if len(at):
                    lo, hi = np.searchsorted(mins[j], window[at], "left"), np.searchsorted(mins[j], window[at], "right")
                    for r, a, b in zip(of[at[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        found.update((r, int(i)) for i in own[j][a:b])
        return found

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(document row, item's row, shingles of the item, those the document has) of the candidates."""
        low, _, s, e, row, h = words(texts)
        sh, of, first = shingles(h, row, self.k, len(texts))
        if self.k > 1 and len(sh):
            whole = np.bincount(row, minlength=len(texts))[of] >= self.k
            sh, of, first = sh[whole], of[whole], first[whole]
        if not len(sh) or not self.levels:
            return
        begins = np.searchsorted(of, np.arange(len(texts) + 1))
        for r, i in sorted(self.candidates(sh, of, len(texts))):
            a, b = begins[r], begins[r + 1]
            hits = np.flatnonzero(np.isin(sh[a:b], self.known[i])) + a
            content = self.content[i]
            got = {c for t in hits.tolist() if (c := _shingle(low, s, e, first[t], self.k)) in content[int(sh[t])]}
            yield r, int(self.rows[i]), self.sizes[i], len(got)


def _shingle(low: np.ndarray, s: np.ndarray, e: np.ndarray, first: int, k: int) -> bytes:
    return b" ".join(low[s[w] : e[w]].tobytes() for w in range(first, min(first + k, len(s))))


def by_length(texts: pa.Array, k: int, hashes: int) -> list[Items]:
    """Items of k words or more together; shorter ones by their number of words."""
    counts = np.bincount(words(texts)[4], minlength=len(texts))
    return [Items(at, texts.take(pa.array(at)), n, hashes) for n in range(1, k + 1) if len(at := np.flatnonzero(counts >= k if n == k else counts == n))]


def find_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.8, hashes: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns: the document's id, the item's id, ``item_shingles``, ``shared``, ``containment``; a row for each
    document and item whose containment is ``threshold`` or more."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    items = items.select(items[item_id_col].alias("item"), items[item_text_col].alias("t")).filter(F.col("t").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes))
    scratch = Scratch(df.sparkSession, "op7") if blocks > 1 else None
    kinds = dict(docs.dtypes)["id"], dict(items.dtypes)["item"]
    schema = f"id {kinds[0]}, item {kinds[1]}, item_shingles long, shared long, containment double"
    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        table = block.toArrow().combine_chunks()
        names, texts = (table.column(c).combine_chunks() if table.num_rows else table.column(c) for c in ("item", "t"))
        found = by_length(texts, k, hashes) if table.num_rows else []

        def run(batches: Iterator[pa.RecordBatch], found: list[Items] = found, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, text = batch.column(0), batch.column(1)
                got = [(a + r, i, n, m) for a, z in slices(text) for f in found for r, i, n, m in f.search(text.slice(a, z - a)) if m >= threshold * n]
                if got:
                    r, i, n, m = (np.array(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(r)), names.take(pa.array(i)), pa.array(n), pa.array(m), pa.array(m / n)], ["id", "item", "item_shingles", "shared", "containment"])

        part = docs.mapInArrow(run, schema)
        part = scratch.save(part) if scratch else part
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_id_col})


def op7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP7_SQL = rf"""
WITH items AS (
  SELECT item_id, row_number() OVER () AS iid, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT iid, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), have AS (
  SELECT DISTINCT rid, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))
), sizes AS (
  SELECT iid, count(*) AS n FROM wanted GROUP BY 1
), shared AS (
  SELECT rid, doc_id, iid, item_id, count(*) AS shared FROM have JOIN wanted USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, n AS item_shingles, shared, shared / n AS containment FROM shared JOIN sizes USING (iid) WHERE shared >= 0.8 * n
"""
