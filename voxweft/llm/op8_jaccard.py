"""Join of documents by the Jaccard index of their word n-grams, with size-banded tiles and hashed bitmaps.

A document's set is the 64-bit hashes of its distinct k-word shingles. Documents with one set are one class; classes
are joined. Two sets can reach the threshold only if they share one of their first elements in a common order (as many
as may be missing, and one more), so candidates share such an element. The order puts elements that many documents
have last, which keeps the groups of an element small. Within a group candidates meet in tiles of neighbouring size
bands; in a tile the number of differing bits of their parity bitmaps (1,024 bits, and 8,192 of large sets) bounds their
overlap from above, and pairs that can't reach the threshold go. The rest, once for all elements they share, is verified
by exact intersection of the sorted arrays, made again from the texts of candidates only.

Near copies come first: stars on four minima join them into clusters (see ``links``), and the exact candidates are
only made between clusters.

Exact up to equal 64-bit hashes of different shingles. The elements that go last are found over all documents: each
task counts what it reads, and the most frequent, ``LAST`` at most, go last; which ones these are changes the work, not the
links. Rows of one id are one document: if their texts differ, what any of them is linked with is connected (see ``ngram_join``).

Defined cases: null texts and texts without words have an empty set and no link; texts of fewer than k words have one
shingle, their whole sequence; equal sets are linked; repeated rows each get their result; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, buffer, mix, shingles, slices, sorted_set, words
from .links import components, linked, narrowed, shared
from .scratch import Scratch, least_common, read_table
from .tiles import with_partner

LAST = 1 << 18
#: Elements that a task counts at a time.
SHARE = 2_000_000
MINIMA = 4
WORDS64 = 16
#: Sets of this size or more have a second bitmap, of so many words of 64 bits.
WIDE_FROM, WIDE = 1000, 128
#: Pairs of one document that are verified together.
PART = 2000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    for a, z in slices(texts):
        part = texts.slice(a, z - a)
        _, _, _, _, row, h = words(part)
        sh, of, _ = shingles(h, row, k, len(part))
        at = np.searchsorted(of, np.arange(len(part) + 1))
        for r in range(len(part)):
            yield sorted_set(sh[at[r] : at[r + 1]])


def prefix_length(n: int, num: int, den: int) -> int:
    """First elements of which two sets that reach num/den share one."""
    return n - -(-num * n // den) + 1


def frequent(docs: DataFrame, scratch: Scratch, k: int) -> np.ndarray:
    """The elements that most documents have, ``LAST`` at most, of those that one share has twice; sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate([np.zeros(0, U64), *held]), return_counts=True)
            held.clear()
            v, n = v[n >= 2], n[n >= 2]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        size = 0
        for batch in batches:
            for s in sets(batch.column(1), k):
                held.append(s)
                size += len(s)
                if size >= SHARE:
                    yield out()
                    size = 0
        yield out()

    found = scratch.save(docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 4"))
    most = found.filter(F.col("n") >= least_common(found, LAST)).select("h").toArrow()
    return np.sort(most.column(0).to_numpy().view(U64))


def parities(m: np.ndarray, words64: int) -> bytes:
    """A bitmap of 64 * words64 bits: which hold an odd number of the set's elements."""
    odd = np.bincount((m & U64(64 * words64 - 1)).astype(np.int64), minlength=64 * words64) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_reach(n: np.ndarray, bits: pa.Array, wide: pa.Array, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets may have an index of num / den, by sizes and by the bits in which their bitmaps differ."""
    least = (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])).nonzero()[0]
    for column, words64 in ((bits, WORDS64), (wide, WIDE)):
        has = column.is_valid().to_numpy(zero_copy_only=False)
        place = np.cumsum(has) - 1
        table = buffer(column)[0].view(U64).reshape(-1, words64)
        keep = np.ones(len(least), bool)
        for a in range(0, len(least), 1 << 16):
            of = least[a : a + (1 << 16)]
            p, q = x[of], y[of]
            both = np.flatnonzero(has[p] & has[q])
            p, q = p[both], q[both]
            differ = np.bitwise_count(table[place[p]] ^ table[place[q]]).sum(axis=1, dtype=np.int64)
            keep[a + both] = (den + num) * (n[p] + n[q] - differ) >= 2 * num * (n[p] + n[q])
        least = least[keep]
    out = np.zeros(len(x), bool)
    out[least] = True
    return out


def signatures(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """Of (id, text): id, n, h1, h2 (hashes of the set), the bitmap, minima and first elements."""
    last = frequent(docs, scratch, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, bits, wide, mins, first = [], [], [], [], [], []
            for s in sets(batch.column(1), k):
                n.append(len(s))
                if not len(s):
                    hashes.append((0, 0)), bits.append(None), wide.append(None), mins.append([]), first.append([])
                    continue
                m = mix(s)
                hashes.append((int(s.sum().astype(np.int64)), int(m.sum().astype(np.int64))))
                bits.append(parities(m, WORDS64))
                wide.append(parities(m, WIDE) if len(s) >= WIDE_FROM else None)
                mins.append([int(x) for x in mix((s[None, :] * FACTORS[:, None]).min(axis=1) ^ FACTORS).astype(np.int64)])
                p = prefix_length(len(s), num, den)
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                first.append(np.concatenate([s[~late], s[late]])[:p].astype(np.int64))
            h = np.array(hashes, np.int64).reshape(-1, 2)
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(mins, longs), pa.array(first, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "bits", "wide", "mins", "first"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, bits binary, wide binary, mins array<long>, first array<long>")


def text_sets(docs: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    """Makes (id, s), the sets of documents of a table (id), from their texts."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(np.int64) for s in sets(part.column(1), k)], pa.list_(pa.int64()))], ["id", "s"])

    return lambda needed: narrowed(docs, needed).join(needed, "id", "left_semi").mapInArrow(arrays, "id long, s array<long>")


def verifier(sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs (a, b) whose sets reach the threshold. The sets of a pair meet by a; an a of many pairs has its
    set in several parts of ``PART`` pairs."""

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lead = None, np.zeros(0, U64)
        for batch in batches:
            data, off = _flat(batch.column("s"))
            found = []
            for i, (a, salt, member, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "id")), strict=True)):
                s = data[off[i] : off[i + 1]]
                if not member:
                    of, lead = (a, salt), s.copy()
                elif of == (a, salt):
                    both = overlap(lead, s)
                    if den * both >= num * (len(lead) + len(s) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs.select("a", "b").distinct())
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        members = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("salt"), F.lit(True).alias("member"))
        leads = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
        want = scratch.save(members.unionByName(leads))
        rows = sets_of(want.select("id").distinct()).join(want, "id").select("a", "salt", "member", "id", "s")
        return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(intersect, "a long, b long").distinct()

    return verify


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(U64), off


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def ngram_join(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row: the id, ``n_shingles`` and ``component_id``, the least id it is connected with by links of a
    Jaccard index of num/den or more, itself included.

    Ids are of any type that has an order. Rows of one id are one document of several texts: what any of them is linked with is
    connected. Where ids repeat, are null or are no whole numbers, rows are numbered first and their components are put together by id
    afterwards; rows without an id are connected by links alone."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    whole = dict(docs.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and docs.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        out = joined(docs.select(F.col("id").cast("long"), "text"), scratch, k, num, den)
        return out.select(F.col("id").alias(id_col), "n_shingles", F.col("comp").alias("component_id"))
    rows = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()))
    found = joined(rows.select(F.col("row").alias("id"), "text"), scratch, k, num, den).withColumnRenamed("id", "row")
    found = scratch.save(found.join(rows.select("row", F.col("id").alias("doc")), "row"))
    least = found.filter("doc IS NOT NULL").groupBy("doc").agg(F.min("comp").alias("a"))
    edges = found.join(least, "doc").select("a", F.col("comp").alias("b")).filter("a <> b").distinct()
    merged = components(edges, scratch).select(F.col("id").alias("comp"), F.col("comp").alias("whole"))
    out = scratch.save(found.join(merged, "comp", "left").withColumn("whole", F.coalesce("whole", "comp")))
    names = out.groupBy("whole").agg(F.min("doc").alias("component_id"))
    return out.join(names, "whole").select(F.col("doc").alias(id_col), "n_shingles", "component_id")


def joined(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """(id, n_shingles, comp) of texts with different whole numbers as ids."""
    sig = scratch.save(signatures(docs, scratch, k, num, den))
    classes = sig.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("node"))
    own = sig.filter("n > 0").join(classes, ["n", "h1", "h2"])
    nodes = scratch.save(own.filter("id = node").select("id", "n", "bits", "wide", "mins", "first").dropDuplicates(["id"]))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("long")
    minima = scratch.save(nodes.select("id", F.lit(MINIMA).alias("own"), F.transform("mins", lambda m, j: F.xxhash64(j, m, band)).alias("keys")))
    rows = shared(nodes.select("id", F.size("first").alias("own"), F.col("first").alias("keys")), scratch)
    bounds = nodes.select("id", "n", "bits", "wide")
    sets_of = text_sets(docs, k)
    exact = verifier(sets_of, scratch, num, den)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (bounds.select(F.col("id").alias(c), *(F.col(v).alias(v + c) for v in ("n", "bits", "wide"))) for c in "ab")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, bits, wide = (pa.concat_arrays([batch.column(v + "a"), batch.column(v + "b")]) for v in ("n", "bits", "wide"))
                at = np.arange(len(batch))
                yield batch.select(["a", "b"]).filter(pa.array(may_reach(n.to_numpy(), bits, wide, at, at + len(batch), num, den)))

        return exact(pairs.join(x, "a").join(y, "b").mapInArrow(bound, "a long, b long"))

    def across(rows: DataFrame) -> DataFrame:
        """Links of one element's sets; those of sizes that can't reach the threshold lie in bands that are not neighbours."""
        size = rows.join(bounds.select("id", "n"), "id").withColumn("band", octave(F.col("n")))
        size = size.withColumn("band", F.explode(F.array_distinct(F.array(F.col("band"), octave(F.col("n") * den / num)))))
        banded = size.select(F.xxhash64("key", "band").alias("key"), "id", "cluster")
        may = lambda t, x, y: may_reach(t.column("n").to_numpy(), t.column("bits").combine_chunks(), pa.nulls(len(t), pa.binary()), x, y, num, den)
        return verify(scratch.save(with_partner(banded, bounds.drop("wide"), may, scratch, as_pairs=True)))

    octave = lambda n: F.floor(F.log2(n) + 1e-9).cast("int")
    _, comp = linked(rows, scratch, verify, across, shared(minima, scratch))
    node = sig.select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    out = node.join(comp.withColumnRenamed("id", "node"), "node", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node", "id").alias("comp"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    return ngram_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch, k=3, num=90, den=100)


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
