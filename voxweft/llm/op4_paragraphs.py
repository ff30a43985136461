"""Repeated passages by MinHash banding of paragraphs.

Paragraphs are whole lines, and pieces of a text: it is cut after a word that is a better place than the ``least`` - 1
words to either side, where a line's end is better than a sentence's, that is better than any other word, and among
equals a hash of the word and its neighbours decides. So pieces have ``least`` words or more, short lines and sentences
go with their neighbours, long ones are cut, no word is left out of texts of ``least`` words, and a passage is cut alike
wherever it stands but at its ends. Paragraphs are compared by their sets of k-word shingles.
``BANDS`` bands of ``ROWS`` minima make candidates: 5 bands of 2 find 99 % of pairs of a Jaccard index of 0.8. Paragraphs
that collide in a band are joined (see ``links``: stars, then, in ``tiles`` of bounded size, pairs between different
clusters). What the ends of their shingles' hashes don't rule out is verified by the exact index of their sets, made
again from the texts, and links are connected into classes.

Equal paragraphs are one item, known by a 64-bit hash and collapsed within each batch before anything is shuffled.
A passage is a run of paragraphs of classes that occur in two documents or more, with gaps of ``least`` words at most;
runs that cover fewer than ``run_words`` words, such as a license line, are left alone. Of each class the first occurrence (by document id, then place) stays.

Defined cases: null and empty texts have no paragraph, nor have texts of fewer than ``least`` words;
repeated rows are further occurrences; an empty table gives an empty table; other columns are not read. Rows of one
doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import STEP, U64, buffer, lengths, mix, powers, slices, sorted_set, words
from .links import linked, narrowed, shared
from .op8_jaccard import verifier
from .scratch import Scratch, read_table
from .tiles import in_tiles, jaccard_links, overlaps, with_partner

BANDS, ROWS = 5, 2
CLOSE = np.zeros(256, bool)
CLOSE[list(b".!?")] = True
_random = np.random.RandomState(5)
FACTORS = (_random.randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


class Paragraphs:
    """Of many texts: each paragraph's row, first word in its text, number of words, hash, and shingles."""

    def __init__(self, column: pa.Array, k: int, least: int):
        low, off, s, e, row, h = words(column)
        n = len(h)
        feeds = np.concatenate([[0], np.cumsum(low == 10)])
        line = feeds[s]
        fresh = np.ones(n, bool)
        fresh[1:] = row[1:] != row[:-1]
        new = fresh.copy()
        new[1:] |= line[1:] != line[:-1]
        last, done = np.ones(n, bool), np.ones(n, bool)
        last[:-1], done[:-1] = new[1:], fresh[1:]
        # how good a cut after each word is: line ends first, then sentence ends, then a hash of the words around it
        around = np.zeros(n + 2, U64)
        around[1:-1] = h
        grade = np.where(last, 0, np.where(CLOSE[low[e - 1]], 1, 2)).astype(U64) if n else np.zeros(0, U64)
        value = (grade << U64(62)) | (mix(around[:-2] * STEP[0] + around[1:-1] * STEP[1] + around[2:] * STEP[2]) >> U64(2))
        best = np.ones(n, bool)
        for j in range(1, min(least, n)):
            best[j:] &= value[j:] < value[: n - j]
            best[: n - j] &= value[: n - j] < value[j:]
        # no cut leaves fewer than ``least`` words at either end of a text
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(fresh, place, 0)) if n else place
        end = np.minimum.accumulate(np.where(done, place, n)[::-1])[::-1] if n else place
        cut = done | (best & (place - begin + 1 >= least) & (end - place >= least))
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else ends
        # whole lines are paragraphs too
        whole = np.stack([np.flatnonzero(new), np.flatnonzero(last) + 1]) if n else np.zeros((2, 0), np.int64)
        both = np.unique(np.concatenate([np.stack([starts, ends]), whole], axis=1), axis=1)
        starts, ends = both[:, both[1] - both[0] >= least]
        p, q = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(h * p[:n], out=total[1:])
        self.hash = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))
        self.row = row[starts] if n else starts
        self.first = starts - np.searchsorted(row, self.row)
        self.size = ends - starts
        count = self.size - k + 1
        at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
        sh = np.zeros(len(at), U64)
        for j in range(k):
            sh += h[at + j] * STEP[j]
        self.shingles, self.begins = mix(sh), np.cumsum(count) - count
        self.ends = self.begins + count

    def keys(self) -> np.ndarray:
        """Band keys, one row for each paragraph."""
        if not len(self.begins):
            return np.zeros((0, BANDS), U64)
        out = []
        for b in range(BANDS):
            x = np.full(len(self.begins), b, U64)
            for f in FACTORS[b * ROWS : (b + 1) * ROWS]:
                x = mix(x * U64(3) + np.minimum.reduceat(self.shingles * f, self.begins))
            out.append(x)
        return np.stack(out, 1)

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """By paragraph the different 16-bit ends of its shingles, sorted, and where each paragraph's begin."""
        both = sorted_set(np.repeat(np.arange(len(self.begins)), self.ends - self.begins) << 16 | (self.shingles >> U64(48)).astype(np.int64))
        return (both & 0xFFFF).astype(np.uint16), np.searchsorted(both >> 16, np.arange(len(self.begins) + 1))


def may_reach(m: np.ndarray, ends: pa.Array, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of paragraphs may have an index of num / den, by the ends of their ``m`` shingles. Two sets share one more
    shingle than ends only where both have shingles that end alike, or that repeat."""
    off = np.concatenate([[0], np.cumsum(lengths(ends))]) // 2
    different = np.diff(off)
    ok = np.flatnonzero(den * np.minimum(m[x], m[y]) >= num * np.maximum(different[x], different[y]))
    p, q = x[ok], y[ok]
    both = overlaps(buffer(ends)[0].view(np.uint16), off, p, q) + np.minimum(m[p] - different[p], m[q] - different[q])
    keep = np.zeros(len(x), bool)
    keep[ok] = (den + num) * both >= num * (different[p] + different[q])
    return keep


def near_paragraphs(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, least: int = 8, run_words: int = 16) -> DataFrame:
    """(doc, first, n, class_id, removed): the paragraphs of repeated passages, by first word and number of words."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(docs.dtypes)["id"]
    least = max(least, k)
    last, scratch = scratch, Scratch(scratch.spark, "op4-search")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch.column(1)):
                p = Paragraphs(batch.column(1).slice(a, z - a), k, least)
                order = np.argsort(p.hash, kind="stable")
                new = np.append(True, p.hash[order][1:] != p.hash[order][:-1]) if len(order) else np.zeros(0, bool)
                lead = order[new]
                off = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
                at = pa.StructArray.from_arrays([batch.column(0).take(pa.array(p.row[order] + a)), pa.array(p.first[order].astype(np.int32)), pa.array(p.size[order].astype(np.int32))], ["doc", "first", "n"])
                keys = p.keys()[lead]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                values, begin = p.sketch()
                ends = [values[begin[i] : begin[i + 1]].tobytes() for i in lead.tolist()]
                size = (p.ends - p.begins)[lead].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(p.hash[lead].view(np.int64)), pa.ListArray.from_arrays(pa.array(off), at), listed, pa.array(size), pa.array(ends, pa.binary())], ["h", "at", "keys", "m", "ends"])

    wide = Scratch(scratch.spark, "op4-paragraphs")
    paras = wide.save(docs.mapInArrow(run, f"h long, at array<struct<doc:{kind},first:int,n:int>>, keys array<long>, m int, ends binary"))
    items = paras.withColumnRenamed("h", "id")
    # keys are read for the search of recurring ones only, and the table that has them goes
    rows = shared(items.select("id", F.lit(BANDS).alias("own"), "keys"), scratch, BANDS * paras.count())
    ids = rows.select("id").distinct()
    sketch = scratch.save(narrowed(items.select("id", "m", "ends"), ids).join(ids, "id", "left_semi").dropDuplicates(["id"]))
    paras = scratch.save(paras.select("h", "at"))
    items = paras.withColumnRenamed("h", "id")
    wide.drop()
    scratch.free()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                p = Paragraphs(part.column("text"), k, least)
                where = {x: i for i, x in enumerate(zip(p.row.tolist(), p.first.tolist(), p.size.tolist(), strict=True))}
                ids, found = [], []
                for r, want in enumerate(part.column("want").to_pylist()):
                    for w in want:
                        if (i := where.get((r, w["first"], w["n"]))) is not None:
                            ids.append(w["h"]), found.append(sorted_set(p.shingles[p.begins[i] : p.ends[i]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "s"])

    def sets_of(needed: DataFrame) -> DataFrame:
        where = paras.join(needed.withColumnRenamed("id", "h"), "h", "left_semi").groupBy("h").agg(F.min(F.get("at", F.lit(0))).alias("o"))
        per_doc = where.groupBy(F.col("o.doc").alias("id")).agg(F.collect_list(F.struct(F.col("o.first").alias("first"), F.col("o.n").alias("n"), "h")).alias("want"))
        return narrowed(docs, per_doc).join(per_doc, "id").select("text", "want").mapInArrow(sets, "id long, s array<long>")

    exact = verifier(sets_of, scratch, num, den)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (sketch.select(F.col("id").alias(c), F.col("m").alias(f"m{c}"), F.col("ends").alias(f"e{c}")) for c in "ab")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = np.concatenate([batch.column("ma").to_numpy(), batch.column("mb").to_numpy()])
                ends = pa.concat_arrays([batch.column("ea"), batch.column("eb")])
                at = np.arange(len(batch))
                yield batch.select(["a", "b"]).filter(pa.array(may_reach(m, ends, at, at + len(batch), num, den)))

        return exact(pairs.join(x, "a").join(y, "b").select("a", "b", "ma", "mb", "ea", "eb").mapInArrow(bound, "a long, b long"))

    def across(rows: DataFrame) -> DataFrame:
        may = lambda t, x, y: may_reach(t.column("m").to_numpy(), t.column("ends").combine_chunks(), x, y, num, den)
        near = scratch.save(with_partner(rows, sketch, may, scratch))
        return in_tiles(near, sets_of(near.select("id").distinct()), jaccard_links(num, den), scratch)

    _, comp = linked(rows, scratch, verify, across)
    docs_of = F.transform("at", lambda x: x["doc"])
    many = paras.groupBy("h").agg(F.min(F.array_min(docs_of)).alias("lo"), F.max(F.array_max(docs_of)).alias("hi"))
    many = many.join(comp.select(F.col("id").alias("h"), "comp"), "h", "left").filter("lo < hi or comp is not null").withColumn("class_id", F.coalesce("comp", "h"))
    many = scratch.save(many)
    several = many.groupBy("class_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("class_id")
    many = scratch.save(many.join(several, "class_id").select(F.col("h").alias("id"), "class_id"))
    scratch.free()
    found = last.save(narrowed(items.select("id", "at"), many).join(many, "id").select("class_id", "at"))
    scratch.drop()
    last.free()
    first = found.groupBy("class_id").agg(F.min(F.array_min("at")).alias("lead"))
    # a piece of the line that stays, or a line around the piece, stays with it
    apart = lambda o: (o["doc"] != F.col("lead.doc")) | (o["first"] >= F.col("lead.first") + F.col("lead.n"))
    marked = F.transform("at", lambda o: F.struct(o["doc"].alias("doc"), o["first"].alias("first"), o["n"].alias("n"), apart(o).alias("removed")))
    out = found.join(first, "class_id").select("class_id", marked.alias("at")).select("class_id", F.inline("at"))
    in_doc = Window.partitionBy("doc").orderBy("first", "n", "class_id")
    reach = F.coalesce(F.max(F.col("first") + F.col("n")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-least - 1))
    out = out.withColumn("reach", reach).withColumn("more", F.greatest(F.lit(0), F.col("first") + F.col("n") - F.greatest("first", "reach")))
    out = out.withColumn("run", F.sum((F.col("first") > F.col("reach") + least).cast("int")).over(in_doc))
    out = out.withColumn("words", F.sum("more").over(Window.partitionBy("doc", "run")))
    return out.filter(F.col("words") >= run_words).select("doc", "first", "n", "class_id", "removed")


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of repeated passages: doc_id, first_word, n_words, class_id, removed."""
    out = near_paragraphs(read_table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return out.select(F.col("doc").alias("doc_id"), F.col("first").alias("first_word"), F.col("n").alias("n_words"), "class_id", "removed")
