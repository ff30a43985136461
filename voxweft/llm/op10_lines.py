"""Near-duplicate lines by a segment-partition edit join.

A line of at least ``min_chars`` code points is cut into threshold + 1 segments of even length. Two lines within the
threshold leave one segment of the shorter untouched, so the longer one holds it as a substring near its place. Lines
are indexed by (length, segment number, segment hash), and every line probes the indexes of its own and of the
``threshold`` next smaller lengths with the few substrings that a match-aware selection leaves (12 for a threshold of
2). Candidates are verified by banded bit-parallel edit distance of their whole texts. Linked lines are connected into
classes (see ``links``: stars first, then pairs between different clusters only). The latter are compared in ``tiles`` of
bounded size, and only if the counts of their letters allow the threshold.

With ``short_chars`` all lines are compared that aren't blank: two lines of which the shorter has ``short_chars`` to
``min_chars`` - 1 code points may differ by threshold - 1 edits and are found by segments of their own, still shorter
ones must be equal.

Equal lines are one item, known by a 64-bit hash of the text and collapsed within each slice of the input before
anything is shuffled. Of every class the first occurrence (by document id, then line number) stays and the others go.

Defined cases: null and empty texts have no lines; without ``short_chars`` shorter lines are left alone; lines that differ in letter case or
spaces are different by that many edits; repeated rows are further occurrences; an empty table gives an empty table;
other columns are not read. Rows of one doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, mix, powers, release, slices
from .links import linked, narrowed, shared
from .scratch import Scratch, read_table
from .tiles import Clusters, comparable, in_tiles

#: Groups of letters whose counts are compared before lines are.
GROUPS = 24
#: From so many code points on, lines of fewer than ``min_chars`` are compared with nearly equal ones.
SHORT = 8


def line_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, joined by line feeds; start, end and text number of each line."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.concatenate([[0], ends[:-1] + 1])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    return points, starts, ends, np.searchsorted(begins, starts, "right") - 1


class Prefix:
    """Hashes of any spans of an array of code points."""

    def __init__(self, points: np.ndarray):
        p, self.q = powers(len(points) + 1)
        self.total = np.zeros(len(points) + 1, U64)
        np.cumsum(mix(points.astype(U64) + U64(0x51ED27)) * p[: len(points)], out=self.total[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.total[e] - self.total[s]) * self.q[s] + (e - s).astype(U64))


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i (from 0) of lines of these lengths begins, and its length."""
    short, long = length // (tau + 1), length % (tau + 1)
    plain = tau + 1 - long
    return i * short + np.maximum(0, i - plain), short + (i >= plain)


def line_keys(h: Prefix, s: np.ndarray, e: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, one row for each line, of its own segments, and of the substrings that it probes with."""
    size = e - s
    key = lambda length, i, x: mix(x ^ mix(length.astype(U64) * U64(64) + U64(i)))
    own, probes = [], []
    for i in range(tau + 1):
        at, n = segment(size, i, tau)
        own.append(key(size, i, h(s + at, s + at + n)))
    for delta in range(tau + 1):
        less = size - delta
        for i in range(tau + 1):
            at, n = segment(less, i, tau)
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1):
                p = np.clip(at + shift, 0, np.maximum(size - n, 0))
                probes.append(key(less, i, h(s + p, s + p + n)))
    return np.stack(own, 1), np.stack(probes, 1)


def letter_counts(line: str, groups: int) -> np.ndarray:
    """For each of so many groups of letters, a 16-bit hash of how often the line has each letter of it."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = mix(points.astype(U64) + U64(0x2545F491))
    sums = np.bincount((h % U64(groups)).astype(np.int64), weights=((h >> U64(32)) & U64(0xFFFF)).astype(np.float64), minlength=groups)
    return (sums.astype(np.int64) & 0xFFFF).astype(np.uint16).view(np.int16)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k or less: common ends are cut, the rest is read in a band of k diagonals to
    either side, held in one machine word."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b or not k:
        return a == b
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= k
    return banded(a, b, k) <= k


def banded(a: str, b: str, k: int) -> int:
    """Edit distance if it is k or less, else something larger. Bit t of a column's word is row column - k + t, with
    vertical steps of +1 in ``up`` and of -1 in ``down``; the score is followed along the lowest diagonal, then along
    the last row."""
    m, n = len(a), len(b)
    width = 2 * k + 1
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    up, down, score = full ^ ((1 << k) - 1), 0, min(k, m)
    along = 1 << (min(m, k) + k - 1)
    for col in range(n):
        shift = col - k
        at = where.get(b[col], 0)
        match = (at >> shift if shift >= 0 else at << -shift) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus = down | (full & ~(zero | up))
        minus = zero & up
        if col + k < m:
            score += not zero & lowest
        else:
            score += bool(plus & along) - bool(minus & along)
            along >>= 1
        half = zero >> 1
        up = (minus | ~(half | plus)) & full
        down = half & plus
    return score


def near(tau: int, min_chars: int, short_chars: int | None) -> Callable[[str, str], bool]:
    """Whether two different lines are within the threshold that the shorter one's length has."""

    def check(a: str, b: str) -> bool:
        n = min(len(a), len(b))
        return within(a, b, tau if n >= min_chars else tau - 1) if n >= min_chars or short_chars is not None and n >= short_chars else False

    return check


def line_links(tau: int, check: Callable[[str, str], bool] | None = None) -> Callable[[list[dict]], list[tuple]]:
    """Links of a tile's lines as far as they join clusters. Lines within the threshold differ in the counts of 2 tau
    groups of letters at most; those are verified, unless links found before connect them."""
    check = check or (lambda a, b: within(a, b, tau))

    def links_of(rows: list[dict]) -> list[tuple]:
        counts = np.array([letter_counts(r["line"] or "", GROUPS) for r in rows])
        size = np.array([len(r["line"] or "") for r in rows])
        ok = comparable(rows) & (np.abs(size[:, None] - size[None, :]) <= tau)
        clusters, found = Clusters(rows), []
        for x in np.flatnonzero(ok.any(axis=1)).tolist():
            for y in np.flatnonzero(ok[x] & ((counts != counts[x]).sum(axis=1) <= 2 * tau)).tolist():
                p, q = clusters.find(rows[x]["cluster"]), clusters.find(rows[y]["cluster"])
                if p != q and check(rows[x]["line"] or "", rows[y]["line"] or ""):
                    clusters.root[p] = q
                    found.append((rows[x]["id"], rows[y]["id"]))
        return found

    return links_of


def batch_lines(key: pa.Array, column: pa.Array, tau: int, least: int, short: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of one batch of documents, slice by slice, a row for each different line: its hash, occurrences, and keys. Lines of
    ``least`` code points also have a row without occurrences, of the probes for lines shorter by one."""
    listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64)))
    for a, z in slices(column):
        texts = [t or "" for t in column.slice(a, z - a).to_pylist()]
        points, s, e, of = line_table(texts)
        first = np.searchsorted(of, np.arange(len(texts)))
        no = np.arange(len(s)) - first[of]
        keep = e - s >= least
        if short is not None:
            ink = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
            keep |= ink[e] > ink[s]
        s, e, of, no = s[keep], e[keep], of[keep], no[keep]
        h = Prefix(points)
        lines = h(s, e)
        order = np.lexsort((no, of, lines))
        new = np.append(True, lines[order][1:] != lines[order][:-1]) if len(order) else np.zeros(0, bool)
        lead = order[new]
        off = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
        occurrences = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([key.take(pa.array(of[order] + a)), pa.array(no[order].astype(np.int32))], ["doc", "no"]))
        size = e[lead] - s[lead]
        parts = [(size >= least, tau, True)]
        if short is not None:
            parts += [((size >= short) & (size < least), tau - 1, True), (size == least, tau - 1, False), (size < short, None, True)]
        for chosen, edits, whole in parts:
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            own = probes = np.zeros((len(at), 0), U64)
            if edits is not None:
                own, probes = line_keys(h, s[lead[at]], e[lead[at]], edits)
                if edits < tau:
                    own, probes = mix(own), mix(probes)
            at_of = occurrences.take(pa.array(at)) if whole else pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), occurrences.values.slice(0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(lines[lead[at]].view(np.int64)), at_of, listed(own if whole else own[:, :0]), listed(probes)], ["h", "at", "own", "probes"])


def near_lines(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 24, short_chars: int | None = None) -> DataFrame:
    """(doc, no, class_id, removed): each occurrence of a line of a class of two occurrences or more. Lines of fewer than
    ``min_chars`` code points are compared if ``short_chars`` is given."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(docs.dtypes)["id"]
    least = max(min_chars, 2 * (tau + 1))
    short = None if short_chars is None else min(least, max(short_chars, 2 * tau, 1))
    is_near = near(tau, least, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batch_lines(batch.column(0), batch.column(1), tau, least, short)

    # keys are most of what is known of a line, and go as soon as the shared ones are found
    keyed = Scratch(scratch.spark, "lines")
    every = keyed.save(docs.mapInArrow(run, f"h long, at array<struct<doc:{kind},no:int>>, own array<long>, probes array<long>"))
    items = every.select(F.col("h").alias("id"), F.size("own").alias("own"), F.concat("own", "probes").alias("keys"))
    rows = shared(items, scratch)
    lines = scratch.save(every.select("h", "at"))
    keyed.drop()

    def texts_of(needed: DataFrame) -> DataFrame:
        """(h, line) of lines (h), each from one of its occurrences."""
        where = lines.join(needed, "h", "left_semi").groupBy("h").agg(F.min(F.get("at", F.lit(0))).alias("o"))
        per_doc = where.groupBy(F.col("o.doc").alias("id")).agg(F.collect_list(F.struct(F.col("o.no").alias("no"), "h")).alias("want"))
        texts = narrowed(docs, per_doc).join(per_doc, "id").select("want", F.split("text", "\n", -1).alias("l"))
        texts = texts.select(F.inline(F.transform("want", lambda w: F.struct(w["h"].alias("h"), F.get("l", w["no"]).alias("line")))))
        return texts.dropDuplicates(["h"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs)
        texts = scratch.save(texts_of(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()))
        x, y = (texts.select(F.col("h").alias(c), F.col("line").alias(f"l{c}")) for c in "ab")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    keep = [is_near(p, q) for p, q in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

        return pairs.join(x, "a").join(y, "b").select("a", "b", "la", "lb").mapInArrow(check, "a long, b long")

    def across(rows: DataFrame) -> DataFrame:
        texts = texts_of(rows.select(F.col("id").alias("h")).distinct()).withColumnRenamed("h", "id")
        return in_tiles(rows, texts, line_links(tau, is_near), scratch)

    _, comp = linked(rows, scratch, verify, across)
    many = lines.groupBy("h").agg(F.sum(F.size("at")).alias("n"))
    many = many.join(comp.select(F.col("id").alias("h"), "comp"), "h", "left").filter("n > 1 or comp is not null").select("h", F.coalesce("comp", "h").alias("class_id"))
    many = scratch.save(many)
    first = lines.join(many, "h").groupBy("class_id").agg(F.min(F.array_min("at")).alias("first"))
    of = many.join(first, "class_id")
    out = lines.select("h", "at").join(of, "h").select("class_id", "first", F.explode("at").alias("o"))
    return out.select(F.col("o.doc").alias("doc"), F.col("o.no").alias("no"), "class_id", (F.col("o") != F.col("first")).alias("removed"))


def dedup_lines(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 24) -> DataFrame:
    """The documents without the lines that repeat an earlier one; a document that had lines and has none left goes.
    Columns stay as they are, whatever their names; null and empty texts stay."""
    removed = near_lines(df, scratch, id_col, text_col, tau, min_chars).filter("removed")
    gone = removed.groupBy("doc").agg(F.collect_set("no").alias("gone"))

    def without(text: Column) -> Column:
        numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        kept = lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.get(lines, i)), "\n")
        return F.get(F.transform(F.array(F.split(text, "\n", -1)), kept), F.lit(0))

    row, ink = F.col("row"), r"[^\x20\x09-\x0D]"
    t = df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).join(gone, row[id_col] == F.col("doc"), "left")
    same = F.col("gone").isNull() | F.coalesce(~row[text_col].rlike(ink), F.lit(True))
    t = t.select("row", same.alias("same"), F.when(same, row[text_col]).otherwise(without(row[text_col])).alias("left"))
    t = t.filter(F.col("same") | F.col("left").rlike(ink))
    return t.select(*[F.col("left").alias(c) if c == text_col else row[c].alias(c) for c in df.columns])


def op10_segment_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of lines that are equal or nearly so: doc_id, line_no, class_id, removed."""
    out = near_lines(read_table(spark, sf_dir, "documents"), Scratch(spark, "op10"), short_chars=SHORT)
    return out.select(F.col("doc").alias("doc_id"), F.col("no").alias("line_no"), "class_id", "removed")
