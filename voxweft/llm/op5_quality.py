"""Quality by the vote of nearest labelled neighbours in a latent-semantic space.

A text's terms are hashed byte pairs, pairs of byte classes, and two shares of words: those equal to the word before, and
those seen before in the text. Term counts are damped by a logarithm, weighted by inverse document frequency
over the labelled sample, and projected on the sample's leading singular vectors. The labelled vectors (``sample_rows``
rows of ``rank`` numbers, a bounded size) go to every worker; each document's cosines with all of them are exact,
computed in blocks by one matrix product, and the ``neighbours`` nearest vote with their similarity as weight.

Training reads a bounded sample of labelled rows, ``sample_rows`` at most, chosen by a hash of the id, of texts of
``SAMPLE_BYTES`` at most. An id with different labels has the least of them, one with different texts the first in order.
Scoring is one pass over the texts with no shuffle.

Defined cases: null and empty texts are one empty text, scored by the share of label 1 in the sample, as is everything
where there is nothing to learn from; similarities are compared by five digits, and all labelled rows as similar as the
last of the ``neighbours`` vote with them, so neither the order of labelled rows nor how texts fall into blocks decides who votes; very long texts are read whole; repeated rows each get their result; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import SPACE, buffer, slices, words
from .op1_langid import remainder
from .scratch import read_table

#: Longer texts aren't learned from, so the sample's size is bounded.
SAMPLE_BYTES = 200_000
PAIRS = 2048
TRAITS = 64
TERMS = PAIRS + TRAITS
_random = np.random.RandomState(11)
FOLD = _random.randint(0, PAIRS, 65536)
#: Classes of bytes for shapes: white space, small and capital letters, digits, closing marks, others, beyond ASCII.
CLASS = np.full(256, 5, np.int64)
CLASS[SPACE], CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 3, 6
for _c in b".,;:!?'\"()-":
    CLASS[_c] = 4


def counts(column: pa.Array) -> np.ndarray:
    """Damped term counts by row, each row of length 1 or 0."""
    data, off = buffer(column)
    rows = len(column)
    out = np.zeros((rows, TERMS), np.float32)
    if not len(data):
        return out
    _, _, s, e, row, h = words(column)
    n = np.maximum(1, np.bincount(row, minlength=rows))
    # words seen earlier in the same text
    order = np.lexsort((h, row))
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1]))
    repeated = np.bincount(row[order][again], minlength=rows) / n
    follow = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    doubled = np.bincount(row[follow], minlength=rows) / n
    kind = CLASS[data]
    shape = kind[:-1] * 8 + kind[1:]
    pair = FOLD[data[:-1].astype(np.int64) * 256 + data[1:]]
    for i in range(rows):
        a, z = off[i], max(off[i], off[i + 1] - 1)
        if z > a:
            out[i, :PAIRS] = np.bincount(pair[a:z], minlength=PAIRS)
            own = np.bincount(shape[a:z], minlength=64)
            out[i, :PAIRS] /= z - a
            out[i, PAIRS:] = own / (z - a)
    out = np.log1p(200 * out)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    out /= np.where(norm > 0, norm, 1)
    out[:, PAIRS + 56], out[:, PAIRS + 57] = doubled, repeated
    return out


@dataclass
class Neighbours:
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.idf - self.mean) @ self.axes
        norm = np.sqrt((v**2).sum(axis=1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def score(self, column: pa.Array) -> np.ndarray:
        terms = counts(column)
        empty = ~terms.any(axis=1)
        close = self.project(terms) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        close = np.round(close.astype(np.float64), 5)
        least = np.partition(close, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
        weight = np.where(close >= least, np.clip(close, 1e-6, 1) ** 4, 0)
        out = weight @ self.labels / weight.sum(axis=1)
        return np.where(empty, self.prior, np.clip(out, 0, 1)).astype(np.float64)


def fit(texts: list[str | None], labels: list[int], rank: int = 48, neighbours: int = 15) -> Neighbours | None:
    if not labels:
        return None
    column = pa.array(texts, pa.string())
    x = np.concatenate([counts(column.slice(a, z - a)) for a, z in slices(column)])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = x * idf
    mean = x.mean(axis=0)
    x = x - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False) if len(x) <= TERMS else (None, None, np.linalg.eigh(x.T @ x)[1][:, ::-1].T)
    axes = axes[:rank].T.astype(np.float32)
    v = x @ axes
    norm = np.sqrt((v**2).sum(axis=1, keepdims=True))
    y = np.array(labels, np.float32)
    return Neighbours(idf, mean, axes, (v / np.where(norm > 0, norm, 1)).astype(np.float32), y, float(y.mean()), neighbours)


def sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, where: Column | None = None) -> tuple[list, list]:
    """Texts and labels of at most ``sample_rows`` labelled rows, in the order of a hash of the id."""
    y = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    y = y if where is None else y.filter(where)
    y = y.groupBy("id").agg(F.min("y").alias("y"))
    chosen = y.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("quality sample")), "id", "y").limit(sample_rows)
    ids = chosen.collect()
    x = df.select(df[id_col].alias("id"), df[text_col].alias("text")).filter(F.col("id").isin([r["id"] for r in ids]) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES))
    x = x.groupBy("id").agg(F.min("text").alias("text")).collect()
    by = {r["id"]: r["text"] for r in x}
    rows = sorted((r["id"], r["y"]) for r in ids if r["id"] in by)
    return [by[i] for i, _ in rows], [v for _, v in rows]


def vote(df: DataFrame, model: Neighbours | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score`` of each row."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch.column(1)):
                for b in range(a, z, 512):
                    part = batch.slice(b, min(512, z - b))
                    score = model.score(part.column(1)) if model else np.full(len(part), 0.5)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])

    return docs.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


SAMPLE_ROWS = 2000


def op5_neighbours(spark: SparkSession, sf_dir: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    model = fit(*sample(docs, labels, "doc_id", "text", "quality", sample_rows, remainder("id", 5) != 0))
    out = vote(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
