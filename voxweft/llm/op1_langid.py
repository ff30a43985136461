"""Language of every word by a linear-chain conditional random field, and of every text by its words.

A word is a run of letters. Its features are the byte n-grams (2 to 4) of the word between boundary marks, so affixes
are features of their own, and its lexicon entry if the training sample has it often enough. Emission weights,
transitions and starts are learned together by stochastic gradient ascent on the conditional log-likelihood, on runs
of ``RUN`` words; part of the runs are spliced of two documents, so switches between languages are learned too.
Prediction runs forward-backward over each whole text as one chain, and sums the words' marginals: the text's language has
the largest sum, its score is that sum's share. Texts are cut in runs of ``RUN`` words for the work alone; messages go
from run to run.

Training reads a bounded sample of labelled rows: about ``sample_docs`` documents of each language, twice as many at most,
chosen by a hash of the id, of texts of ``SAMPLE_BYTES`` at most. Prediction is one pass over the texts with no shuffle; the model (2^18 hashed weights for each language) goes
to the workers with the function.

Defined cases: texts that are null or have no letter get ``und`` and score 0; rows with a null language aren't learned
from; with nothing to learn from all texts get ``und``; ties go to the language that sorts first; very long texts are
read whole; repeated rows each get their result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, buffer, mix, slices, span_hashes, spans
from .scratch import read_table

RUN = 64
#: Longer texts aren't learned from, so the sample's size is bounded.
SAMPLE_BYTES = 200_000
BUCKETS = 1 << 18
NGRAMS = (2, 3, 4)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ASCII_LETTER = LETTER & (np.arange(256) < 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z and the two-byte capitals of Latin-1), row offsets, and the words' starts, ends, rows."""
    data, off = buffer(column)
    low = LOWER[data]
    if len(low) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    return low, off, *spans(LETTER[data], off)


def features(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words one after another, and where each word's begin (one more than words)."""
    size = e - s + 2
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) + max(NGRAMS), U64)
    at = np.arange(int((e - s).sum())) + np.repeat(begin + 1 - (np.cumsum(e - s) - (e - s)), e - s)
    flat[at] = low[np.arange(len(at)) + np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s)]
    flat[begin], flat[begin + size - 1] = 1, 2
    n = len(flat) - max(NGRAMS)
    word = np.repeat(np.arange(len(s)), size)
    left = np.repeat(begin + size, size) - np.arange(n)
    hashes, owners = [], []
    for k in NGRAMS:
        h = np.full(n, k, U64)
        for j in range(k):
            h = h * U64(1099511628211) + flat[j : j + n]
        ok = left >= k
        hashes.append((mix(h[ok]) & U64(BUCKETS - 1)).astype(np.int64)), owners.append(word[ok])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(np.concatenate(owners)[order], np.arange(len(s) + 1))


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of rows with these counts: each one's place in a (run, RUN) table; the runs' rows; their lengths."""
    per = -(-counts // RUN)
    row = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(RUN, np.repeat(counts, per) - nth * RUN)
    place = np.arange(int(counts.sum())) + np.repeat(np.arange(len(row)) * RUN - (np.cumsum(length) - length), length)
    return place, row, length


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From log potentials: marginals (run, RUN, label), and the forward and backward messages of which neighbours'
    joint marginals are made; what lies beyond a run's length is of no meaning. ``start`` holds log weights of a run's first
    label, of all runs or by run; ``last`` the backward messages by run at its last word, if the text goes on."""
    t = emit.shape[1]
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    if last is not None:
        beta[:] = last[:, None, :]
    alpha[:, 0] = e[:, 0] * np.exp(start - start.max(axis=-1, keepdims=True))
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (e[:, i + 1] * beta[:, i + 1]) @ a.T
        beta[:, i] = np.where((length > i + 1)[:, None], x / x.sum(axis=1, keepdims=True), beta[:, i])
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), alpha, e * beta


def chained(emit: np.ndarray, length: np.ndarray, row: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of whole texts as ``runs`` cuts them. The runs of a text are one chain: each run's product of transitions and
    emissions takes the forward message from run to run, and the backward message the other way."""
    n, k = len(row), len(start)
    first = np.append(True, row[1:] != row[:-1])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    nth = np.arange(n) - begin
    if not nth.any():
        return forward_backward(emit, length, trans, start)[0]
    several = np.repeat(np.diff(np.append(np.flatnonzero(first), n)) > 1, np.diff(np.append(np.flatnonzero(first), n)))
    e = np.exp(emit - emit.max(axis=2, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max()).astype(np.float64)
    # of first runs the forward message after them, of the others the product of all their steps
    at = np.flatnonzero(several & first)
    ahead = np.zeros((n, k))
    x = np.exp(start - start.max()) * e[at, 0]
    for i in range(1, emit.shape[1]):  # the first run of several is full
        x = (x @ a) * e[at, i]
        x /= x.sum(axis=1, keepdims=True)
    ahead[at] = x
    later = np.flatnonzero(several & ~first)
    step = np.broadcast_to(np.eye(k), (len(later), k, k)).copy()
    for i in range(emit.shape[1]):
        new = (step @ a) * e[later, i][:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        step = np.where((length[later] > i)[:, None, None], new, step)
    product = np.zeros((n, k, k))
    product[later] = step
    order = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[order], np.arange(int(nth.max()) + 2))
    behind = np.ones((n, k))
    for d in range(1, len(cut) - 1):
        of = order[cut[d] : cut[d + 1]]
        x = np.einsum("ni,nij->nj", ahead[of - 1], product[of])
        ahead[of] = x / x.sum(axis=1, keepdims=True)
    for d in range(len(cut) - 2, 0, -1):
        of = order[cut[d] : cut[d + 1]]
        x = np.einsum("nij,nj->ni", product[of], behind[of])
        behind[of - 1] = x / x.sum(axis=1, keepdims=True)
    entry = np.tile(start.astype(np.float64), (n, 1))
    entry[later] = np.log(np.maximum(ahead[later - 1] @ a, 1e-300))
    return forward_backward(emit, length, trans, entry.astype(emit.dtype), behind.astype(emit.dtype))[0]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    known: np.ndarray
    known_weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Of different words."""
        f, at = features(low, s, e)
        out = np.add.reduceat(self.weights[f], at[:-1], axis=0)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[i] == hashes
            out[hit] += self.known_weights[i[hit]]
        return out

    def marginals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Marginals by word, and the number of words by row."""
        low, off, s, e, row = letters(column)
        counts = np.bincount(row, minlength=len(column))
        if not len(s):
            return np.zeros((0, len(self.labels)), np.float32), counts
        h = span_hashes(low, s, e)
        u, first, word = np.unique(h, return_index=True, return_inverse=True)
        by_word = self.emissions(low, s[first], e[first], u)
        place, of, length = runs(counts)
        table = np.zeros((len(length) * RUN, len(self.labels)), np.float32)
        table[place] = by_word[word]
        out = chained(table.reshape(-1, RUN, len(self.labels)), length, of, self.trans, self.start)
        return out.reshape(-1, len(self.labels))[place], counts


def train(texts: list[str], langs: list[str], epochs: int = 4, lexicon_least: int = 3, rate: float = 0.3, spliced: float = 0.3, seed: int = 1) -> Crf | None:
    """Fits the field to whole texts, all words of a text bearing its language."""
    labels = sorted(set(langs))
    if not labels:
        return None
    column = pa.array(texts, pa.string())
    low, _, s, e, row = letters(column)
    if not len(s):
        return None
    rng = np.random.RandomState(seed)
    gold = np.array([labels.index(x) for x in langs])
    h = span_hashes(low, s, e)
    u, first, word, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    f, at = features(low, s[first], e[first])
    lex = np.flatnonzero(count >= lexicon_least)
    slot = np.full(len(u), -1)
    slot[lex] = np.arange(len(lex))
    k = len(labels)
    place, of, length = runs(np.bincount(row, minlength=len(texts)))
    ids, tags = np.full(len(length) * RUN, -1), np.zeros(len(length) * RUN, np.int64)
    ids[place], tags[place] = word, gold[row]
    ids, tags = ids.reshape(-1, RUN), tags.reshape(-1, RUN)
    for i in np.flatnonzero(rng.rand(len(length)) < spliced):
        j = rng.randint(len(length))
        a, b = rng.randint(1, length[i] + 1), rng.randint(1, length[j] + 1)
        b = min(b, RUN - a)
        if b > 0:
            ids[i, a : a + b], tags[i, a : a + b] = ids[j, :b], tags[j, :b]
            ids[i, a + b :] = -1
            length[i] = a + b
    w, lw = np.zeros((BUCKETS, k), np.float32), np.zeros((len(lex), k), np.float32)
    trans, start = np.zeros((k, k)), np.zeros(k)
    gw, gl, gt, gs = (np.full(x.shape, 1e-6) for x in (w[:, :1], lw[:, :1], trans, start))
    one = np.eye(k, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(length))
        for b in range(0, len(order), 128):
            x = order[b : b + 128]
            wid, y, n = ids[x], tags[x], length[x]
            mask = np.arange(RUN) < n[:, None]
            uu, inv = np.unique(wid[mask], return_inverse=True)
            spans_ = [np.arange(at[i], at[i + 1]) for i in uu]
            flat = f[np.concatenate(spans_)]
            owner = np.repeat(np.arange(len(uu)), [len(z) for z in spans_])
            em = np.zeros((len(uu), k), np.float32)
            np.add.at(em, owner, w[flat])
            has = slot[uu] >= 0
            em[has] += lw[slot[uu][has]]
            table = np.zeros((*wid.shape, k), np.float32)
            table[mask] = em[inv]
            p, ahead, behind = forward_backward(table, n, trans, start)
            d = np.where(mask[:, :, None], one[y] - p, 0)
            g = np.zeros((len(uu), k), np.float32)
            np.add.at(g, inv, d[mask])
            inner = mask[:, 1:]
            joint = ahead[:, :-1][inner][:, :, None] * np.exp(trans)[None] * behind[:, 1:][inner][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1][inner], y[:, 1:][inner]), 1)
            dt, ds = (seen - joint.sum(0)) / len(x) - 0.01 * trans, (one[y[:, 0]] - p[:, 0]).mean(0) - 0.01 * start
            gf = np.zeros((BUCKETS, k), np.float32)
            np.add.at(gf, flat, g[owner])
            touched = np.flatnonzero(gf.any(axis=1))
            gf = gf[touched]
            gw[touched, 0] += (gf**2).mean(axis=1)
            w[touched] += rate * gf / np.sqrt(gw[touched]) - 1e-4 * w[touched]
            gg, own = g[has], slot[uu][has]
            gl[own, 0] += (gg**2).mean(axis=1)
            lw[own] += rate * gg / np.sqrt(gl[own])
            gt += dt**2
            gs += ds**2
            trans += rate * dt / np.sqrt(gt)
            start += rate * ds / np.sqrt(gs)
    order = np.argsort(u[lex])
    return Crf(labels, w, u[lex][order], lw[order], trans.astype(np.float32), start.astype(np.float32))


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, where: Column | None = None) -> tuple[list[str], list[str]]:
    """About ``sample_docs`` texts of each language, and their languages; twice as many at most, of ``SAMPLE_BYTES`` at most."""
    t = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang"))
    t = t.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    t = t if where is None else t.filter(where)
    counts = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    take = F.lit(False)
    for lang, n in sorted(counts.items()):
        take = take | ((F.col("lang") == lang) & (share < min(1.0, sample_docs / n)))
    rows = sorted((r["id"], r["lang"], r["text"]) for r in t.filter(take).orderBy(share, "id", "text", "lang").limit(2 * sample_docs * len(counts)).collect())
    return [r[2] for r in rows], [r[1] for r in rows]


def predict(column: pa.Array, model: Crf | None, spans_too: bool = False) -> tuple[list, np.ndarray, np.ndarray, list]:
    """By text: language, score, number of words, stretches."""
    rows = len(column)
    pred, score, n, stretches = ["und"] * rows, np.zeros(rows), np.zeros(rows, np.int64), [[] for _ in range(rows)]
    if not model:
        return pred, score, n, stretches
    p, n = model.marginals(column)
    ends = np.cumsum(n)
    data, off = buffer(column)
    plain = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])[off]
    best = p.argmax(axis=1)
    for i in range(rows):
        if not n[i] or (plain[i + 1] == plain[i] and not any(map(str.isalpha, column[i].as_py()))):
            continue
        total = p[ends[i] - n[i] : ends[i]].sum(axis=0, dtype=np.float64)
        k = int(total.argmax())
        pred[i], score[i] = model.labels[k], total[k] / total.sum()
        if spans_too:
            own = best[ends[i] - n[i] : ends[i]]
            cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            stretches[i] = [{"lang": model.labels[own[c]], "first_word": int(c), "n_words": int(d - c)} for c, d in zip(cut, [*cut[1:], len(own)], strict=True)]
    return pred, score, n, stretches


def _filtered(df: DataFrame, model: Crf | None, text_col: str, least: float) -> DataFrame:
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch.column(at)):
                pred, score, _, _ = predict(batch.column(at).slice(a, z - a), model)
                keep = [p != "und" and s >= least for p, s in zip(pred, score, strict=True)]
                yield batch.slice(a, z - a).filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def label_words(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", spans_too: bool = False, min_score: float | None = None) -> DataFrame:
    """For each row the id, ``lang_pred``, ``score``, ``n_words``, and with ``spans_too`` ``runs``: stretches of words of one
    language as (lang, first_word, n_words). With ``min_score`` instead the input's rows, as they are, that have a
    language of that score or more."""
    if min_score is not None:
        return _filtered(df, model, text_col, min_score)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(docs.dtypes)["id"]
    extra = ", runs array<struct<lang:string,first_word:int,n_words:int>>" * spans_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch.column(1)):
                pred, score, n, stretches = predict(batch.column(1).slice(a, z - a), model, spans_too)
                columns = [batch.column(0).slice(a, z - a), pa.array(pred), pa.array(score), pa.array(n)]
                names = ["id", "lang_pred", "score", "n_words"]
                if spans_too:
                    columns.append(pa.array(stretches, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, f"id {kind}, lang_pred string, score double, n_words long{extra}").withColumnRenamed("id", id_col)


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    return F.pmod(F.crc32((F.col(column) if isinstance(column, str) else column).cast("string")), F.lit(n))


SAMPLE_DOCS = 250


def op1_crf_language(spark: SparkSession, sf_dir: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(*sample(docs, "doc_id", "text", "lang", sample_docs, remainder("id", 4) != 2))
    out = label_words(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_words")
