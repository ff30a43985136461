"""Language-model scores by a probabilistic suffix tree over words.

Tokens are the words of a lower-cased text and one end. The tree predicts a token from the up to ``depth`` words before
it. With c the occurrences in training texts, n(s) those of a context s and m(s) the number of its different followers,

    P(a | s) = (c(s, a) + m(s) * P(a | s')) / (n(s) + m(s)),   s' the longest retained suffix of s other than itself,

so each context shares mass with its suffix in proportion to the number of its followers. A context is retained if it
occurs ``least`` times and its followers diverge from those of s' by ``divergence`` bits or more. The root has every token
with an absolute discount; the discounted mass is the probability of a token that training has not seen. So the
probabilities of all seen tokens and the unseen one add up to 1 after every context. A token's score is P after the
longest retained suffix of the words before it. Where s' is the root, followers are compared by 2^16 classes of their
hashes, since the root's tokens are too many for one worker.

Nothing but ``least`` keeps a context out, so the model grows with the corpus. Learning and scoring share one shuffle: each
token goes, with the words before it, to the cell of its last context word, where that part of the tree is grown and its
tokens are scored at once; cells send sums by text. A token after a context that alone would fill a cell (a hot one)
goes to a cell of the context and a share of the words before it; counts of hot contexts are summed by a shuffle of
their own, level by level, and the probabilities after them are sent to the cells that ask. Which contexts are hot is
estimated from a sample; it decides where work is done, not what comes out. At most ``top`` words with their counts go to
every worker, and hot contexts by the size of cells; other words' counts are joined.

Words and contexts are known by 64-bit hashes. Defined cases: a null or empty text is one end token; with nothing to learn
from every token is the unseen one, of probability 1; very long texts are read whole; repeated rows each get their
result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import STEP, U64, mix, slices, sorted_set, span_hashes, words
from .op1_langid import remainder
from .scratch import Scratch, least_common, read_table

#: The end's text for its hash; no word holds white space.
END = b"\n"
#: Tokens of a share whose counts or cells are sent together.
SHARE = 1_000_000
#: Tokens of a cell at most and at least, the number of cells that are made if that allows, and the number beyond which they grow.
CELL, LEAST_CELL, CELLS, MOST_CELLS = 1_500_000, 150_000, 128, 1 << 15
#: Tokens of the sample from which hot contexts are estimated, at least; and for each possible hot context.
SAMPLE, SAMPLE_EACH = 4_000_000, 64
#: Tokens of a cell for which the tree is grown at a time.
PIECE = 200_000
#: Sums of 2 ** UNIT_BITS texts are sent together.
UNIT_BITS = 12
#: The root's followers are compared by classes of so many bits of their hashes.
CLASS_BITS = 16


def end_hash() -> np.uint64:
    return span_hashes(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))[0]


class Grams:
    """The token sequence of many rows, each with its end: hashes, rows, and how many words of its row stand before."""

    def __init__(self, column: pa.Array):
        _, _, _, _, row, h = words(column)
        rows = len(column)
        counts = np.bincount(row, minlength=rows)
        at = np.cumsum(counts)
        self.row = np.insert(row, at, np.arange(rows))
        self.hash = np.insert(h, at, end_hash())
        self.sizes = counts + 1
        self.before = np.arange(len(self.hash)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def contexts(self, depth: int) -> Iterator[np.ndarray]:
        """By position and for 1 to ``depth`` words, hashes of the words before it; where there are fewer words, something else."""
        out = np.zeros(len(self.hash), U64)
        for k in range(1, depth + 1):
            out = joined(out, shifted(self.hash, k))
            yield out


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[: len(x) - k]
    return out


def joined(suffix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context that has one more word before it."""
    return mix(suffix * STEP[0] + word * STEP[1] + U64(1))


class Lookup:
    """Places of 64-bit keys in a sorted table, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(U64))
        self.shift = U64(64 - 22)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def __reduce__(self) -> tuple:
        return Lookup, (self.keys,)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are found, and their places in the table."""
        at = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        return at[hit], i[hit]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n, tokens) of texts (text, training): by token the occurrences in training texts; in a row without h all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, size, tokens = [], 0, 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, U64), *share]), return_counts=True)
            rows = len(h)
            known = pa.array(np.append(h, U64(0)).view(np.int64), mask=np.append(np.zeros(rows, bool), True))
            return pa.RecordBatch.from_arrays([known, pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(rows, np.int64), tokens))], ["h", "n", "tokens"])

        for batch in batches:
            for a, z in slices(batch.column(0)):
                g = Grams(batch.column(0).slice(a, z - a))
                flags = batch.column(1).slice(a, z - a).to_numpy(zero_copy_only=False).astype(bool)
                share.append(g.hash[flags[g.row]])
                size += len(share[-1])
                tokens += len(g.hash)
                if size >= SHARE:
                    yield out()
                    share, size, tokens = [], 0, 0
        yield out()

    return docs.select("text", "training").mapInArrow(count, "h long, n long, tokens long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


def hot_contexts(docs: DataFrame, depth: int, tokens: int, cell: int) -> list[tuple[Lookup, np.ndarray]]:
    """By length, contexts that may have more than a cell's tokens, and into how many shares each is cut."""
    fraction = min(1.0, max(SAMPLE, SAMPLE_EACH * tokens // cell) / max(1, tokens))
    rate = cell / max(1, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, size = [[] for _ in range(depth)], 0

        def out() -> Iterator[pa.RecordBatch]:
            for k, of in enumerate(share, 1):
                h, n = np.unique(np.concatenate(of), return_counts=True)
                keep = n >= 0.25 * rate * size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), k, np.int32)), pa.array(h[keep].view(np.int64)), pa.array(n[keep])], ["k", "h", "n"])

        for batch in batches:
            for a, z in slices(batch.column(0)):
                g = Grams(batch.column(0).slice(a, z - a))
                for k, h in enumerate(g.contexts(depth), 1):
                    share[k - 1].append(h[g.before >= k])
                size += len(g.hash)
                if size >= SHARE:
                    yield from out()
                    share, size = [[] for _ in range(depth)], 0
        if size:
            yield from out()

    texts = docs.select("text")
    found = (texts if fraction == 1 else texts.sample(fraction, 7)).mapInArrow(run, "k int, h long, n long")
    found = found.groupBy("k", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= rate * fraction * tokens).toArrow()
    k, h, n = (found.column(i).to_numpy() for i in range(3))
    hot = []
    for level in range(1, depth + 1):
        keys, count = h[k == level].view(U64), n[k == level]
        order = np.argsort(keys)
        hot.append((Lookup(keys), np.ceil(count[order] / (rate * fraction * tokens)).astype(np.int64)))
    return hot


class Common:
    """What every worker has: frequent words with their counts, the most frequent first; hot contexts; the root's classes.
    Words and counts are sent, and what follows from them is made anew by each worker."""

    def __init__(self, h: np.ndarray, n: np.ndarray, hot: list, bits: int, depth: int, discount: float, tokens: int, vocabulary: int, mass: np.ndarray):
        order = np.argsort(-n, kind="stable")
        self.hashes, counts = h[order], n[order]
        self.sent = (self.hashes, counts, hot, bits, depth, discount, tokens, vocabulary, mass)
        self.lookup, self.rank = Lookup(h), np.argsort(self.hashes)
        self.hot, self.bits, self.depth, self.mass = hot, bits, depth, mass
        self.root = (counts - discount) / max(1, tokens)
        self.base = np.log10(counts + 0.1) - math.log10(tokens + 0.1 * (vocabulary + 1))

    def __reduce__(self) -> tuple:
        return Common, self.sent

    def codes(self, h: np.ndarray) -> np.ndarray:
        """1 and more: the rank of a frequent word; 0: another."""
        out = np.zeros(len(h), np.int32)
        at, i = self.lookup(h)
        out[at] = self.rank[i] + 1
        return out

    def cells(self, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By position the hot words before it, the hash of these, into how many shares they are cut, and the cell."""
        n = len(g.hash)
        level, key, cut, parts = np.zeros(n, np.int8), np.where(g.before >= 1, shifted(g.hash, 1), mix(g.hash)), np.ones(n, np.int64), np.zeros(n, U64)
        alive = None
        for k, h in enumerate(g.contexts(self.depth), 1):
            lookup, shares = self.hot[k - 1]
            if not len(lookup.keys):
                break
            at, i = lookup(h)
            ok = g.before[at] >= k if alive is None else (g.before[at] >= k) & alive[at]
            at, i = at[ok], i[ok]
            alive = np.zeros(n, bool)
            alive[at] = True
            level[at], key[at], cut[at] = k, h[at], shares[i]
            if k < self.depth:
                parts[at] = shifted(g.hash, k + 1)[at] * (g.before[at] > k)
        return level, key, cut, self.bucket(level, key, parts % cut.astype(U64))

    def bucket(self, level: np.ndarray, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        h = np.where(level > 0, mix(key + part * STEP[2]), key)
        return (h >> U64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(h), np.int32)


def planes(x: np.ndarray) -> bytes:
    """Numbers, byte by byte."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Words below ONE take a byte, below TWO two bytes, below THREE three, others four.
ONE, TWO, THREE = 192, 192 + 48 * 256, 192 + 48 * 256 + 15 * 65536


def packed(codes: np.ndarray) -> bytes:
    """Numbers in bytes of which the first tells how many follow: first all first bytes, then the others of each kind."""
    c = codes.astype(np.int64)
    two, three = c >= ONE, c >= TWO
    four = c >= THREE
    first = np.select([four, three, two], [255, 240 + (c - TWO >> 16), 192 + (c - ONE >> 8)], c).astype(np.uint8)
    low = np.select([four, three], [c, c - TWO], c - ONE)
    return first.tobytes() + (low[two] & 255).astype(np.uint8).tobytes() + (low[three] >> 8 & 255).astype(np.uint8).tobytes() + (c[four] >> 16).astype(np.uint8).tobytes()


def unpacked(data: np.ndarray, n: int) -> np.ndarray:
    c = data[:n].astype(np.int32)
    two, three, four = (np.flatnonzero(c >= x) for x in (192, 240, 255))
    rest = np.split(data[n:], np.cumsum([len(two), len(three)]))
    low = np.zeros(n, np.int32)
    low[two] = rest[0]
    low[three] |= rest[1].astype(np.int32) << 8
    c[two] = np.where(c[two] >= 240, TWO + (c[two] - 240 << 16), ONE + (c[two] - 192 << 8))
    c[four] = rest[2].astype(np.int32) << 16
    return c + low


ROW = "bucket int, base long, size int, blob binary, rare binary, ctx long, a long, alpha double, beta double, sn double, sc double, rid long, n_tokens int, n_known int, bs double"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def batch_of(columns: dict, rows: int, ids: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array(columns[n], TYPES[t]) if n in columns else pa.nulls(rows, TYPES[t]) for n, t in (x.split() for x in ROW.split(", "))]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(rows, kind) if ids is None else ids], [*NAMES, "id"])


def tokens_by_cell(docs: DataFrame, common: Broadcast) -> DataFrame:
    """Of texts (id, text, training): for each share and cell its tokens, with the words before them; and a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, codec = common.value, pa.Codec("zstd", 3)
        depth, top = own.depth, len(own.hashes)
        rid, share, others, size = TaskContext.get().partitionId() << 33, [], [], 0

        def out(kind: pa.DataType) -> pa.RecordBatch:
            bucket, row, flag, before, code = (np.concatenate(x) for x in zip(*share, strict=True))
            rare, place = np.unique(np.concatenate(others), return_inverse=True)
            code[code == 0] = top + 1 + place
            order = np.argsort(bucket, kind="stable")
            cut = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order)).tolist()
            rows: dict[str, list] = {n: [] for n in ("bucket", "base", "size", "blob", "rare")}
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                at = order[i:j]
                window = np.stack([np.where(before[at] >= k, code[at - k], 0) for k in range(depth + 1)])
                other = window > top
                used, place = np.unique(window[other], return_inverse=True)
                window[other] = top + 1 + place
                r = row[at]
                blob = codec.compress(planes(np.diff(r, prepend=r[0]).astype(np.uint32)) + flag[at].tobytes() + packed(window.ravel()), asbytes=True)
                for n, v in zip(rows, (bucket[at[0]], int(r[0]), j - i, blob, rare[used - top - 1].tobytes()), strict=True):
                    rows[n].append(v)
            return batch_of(rows, len(cut) - 1, None, kind)

        for batch in batches:
            for a, z in slices(batch.column(1)):
                part = batch.slice(a, z - a)
                kind = part.column(0).type
                g = Grams(part.column(1))
                level, key, cut, bucket = own.cells(g)
                leaf = level == depth
                if leaf.any():
                    bucket[leaf] = own.bucket(level[leaf], key[leaf], (np.arange(len(level))[leaf] % cut[leaf]).astype(U64))
                train = part.column(2).to_numpy(zero_copy_only=False).astype(np.int8)
                code = own.codes(g.hash)
                share.append((bucket, rid + g.row, level * np.int8(2) + train[g.row], np.minimum(g.before, depth).astype(np.int8), code))
                others.append(g.hash[code == 0])
                size += len(g.hash)
                at = np.flatnonzero(code)
                rows = len(part)
                # of the texts themselves: tokens, and what is known of their frequent words
                known = np.bincount(g.row[at], minlength=rows).astype(np.int32)
                base = np.bincount(g.row[at], weights=own.base[code[at] - 1], minlength=rows)
                rids = rid + np.arange(rows)
                yield batch_of({"bucket": (rids % (1 << own.bits)).astype(np.int32), "rid": rids, "n_tokens": g.sizes.astype(np.int32), "n_known": known, "bs": base}, rows, part.column(0), kind)
                rid += rows
                if size >= SHARE:
                    yield out(kind)
                    share, others, size = [], [], 0
        if size:
            yield out(kind)

    return docs.select("id", "text", "training").mapInArrow(run, f"{ROW}, id {dict(docs.dtypes)['id']}")


class States:
    """By token the longest retained context so far: P(a) after it is alpha + beta * root(a); sn and sc count it, and the
    token after it, in training. sn is 0 at the root."""

    def __init__(self, n: int):
        self.alpha, self.beta, self.sn, self.sc = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)


def grow(states: States, windows: list[np.ndarray], level: np.ndarray, path: np.ndarray, a: np.ndarray, train: np.ndarray, classes: np.ndarray, mass: np.ndarray, least: int, divergence: float) -> None:
    """Takes the states of one cell's tokens from context to longer context. ``path`` tells the hot contexts of ``level`` words
    apart; ``windows`` has by length the word at that distance, 0 for none; ``classes`` the class of each word."""
    wide = np.int64(len(classes))
    group = path.astype(np.int64)
    live = np.ones(len(a), bool)
    for k, word in enumerate(windows, 1):
        at = np.flatnonzero(live & (level < k) & (word > 0))
        if not len(at):
            continue
        _, ctx = np.unique(group[at] * wide + word[at], return_inverse=True)
        n = np.bincount(ctx, weights=train[at])
        often = n >= least
        live[at] = often[ctx]
        at, ctx = at[often[ctx]], ctx[often[ctx]]
        if not len(at):
            continue
        group[at] = ctx
        _, first, pair = np.unique(ctx * wide + a[at], return_index=True, return_inverse=True)
        c = np.bincount(pair, weights=train[at])
        of, token = ctx[first], at[first]
        m = np.bincount(of[c > 0], minlength=len(n))
        seen = np.flatnonzero(c > 0)
        of, token, count = of[seen], token[seen], c[seen]
        low = states.sn[token] > 0
        bits = np.zeros(len(n))
        bits += np.bincount(of[low], weights=count[low] * np.log2(count[low] * states.sn[token[low]] / states.sc[token[low]]), minlength=len(n))
        if not low.all():
            key, inverse = np.unique(of[~low] << CLASS_BITS | classes[a[token[~low]]], return_inverse=True)
            count = np.bincount(inverse, weights=count[~low])
            bits += np.bincount(key >> CLASS_BITS, weights=count * np.log2(count / mass[key & ((1 << CLASS_BITS) - 1)]), minlength=len(n))
        with np.errstate(divide="ignore", invalid="ignore"):
            keep = often & (bits / n - np.log2(n) >= divergence)
        chosen = keep[ctx]
        at, ctx, pair = at[chosen], ctx[chosen], pair[chosen]
        share = m[ctx] / (n[ctx] + m[ctx])
        states.alpha[at] = c[pair] / (n[ctx] + m[ctx]) + share * states.alpha[at]
        states.beta[at] *= share
        states.sn[at], states.sc[at] = n[ctx], c[pair]


def scored_cells(rows: DataFrame, common: Broadcast, least: int, divergence: float) -> DataFrame:
    """Of rows by cell: sums by text in units of texts (rid of the first, size, blob), tokens that are rare words (rid, a, alpha,
    beta), and the rows of texts."""

    def cell(parts: list[dict], asked: list[pa.RecordBatch]) -> Iterator[dict]:
        own, codec = common.value, pa.Codec("zstd", 3)
        depth, top = own.depth, len(own.hashes)
        rids, flags, codes, rares = [], [], [[] for _ in range(depth + 1)], []
        for p in parts:
            n = p["size"]
            data = zstandard.decompress(p["blob"])
            rids.append(p["base"] + np.cumsum(unplaned(data[: 4 * n], np.uint32).astype(np.int64)))
            flags.append(np.frombuffer(data, np.int8, n, 4 * n))
            for k, c in enumerate(np.split(unpacked(np.frombuffer(data, np.uint8, offset=5 * n), (depth + 1) * n), depth + 1)):
                codes[k].append(c)
            rares.append(np.frombuffer(p["rare"], U64))
        rare = sorted_set(np.concatenate(rares))
        for i, r in enumerate(rares):
            place = np.concatenate([np.arange(top + 1), top + 1 + np.searchsorted(rare, r)]).astype(np.int32) if len(r) else None
            for c in codes:
                if place is not None:
                    c[i] = place[c[i]]
        rid, flag, window = np.concatenate(rids), np.concatenate(flags), [np.concatenate(c) for c in codes]
        rids = flags = codes = rares = None
        hashes = np.concatenate([np.zeros(1, U64), own.hashes, rare])
        classes = (hashes >> U64(64 - CLASS_BITS)).astype(np.int32)
        if asked:
            key, *known = (np.concatenate([b.column(i).to_numpy() for b in asked]) for i in range(5))
            order = np.argsort(key.view(U64))
            key, known = key.view(U64)[order], [x[order] for x in known]
        # contexts of one last word are grown together, and about ``PIECE`` tokens at a time
        order = np.argsort(window[1], kind="stable")
        last = window[1][order]
        new = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        cut = [*new[np.flatnonzero(np.append(True, new[1:] // PIECE != new[:-1] // PIECE))].tolist(), len(order)]
        value, more = np.zeros(len(rid)), []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            at = order[i:j]
            a, *windows = (w[at] for w in window)
            level = flag[at] >> 1
            states, path = States(len(a)), np.zeros(len(a), np.int64)
            hot = np.flatnonzero(level)
            if len(hot):
                ctx = np.zeros(len(hot), U64)
                for k in range(1, depth + 1):
                    on = level[hot] >= k
                    ctx[on] = joined(ctx[on], hashes[windows[k - 1][hot[on]]])
                _, path[hot] = np.unique(ctx, return_inverse=True)
                path[hot] += len(a) + 1  # apart from the numbers that shorter contexts get
                place = np.searchsorted(key, mix(ctx * STEP[3] + hashes[a[hot]]))
                states.alpha[hot], states.beta[hot], states.sn[hot], states.sc[hot] = (x[place] for x in known)
            grow(states, windows, level, path, a, (flag[at] & 1).astype(np.float64), classes, own.mass, least, divergence)
            frequent = a <= top
            value[at[frequent]] = np.log10(states.alpha[frequent] + states.beta[frequent] * own.root[a[frequent] - 1])
            other = ~frequent
            more.append((rid[at[other]], hashes[a[other]].view(np.int64), states.alpha[other], states.beta[other]))
        yield from sums(rid, value, codec)
        yield dict(zip(("rid", "a", "alpha", "beta"), (np.concatenate(x) for x in zip(*more, strict=True)), strict=True))

    def sums(rid: np.ndarray, value: np.ndarray, codec: pa.Codec) -> Iterator[dict]:
        """Sums by text, packed by units of texts."""
        if not len(rid):
            return
        order = np.argsort(rid, kind="stable")
        rid, value = rid[order], value[order]
        begin = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
        rid, value = rid[begin], np.add.reduceat(value, begin)
        unit = rid >> UNIT_BITS
        cut = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit)).tolist()
        place = (rid & ((1 << UNIT_BITS) - 1)).astype(np.uint16)
        blobs = [codec.compress(planes(np.diff(place[i:j], prepend=np.uint16(0))) + planes(value[i:j]), asbytes=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield {"rid": rid[cut[:-1]], "size": np.diff(cut).astype(np.int32), "blob": blobs}

    kinds = {"rid": pa.int64(), "size": pa.int32(), "blob": pa.binary(), "a": pa.int64(), "alpha": pa.float64(), "beta": pa.float64(), "n_tokens": pa.int32(), "n_known": pa.int32(), "bs": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, asked, id_kind = None, [], [], None

        def out(columns: dict, ids: pa.Array | None = None) -> pa.RecordBatch:
            rows = len(columns["rid"])
            arrays = [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], v) if k in columns else pa.nulls(rows, v) for k, v in kinds.items()]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(rows, id_kind) if ids is None else ids], [*kinds, "id"])

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                for columns in cell(parts, asked):
                    for i in range(0, len(columns["rid"]), 100_000):
                        yield out({k: v[i : i + 100_000] for k, v in columns.items()})

        for batch in batches:
            id_kind = batch.column("id").type
            buckets = batch.column("bucket").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)).tolist() if len(buckets) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if buckets[i] != bucket:
                    yield from flush()
                    bucket, parts, asked = buckets[i], [], []
                part = batch.slice(i, j - i)
                texts = part.filter(part.column("rid").is_valid())
                if len(texts):
                    yield out({k: texts.column(k) for k in ("rid", "n_tokens", "n_known", "bs")}, texts.column("id"))
                parts += part.filter(part.column("blob").is_valid()).select(["base", "size", "blob", "rare"]).to_pylist()
                hot = part.filter(part.column("ctx").is_valid())
                if len(hot):
                    key = mix(hot.column("ctx").to_numpy().view(U64) * STEP[3] + hot.column("a").to_numpy().view(U64)).view(np.int64)
                    asked.append(pa.RecordBatch.from_arrays([pa.array(key), *(hot.column(x) for x in ("alpha", "beta", "sn", "sc"))], ["key", "alpha", "beta", "sn", "sc"]))
        yield from flush()

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"rid long, size int, blob binary, a long, alpha double, beta double, n_tokens int, n_known int, bs double, id {kind}")


def hot_states(docs: DataFrame, common: Broadcast, mass: DataFrame, scratch: Scratch, depth: int, least: int, divergence: float) -> DataFrame:
    """(bucket, ctx, a, alpha, beta, sn, sc): states of tokens after hot contexts, for the cells that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = common.value
        for batch in batches:
            for i, j in slices(batch.column(0)):
                g = Grams(batch.column(0).slice(i, j - i))
                train = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)[g.row]
                level, _, cut, bucket = own.cells(g)
                before = np.zeros(len(level), U64)
                for k, ctx in enumerate(g.contexts(depth), 1):
                    at = np.flatnonzero(level >= k)
                    if not len(at):
                        break
                    where = np.where(level[at] == k, 0 if k == depth else bucket[at], -1)
                    shares = np.where(level[at] == depth, cut[at], 1)
                    _, first, inverse = np.unique(mix(ctx[at] * STEP[0] + g.hash[at] * STEP[1] + where.astype(np.int64).view(U64)), return_index=True, return_inverse=True)
                    n = np.bincount(inverse, weights=train[at]).astype(np.int64)
                    x = at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), *(pa.array(v[x].view(np.int64)) for v in (ctx, before, g.hash)), pa.array(where[first].astype(np.int32)), pa.array(shares[first].astype(np.int32)), pa.array(n)], ["k", "ctx", "sup", "a", "bucket", "shares", "n"])
                    before = ctx

    found = docs.select("text", "training").mapInArrow(run, "k int, ctx long, sup long, a long, bucket int, shares int, n long")
    found = scratch.save(found.groupBy("k", "ctx", "sup", "a", "bucket", "shares").agg(F.sum("n").alias("n")))
    lower, asked = None, None
    for k in range(1, depth + 1):
        pairs = found.filter(F.col("k") == k).groupBy("ctx", "sup", "a").agg(F.sum("n").alias("c"))
        if lower is None:
            pairs = pairs.withColumns({"alpha": F.lit(0.0), "beta": F.lit(1.0), "sn": F.lit(0.0), "sc": F.lit(0.0)})
        else:
            pairs = pairs.join(lower.withColumnRenamed("ctx", "sup"), ["sup", "a"])
        pairs = scratch.save(pairs)
        c = F.col("c")
        low = pairs.filter("c > 0 and sn > 0").groupBy("ctx").agg(F.sum(c * F.log2(c * F.col("sn") / F.col("sc"))).alias("bits"))
        own = pairs.filter("c > 0 and sn = 0").groupBy("ctx", F.shiftrightunsigned("a", 64 - CLASS_BITS).alias("class")).agg(F.sum("c").alias("c"))
        own = own.join(F.broadcast(mass), "class").groupBy("ctx").agg(F.sum(c * F.log2(c / F.col("mass"))).alias("bits"))
        total = pairs.groupBy("ctx").agg(F.sum("c").alias("n"), F.count(F.when(c > 0, 1)).alias("m"))
        total = total.join(low.union(own), "ctx").filter((F.col("n") >= least) & (F.col("bits") / F.col("n") - F.log2("n") >= divergence)).drop("bits")
        d = pairs.join(total, "ctx", "left")
        kept = lambda new, old: F.when(F.col("n").isNull(), F.col(old)).otherwise(new)
        both, share = F.col("n") + F.col("m"), F.col("m") / (F.col("n") + F.col("m"))
        d = d.select("ctx", "a", kept(c / both + share * F.col("alpha"), "alpha").alias("alpha"), kept(share * F.col("beta"), "beta").alias("beta"), kept(F.col("n").cast("double"), "sn").alias("sn"), kept(c.cast("double"), "sc").alias("sc"))
        lower = scratch.save(d)
        more = found.filter((F.col("k") == k) & (F.col("bucket") >= 0)).select("ctx", "a", "bucket", "shares")
        if k == depth:
            own_bucket = _leaf_bucket(common)
            more = more.select("ctx", "a", "shares").distinct().mapInArrow(own_bucket, "ctx long, a long, bucket int")
        else:
            more = more.drop("shares")
        more = more.distinct().join(lower, ["ctx", "a"])
        asked = more if asked is None else asked.unionByName(more)
    return asked


def _leaf_bucket(common: Broadcast):
    """For contexts of full length, a row for each of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, a, shares = (batch.column(i).to_numpy() for i in range(3))
            at = np.repeat(np.arange(len(ctx)), shares)
            part = np.arange(len(at)) - np.repeat(np.cumsum(shares) - shares, shares)
            key = ctx[at].view(U64)
            bucket = common.value.bucket(np.full(len(at), common.value.depth), key, part.astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(ctx[at]), pa.array(a[at]), pa.array(bucket)], ["ctx", "a", "bucket"])

    return run


def score_texts(df: DataFrame, scratch: Scratch, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, least: int = 2, divergence: float = 0.05, top: int = 1 << 20, cell: int = CELL) -> DataFrame:
    """For each row the id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. ``training`` is true for the
    rows to learn from."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    every = scratch.save(word_counts(docs))
    counts = every.filter("h is not null and n > 0").select("h", "n")
    of = lambda n: F.count(F.when(F.col("n") == n, 1))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), of(1).alias("ones"), of(2).alias("twos")).first()
    read = every.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tokens, vocabulary = total["n"], total["v"]
    discount = min(0.9, max(0.1, total["ones"] / (total["ones"] + 2 * total["twos"]))) if total["ones"] else 0.1
    unseen = discount * vocabulary / tokens if tokens else 1.0
    size = math.log10(tokens + 0.1 * (vocabulary + 1))
    share = lambda n: math.log2(max(1, read) / n)
    bits = max(0, min(math.ceil(share(cell)), int(math.log2(MOST_CELLS))), min(int(math.log2(CELLS)), math.floor(share(LEAST_CELL))))
    most = counts.filter(F.col("n") >= least_common(counts, top)).toArrow()
    shares = counts.groupBy(F.shiftrightunsigned("h", 64 - CLASS_BITS).alias("class")).agg((F.sum("n") / max(1, tokens)).alias("mass"))
    classes = shares.toArrow()
    mass = np.zeros(1 << CLASS_BITS)
    mass[classes.column(0).to_numpy()] = classes.column(1).to_numpy()
    hot = hot_contexts(docs, depth, read, max(1, read >> bits + 1))
    common = spark.sparkContext.broadcast(Common(most.column(0).to_numpy().view(U64), most.column(1).to_numpy(), hot, bits, depth, discount, tokens, vocabulary, mass))
    rows, asked = tokens_by_cell(docs, common), None
    if len(hot[0][0].keys):
        states = Scratch(spark, "op2-hot")
        asked = scratch.save(hot_states(docs, common, scratch.save(shares), states, depth, least, divergence))
        states.drop()
        scratch.free()
        rows = rows.unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    parts = scratch.save(scored_cells(rows, common, least, divergence))
    rows = asked = None
    scratch.free()
    seen = F.coalesce("n", F.lit(0))
    root = F.when(seen > 0, (seen - discount) / max(1, tokens)).otherwise(unseen)
    rare = parts.filter("a is not null").select("rid", "a", "alpha", "beta").join(counts.withColumnRenamed("h", "a"), "a", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.col("alpha") + F.col("beta") * root)).alias("score"), F.count(F.when(seen > 0, 1)).cast("int").alias("n_known"), F.sum(F.log10(seen + F.lit(0.1)) - size).alias("bs"))
    parts = parts.filter("a is null").select("rid", "id", "size", "blob", "n_tokens", "n_known", "bs").unionByName(rare, allowMissingColumns=True)
    parts = parts.withColumn("unit", F.shiftright("rid", UNIT_BITS))
    out = text_sums(parts.repartition("unit").sortWithinPartitions("unit"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("bs").alias("base_score"), "score")


def text_sums(parts: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, bs, score) by text, of the parts of its unit."""
    texts = 1 << UNIT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, unit, ids = pa.Codec("zstd"), None, []
        total = np.zeros((4, texts))

        def out() -> pa.RecordBatch:
            place = np.concatenate([p for p, _ in ids])
            n, known, base, score = total[:, place]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x for _, x in ids]), *(pa.array(v.astype(np.int64)) for v in (n, known)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "bs", "score"])

        for batch in batches:
            of = batch.column("unit").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).tolist() if len(of) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if of[i] != unit:
                    if ids:
                        yield out()
                    unit, ids = of[i], []
                    total[:] = 0
                part = batch.slice(i, j - i)
                for r in part.filter(part.column("blob").is_valid()).select(["size", "blob"]).to_pylist():
                    data = codec.decompress(r["blob"], r["size"] * 10, asbytes=True)
                    total[3, np.cumsum(unplaned(data[: 2 * r["size"]], np.uint16))] += unplaned(data[2 * r["size"] :], np.float64)
                part = part.filter(part.column("blob").is_null())
                place = part.column("rid").to_numpy() & (texts - 1)
                for k, name in enumerate(("n_tokens", "n_known", "bs", "score")):
                    np.add.at(total[k], place, part.column(name).fill_null(0).to_numpy(zero_copy_only=False))
                own = part.column("n_tokens").is_valid()
                ids.append((place[own.to_numpy(zero_copy_only=False)], part.column("id").filter(own)))
        if ids:
            yield out()

    return parts.mapInArrow(run, f"id {dict(parts.dtypes)['id']}, n_tokens long, n_known long, bs double, score double")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, Scratch(spark, "op2"), remainder("doc_id", 10) != 0)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)
