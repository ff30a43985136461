"""Edit alignment of token sequences.

Error counts with unit costs need no path: those of characters are the built-in ``levenshtein``, those of tokens a
bit-parallel distance in an Arrow UDF. Paths come from Arrow UDFs too: with unit costs from the words of that distance, with other
costs or a band from a table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, SUB, INS, DEL = "MATCH", "SUB", "INS", "DEL"
OPS = "array<struct<op:string,ref:string,hyp:string>>"
PATH = "array<struct<op:string,i:int,j:int>>"


def token_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Unit-cost edit distance of two token sequences, bit-parallel: the longer one's positions are the bits of integers, of
    any size, and each token of the shorter one takes a few operations on them. Common ends are cut first."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return len(long)
    places: dict[str, list[int]] = {}
    for i, t in enumerate(long):
        places.setdefault(t, []).append(i)
    full, top, score = (1 << len(long)) - 1, 1 << (len(long) - 1), len(long)
    up, down = full, 0
    for t in short:
        equal = 0
        for i in places.get(t, ()):
            equal |= 1 << i
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(across | up)) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        equal |= down
        up, down = (minus | ~(equal | plus)) & full, plus & equal & full
    return score


def word_errors(ref: Column, hyp: Column) -> Column:
    """Substitutions, insertions and deletions with unit costs."""

    @F.arrow_udf("int")
    def errors(r: pa.Array, h: pa.Array) -> pa.Array:
        pairs = zip(r.to_pylist(), h.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else token_distance(a, b) for a, b in pairs], pa.int32())

    return errors(ref, hyp)


def char_errors(ref: Column, hyp: Column) -> Column:
    """The same over the characters of two strings."""
    return F.levenshtein(ref, hyp)


def error_rate(errors: Column, ref_length: Column, hyp_length: Column) -> Column:
    """Errors for each reference token; against an empty reference 0 for an empty hypothesis and 1 for any other."""
    return F.when(ref_length == 0, F.when(hyp_length == 0, 0.0).otherwise(1.0)).otherwise(errors / ref_length)


def symmetric_error_rate(errors: Column, ref_length: Column, hyp_length: Column) -> Column:
    """Errors for each token of both sides' mean length; 0 for two empty sides."""
    both = ref_length + hyp_length
    return F.when(both == 0, 0.0).otherwise(2.0 * errors / both)


def with_rates(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds ref_len, hyp_len, word_errors, wer, char_len, char_errors and cer (over joined tokens)."""
    r, h = F.col(ref), F.col(hyp)
    rt, ht = F.array_join(r, ""), F.array_join(h, "")
    out = pairs.withColumns({"ref_len": F.size(r), "hyp_len": F.size(h), "word_errors": word_errors(r, h), "char_len": F.char_length(rt), "char_errors": char_errors(rt, ht)})
    return out.withColumns({"wer": error_rate(F.col("word_errors"), F.col("ref_len"), F.col("hyp_len")), "cer": error_rate(F.col("char_errors"), F.col("char_len"), F.char_length(ht))})


def corpus_rates(rates: DataFrame, *by: str) -> DataFrame:
    """n, and micro and macro word and character error rates; a total reference length of 0 gives micro 0."""
    micro = lambda e, n: F.when(F.sum(n) > 0, F.sum(e) / F.sum(n)).otherwise(0.0)
    return rates.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(micro("word_errors", "ref_len"), F.lit(0.0)).alias("wer_micro"),
        F.coalesce(F.avg("wer"), F.lit(0.0)).alias("wer_macro"),
        F.coalesce(micro("char_errors", "char_len"), F.lit(0.0)).alias("cer_micro"),
        F.coalesce(F.avg("cer"), F.lit(0.0)).alias("cer_macro"),
    )


class Costs:
    """Costs of the operations, and of substitutions of particular pairs; all finite and not negative."""

    def __init__(self, sub: float = 1.0, ins: float = 1.0, dele: float = 1.0, pairs: Mapping[tuple[str, str], float] | None = None):
        self.sub, self.ins, self.dele, self.pairs = sub, ins, dele, dict(pairs or {})
        for cost in (sub, ins, dele, *self.pairs.values()):
            if not math.isfinite(cost) or cost < 0:
                raise ValueError(f"cost must be finite and not negative: {cost}")


UNIT = Costs()


def best_path(ref: Sequence[str], hyp: Sequence[str], costs: Costs = UNIT, band: int | None = None) -> tuple[list[tuple], float]:
    """(op, ref token, hyp token) steps and their cost. Equal tokens always match; of equal costs a substitution comes
    before an insertion and that before a deletion. A band keeps to cells of |i - j| <= band."""
    if isinstance(ref, str) or isinstance(hyp, str):
        raise TypeError("token sequences are wanted, not strings")
    n, m = len(ref), len(hyp)
    if band is not None and (band < 0 or abs(n - m) > band):
        raise ValueError("no path inside the band")
    # an equal token is always matched, so the common end is
    end = 0
    while end < min(n, m) and ref[n - 1 - end] == hyp[m - 1 - end]:
        end += 1
    tail = [(MATCH, t, t) for t in ref[n - end :]]
    n, m, inf = n - end, m - end, math.inf
    width = max(n, m) if band is None else band
    above = [j * costs.ins if j <= width else inf for j in range(m + 1)]
    row = [inf] * (m + 1)
    choices = []
    for i, r in enumerate(ref[:n], 1):
        lo, hi = max(1, i - width), min(m, i + width)
        chosen = bytearray(max(0, hi - lo + 1))
        row[lo - 1] = i * costs.dele if lo == 1 and i <= width else inf
        for j in range(lo, hi + 1):
            h = hyp[j - 1]
            if r == h:
                row[j] = above[j - 1]
                continue
            best, kind = above[j - 1] + costs.pairs.get((r, h), costs.sub), 1
            if row[j - 1] + costs.ins < best:
                best, kind = row[j - 1] + costs.ins, 2
            if above[j] + costs.dele < best:
                best, kind = above[j] + costs.dele, 3
            row[j], chosen[j - lo] = best, kind
        if hi < m:
            row[hi + 1] = inf
        choices.append((lo, chosen))
        above, row = row, above
    steps, i, j = [], n, m
    while i or j:
        kind = 2 if not i else 3 if not j else choices[i - 1][1][j - choices[i - 1][0]]
        if kind == 2:
            steps.append((INS, None, hyp[j - 1]))
            j -= 1
        elif kind == 3:
            steps.append((DEL, ref[i - 1], None))
            i -= 1
        else:
            steps.append((SUB if kind else MATCH, ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
    return steps[::-1] + tail, above[m]


def unit_path(ref: Sequence[str], hyp: Sequence[str]) -> list[tuple[str, int | None, int | None]]:
    """(op, place in ref, place in hyp) of the best path with unit costs, of equal costs as :func:`best_path` chooses."""
    op = lambda i, j: INS if i < 0 else DEL if j < 0 else MATCH if ref[i] == hyp[j] else SUB
    return [(op(i, j), None if i < 0 else i, None if j < 0 else j) for i, j in zip(*unit_places(ref, hyp), strict=True)]


def unit_places(ref: Sequence, hyp: Sequence) -> tuple[list[int], list[int]]:
    """The places in ref and in hyp of each step of :func:`unit_path`, -1 where a step has none.

    The reference's positions are the bits of integers, as in :func:`token_distance`. Of each hypothesis token two words
    are kept: where the distance is that of the cell before on the diagonal, and where it falls from one reference position to
    the next. They tell at each cell of the way back which step led there, so 25,000 tokens on both sides take 160 MB, not the
    cells of a table."""
    n, m = len(ref), len(hyp)
    while n and m and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    olds, news = list(range(len(ref) - 1, n - 1, -1)), list(range(len(hyp) - 1, m - 1, -1))
    i, j = n, m
    if n and m:
        places: dict[str, int] = {}
        bit = 1
        for t in ref[:n]:
            places[t] = places.get(t, 0) | bit
            bit <<= 1
        full, up, down = bit - 1, bit - 1, 0
        level, falls = [], [0]
        for t in hyp[:m]:
            equal = places.get(t, 0)
            across = ((((equal & up) + up) ^ up) | equal | down) & full
            plus, minus = (down | ~(across | up)) << 1 | 1, up & across
            up, down = (minus << 1 | ~(across | plus)) & full, plus & across & full
            level.append(across)
            falls.append(down)
        while i and j:
            if ref[i - 1] == hyp[j - 1] or not level[j - 1] >> (i - 1) & 1:
                i, j = i - 1, j - 1
                olds.append(i)
                news.append(j)
            elif falls[j - 1] >> (i - 1) & 1:
                j -= 1
                olds.append(-1)
                news.append(j)
            else:
                i -= 1
                olds.append(i)
                news.append(-1)
    olds += [*range(i - 1, -1, -1), *[-1] * j]
    news += [*[-1] * i, *range(j - 1, -1, -1)]
    return olds[::-1], news[::-1]


def edit_path(ref: Column, hyp: Column) -> Column:
    """The steps of the best path with unit costs, as an array of (op, i, j), places in both sequences. Equal sequences don't go to
    Python; a null one is empty."""

    @F.arrow_udf(PATH)
    def path(r: pa.Array, h: pa.Array) -> pa.Array:
        found = [unit_path(a or [], b or []) for a, b in zip(r.to_pylist(), h.to_pylist(), strict=True)]
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        op, i, j = zip(*chain.from_iterable(found), strict=True) if any(found) else ((), (), ())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(op, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["op", "i", "j"]))

    empty = F.array().cast("array<string>")
    r, h = F.coalesce(ref, empty), F.coalesce(hyp, empty)
    same = F.transform(r, lambda _, k: F.struct(F.lit(MATCH).alias("op"), k.alias("i"), k.alias("j")))
    return F.when(r == h, same).otherwise(path(F.when(r != h, r), F.when(r != h, h)))


def edit_ops(ref: Column, hyp: Column, costs: Costs = UNIT, band: int | None = None) -> Column:
    """The steps of the best path, as an array of (op, ref, hyp)."""
    if costs is UNIT and band is None:
        at = lambda side, k: F.when(k.isNotNull(), F.get(side, k))
        return F.transform(edit_path(ref, hyp), lambda o: F.struct(o["op"].alias("op"), at(ref, o["i"]).alias("ref"), at(hyp, o["j"]).alias("hyp")))

    @F.arrow_udf(OPS)
    def ops(r: pa.Array, h: pa.Array) -> pa.Array:
        out = [[dict(zip(("op", "ref", "hyp"), s, strict=True)) for s in best_path(a or [], b or [], costs, band)[0]] for a, b in zip(r.to_pylist(), h.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("op", pa.string()), ("ref", pa.string()), ("hyp", pa.string())])))

    return ops(ref, hyp)


def edit_cost(ref: Column, hyp: Column, costs: Costs = UNIT, band: int | None = None) -> Column:
    """The cost of the best path."""

    @F.arrow_udf("double")
    def cost(r: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([best_path(a or [], b or [], costs, band)[1] for a, b in zip(r.to_pylist(), h.to_pylist(), strict=True)], pa.float64())

    return cost(ref, hyp)


def op_count(ops: Column, kind: str) -> Column:
    return F.size(F.filter(ops, lambda o: o["op"] == kind))


def breakdown(ops: Column) -> dict[str, Column]:
    """Counts by operation, errors, and both lengths."""
    s, i, d, m = (op_count(ops, k) for k in (SUB, INS, DEL, MATCH))
    return {"substitutions": s, "insertions": i, "deletions": d, "errors": s + i + d, "ref_length": m + s + d, "hyp_length": m + s + i}


def ops_markdown(ops: Column, max_rows: int) -> Column:
    """The first steps as a Markdown table, tokens quoted, and how many more there are."""
    quoted = lambda t: F.when(t.isNull(), "None").otherwise(F.concat(F.lit("'"), t, F.lit("'")))
    rows = F.transform(F.slice(ops, 1, max_rows), lambda o: F.concat(F.lit("| "), o["op"], F.lit(" | "), quoted(o["ref"]), F.lit(" | "), quoted(o["hyp"]), F.lit(" |")))
    more = F.size(ops) - max_rows
    tail = F.when(more > 0, F.array(F.concat(F.lit("| ... ("), more.cast("string"), F.lit(" more) ... | | |")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("| op | ref | hyp |"), F.lit("|---|---|---|")), rows, tail), "\n")
