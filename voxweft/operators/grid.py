"""Progressive alignment of several hypotheses into a grid of columns.

The grid's first row is aligned with one more hypothesis at a time: a match or substitution puts the token into the
column, an insertion opens a column of gaps, a deletion puts a gap. Gaps in the first row are ordinary symbols there, so
a later token may stand in a column that an earlier insertion opened. The sequential part is one Arrow UDF for each
utterance; everything after it is relational, on one row for each cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import accumulate, chain, pairwise, repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import DEL, INS, UNIT, Costs, best_path, unit_places

#: Fixed value: the symbol of a gap.
GAP = "*"


def columns_of(hyps: Sequence[Sequence[str]], costs: Costs = UNIT) -> list[list[str]]:
    """Columns of the grid, each with one cell for each hypothesis."""
    return [list(c) for c in zip(*grid_rows(hyps, costs), strict=True)]


def grid_rows(hyps: Sequence[Sequence], costs: Costs = UNIT, gap: str | int = GAP) -> list[list]:
    """Rows of the grid, one for each hypothesis, all of one width. With unit costs the path is that of :func:`unit_path <.alignment.unit_path>`."""
    if any(gap in h for h in hyps):
        raise ValueError("hypotheses must not hold the gap symbol")
    if not hyps:
        return []
    grid = [list(hyps[0])]
    for hyp in hyps[1:]:
        if costs is UNIT:
            olds, news = unit_places(grid[0], hyp)
            added = list(map([*hyp, gap].__getitem__, news))  # place -1, of no token, is the gap's
            if len(olds) > len(grid[0]):
                grid = [list(map([*row, gap].__getitem__, olds)) for row in grid]
        else:
            steps = best_path(grid[0], hyp, costs)[0]
            added = [gap if op == DEL else token for op, _, token in steps]
            olds = [iter(row) for row in grid]
            grid = [[gap if op == INS else next(old) for op, _, _ in steps] for old in olds]
        grid.append(added)
    return grid


class Lists:
    """Lists of hypotheses of an Arrow batch, null ones as empty ones: words are codes, the gap's is the one after the words'."""

    def __init__(self, values: pa.Array):
        inner = values.flatten()
        words = pc.dictionary_encode(inner.flatten())
        self.words: pa.Array = words.dictionary
        self.gap = len(self.words)
        if pc.any(pc.equal(self.words, GAP)).as_py():
            raise ValueError("hypotheses must not hold the gap symbol")
        codes = pc.fill_null(words.indices, self.gap + 1).to_numpy(zero_copy_only=False).tolist()
        hyps = [codes[i:j] for i, j in pairwise(ends(inner))]
        self.lists: list[list[list[int]]] = [hyps[i:j] for i, j in pairwise(ends(values))]

    def packed(self, grids: Sequence[list[list[int]]]) -> pa.Array:
        """Arrow columns of grids that are given as rows."""
        widths = [len(g[0]) if g else 0 for g in grids]
        table = pa.concat_arrays([self.words, pa.array([GAP, None], self.words.type)])
        codes = pa.array(list(chain.from_iterable(chain.from_iterable(zip(*g, strict=True)) for g in grids)), pa.int32())
        cells = accumulate(chain.from_iterable(repeat(len(g), w) for g, w in zip(grids, widths, strict=True)))
        columns = pa.ListArray.from_arrays(pa.array([0, *cells], pa.int32()), table.take(codes))
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(widths)], pa.int32()), columns)


def ends(lists: pa.Array) -> list[int]:
    return [0, *pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).cumsum().tolist()]


def align(hyps: Column, costs: Costs = UNIT) -> Column:
    """Array of columns (arrays of cells) of an array of hypotheses."""

    @F.arrow_udf("array<array<string>>")
    def grid(values: pa.Array) -> pa.Array:
        t = Lists(values)
        return t.packed([grid_rows(hs, costs, t.gap) for hs in t.lists] if costs is UNIT else [coded(t, hs, costs) for hs in t.lists])

    # so that it is evaluated once, not in a filter of empty grids as well
    return grid.asNondeterministic()(hyps)


def coded(t: Lists, hyps: Sequence[Sequence[int]], costs: Costs) -> list[list[int]]:
    """The same with costs that go by the words themselves."""
    words = [*t.words.to_pylist(), GAP, None]
    code = {w: k for k, w in enumerate(words)}
    return [[code[w] for w in row] for row in grid_rows([[words[k] for k in h] for h in hyps], costs)]


def columns(hyp: DataFrame, keys: Sequence[str] = ("utt_id",), rank: str = "rank", tokens: str = "hyp", costs: Costs = UNIT, keep: Sequence[str] = ()) -> DataFrame:
    """(keys, col, cells): the grid of each group's hypotheses, in the order of their rank; a column's cells are an array of (hyp,
    token, the ``keep`` columns), all from 0. What is kept of a hypothesis goes with its group and stands at each of its
    cells, so cells are joined with nothing. Groups are as large as n-best lists are."""
    lists = hyp.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank, tokens, *keep))).alias("h"))
    side = F.transform("h", lambda x: F.struct(*[x[c].alias(c) for c in keep])) if keep else F.lit(0)
    t = lists.select(*keys, side.alias("k"), align(F.transform("h", lambda x: x[tokens]), costs).alias("g")).select(*keys, "k", F.posexplode("g").alias("col", "c"))
    cell = lambda token, i: F.struct(i.alias("hyp"), token.alias("token"), *[F.get("k", i)[c].alias(c) for c in keep])
    return t.select(*keys, "col", F.transform("c", cell).alias("cells"))


def flat(columns: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """A row for each cell of :func:`columns`."""
    return columns.select(*keys, "col", F.inline("cells"))


def cells(hyp: DataFrame, keys: Sequence[str] = ("utt_id",), rank: str = "rank", tokens: str = "hyp", costs: Costs = UNIT, keep: Sequence[str] = ()) -> DataFrame:
    """(keys, col, hyp, token, the ``keep`` columns): the same, a row for each cell."""
    return flat(columns(hyp, keys, rank, tokens, costs, keep), keys)


def rows(grid: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, hyp, tokens): the hypotheses again."""
    kept = F.when(F.col("token") != GAP, F.struct("col", "token"))
    return grid.groupBy(*keys, "hyp").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["token"]).alias("tokens"))


def coverage(grid: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, hyp, cells): cells of each hypothesis that are no gap."""
    return grid.groupBy(*keys, "hyp").agg(F.count_if(F.col("token") != GAP).alias("cells"))


def shape(grid: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, width, depth)."""
    return grid.groupBy(*keys).agg((F.max("col") + 1).alias("width"), (F.max("hyp") + 1).alias("depth"))


def audit(grid: DataFrame, hyp: DataFrame, keys: Sequence[str] = ("utt_id",), rank: str = "rank", tokens: str = "hyp") -> DataFrame:
    """(keys, width, depth, lost, silent): the hypotheses that a group's grid, by columns or by cells, doesn't give back, and the columns
    without a token. Columns and hypotheses meet as one row of each group."""
    t = grid if "cells" in grid.columns else grid.groupBy(*keys, "col").agg(F.sort_array(F.collect_list(F.struct("hyp", "token"))).alias("cells"))
    side = F.sort_array(F.collect_list(F.struct("col", F.transform("cells", lambda x: x["token"]).alias("tokens"))))
    want = hyp.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank, tokens))).alias("h"))
    t = want.hint("merge").join(t.groupBy(*keys).agg(side.alias("c")), list(keys), "full_outer")  # no side is small enough to be broadcast
    t = t.select(*keys, "h", F.coalesce("c", F.array().cast("array<struct<col:int,tokens:array<string>>>")).alias("c"))
    back = lambda i: F.filter(F.transform("c", lambda x: F.get(x["tokens"], i)), lambda y: y != GAP)
    given = lambda x, i: F.coalesce(x[tokens], F.array().cast("array<string>")) == back(i)
    lost = F.filter(F.transform("h", lambda x, i: F.when(~given(x, i), i)), lambda i: i.isNotNull())
    silent = F.transform(F.filter("c", lambda x: F.forall(x["tokens"], lambda y: y == GAP)), lambda x: x["col"])
    return t.select(*keys, F.size("c").alias("width"), F.coalesce(F.size(F.get("c", F.lit(0))["tokens"]), F.lit(0)).alias("depth"), lost.alias("lost"), silent.alias("silent"))


def inconsistent(grid: DataFrame, hyp: DataFrame, keys: Sequence[str] = ("utt_id",), rank: str = "rank", tokens: str = "hyp") -> DataFrame:
    """Hypotheses that the grid doesn't give back, and columns without a token; none is expected."""
    t = audit(grid, hyp, keys, rank, tokens)
    kinds = F.array(F.struct(F.lit("row").alias("fault"), F.col("lost").alias("at")), F.struct(F.lit("column").alias("fault"), F.transform("silent", lambda _: F.lit(-1)).alias("at")))
    return t.select(*keys, F.inline(kinds)).select(*keys, F.explode("at").alias("hyp"), "fault")


def turned(hyps: Column, costs: Costs = UNIT) -> Column:
    """(given, sorted) of each order of a list that puts one of its hypotheses first: the digests of its grid, rows back in the
    order of the list, and of the grid of its hypotheses sorted. An order that is met again in a list isn't aligned again."""

    @F.arrow_udf("array<struct<given:string,sorted:string>>")
    def both(values: pa.Array) -> pa.Array:
        t = Lists(values)
        words = [*t.words.to_pylist(), GAP, None]
        out = []
        for hyps in t.lists:
            named = [repr(tuple(words[k] for k in h)) for h in hyps]
            made: dict[tuple[str, ...], list[list[int]]] = {}
            found = []
            for turn in range(len(hyps)):
                order = [*range(turn, len(hyps)), *range(turn)]
                digests = []
                for rows in (order, sorted(order, key=named.__getitem__)):
                    key = tuple(named[k] for k in rows)
                    if key not in made:
                        made[key] = grid_rows([hyps[k] for k in rows], costs, t.gap) if costs is UNIT else coded(t, [hyps[k] for k in rows], costs)
                    back = made[key] if rows is not order else [made[key][order.index(k)] for k in range(len(hyps))]
                    lines = "\n".join([" ".join([words[x] for x in c if x <= t.gap]) for c in zip(*back, strict=True)])
                    digests.append(hashlib.md5(lines.encode()).hexdigest())
                found.append(dict(zip(("given", "sorted"), digests, strict=True)))
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("given", pa.string()), ("sorted", pa.string())])))

    return both(hyps)


def order_effects(hyp: DataFrame, keys: Sequence[str] = ("utt_id",), rank: str = "rank", tokens: str = "hyp", costs: Costs = UNIT) -> DataFrame:
    """(keys, orders, grids, sorted_grids, sorted_hash): how many different grids the hypotheses give when each is put first
    in turn, their rows back in the order of rank; how many when they are sorted, which must be 1; and the digest of that grid.
    As many orders as hypotheses are tried, not all permutations: the first row decides what the others are aligned with. A
    grid's digest is of its columns, a line each. Repeated hypotheses and ties of rank are ordered by their tokens."""
    lists = hyp.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, tokens))), lambda x: x[tokens]).alias("hs"))
    t = lists.select(*keys, turned(F.col("hs"), costs).alias("t"))
    different = lambda c: F.size(F.array_distinct(F.transform("t", lambda x: x[c])))
    return t.select(*keys, F.size("t").cast("long").alias("orders"), different("given").alias("grids"), different("sorted").alias("sorted_grids"), F.array_min(F.transform("t", lambda x: x["sorted"])).alias("sorted_hash"))
