"""Fusion of grid columns by voting, and confusion networks.

Input cells have the grid's keys, col, hyp, token, and optionally a score, an lm score, a posterior and a hypothesis
weight: a row for each, or an array for each column as ``grid.columns`` gives them, which is not shuffled again. Votes are sums by token
over a column's cells; a column has as many as an n-best list has hypotheses.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import GAP, flat

#: Limits of work, not of results: numbers of ties that a table of seeded draws has, and words of the generator beyond it.
FEW, WORDS = 64, 256


@dataclass(frozen=True)
class Fusion:
    """``policy``: majority, score, lm, posterior or confidence, or a function of the base weight that gives a column.
    ``tie_break``: lexicographic, first, highest_score or seeded. ``gaps``: keep (a column of gaps yields a gap of
    confidence 0), drop, or vote. ``order``: given, or sorted by token."""

    policy: str | Callable[[Column], Column] = "majority"
    alpha: float = 1.0
    tie_break: str = "lexicographic"
    gaps: str = "keep"
    seed: int = 0
    order: str = "given"

    def __post_init__(self) -> None:
        for value, allowed in ((self.tie_break, ("lexicographic", "first", "highest_score", "seeded")), (self.gaps, ("keep", "drop", "vote")), (self.order, ("given", "sorted"))):
            if value not in allowed:
                raise ValueError(f"{value} is none of {allowed}")
        if isinstance(self.policy, str) and self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy}")


#: By name: a candidate's weight from its base weight (1, or its score if that is positive) and its other columns.
POLICIES: dict[str, Callable[[Column, Fusion, Callable[[str], Column]], Column]] = {
    "majority": lambda w, f, of: w,
    "score": lambda w, f, of: w,
    "lm": lambda w, f, of: w + f.alpha * of("lm"),
    "posterior": lambda w, f, of: w * F.greatest(F.lit(0.0), of("posterior")),
    "confidence": lambda w, f, of: w * F.greatest(F.lit(0.0), of("hyp_weight")),
}


def by_column(cells: DataFrame, keys: Sequence[str], fields: Callable[[Callable[[str], Column]], dict[str, Column]], whole: bool = False) -> DataFrame:
    """(keys, col, cells): fields of each cell, made by a function that gets another from a field's name to the field. ``whole``: they are made
    of a table of cells, since they may name its columns."""
    of = lambda f: F.struct(*[c.alias(n) for n, c in fields(f).items()])
    if "cells" in cells.columns and not whole:
        return cells.select(*keys, "col", F.transform("cells", lambda x: of(lambda n: x[n])).alias("cells"))
    t = flat(cells, keys) if "cells" in cells.columns else cells
    return t.groupBy(*keys, "col").agg(F.collect_list(of(F.col)).alias("cells"))


def by_token(cells: Column) -> Column:
    """(token, own): the different tokens of an array of cells, each with its cells."""
    kinds = F.array_distinct(F.transform(cells, lambda x: x["token"]))
    return F.transform(kinds, lambda k: F.struct(k.alias("token"), F.filter(cells, lambda x: x["token"].eqNullSafe(k)).alias("own")))


def added(cells: Column, field: str) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + F.coalesce(x[field], F.lit(0.0)))


def seeded_draw(ties: Column, seed: int) -> Column:
    """Which of so many tied tokens a seeded generator of the standard library draws, counted from 1. That is its first 32-bit word whose
    leading bits, as many as the number has, are below the number. Up to ``FEW`` tokens a table says it; beyond, at least half of
    all words are, so none of ``WORDS`` is with a probability of 2^-256 at most."""
    drawn = F.array(*[F.lit(random.Random(seed).choice(range(1, n + 1))) for n in range(1, FEW + 1)])
    source = random.Random(seed)
    words = F.array(*[F.lit(source.getrandbits(32)).cast("long") for _ in range(WORDS)])
    leading = F.transform(words, lambda w: F.call_function("shiftright", w, 32 - F.length(F.bin(ties))))
    return F.when(ties <= FEW, F.get(drawn, ties - 1)).otherwise((F.get(F.filter(leading, lambda x: x < ties), F.lit(0)) + 1).cast("int"))


def fuse(cells: DataFrame, config: Fusion = Fusion(), keys: Sequence[str] = ("utt_id",), score: str | None = None) -> DataFrame:  # noqa: B008
    """(keys, col, token, confidence, agreement, margin, entropy) of each column's winner. Votes are summed by token over a
    column's cells; without a window, and without a shuffle where columns are given."""
    column = [*keys, "col"]

    def fields(of: Callable[[str], Column]) -> dict[str, Column]:
        base = F.greatest(F.lit(0.0), of(score)).cast("double") if score else F.lit(1.0)
        weight = config.policy(base) if callable(config.policy) else POLICIES[config.policy](base, config, of)
        return {"hyp": of("hyp"), "token": of("token"), "base": base, "weight": weight.cast("double")}

    t = by_column(cells, keys, fields, callable(config.policy))
    voters = F.col("cells") if config.gaps == "vote" else F.filter("cells", lambda x: x["token"] != GAP)
    t = t.select(*column, voters.alias("voters"))
    if config.gaps != "keep":
        t = t.filter(F.size("voters") > 0)
    falling = lambda c: F.coalesce(-F.round(c, 12), F.lit(math.inf))

    def tally(x: Column) -> Column:
        own, plain = x["own"], added(x["own"], "base")
        weights = F.transform(own, lambda y: y["weight"])
        mass = plain if config.policy in ("majority", "score") else F.when(F.exists(weights, lambda w: w.isNotNull()), added(own, "weight"))
        place = lambda y: y["hyp"] if config.order == "given" else y["token"]
        best = F.array_min(F.transform(own, lambda y: F.struct((-y["weight"]).alias("w"), place(y).alias("p"))))["p"]
        order = {"first": [F.array_min(F.transform(own, place)).alias("place")], "highest_score": [falling(F.array_max(weights)).alias("top"), best.alias("place")]}.get(config.tie_break, [])
        return F.struct(falling(mass).alias("mass"), *order, x["token"].alias("token"), F.size(own).alias("votes"), plain.alias("plain"))

    t = t.select(*column, F.size("voters").alias("all_votes"), F.sort_array(F.transform(by_token(F.col("voters")), tally)).alias("listed"))
    t = t.withColumn("total", added(F.col("listed"), "plain"))
    won = F.get("listed", F.lit(0))
    if config.tie_break == "seeded":
        ties = F.size(F.filter("listed", lambda x: x["mass"] == F.get("listed", F.lit(0))["mass"]))
        t = t.withColumn("ties", ties).withColumn("chosen", seeded_draw(F.col("ties"), config.seed))
        won = F.get("listed", F.col("chosen") - 1)
    part = lambda x: x["plain"] / F.col("total")
    t = t.select(
        *column,
        "all_votes",
        "total",
        won.alias("won"),
        F.get(F.sort_array(F.transform("listed", lambda x: x["plain"]), asc=False), F.lit(1)).alias("second"),
        F.aggregate("listed", F.lit(0.0), lambda s, x: s + F.when((x["plain"] > 0) & (F.col("total") > 0), -part(x) * F.log(part(x))).otherwise(0.0)).alias("entropy"),
    )
    voted, positive = F.col("all_votes") > 0, F.col("total") > 0
    return t.select(
        *column,
        F.when(voted, F.col("won.token")).otherwise(GAP).alias("token"),
        F.when(voted, F.col("won.votes") / F.col("all_votes")).otherwise(0.0).alias("confidence"),
        F.when(positive, F.col("won.plain") / F.col("total")).otherwise(0.0).alias("agreement"),
        F.when(positive, (F.col("won.plain") - F.coalesce("second", F.lit(0.0))) / F.col("total")).otherwise(0.0).alias("margin"),
        "entropy",
    )


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def fused_text(fused: DataFrame, keys: Sequence[str] = ("utt_id",), confidences: bool = True) -> DataFrame:
    """(keys, tokens, confidences) in the order of columns; the last one where asked for."""
    kept = ["token", *["confidence"] * confidences]
    s = F.array_sort(F.collect_list(F.struct("col", *kept)))
    return fused.groupBy(*keys).agg(s.alias("s")).select(*keys, *[_field("s", c).alias(f"{c}s") for c in kept])


def fusion_summary(fused: DataFrame, *by: str) -> DataFrame:
    """tokens, mean confidence, share of unanimous columns, share of gaps."""
    return fused.groupBy(*by).agg(
        F.count("*").alias("tokens"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg((F.col("confidence") >= 1 - 1e-9).cast("int")), F.lit(0.0)).alias("unanimous"),
        F.coalesce(F.avg((F.col("token") == GAP).cast("int")), F.lit(0.0)).alias("gap_share"),
    )


def fusion_faults(fused: DataFrame, cells: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """Winners that no hypothesis has in the column, and statistics out of range; none is expected."""
    place = [*keys, "col", "token"]
    both = fused.select(*place, F.lit(1).alias("won"), F.lit(0).alias("had")).unionByName((flat(cells, keys) if "cells" in cells.columns else cells).select(*place, F.lit(0).alias("won"), F.lit(1).alias("had")))
    strange = both.groupBy(*place).agg(F.sum("won").alias("won"), F.max("had").alias("had")).filter("won > 0 and had = 0")
    strange = strange.select(*keys, "col", F.explode(F.array_repeat(F.lit("token"), F.col("won").cast("int"))).alias("fault"))
    out = fused.filter(~F.col("confidence").between(0, 1 + 1e-9) | (F.col("agreement") > 1 + 1e-9))
    return strange.unionByName(out.select(*keys, "col", F.lit("range").alias("fault")))


def confusion_network(cells: DataFrame, keys: Sequence[str] = ("utt_id",), score: str | None = None, keep_gaps: bool = False) -> DataFrame:
    """(keys, col, token, posterior, place, pivot): arcs by falling posterior, then token. The pivot is the best arc that
    is no gap; a column of gaps has one gap of posterior 1. Arcs are sums over a column's cells, as in :func:`fuse`."""
    column = [*keys, "col"]
    base = lambda of: F.greatest(F.lit(0.0), of(score)) if score else F.lit(1.0)
    t = by_column(cells, keys, lambda of: {"token": of("token"), "w": base(of).cast("double")})
    arcs = F.transform(by_token(F.col("cells")), lambda x: F.struct(x["token"].alias("token"), added(x["own"], "w").alias("mass")))
    t = t.select(*column, arcs.alias("arcs")).withColumn("silent", F.forall("arcs", lambda x: x["token"] == GAP))
    kept = F.col("arcs") if keep_gaps else F.filter("arcs", lambda x: F.col("silent") | (x["token"] != GAP))
    t = t.select(*column, "silent", kept.alias("kept")).withColumn("total", added(F.col("kept"), "mass"))
    share = lambda x: F.when(F.col("silent"), 1.0).otherwise(x["mass"] / F.col("total"))
    placed = F.sort_array(F.transform(F.transform("kept", lambda x: F.struct(x["token"].alias("token"), share(x).alias("posterior"))), lambda x: F.struct((-F.round(x["posterior"], 12)).alias("falling"), x["token"].alias("token"), x["posterior"].alias("posterior"))))
    t = t.select(*column, placed.alias("placed"))
    pivot = F.when(F.get("placed", F.lit(0))["token"] != GAP, 0).otherwise(F.least(F.lit(1), F.size("placed") - 1))
    t = t.select(*column, pivot.alias("best"), F.posexplode_outer("placed").alias("at", "a"))  # outer: no column is empty, and no filter is made of it that computes the arcs again
    return t.select(*column, "a.token", "a.posterior", (F.col("at") + 1).alias("place"), (F.col("at") == F.col("best")).alias("pivot"))


def one_best(network: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, tokens): pivots in order, which is the cheapest cut of a chain."""
    s = F.array_sort(F.collect_list(F.when(F.col("pivot"), F.struct("col", "token"))))
    return network.groupBy(*keys).agg(F.transform(s, lambda x: x["token"]).alias("tokens"))


def network_faults(network: DataFrame, keys: Sequence[str] = ("utt_id",), tolerance: float = 1e-6) -> DataFrame:
    """Columns whose posteriors are negative or don't add up to 1."""
    sums = network.groupBy(*keys, "col").agg(F.sum("posterior").alias("s"), F.min("posterior").alias("m"))
    return sums.filter((F.abs(F.col("s") - 1) > tolerance) | (F.col("m") < 0))


def differing_positions(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, pos, a, b): places where two token arrays differ, those beyond the shorter included. Arrays are joined as wholes."""
    x, y = (t.select(*keys, F.col("tokens").alias(n)) for t, n in ((a, "x"), (b, "y")))
    places = F.arrays_zip(*[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in ("x", "y")])
    t = x.hint("merge").join(y, list(keys), "full_outer").select(*keys, F.posexplode(places).alias("pos", "p"))
    return t.select(*keys, "pos", F.col("p")["x"].alias("a"), F.col("p")["y"].alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))


def vote_confidence(chosen: DataFrame, hyps: DataFrame, keys: Sequence[str] = ("utt_id",), tokens: str = "hyp", rank: str | None = None) -> DataFrame:
    """(keys, pos, confidence): of the streams that reach a position of the chosen tokens, the share that have its
    token there; 0 where none reaches it. Streams are joined as wholes, not word by word; listed with their ranks they are
    what ``grid.columns`` lists, so Spark shuffles them once for both."""
    listed = F.sort_array(F.collect_list(F.struct(rank, tokens))) if rank else F.collect_list(F.struct(tokens))
    streams = hyps.groupBy(*keys).agg(listed.alias("s")).select(*keys, F.transform("s", lambda x: x[tokens]).alias("streams"))
    t = chosen.select(*keys, "tokens").join(streams.hint("merge"), list(keys), "left").select(*keys, "streams", F.posexplode("tokens").alias("pos", "want"))
    t = t.select(*keys, "pos", F.transform("streams", lambda s: F.get(s, F.col("pos")) == F.col("want")).alias("same"))
    known = F.size(F.filter("same", lambda x: x.isNotNull()))
    return t.select(*keys, "pos", F.when(known > 0, F.size(F.filter("same", lambda x: x)) / known).otherwise(0.0).alias("confidence"))


def agreement(cells: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, col, agreement): share of the most frequent token among a column's tokens, gaps left out; 0 for a column of
    gaps."""
    n = cells.groupBy(*keys, "col", "token").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("token") != GAP, F.col("n")))
    return n.groupBy(*keys, "col").agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("agreement"))
