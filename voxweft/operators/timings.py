"""Token timings: one row (track, idx, token, start_s, end_s) for each timed token, in seconds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import edit_path
from .draws import numbered


def _order() -> Window:
    return Window.partitionBy("track").orderBy("idx")


def timing_fault(tolerance: float = 1e-9) -> Column:
    """What is wrong with a row, or null; over whole tracks."""
    s, e = F.col("start_s"), F.col("end_s")
    before = F.lag("end_s").over(_order())
    infinite = lambda x: F.abs(x) == F.lit(float("inf"))
    return (
        F.when(F.isnan(s) | F.isnan(e), "nan")
        .when((s < 0) | (e < 0), "negative")
        .when(e < s, "reversed")
        .when(infinite(s) | infinite(e), "infinite")
        .when(s < before - tolerance, "overlap")
    )


def faults(timings: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    return timings.withColumn("fault", timing_fault(tolerance)).filter("fault is not null")


def track_totals(timings: DataFrame) -> DataFrame:
    """(track, n, total_s, speaking_s, speaking_ratio)."""
    t = timings.groupBy("track").agg(F.count("*").alias("n"), (F.max_by("end_s", "idx") - F.min_by("start_s", "idx")).alias("total_s"), F.sum(F.col("end_s") - F.col("start_s")).alias("speaking_s"))
    return t.withColumn("speaking_ratio", F.when(F.col("total_s") > 0, F.col("speaking_s") / F.col("total_s")).otherwise(0.0))


def fill_gaps(timings: DataFrame, max_gap_s: float) -> DataFrame:
    """Tokens without duration grow into the middle of the silence around them, if that is ``max_gap_s`` at most.
    Neighbours are taken as they were."""
    if max_gap_s < 0:
        raise ValueError("max_gap_s must not be negative")
    s, e = F.col("start_s"), F.col("end_s")
    before = F.coalesce(F.lag("end_s").over(_order()), s)
    after = F.coalesce(F.lead("start_s").over(_order()), e)
    t = timings.withColumns({"_b": before, "_a": after})
    gap = F.col("_a") - F.col("_b")
    grow = ~(e - s > 0) & (gap > 0) & (gap <= max_gap_s)
    return t.withColumns({"start_s": F.when(grow, (F.col("_b") + s) / 2).otherwise(s), "end_s": F.when(grow, (e + F.col("_a")) / 2).otherwise(e)}).drop("_a", "_b")


def _away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def snap(timings: DataFrame, frame_s: float = 0.01) -> DataFrame:
    """Boundaries as multiples of a frame, halves away from zero, none below zero or reversed."""
    if frame_s <= 0:
        raise ValueError("frame_s must be positive")
    on = lambda c: F.greatest(F.lit(0.0), _away(F.col(c) / frame_s) * frame_s)
    return timings.withColumns({"start_s": on("start_s"), "end_s": F.greatest(on("start_s"), on("end_s"))})


def duration_bucket(seconds: Column, edges: Sequence[float] = (1.0, 3.0, 8.0)) -> Column:
    """<1.0s, 1.0-3.0s and so on; an edge belongs to the bucket above it."""
    out = F.lit(f">={float(edges[-1])}s")
    for i in range(len(edges) - 1, -1, -1):
        name = f"<{float(edges[0])}s" if i == 0 else f"{float(edges[i - 1])}-{float(edges[i])}s"
        out = F.when(seconds < edges[i], name).otherwise(out)
    return out


def timing_report(timings: DataFrame) -> DataFrame:
    """(count, mean_s, median_s, p95_s, gap_total_s): nearest-rank quantiles of tracks' totals, and all silence.
    Totals are numbered by ranges; those that are null count as tracks only."""
    silence = F.greatest(F.lit(0.0), F.col("start_s") - F.lag("end_s").over(_order()))
    gaps = timings.withColumn("gap", F.coalesce(silence, F.lit(0.0))).groupBy("track").agg(F.sum("gap").alias("gap"))
    t = track_totals(timings).join(gaps, "track").select(F.col("total_s").isNull().alias("unknown"), "total_s", "track", "gap")
    t = numbered(t, ["unknown", "total_s", "track"])
    known = t.agg(F.count("total_s")).first()[0]
    at = lambda q: F.coalesce(F.max(F.when(F.col("place") == math.ceil(q * known) - 1, F.col("total_s"))), F.lit(0.0))
    return t.agg(F.count("*").alias("count"), F.coalesce(F.avg("total_s"), F.lit(0.0)).alias("mean_s"), at(0.5).alias("median_s"), at(0.95).alias("p95_s"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_total_s"))


def align_tracks(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(track, step, op, ref_idx, hyp_idx, start_s, end_s): the best path of two tracks' tokens, timed by the
    hypothesis, and by the reference where a token is missing. Tracks are as long as recordings are."""
    lists = lambda t, n: t.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "token", "start_s", "end_s"))).alias(n))
    both = lists(ref, "r").join(lists(hyp, "h"), "track")
    words = lambda c: F.transform(c, lambda x: x["token"])
    t = both.select("track", "r", "h", F.posexplode(edit_path(words("r"), words("h"))).alias("step", "o"))
    timed = F.coalesce(F.get("h", F.col("o.j")), F.get("r", F.col("o.i")))
    return t.select("track", "step", "o.op", F.col("o.i").alias("ref_idx"), F.col("o.j").alias("hyp_idx"), timed["start_s"].alias("start_s"), timed["end_s"].alias("end_s"))
