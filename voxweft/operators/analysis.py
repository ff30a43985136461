"""Error analysis: slices, substitution pairs, bootstrap intervals, group bias."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..saved import saved
from .alignment import SUB
from .draws import drawn_means

#: Cumulative probabilities of a Poisson variable of mean 1, as far as a uniform number of 32 bits can tell them from 1.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))
#: Groups whose sums a task holds before it hands them on.
MOST_GROUPS = 1024


def field_slice(column: Column) -> Column:
    """The value, or unknown where there is none."""
    return F.when(column.isNull() | (column == ""), "unknown").otherwise(column)


def noise_slice(db: Column) -> Column:
    return F.when(db < 0, "quiet").when(db < 20, "moderate").otherwise("noisy")


def duration_slices(seconds: Column, boundaries: Sequence[float] = (1.0, 3.0, 10.0)) -> Column:
    """Every utterance's two slices: all, and the first boundary above its duration, or >10s."""
    bucket = F.lit(">10s")
    for b in reversed(boundaries):
        bucket = F.when(seconds < b, f"<{b:g}s").otherwise(bucket)
    return F.array(F.lit("all"), bucket)


def quantile_edges(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Nearest-rank edges: the values at ranks i * n / buckets of the sorted column, without repetitions. The ranks
    come from counts of different values, summed in order over blocks of neighbouring values."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    n = df.count()
    if not n:
        return []
    ranks = sorted({min(i * n // buckets, n - 1) for i in range(buckets + 1)})
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = (high - low) / 4096 or 1.0
    block = F.least(F.lit(4095), F.floor((F.col("v") - low) / width)).cast("int")
    counts = counts.withColumn("block", block)
    totals = counts.groupBy("block").agg(F.sum("c").alias("t"))
    before = totals.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    inner = Window.partitionBy("block").orderBy("v")
    ends = counts.join(F.broadcast(before), "block").withColumn("end", F.sum("c").over(inner) + F.col("before"))
    hit = F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("c")))
    return sorted(r["v"] for r in ends.filter(hit).select("v").distinct().collect())


def quantile_slice(column: Column, edges: Sequence[float]) -> Column:
    """q0, q1 and so on: the half-open interval between edges that holds a value; the last one is closed."""
    if len(edges) < 2:
        return F.lit("all")
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 2, -1, -1):
        lo, hi = edges[k], edges[k + 1]
        last = k == len(edges) - 2
        inside = (column >= lo) & ((column <= hi) if last else (column < hi))
        out = F.when(inside, f"q{k}").otherwise(out)
    return out


def slice_metrics(rates: DataFrame, key: Column, use_cer: bool = True) -> DataFrame:
    """(key, count, cer, wer): mean rates by slice."""
    cer = F.avg("cer") if use_cer else F.lit(0.0)
    return rates.withColumn("key", key).groupBy("key").agg(F.count("*").alias("count"), cer.alias("cer"), F.avg("wer").alias("wer"))


def substitution_pairs(ops: DataFrame, ops_col: str = "ops", directed: bool = True, min_count: int = 1, top: int | None = None) -> DataFrame:
    """(ref, hyp, count) of substitutions, most frequent first, ties by the pair. A top list sorts only its own rows."""
    s = ops.select(F.explode(F.filter(ops_col, lambda o: o["op"] == SUB)).alias("o")).select("o.ref", "o.hyp")
    if not directed:
        s = s.select(F.least("ref", "hyp").alias("ref"), F.greatest("ref", "hyp").alias("hyp"))
    out = s.groupBy("ref", "hyp").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count).orderBy(F.desc("count"), "ref", "hyp")
    return out if top is None else out.limit(top)


def poisson_weights(ids: Sequence[str | None], replicates: int, seed: int) -> np.ndarray:
    """How often each row is drawn in each replicate: Poisson variables of a hash of seed, replicate and id. Rows of one id that
    follow one another are drawn at once."""
    begins, last, drawn, at = [f"{seed}:{r}:".encode() for r in range(replicates)], object(), [], []
    for i in ids:
        if i != last:
            last, end = i, (i or "").encode()
            # no id, no colon before it
            drawn += [md5(p + end if i is not None else p[:-1]).digest()[:4] for p in begins]
        at.append(len(drawn) // max(1, replicates) - 1)
    units = np.frombuffer(b"".join(drawn), ">u4").astype(np.float64) / 4294967296.0
    return np.searchsorted(POISSON, units, "right").reshape(-1, replicates)[at]


def bootstrap(pairs: DataFrame, id_col: str, a: str, b: str, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(rep, delta): mean of b - a in each replicate. Rows are drawn by Poisson weights, so replicates are sums over one
    pass of the rows: each task adds up its rows' weights for all replicates, and its sums are grouped. Rows are small
    and their draws are not, so they are dealt out by a fixed number first, which Spark doesn't put together by size."""
    t = pairs.select(*by, F.col(id_col).cast("string").alias("_id"), (F.col(b) - F.col(a)).cast("double").alias("_d"))
    spark = pairs.sparkSession
    t = t.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("_id"))  # a plain key may be the one of a grouping, whose partitions are put together

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[np.ndarray | bool]] = {}
        for batch in batches:
            groups = list(zip(*[c.to_pylist() for c in batch.columns[: len(by)]], strict=True)) or [()] * batch.num_rows
            d = batch.columns[-1].to_numpy(zero_copy_only=False)
            known = batch.columns[-1].is_valid().to_numpy(zero_copy_only=False)
            w = poisson_weights(batch.columns[-2].to_pylist(), replicates, seed)
            code = {g: k for k, g in enumerate(dict.fromkeys(groups))}
            of = np.array([code[g] for g in groups], np.int64)
            for g, k in code.items():
                own, has = of == k, (of == k) & known
                s, n, any_known = found.get(g, (0.0, 0, False))
                found[g] = (s + d[has] @ w[has], n + w[own].sum(0), any_known or bool(has.any()))
            if len(found) > MOST_GROUPS:
                yield packed(found)
                found = {}
        if found:
            yield packed(found)

    def packed(found: dict) -> pa.RecordBatch:
        reps = range(replicates)
        values = [(*g, r, float(s[r]) if some else None, int(n[r])) for g, (s, n, some) in found.items() for r in reps]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*values, strict=True), kinds, strict=True)], names)

    schema = T.StructType([*[t.schema[c] for c in by], T.StructField("rep", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    names, kinds = schema.names, [f.type for f in to_arrow_schema(schema)]
    drawn = t.mapInArrow(sums, schema).groupBy(*by, "rep").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return drawn.select(*by, "rep", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("delta"))


def bootstrap_interval(replicated: DataFrame, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(lo, hi, p_value): percentile interval by linear interpolation, and (replicates with delta <= 0, + 1) over
    (replicates + 1)."""
    q = (1 - level) / 2
    return replicated.groupBy(*by).agg(
        F.percentile("delta", F.lit(q)).alias("lo"),
        F.percentile("delta", F.lit(1 - q)).alias("hi"),
        ((F.sum((F.col("delta") <= 0).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"),
    )


def sequential_bootstrap(pairs: DataFrame, order: Sequence[str], metrics: Sequence[tuple[str, str]], replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """(metric, delta, lo, hi, p_value, n): for each pair (a, b) of ``metrics`` the mean of b less that of a, and its interval
    over replicates drawn as one seeded generator draws them from the rows in this order, all metrics from the same draws.
    Metrics are named by their second column. Nulls make a metric's values null; without rows there is no row."""
    columns = list(dict.fromkeys(c for pair in metrics for c in pair))
    pairs = saved(pairs.select(*dict.fromkeys([*order, *columns])), "pairs")
    named = lambda a, b, x: F.struct(F.lit(b).alias("metric"), x.alias("delta"))
    each = lambda t: t.select(F.inline(F.array(*[named(a, b, F.col(b) - F.col(a)) for a, b in metrics])))
    replicated = each(drawn_means(pairs, order, columns, replicates, seed))
    whole = pairs.agg(F.count("*").alias("n"), *[F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in columns])
    whole = whole.select("n", F.inline(F.array(*[named(a, b, F.col(b) - F.col(a)) for a, b in metrics])))
    missing = replicated.groupBy("metric").agg((F.count("delta") < F.count("*")).alias("missing"))
    known = lambda c: F.when(~F.col("missing"), F.col(c)).alias(c)
    out = whole.join(bootstrap_interval(replicated, level, ("metric",)), "metric").join(missing, "metric")
    return out.select("metric", "delta", *[known(c) for c in ("lo", "hi", "p_value")], "n")


def paired_intervals(pairs: DataFrame, id_col: str, metrics: Sequence[tuple[str, str]], replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """As :func:`sequential_bootstrap`, with the draws of :func:`bootstrap`; pairs in which a value is null are left out of
    their metric."""
    stacked = F.inline(F.array(*[F.struct(F.lit(b).alias("metric"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in metrics]))
    t = pairs.select(F.col(id_col).alias("id"), stacked).filter("a is not null and b is not null")
    whole = t.groupBy("metric").agg((F.avg("b") - F.avg("a")).alias("delta"), F.count("*").alias("n"))
    found = bootstrap_interval(bootstrap(t, "id", "a", "b", replicates, seed, ("metric",)), level, ("metric",))
    return whole.join(found, "metric").select("metric", "delta", "lo", "hi", "p_value", "n")


def comparison(intervals: DataFrame, cer: str, wer: str, system_a: str = "A", system_b: str = "B") -> DataFrame:
    """(system_a, system_b, n_pairs, delta_cer, cer_lo, cer_hi, delta_wer, wer_lo, wer_hi) of the intervals of two metrics."""
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    each = [of(m, c).alias(name.format(kind)) for m, kind in ((cer, "cer"), (wer, "wer")) for c, name in (("delta", "delta_{}"), ("lo", "{}_lo"), ("hi", "{}_hi"))]
    return intervals.agg(F.count("*").alias("_rows"), F.max("n").alias("n_pairs"), *each).filter("_rows > 0").select(F.lit(system_a).alias("system_a"), F.lit(system_b).alias("system_b"), "n_pairs", *[c for k in ("cer", "wer") for c in (f"delta_{k}", f"{k}_lo", f"{k}_hi")])


def group_bias(rates: DataFrame, group: Column, id_col: str, replicates: int, seed: int) -> DataFrame:
    """(group, n, wer, lo, hi): mean word error rate by group with a bootstrap interval, worst first."""
    t = rates.withColumns({"group": group, "zero": F.lit(0.0)})
    means = t.groupBy("group").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"))
    ci = bootstrap_interval(bootstrap(t, id_col, "zero", "wer", replicates, seed, ("group",)), by=("group",)).drop("p_value")
    return means.join(ci, "group").orderBy(F.desc("wer"), "group")
