"""Re-ranking of hypotheses by acoustic and language-model scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import char_errors, error_rate


def shallow_fusion(acoustic: Column, lm: Column, length: Column, lm_weight: Column | float, acoustic_weight: float = 1.0, penalty: float = 0.0) -> Column:
    return acoustic_weight * acoustic + lm_weight * lm - penalty * length


def rescored(hyps: DataFrame, score: Column, keys: Sequence[str] = ("utt_id",), tie: str = "rank", top: int | None = None) -> DataFrame:
    """Adds ``score`` and ``new_rank``, from 1, by falling score; equal scores keep the order of ``tie``."""
    t = hyps.withColumn("score", score)
    t = t.withColumn("new_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), tie)))
    return t if top is None else t.filter(F.col("new_rank") <= top)


def with_error(hyps: DataFrame, keys: Sequence[str] = ("utt_id",), ref: str = "ref", tokens: str = "hyp") -> DataFrame:
    """Adds ``error``: of utterances any of whose hypotheses has a token of several characters, the character error rate
    of the joined reference and the hypothesis's text with spaces; of others the word error rate. Rows have ``wer``."""
    r, h = F.array_join(ref, ""), F.array_join(tokens, " ")
    long = F.max(F.exists(tokens, lambda t: F.char_length(t) > 1)).over(Window.partitionBy(*keys))
    cer = error_rate(char_errors(r, h), F.char_length(r), F.char_length(h))
    return hyps.withColumn("error", F.when(long, cer).otherwise(F.col("wer")))


def weight_sweep(hyps: DataFrame, weights: Sequence[float] = (0.0, 0.1, 0.2, 0.5, 1.0), keys: Sequence[str] = ("utt_id",), tie: str = "rank", penalty: float = 0.0, tokens: str = "hyp") -> DataFrame:
    """(weight, error, n): mean error of the best hypothesis at each weight; rows have acoustic, lm and error. Each
    weight's best one is an aggregate, so no row is sorted."""
    t = hyps.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    score = F.round(shallow_fusion(F.col("acoustic"), F.col("lm"), F.size(tokens), F.col("weight"), penalty=penalty), 9)
    best = t.groupBy(*keys, "weight").agg(F.min_by("error", F.struct((-score).alias("s"), F.col(tie).alias("t"))).alias("error"))
    return best.groupBy("weight").agg(F.avg("error").alias("error"), F.count("*").alias("n"))


def not_monotone(hyps: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("utt_id",), tie: str = "rank") -> DataFrame:
    """Pairs of one utterance with equal acoustic scores of which the one with the larger lm score gets the smaller
    fused score at a weight; none is expected for weights of 0 or more. Neighbours in the order of lm are enough, since
    the fused score is compared along it."""
    w = Window.partitionBy(*keys, "acoustic", "weight").orderBy("lm", tie)
    t = hyps.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    t = t.withColumn("score", shallow_fusion(F.col("acoustic"), F.col("lm"), F.lit(0), F.col("weight")))
    return t.withColumn("before", F.lag("score").over(w)).filter(F.col("score") < F.col("before") - 1e-12)
