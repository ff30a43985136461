"""Alignments, fusions, confusion networks and timings as manifest rows, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import OPS, breakdown
from ..operators.voting import Fusion
from .provenance import stable_hash


def _json(df: DataFrame, keys: Sequence[str], fields: dict) -> DataFrame:
    return df.select(*keys, F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])).alias("value"))


def alignment_rows(df: DataFrame, keys: Sequence[str] = ("utt_id",), ops: str = "ops") -> DataFrame:
    """(keys, value): steps with their counts."""
    n = breakdown(F.col(ops))
    fields = {"schema": F.lit("alignment"), "schema_version": F.lit(1), "ops": F.col(ops), "score": n["errors"].cast("double"), "errors": n["errors"], "ref_length": n["ref_length"], "hyp_length": n["hyp_length"]}
    return _json(df, keys, fields)


def alignments(rows: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, ops, score, fault) of rows; a fault is a tag, version or field that isn't as it must be."""
    t = rows.select(*keys, F.from_json("value", f"schema string, schema_version int, score double, ops {OPS}").alias("v"))
    fault = F.when(F.col("v.schema").isNull() | (F.substring_index("v.schema", ".", -1) != "alignment"), "schema").when(F.coalesce("v.schema_version", F.lit(1)) != 1, "schema_version").when(F.col("v.ops").isNull() | F.col("v.score").isNull(), "fields")
    return t.select(*keys, "v.ops", "v.score", fault.alias("fault"))


def fusion_rows(fused: DataFrame, config: Fusion, systems: Sequence[str] = (), keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, value) of (keys, tokens, confidences); the hash covers policy, alpha and tie-break."""
    name = config.policy if isinstance(config.policy, str) else "custom"
    digest = stable_hash({"policy": name, "alpha": config.alpha, "tie_break": config.tie_break})
    listed = F.array(*[F.lit(s) for s in systems]).cast("array<string>")
    fields = {"schema": F.lit("fusion_run"), "schema_version": F.lit(1), "utterance_id": F.concat_ws("-", *keys), "systems": listed, "tokens": F.col("tokens"), "confidences": F.col("confidences"), "policy": F.lit(name), "config_hash": F.lit(digest), "arcs": F.array().cast("array<string>")}
    return _json(fused, keys, fields)


def fusions(rows: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, tokens, confidences, policy, config_hash)."""
    t = rows.select(*keys, F.from_json("value", "tokens array<string>, confidences array<double>, policy string, config_hash string").alias("v"))
    return t.select(*keys, "v.*")


def network_rows(network: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, value): a network as a fusion run of its pivots, with arcs as pairs of token and probability."""
    arcs = F.array_sort(F.collect_list(F.struct("place", "token", "posterior")))
    pivot = lambda c: F.max(F.when(F.col("pivot"), F.col(c)))
    slots = network.groupBy(*keys, "col").agg(pivot("token").alias("pivot"), pivot("posterior").alias("p"), F.transform(arcs, lambda a: F.array(a["token"], a["posterior"].cast("string"))).alias("candidates"))
    s = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "pivot", "p", "candidates"))).alias("s"))
    part = lambda f: F.transform("s", lambda x: x[f])
    fields = {"schema": F.lit("fusion_run"), "schema_version": F.lit(1), "utterance_id": F.concat_ws("-", *keys), "policy": F.lit("confusion"), "config_hash": F.lit(""), "tokens": part("pivot"), "confidences": part("p"), "arcs": F.transform("s", lambda x: F.struct(x["pivot"].alias("pivot"), x["candidates"].alias("candidates")))}
    return _json(s, keys, fields)


def networks(rows: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, col, token, posterior, place, pivot)."""
    t = rows.select(*keys, F.from_json("value", "arcs array<struct<pivot:string,candidates:array<array<string>>>>").alias("v")).select(*keys, F.posexplode("v.arcs").alias("col", "s"))
    t = t.select(*keys, "col", "s.pivot", F.posexplode("s.candidates").alias("place", "a"))
    return t.select(*keys, "col", F.col("a")[0].alias("token"), F.col("a")[1].cast("double").alias("posterior"), (F.col("place") + 1).alias("place"), (F.col("a")[0] == F.col("pivot")).alias("pivot"))


def timing_rows(timings: DataFrame) -> DataFrame:
    """(track, value): tokens and their times."""
    s = timings.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "token", "start_s", "end_s"))).alias("s"))
    return _json(s, ["track"], {"tokens": F.transform("s", lambda x: x["token"]), "timings": F.transform("s", lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s")))})


def tracks(rows: DataFrame) -> DataFrame:
    """(track, idx, token, start_s, end_s, fault): the tokens; lists of different lengths are a fault."""
    t = rows.select("track", F.from_json("value", "tokens array<string>, timings array<struct<start_s:double,end_s:double>>").alias("v"))
    fault = F.when(F.size("v.tokens") != F.size("v.timings"), "lengths")
    return t.select("track", fault.alias("fault"), F.posexplode(F.arrays_zip("v.tokens", "v.timings")).alias("idx", "x")).select("track", "idx", F.col("x.tokens").alias("token"), "x.timings.start_s", "x.timings.end_s", "fault")
