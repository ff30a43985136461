"""Command line: ``python -m voxweft COMMAND``. Exit code 0, or 2 for what the user can mend."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alignment, analysis, calibration, grid, ngram, rescoring, voting
from ..session import prepare
from ..sources import manifests, models, reports


def session() -> SparkSession:
    s = SparkSession.builder.appName("voxweft").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return prepare(s)


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def joined(spark: SparkSession, a: argparse.Namespace, normal: bool) -> DataFrame:
    """References with the first hypothesis of each utterance, by tokens; utterances of one side only are left out."""
    n = manifests.parsed(manifests.read_manifest(spark, a.nbest), "nbest", allow_extra=True)
    r = manifests.parsed(manifests.read_manifest(spark, a.reference), "reference", allow_extra=True)
    first = F.get("hypotheses", F.lit(0))
    hyp = n.select("utterance_id", F.coalesce(first["text"], F.lit("")).alias("hyp_text"), first["tokens"].alias("hyp_tokens"))
    t = r.select("utterance_id", "speaker_group", "noise_db", "duration_s", "intent_domain", F.coalesce("text", F.lit("")).alias("text")).join(hyp, "utterance_id")
    if normal:
        t = t.withColumns({"ref": text.tokens(text.normalized(F.col("text"))), "hyp": text.tokens(text.normalized(F.col("hyp_text")))})
    else:
        t = t.withColumns({"ref": text.tokens(text.collapsed(F.col("text"))), "hyp": F.coalesce("hyp_tokens", text.tokens(F.col("hyp_text")))})
    if t.isEmpty():
        raise ValueError("no utterance is in both manifests")
    return alignment.with_rates(t)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    t = manifests.read_manifest(spark, a.manifest)
    if a.schema and (other := t.filter(F.col("schema") != a.schema).first()):
        raise ValueError(f"line {other['line_id'] + 1}: {other['schema']} is not {a.schema}")
    print(f"{t.count()} records")


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    t = spark.createDataFrame([(a.ref, a.hyp)], "r string, h string").select(text.normalized_pair(F.col("r"), F.col("h")).alias("p")).select("p.*")
    row = t.first()
    if row["fault"]:
        raise ValueError(row["fault"])
    print(json.dumps({"ref": row["ref"], "hyp": row["hyp"]}, ensure_ascii=False))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    show(joined(spark, a, not a.raw).agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer")))


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    t = manifests.hypothesis_rows(manifests.parsed(manifests.read_manifest(spark, path), "nbest", allow_extra=True))
    return t.select("utterance_id", "system", F.struct("system", "position").alias("rank"), F.col("tokens").alias("hyp"), "text", "acoustic")


def align(spark: SparkSession, a: argparse.Namespace) -> None:
    show(grid.shape(grid.cells(hypotheses(spark, a.nbest), ["utterance_id"]), ["utterance_id"]))


def fuse(spark: SparkSession, a: argparse.Namespace) -> None:
    cells = grid.cells(hypotheses(spark, a.nbest), ["utterance_id"])
    fused = voting.fuse(cells, voting.Fusion(policy=a.policy, tie_break=a.tie_break), ["utterance_id"])
    show(voting.fused_text(fused, ["utterance_id"]))


def rescore(spark: SparkSession, a: argparse.Namespace) -> None:
    if not (a.arpa or a.corpus):
        raise ValueError("--arpa or --corpus is wanted")
    model = models.read_arpa(spark, a.arpa) if a.arpa else ngram.train(models.read_corpus(spark, a.corpus), a.order)
    t = hypotheses(spark, a.nbest).withColumnRenamed("hyp", "tokens")
    t = ngram.lm_scores(t, model, ["utterance_id", "rank"], method="arpa" if a.arpa else "katz")
    s = rescoring.shallow_fusion(F.col("acoustic"), F.col("lm_score"), F.size("tokens"), a.lm_weight)
    show(rescoring.rescored(t, s, ["utterance_id"], top=a.top).select("utterance_id", "new_rank", "text", "score").orderBy("utterance_id", "new_rank"))


def calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    t = models.read_scores(spark, a.scores, inline=not a.file)
    if t.filter("score is null").count() or t.isEmpty():
        raise ValueError("scores must be numbers")
    t = calibration.softmax_scaled(t.withColumn("g", F.lit(0)), "score", a.temperature, ["g"]) if a.method == "temperature" else t.withColumn("scaled", F.col("score"))
    show(t.select("pos", "scaled").orderBy("pos"))


SLICES: dict[str, Callable] = {
    "speaker_group": lambda: analysis.field_slice(F.col("speaker_group")),
    "intent_domain": lambda: analysis.field_slice(F.col("intent_domain")),
    "noise": lambda: analysis.noise_slice(F.coalesce("noise_db", F.lit(0.0))),
    "duration": lambda: F.explode(analysis.duration_slices(F.coalesce("duration_s", F.lit(0.0)))),
}


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    slices = analysis.slice_metrics(joined(spark, a, False), SLICES[a.by](), use_cer=False).orderBy("key")
    print(reports.markdown(slices)) if a.format == "markdown" else show(slices)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    slices = analysis.slice_metrics(joined(spark, a, False), SLICES["speaker_group"](), use_cer=False)
    print(reports.markdown(slices)) if a.format == "markdown" else [print(r["value"]) for r in reports.json_lines(slices.orderBy("key")).collect()]


def demo(spark: SparkSession, a: argparse.Namespace) -> None:
    from ..sources.fixtures import Fixture, manifest_rows

    path = f"{a.out}/manifest"
    manifest_rows(spark, Fixture(n=a.n, seed=a.seed)).coalesce(1).write.mode("overwrite").text(path)
    a.nbest = a.reference = path
    a.raw = False
    score(spark, a)
    slices = analysis.slice_metrics(joined(spark, a, False), SLICES["speaker_group"](), use_cer=False)
    print(reports.markdown(slices))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxweft")
    commands = p.add_subparsers(dest="command", required=True)

    def add(f: Callable, *options: tuple, both: bool = False) -> None:
        c = commands.add_parser(f.__name__)
        c.set_defaults(run=f)
        for names, kw in ([(("--nbest",), {"required": True}), (("--reference",), {"required": True})] if both else []) + list(options):
            c.add_argument(*names, **kw)

    nbest = (("--nbest",), {"required": True})
    form = (("--format",), {"choices": ["markdown", "json"], "default": "markdown"})
    add(validate, (("manifest",), {}), (("--schema",), {}))
    add(normalize, (("--ref",), {"required": True}), (("--hyp",), {"required": True}))
    add(score, (("--raw",), {"action": "store_true"}), both=True)
    add(align, nbest)
    add(fuse, nbest, (("--policy",), {"choices": ["majority", "score"], "default": "majority"}), (("--tie-break",), {"choices": ["lexicographic", "first", "highest_score", "seeded"], "default": "lexicographic"}))
    add(rescore, nbest, (("--arpa",), {}), (("--corpus",), {}), (("--order",), {"type": int, "default": 2}), (("--lm-weight",), {"type": float, "default": 0.5}), (("--top",), {"type": int}))
    add(calibrate, (("scores",), {}), (("--file",), {"action": "store_true"}), (("--method",), {"choices": ["temperature", "piecewise"], "default": "temperature"}), (("--temperature",), {"type": float, "default": 1.0}))
    add(analyze, (("--by",), {"choices": sorted(SLICES), "default": "duration"}), form, both=True)
    add(report, form, both=True)
    add(demo, (("--out",), {"required": True}), (("-n",), {"type": int, "default": 20}), (("--seed",), {"type": int, "default": 0}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(session(), args)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # Spark wraps what its readers raise
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2
    return 0
