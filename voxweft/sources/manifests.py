"""Manifests: JSON lines of tagged, versioned records.

A record's tag ends, after the last dot, with its kind. Reading keeps every line; what is wrong with one is a column, so
bad lines become rows of a table of faults. Parsed kinds can be kept as Parquet by kind, where filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HYPOTHESIS = "struct<rank:int,text:string,tokens:array<string>,posteriors:array<double>,acoustic_log10:double,lm_log10:double,start_time:double,end_time:double,score:double>"
#: The fields of each kind, those that must be there as text, and the newest version.
KINDS: dict[str, dict[str, str]] = {
    "nbest": {"utterance_id": "string", "system": "string", "language": "string", "audio_path": "string", "acoustic_log10": "double", "lm_log10": "double", "hypotheses": f"array<{HYPOTHESIS}>"},
    "reference": {"utterance_id": "string", "text": "string", "speaker_id": "string", "speaker_group": "string", "duration_s": "double", "noise_db": "double", "intent_domain": "string", "tokens": "array<string>"},
    "system": {"system_id": "string", "language": "string", "vocabulary_size": "int", "description": "string", "acoustic_model": "string", "language_model": "string", "decoder": "string", "version": "string"},
    "fusion_run": {"utterance_id": "string", "systems": "array<string>", "tokens": "array<string>", "confidences": "array<double>", "policy": "string", "config_hash": "string", "arcs": "array<struct<pivot:string,candidates:array<array<string>>>>"},
    "report": {"report_id": "string", "generated_at": "string", "version": "string", "config_hash": "string", "seed": "int", "artifact_paths": "array<string>", "metrics": "array<struct<name:string,value:double>>"},
}
REQUIRED = {"nbest": ("utterance_id", "system", "language"), "reference": ("utterance_id",), "system": ("system_id", "language"), "fusion_run": ("utterance_id", "policy")}
VERSIONS = {"nbest": 2, "reference": 1, "system": 1, "fusion_run": 1, "report": 1}
COMMON = ("schema", "schema_version", "run")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line_id, value): lines that aren't blank, in an order that rises within each file's part."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_id"), "value")
    return t.filter(F.trim("value") != "")


def kind_of(tag: Column) -> Column:
    return F.substring_index(tag, ".", -1)


def record_fault(value: Column) -> Column:
    """What is wrong with a line, or null."""
    v = F.try_parse_json(value)
    kind_type = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    tag, version = text("schema"), F.try_variant_get(v, "$.schema_version", "int")
    kind = kind_of(tag)
    fault = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(kind_type("schema").isNull(), "schema is missing").when(kind_type("schema") != "STRING", "schema is no string")
    fault = fault.when(~kind.isin(*KINDS), "unknown schema")
    for k, fields in REQUIRED.items():
        for f in fields:
            own = kind_type(f)
            fault = fault.when((kind == k) & (own.isNull() | (own != "STRING") | (text(f) == "")), f"{f} must be a non-empty string")
    for f in ("acoustic_log10", "lm_log10"):
        own = kind_type(f)
        fault = fault.when((kind == "nbest") & own.isNotNull() & ~own.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), f"{f} must be numeric")
    own = kind_type("schema_version")
    newest = F.element_at(F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair]), kind)
    fault = fault.when(own.isNotNull() & (own != "VOID") & (own != "BIGINT"), "schema_version must be an integer")
    return fault.when((version < 1) | (version > newest), "unknown schema_version")


def unknown_fields(value: Column, kind: str) -> Column:
    """Names that a kind doesn't have."""
    return F.array_except(F.json_object_keys(value), F.array(*[F.lit(f) for f in (*COMMON, *KINDS[kind])]))


def duplicates(records: DataFrame, scope: str = "schema", id_col: str = "utterance_id", line_col: str = "line_id") -> DataFrame:
    """(schema, id, first_line, second_line) of ids that occur again, within a kind or within the file. Only sums by id
    are shuffled."""
    keys = ["schema", id_col] if scope == "schema" else [id_col]
    if scope not in ("schema", "file"):
        raise ValueError(scope)
    least = records.filter(F.col(id_col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(line_col).alias("first_line"))
    again = records.join(least.filter("n > 1"), keys).filter(F.col(line_col) > F.col("first_line"))
    return again.groupBy(*keys, "first_line").agg(F.min(line_col).alias("second_line"))


def read_manifest(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> DataFrame:
    """(line_id, schema, utterance_id, value, fault) of all lines; ``strict`` raises on the first fault or repeated id."""
    v = F.try_parse_json("value")
    t = read_lines(spark, path).select("line_id", F.try_variant_get(v, "$.schema", "string").alias("schema"), F.try_variant_get(v, "$.utterance_id", "string").alias("utterance_id"), "value", record_fault(F.col("value")).alias("fault"))
    if strict:
        if bad := t.filter("fault is not null").orderBy("line_id").first():
            raise ValueError(f"line {bad['line_id'] + 1}: {bad['fault']}")
        if again := duplicates(t).first():
            raise ValueError(f"{again['utterance_id']} at lines {again['first_line'] + 1} and {again['second_line'] + 1}")
    return t


def summary(records: DataFrame) -> DataFrame:
    """(schema, rows)."""
    return records.groupBy("schema").agg(F.count("*").alias("rows"))


def missing_kinds(records: DataFrame, required: Sequence[str]) -> list[str]:
    have = {r["k"] for r in records.select(kind_of(F.col("schema")).alias("k")).distinct().collect()}
    return [k for k in required if k not in have]


def parsed(records: DataFrame, kind: str, allow_extra: bool = False) -> DataFrame:
    """The records of one kind as columns, newest version; with ``extra``, the fields that the kind doesn't have, which
    are faults unless allowed."""
    fields = ", ".join(f"{f} {t}" for f, t in {"schema": "string", "schema_version": "int", **KINDS[kind]}.items())
    t = records.filter(kind_of(F.col("schema")) == kind)
    t = t.select("line_id", F.from_json("value", fields).alias("r"), unknown_fields(F.col("value"), kind).alias("extra")).select("line_id", "r.*", "extra")
    if kind == "nbest":
        t = migrated(t)
    return t if allow_extra else t.withColumn("fault", F.when(F.size("extra") > 0, F.concat(F.lit("unknown fields: "), F.array_join("extra", ", "))))


def migrated(nbest: DataFrame, to: int = 2) -> DataFrame:
    """N-best records of version 1 as version 2: a hypothesis's score becomes its acoustic score, its lm score is 0."""
    old = F.coalesce("schema_version", F.lit(1)) < to
    hyp = F.transform("hypotheses", lambda h: h.withField("acoustic_log10", F.coalesce(h["score"], h["acoustic_log10"])).withField("lm_log10", F.when(h["score"].isNotNull(), F.coalesce(h["lm_log10"], F.lit(0.0))).otherwise(h["lm_log10"])))
    return nbest.withColumns({"hypotheses": F.when(old, hyp).otherwise(F.col("hypotheses")), "schema_version": F.greatest(F.coalesce("schema_version", F.lit(1)), F.lit(to))})


def tagged(df: DataFrame, tag: str, version: int | None = None) -> DataFrame:
    """(value): rows as JSON with sorted fields, under a tag."""
    t = df.withColumns({"schema": F.lit(tag), "schema_version": F.lit(version or VERSIONS.get(tag.rpartition(".")[2], 1))})
    return t.select(F.to_json(F.struct(*sorted(t.columns))).alias("value"))


def write_manifest(df: DataFrame, path: str, tag: str, single: bool = False) -> None:
    """Writes tagged rows; with ``single`` to one part, for small results."""
    rows = tagged(df, tag)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def hypothesis_rows(nbest: DataFrame) -> DataFrame:
    """(utterance_id, system, position, rank, text, tokens, acoustic, lm): one row for each hypothesis, in file order."""
    t = nbest.select("utterance_id", "system", "acoustic_log10", "lm_log10", F.posexplode("hypotheses").alias("position", "h"))
    words = F.coalesce("h.tokens", F.filter(F.split("h.text", " "), lambda x: x != ""))
    return t.select("utterance_id", "system", "position", "h.rank", "h.text", words.alias("tokens"), F.coalesce("acoustic_log10", "h.acoustic_log10", F.lit(0.0)).alias("acoustic"), F.coalesce("lm_log10", "h.lm_log10", F.lit(0.0)).alias("lm"))


def audio_path_fault(path: Column) -> Column:
    """Why a path isn't a safe relative one, or null; an empty one is fine."""
    parts = F.split(clean_path(path), "/", -1)
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.element_at(parts, -1)
    return (
        F.when(path == "", F.lit(None).cast("string"))
        .when(path.contains("\0"), "NUL byte")
        .when(path.startswith("/") | path.startswith("~"), "not relative")
        .when(path.rlike("^[A-Za-z]:"), "drive letter")
        .when(F.exists(inner, lambda p: p.isin("", ".", "..")) | last.isin(".", ".."), "empty or parent segment")
        .when(F.exists(parts, lambda p: (p != "") & ~p.rlike(r"^[A-Za-z0-9._\-]+$")), "unsafe characters")
    )


def clean_path(path: Column) -> Column:
    """With forward slashes, none of them doubled."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")


def first_lines(records: DataFrame) -> DataFrame:
    """The first record of each kind and id."""
    w = Window.partitionBy("schema", "utterance_id").orderBy("line_id")
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
