"""Hashes of configurations, run metadata, and fingerprints of files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import platform
import sys
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain(value: Any) -> Any:
    """Dataclasses, sets, tuples and paths as what JSON has."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return os.fspath(value) if isinstance(value, os.PathLike) else value


def stable_hash(value: Any) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def merged(config: Any, overrides: Mapping[str, Any]) -> Any:
    """A copy of nested dataclasses with values by dotted name."""
    for name, value in overrides.items():
        head, _, rest = name.partition(".")
        if head not in {f.name for f in dataclasses.fields(config)}:
            raise ValueError(f"unknown option {name}")
        config = dataclasses.replace(config, **{head: merged(getattr(config, head), {rest: value}) if rest else value})
    return config


def from_plain(kind: type, values: Mapping[str, Any]) -> Any:
    """A dataclass of plain values; unknown names are rejected."""
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown options {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def save_config(config: Any, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(config), f, sort_keys=True, indent=2)


def load_config(kind: type, path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return from_plain(kind, json.load(f))


def describe(config: Any, before: str = "") -> list[str]:
    """Lines of dotted names and values."""
    out: list[str] = []
    for k, v in plain(config).items():
        out += describe_mapping(v, f"{before}{k}.") if isinstance(v, dict) else [f"{before}{k} = {v!r}"]
    return out


def describe_mapping(values: Mapping[str, Any], before: str) -> list[str]:
    return [line for k, v in values.items() for line in (describe_mapping(v, f"{before}{k}.") if isinstance(v, dict) else [f"{before}{k} = {v!r}"])]


@dataclasses.dataclass(frozen=True)
class Run:
    """Where, when and how something was computed."""

    config_hash: str
    seed: int
    python: str
    spark: str
    system: str
    stamped_at: str = ""


def capture(spark: SparkSession, config: Any, seed: int = 0, stamped_at: str = "") -> Run:
    return Run(stable_hash(config), seed, platform.python_version(), spark.version, sys.platform, stamped_at)


def with_run(df: DataFrame, run: Run) -> DataFrame:
    """Adds the run to every row."""
    return df.withColumn("run", F.struct(*[F.lit(v).alias(k) for k, v in plain(run).items()]))


def run_matches(df: DataFrame, run: Run) -> bool:
    """Whether all rows bear this run."""
    same = F.lit(True)
    for k, v in plain(run).items():
        same = same & F.col(f"run.{k}").eqNullSafe(F.lit(v))
    return bool(df.agg(F.coalesce(F.bool_and(same), F.lit(True))).first()[0])


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def env_flag(name: str, default: bool = False) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}
