"""Paths under a base, resolved by their names alone: no file system is asked, so links are not followed.

Null in any argument gives null. A base has to be absolute; one that isn't gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .manifests import audio_path_fault, clean_path


def resolved(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; above the root there is only the root. Null for others."""
    names = F.filter(F.split(path, "/", -1), lambda s: ~s.isin("", "."))
    kept = F.aggregate(names, F.array().cast("array<string>"), lambda done, s: F.when(s != "..", F.array_append(done, s)).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))))
    plain = ~path.rlike(r"(^|/)\.\.(/|$)")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(F.when(plain, names).otherwise(kept), "/")))


def _under(base: Column, path: Column) -> Column:
    return (path == base) | path.startswith(F.when(base == "/", base).otherwise(F.concat(base, F.lit("/"))))


def safe_join(base: Column, *parts: Column) -> Column:
    """The base and parts as one resolved path, or null where that lies outside the base. As elsewhere, an absolute part
    replaces what stands before it."""
    root, path = resolved(base), base
    for part in parts:
        path = F.when(part.startswith("/"), part).otherwise(F.concat(path, F.lit("/"), part))
    path = resolved(path)
    return F.when(_under(root, path), path)


def relative_within(base: Column, target: Column) -> Column:
    """The target's path from the base, ``.`` for the base itself, or null where it lies outside."""
    root, path = resolved(base), resolved(target)
    inner = F.substring(path, F.char_length(root) + F.when(root == "/", 1).otherwise(2), F.char_length(path))
    return F.when(path == root, ".").when(_under(root, path), inner)


def safe_audio_join(base: Column, path: Column) -> Column:
    """The base and a manifest's audio path; the base where that is empty, null where it is unsafe."""
    return F.when(audio_join_fault(base, path).isNull(), safe_join(base, clean_path(path)))


def audio_join_fault(base: Column, path: Column) -> Column:
    """Why an audio path can't be joined to the base, or null."""
    return F.coalesce(audio_path_fault(path), F.when(path.isNotNull() & safe_join(base, clean_path(path)).isNull(), "escapes base"))
