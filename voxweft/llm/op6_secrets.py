"""Secret candidates, and how many repositories and owners each occurs with, by DataFrame functions alone.

Candidates are the matches of a list of patterns. The hash of each candidate's value is counted over the corpus:
first by value, owner and repository, then by value and owner, then by value, so that a value held by a third of all
rows reaches each later step as a few partial rows. A value of ``min_owners`` owners or more is a widely copied
example; one of fewer is specific to its owners and looks live. Counts go back to the candidates by a join on the
value and one of ``SALTS`` salts.

Positions count code points. They come from the lengths of the matches and of the pieces between them.

Defined cases: a null or empty text has no candidate; a null owner or repository counts as one of its own; repeated
rows each get their result; an empty table gives an empty table; columns of the input with clashing names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, read_table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The group that is the secret itself, and its least length.
    group: int = 0
    least: int = 0
    #: A cheap test that a text must pass to be searched.
    hint: str = ""


#: The contract's kinds. Runs of hex and access keys are greedy, so the least length can stand in the
#: pattern; an assignment's can't, since a match that fails it still takes its characters.
BASE_KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Kind("hex", r"[0-9a-f]{32,}"),
)
#: Formats that are searched besides.
MORE_KINDS = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", hint="PRIVATE KEY"),
)
KINDS = BASE_KINDS + MORE_KINDS
SALTS = 8


def found(text: Column, k: int, kind: Kind) -> Column:
    """Array of (start, end, kind, value) of one kind's matches; null where there is none."""
    pattern = F.lit(kind.pattern)
    has = text.rlike(kind.pattern) if not kind.hint else text.contains(kind.hint)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,k:int,v:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.char_length(x["p"])
        e = s + F.char_length(x["m"])
        value = F.regexp_extract(x["m"], kind.pattern, kind.group) if kind.group else x["m"]
        one = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(k).alias("k"), value.alias("v")))
        return F.struct(e.alias("at"), F.when(F.char_length(value) >= kind.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    matches = F.filter(pairs, lambda x: x["m"].isNotNull())
    return F.when(has, F.aggregate(matches, start, step, lambda s: s["out"]))


def find_secrets(df: DataFrame, scratch: Scratch, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each input row: the ``keep`` columns and ``secrets``, an array by start, then kind, of (start, end,
    kind, value_hash, n_repos, n_owners, verdict: example or live)."""
    t = df.select(*[df[c].alias(f"_{i}") for i, c in enumerate(keep)], df[repo_col].cast("string").alias("_repo"), df[owner_col].cast("string").alias("_owner"), F.coalesce(df[text_col], F.lit("")).alias("_t"))
    kept = [f"_{i}" for i in range(len(keep))]
    empty = F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")
    every = F.concat(*[F.coalesce(found(F.col("_t"), k, kind), empty) for k, kind in enumerate(KINDS)])
    t = t.select(*kept, "_repo", "_owner", every.alias("_c"))
    hashed = F.transform("_c", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.sha2(x["v"], 256).alias("h")))
    t = scratch.save(t.select(F.monotonically_increasing_id().alias("_rid"), *kept, "_repo", "_owner", hashed.alias("_c")))
    c = t.filter(F.size("_c") > 0).select("_rid", "_repo", "_owner", F.explode("_c").alias("_x"))
    stats = c.select(F.col("_x.h").alias("h"), "_owner", "_repo").groupBy("h", "_owner", "_repo").agg(F.count("*").alias("n"))
    stats = stats.groupBy("h", "_owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    salted = stats.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    c = c.select("_rid", "_x.*", F.pmod(F.hash("_rid"), F.lit(SALTS)).alias("salt")).join(salted, ["h", "salt"])
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = F.struct("s", "k", "e", F.get(names, F.col("k")).alias("kind"), F.col("h").alias("value_hash"), "n_repos", "n_owners", F.when(F.col("n_owners") >= min_owners, "example").otherwise("live").alias("verdict"))
    by_row = c.groupBy("_rid").agg(F.array_sort(F.collect_list(one)).alias("_s"))
    out = t.select("_rid", *kept).join(by_row, "_rid", "left")
    shaped = F.transform("_s", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["kind"].alias("kind"), x["value_hash"].alias("value_hash"), x["n_repos"].alias("n_repos"), x["n_owners"].alias("n_owners"), x["verdict"].alias("verdict")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value_hash:string,n_repos:bigint,n_owners:bigint,verdict:string>>")
    return out.select(*[F.col(a).alias(b) for a, b in zip(kept, keep)], F.coalesce(shaped, none).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = find_secrets(docs, scratch)
    base = F.filter("secrets", lambda x: x["kind"].isin(*[k.name for k in BASE_KINDS]))
    count = lambda name: F.size(F.filter("secrets", lambda x: x["kind"] == name)).cast("long")
    verdict = lambda name: F.size(F.filter("secrets", lambda x: x["verdict"] == name)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        verdict("live").alias("n_live"),
        verdict("example").alias("n_example"),
    )


def _kind_sql(k: int, kind: Kind) -> str:
    pattern = kind.pattern.replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', {kind.group})"
    return f"""SELECT rid, {k} AS k, '{kind.name}' AS kind, (s + length(m))::BIGINT AS e, s::BIGINT AS s, {value} AS v FROM (
    SELECT rid, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
      SELECT rid, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}'))
    ) WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)
  ) WHERE length({value}) >= {kind.least}"""


_BASE = ", ".join(f"'{k.name}'" for k in BASE_KINDS)
OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), c AS (
  {" UNION ALL ".join(_kind_sql(k, kind) for k, kind in enumerate(KINDS))}
), owners AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n FROM c JOIN d USING (rid) GROUP BY v
), s AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind IN ({_BASE})) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (n < 3) AS n_live, count(*) FILTER (n >= 3) AS n_example
  FROM c JOIN owners USING (v) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN s USING (rid)
"""
