"""Utterances, hypotheses, scores and timings made of the driver's tables, in Spark and in SQL.

Every sentence of every turn of ``conversations`` is an utterance, its words (runs of a-z after lower-casing) are the
reference, and three hypotheses are made of it by a hash: a word is replaced, followed by another, left out or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(t: DataFrame, *keys: str) -> DataFrame:
    """A table that is read by fewer tasks than there are cores is dealt out by its keys, where the work on a row costs more
    than the row; one with enough splits is left as it is, without a shuffle."""
    cores = t.sparkSession.sparkContext.defaultParallelism
    return t.repartition(cores, *keys) if t.rdd.getNumPartitions() < cores else t


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, speaker_group, intent, noise_db, duration_s, text, ref)."""
    t = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "text"))
    t = t.withColumn("ref", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    number = F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("pos")
    # a filter on ref would find all words twice, since Spark makes it before the column
    return t.filter(F.lower("text").rlike("[a-z]")).select(
        F.concat_ws("-", "conv_id", "turn", "pos").alias("utt_id"),
        F.col("role").alias("speaker_group"),
        F.when(F.pmod("turn", F.lit(3)) == 0, "greeting").when(F.pmod("turn", F.lit(3)) == 1, "question").otherwise("").alias("intent"),
        (F.pmod(number, F.lit(46)) - 10).cast("double").alias("noise_db"),
        (F.size("ref") / 2 + F.pmod(number, F.lit(5)) / 10).alias("duration_s"),
        "text",
        "ref",
    )


def hypotheses(utt: DataFrame) -> DataFrame:
    """The utterances' columns and (rank, hyp, posteriors, edits, acoustic, lm)."""
    t = utt.withColumn("rank", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    keys = F.transform("ref", lambda x, i: F.md5(F.concat("utt_id", F.lit(":"), (i + 1).cast("string"), F.lit(":"), F.col("rank").cast("string"))))
    t = t.withColumn("keys", keys)
    other = lambda k: F.when(F.substring(k, 3, 1) < "5", "x").when(F.substring(k, 3, 1) < "a", "y").otherwise("z")
    # a digest is below two characters just where its own first two are
    words = F.zip_with("ref", "keys", lambda w, k: F.when(k >= "20", F.array(w)).when(k < "14", F.array(other(k))).when(k < "1a", F.array(w, other(k))).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("hyp", F.flatten(words))
    t = t.withColumn("edits", F.size(F.filter("keys", lambda k: k < "20")))
    posteriors = F.transform("hyp", lambda w, i: 0.5 + F.conv(F.substring(F.md5(F.concat_ws(":", w, i + 1, F.col("rank"))), 1, 2), 16, 10).cast("int") / 510)
    return t.withColumns({
        "posteriors": posteriors,
        "acoustic": F.lit(-10.0) - 2 * F.col("edits") - 0.01 * (35 - F.col("noise_db")),
        "lm": F.lit(-5.0) - 1.5 * F.col("edits"),
    }).drop("keys")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, p, label): a confidence and whether it was right, of every order line."""
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("grp"), confidence().alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def confidence() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_discount") * 8 + F.pmod(F.col("l_quantity"), F.lit(10.0)) / 50))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, idx, token, start_s, end_s): each user's events as timed tokens; every fourth has no duration."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    t = t.withColumns({"first": F.min("at").over(Window.partitionBy("user_id")), "idx": F.row_number().over(order) - 1, "following": F.lead("at").over(order)})
    start = F.round(F.col("at") - F.col("first"), 3)
    following = F.round(F.col("following") - F.col("first"), 3)
    length = F.when(F.pmod("event_id", F.lit(4)) == 0, 0.0).otherwise(F.col("value"))
    return t.select(F.col("user_id").alias("track"), "idx", F.col("event_type").alias("token"), start.alias("start_s"), F.least(F.round(start + length, 3), F.coalesce(following, F.round(start + length, 3))).alias("end_s"))


#: The same relations in SQL, as common table expressions.
SQL_UTT = r"""
turns AS (
  SELECT conv_id, turn, role, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT *, string_split_regex(text, '[.!?\n]+') AS parts FROM conversations)
), utt AS (
  SELECT conv_id || '-' || turn || '-' || pos AS utt_id, role AS speaker_group,
    CASE turn % 3 WHEN 0 THEN 'greeting' WHEN 1 THEN 'question' ELSE '' END AS intent,
    ((conv_id * 7 + turn * 3 + pos) % 46 - 10)::DOUBLE AS noise_db,
    len(ref) / 2.0::DOUBLE + ((conv_id * 7 + turn * 3 + pos) % 5) / 10.0::DOUBLE AS duration_s, text, ref
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS ref FROM turns) WHERE len(ref) > 0
)"""
SQL_HYP = (
    SQL_UTT
    + r""", words AS (
  SELECT *, md5(utt_id || ':' || i || ':' || rank) AS k FROM (
    SELECT utt_id, rank, unnest(ref) AS w, generate_subscripts(ref, 1) AS i FROM utt, (SELECT unnest([1, 2, 3]) AS rank))
), alts AS (
  SELECT *, substr(k, 1, 2) AS b, CASE WHEN substr(k, 3, 1) < '5' THEN 'x' WHEN substr(k, 3, 1) < 'a' THEN 'y' ELSE 'z' END AS alt FROM words
), hyps AS (
  SELECT utt_id, rank, coalesce(flatten(list(CASE WHEN b < '14' THEN [alt] WHEN b < '1a' THEN [w, alt] WHEN b < '20' THEN [] ELSE [w] END ORDER BY i)), []::VARCHAR[]) AS hyp,
    count(*) FILTER (b < '20') AS edits FROM alts GROUP BY utt_id, rank
), hyp AS (
  SELECT utt.*, rank, hyp, edits, -10.0::DOUBLE - 2 * edits - 0.01::DOUBLE * (35 - noise_db) AS acoustic, -5.0::DOUBLE - 1.5::DOUBLE * edits AS lm,
    list_transform(hyp, lambda w, i: 0.5::DOUBLE + ('0x' || substr(md5(w || ':' || i || ':' || rank), 1, 2))::INT / 510.0::DOUBLE) AS posteriors
  FROM hyps JOIN utt USING (utt_id)
)"""
)
SQL_SCORES = """
scores AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS grp,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 8 + (l_quantity % 10) / 50)) AS p, (l_returnflag = 'R')::INT AS label FROM lineitem
)"""
SQL_TIMINGS = """
ev AS (
  SELECT *, epoch_us(ts) / 1e6 AS secs FROM events
), ev2 AS (
  SELECT *, min(secs) OVER (PARTITION BY user_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    lead(secs) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM ev
), ev3 AS (
  SELECT *, round(secs - first, 3) AS start_s, round(following - first, 3) AS next_s, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS length FROM ev2
), timings AS (
  SELECT user_id AS track, idx, event_type AS token, start_s, least(round(start_s + length, 3), coalesce(next_s, round(start_s + length, 3))) AS end_s FROM ev3
)"""
#: Steps of the best path of pairs (pid, r, h), both lists, as strings of M, S, I, D; one step for each reference token.
SQL_OPS = """
dp AS (
  SELECT pid, r, h, 0 AS i, list_transform(range(0, len(h) + 1), lambda j: {'c': j::BIGINT, 'p': repeat('I', j::INT)}) AS row FROM pairs
  UNION ALL
  SELECT pid, r, h, i + 1, list_reduce(
    list_prepend([{'c': row[1].c + 1, 'p': row[1].p || 'D'}], list_transform(range(1, len(h) + 1), lambda j: [{'c': j::BIGINT, 'p': ''}])),
    lambda acc, e: list_append(acc, CASE
      WHEN r[i + 1] = h[e[1].c] THEN {'c': row[e[1].c].c, 'p': row[e[1].c].p || 'M'}
      WHEN row[e[1].c].c <= acc[len(acc)].c AND row[e[1].c].c <= row[e[1].c + 1].c THEN {'c': row[e[1].c].c + 1, 'p': row[e[1].c].p || 'S'}
      WHEN acc[len(acc)].c <= row[e[1].c + 1].c THEN {'c': acc[len(acc)].c + 1, 'p': acc[len(acc)].p || 'I'}
      ELSE {'c': row[e[1].c + 1].c + 1, 'p': row[e[1].c + 1].p || 'D'} END))
  FROM dp WHERE i < len(r)
), paths AS (
  SELECT pid, r, h, row[len(h) + 1].p AS ops, row[len(h) + 1].c AS errors FROM dp WHERE i = len(r)
)"""
