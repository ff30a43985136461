"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, numbers, text
from ..operators import alignment, analysis, calibration, grid, ngram, rescoring, timings, voting
from ..saved import saved
from ..session import prepare
from ..sources import manifests, models, paths, reports, rows
from . import bridge
from .bridge import SQL_HYP, SQL_OPS, SQL_SCORES, SQL_TIMINGS, SQL_UTT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            SQL[key] = sql
        return f

    return add


def r9(column: Column | str) -> Column:
    return F.round(column, 9)


def hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.hypotheses(bridge.utterances(spark, sf_dir))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.with_rates(hyps(spark, sf_dir))


# --- error rates -----------------------------------------------------------------------------------------------

PAIRS = "pairs AS (SELECT utt_id || ':' || rank AS pid, ref AS r, hyp AS h FROM hyp)"
#: Word errors from the path, character errors from a path over the joined tokens' characters.
RATES = f"""WITH RECURSIVE {SQL_HYP}, {PAIRS}, {SQL_OPS}, rates AS (
  SELECT hyp.*, paths.ops, errors AS word_errors, len(ref) AS ref_len, len(hyp) AS hyp_len, array_to_string(ref, '') AS rt, array_to_string(hyp, '') AS ht,
    CASE WHEN len(ref) = 0 THEN (len(hyp) > 0)::INT::DOUBLE ELSE errors / len(ref) END AS wer,
    levenshtein(array_to_string(ref, ''), array_to_string(hyp, '')) AS char_errors FROM hyp JOIN paths ON pid = utt_id || ':' || rank
), rated AS (SELECT *, char_errors / length(rt) AS cer, length(rt) AS char_len FROM rates)"""


@query(f"{RATES} SELECT rank, count(*) AS n, round(sum(word_errors) / sum(ref_len), 9) AS wer_micro, round(avg(wer), 9) AS wer_macro, round(sum(char_errors) / sum(char_len), 9) AS cer_micro, round(avg(cer), 9) AS cer_macro FROM rated GROUP BY rank")
def score_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = alignment.corpus_rates(rates(spark, sf_dir), "rank")
    return t.select("rank", "n", *[r9(c).alias(c) for c in ("wer_micro", "wer_macro", "cer_micro", "cer_macro")])


@query(f"{RATES} SELECT rank, round(avg(CASE WHEN ref_len + hyp_len = 0 THEN 0 ELSE 2.0::DOUBLE * word_errors / (ref_len + hyp_len) END), 9) AS ser, count(*) FILTER (ref = hyp) AS perfect FROM rated GROUP BY rank")
def symmetric_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = alignment.symmetric_error_rate(F.col("word_errors"), F.col("ref_len"), F.col("hyp_len"))
    return rates(spark, sf_dir).groupBy("rank").agg(r9(F.avg(s)).alias("ser"), F.count_if(F.col("ref") == F.col("hyp")).alias("perfect"))


_count = lambda c: f"len(ops) - len(replace(ops, '{c}', ''))"


@query(f"{RATES} SELECT utt_id, rank, {_count('S')} AS substitutions, {_count('I')} AS insertions, {_count('D')} AS deletions, word_errors AS errors, ref_len AS ref_length, hyp_len AS hyp_length FROM rated")
def ops_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hyps(spark, sf_dir).select("utt_id", "rank", alignment.edit_ops(F.col("ref"), F.col("hyp")).alias("ops"))
    return t.select("utt_id", "rank", *[c.cast("long").alias(n) for n, c in alignment.breakdown(F.col("ops")).items()])


STEPS = f"""{RATES}, chars AS (
  SELECT utt_id, rank, ref, hyp, unnest(string_split(ops, '')) AS op, generate_subscripts(string_split(ops, ''), 1) AS k FROM rated WHERE ops <> ''
), steps AS (
  SELECT *, count(*) FILTER (op <> 'I') OVER w AS ri, count(*) FILTER (op <> 'D') OVER w AS hi FROM chars WINDOW w AS (PARTITION BY utt_id, rank ORDER BY k)
)"""


@query(f"{STEPS} SELECT ref[ri] AS ref, hyp[hi] AS hyp, count(*) AS count FROM steps WHERE op = 'S' GROUP BY 1, 2 HAVING count(*) >= 2")
def substitution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hyps(spark, sf_dir).select(alignment.edit_ops(F.col("ref"), F.col("hyp")).alias("ops"))
    return analysis.substitution_pairs(t, min_count=2)


@query(f"{STEPS} SELECT least(ref[ri], hyp[hi]) AS ref, greatest(ref[ri], hyp[hi]) AS hyp, count(*) AS count FROM steps WHERE op = 'S' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def substitution_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hyps(spark, sf_dir).select(alignment.edit_ops(F.col("ref"), F.col("hyp")).alias("ops"))
    return analysis.substitution_pairs(t, directed=False, top=50)


_cell = lambda side, i, gone: f"CASE WHEN op = '{gone}' THEN 'None' ELSE '''' || {side}[{i}] || '''' END"


@query(
    f"""{STEPS}, lines AS (SELECT utt_id, rank, k, '| ' || CASE op WHEN 'M' THEN 'MATCH' WHEN 'S' THEN 'SUB' WHEN 'I' THEN 'INS' ELSE 'DEL' END || ' | ' || {_cell('ref', 'ri', 'I')} || ' | ' || {_cell('hyp', 'hi', 'D')} || ' |' AS line FROM steps)
SELECT utt_id, rank, '| op | ref | hyp |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (k <= 5) || CASE WHEN max(k) > 5 THEN chr(10) || '| ... (' || (max(k) - 5) || ' more) ... | | |' ELSE '' END AS md FROM lines GROUP BY utt_id, rank"""
)
def alignment_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hyps(spark, sf_dir)
    return t.select("utt_id", "rank", alignment.ops_markdown(alignment.edit_ops(F.col("ref"), F.col("hyp")), 5).alias("md"))


@query()
def weighted_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost with dear substitutions and one cheap pair; see tests for its values."""
    costs = alignment.Costs(sub=1.5, ins=0.75, dele=1.0, pairs={("the", "x"): 0.25})
    return hyps(spark, sf_dir).select("utt_id", "rank", r9(alignment.edit_cost(F.col("ref"), F.col("hyp"), costs)).alias("cost"))


# --- slices and reports ----------------------------------------------------------------------------------------


def _slices(name: str, spark_key: Callable[[], Column], sql_key: str) -> None:
    sql = f"{RATES} SELECT {sql_key} AS key, count(*) AS count, round(avg(cer), 9) AS cer, round(avg(wer), 9) AS wer FROM rated WHERE rank = 1 GROUP BY 1"

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = analysis.slice_metrics(rates(spark, sf_dir).filter("rank = 1"), spark_key())
        return t.select("key", "count", r9("cer").alias("cer"), r9("wer").alias("wer"))


_slices("slice_speaker", lambda: analysis.field_slice(F.col("speaker_group")), "CASE WHEN speaker_group IS NULL OR speaker_group = '' THEN 'unknown' ELSE speaker_group END")
_slices("slice_intent", lambda: analysis.field_slice(F.col("intent")), "CASE WHEN intent IS NULL OR intent = '' THEN 'unknown' ELSE intent END")
_slices("slice_noise", lambda: analysis.noise_slice(F.col("noise_db")), "CASE WHEN noise_db < 0 THEN 'quiet' WHEN noise_db < 20 THEN 'moderate' ELSE 'noisy' END")
_slices("slice_duration", lambda: F.explode(analysis.duration_slices(F.col("duration_s"))), "unnest(['all', CASE WHEN duration_s < 1 THEN '<1s' WHEN duration_s < 3 THEN '<3s' WHEN duration_s < 10 THEN '<10s' ELSE '>10s' END])")


@query(
    f"""{RATES}, one AS (SELECT * FROM rated WHERE rank = 1), sorted AS (SELECT duration_s AS v, row_number() OVER (ORDER BY duration_s) - 1 AS k, count(*) OVER () AS n FROM one),
edges AS (SELECT DISTINCT v FROM sorted WHERE k IN (SELECT least(i * n // 4, n - 1) FROM (SELECT unnest(range(5)) AS i), (SELECT max(n) AS n FROM sorted))),
spans AS (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi, row_number() OVER (ORDER BY v) - 1 AS q, count(*) OVER () AS m FROM edges)
SELECT 'q' || q AS key, count(*) AS count, round(avg(cer), 9) AS cer, round(avg(wer), 9) AS wer FROM one JOIN spans ON duration_s >= lo AND (duration_s < hi OR (q = m - 2 AND duration_s = hi)) GROUP BY 1"""
)
def slice_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rates(spark, sf_dir).filter("rank = 1")
    edges = analysis.quantile_edges(t, "duration_s", 4)
    t = analysis.slice_metrics(t, analysis.quantile_slice(F.col("duration_s"), edges))
    return t.select("key", "count", r9("cer").alias("cer"), r9("wer").alias("wer"))


@query(f"{RATES} SELECT speaker_group AS key, '| ' || speaker_group || ' | ' || count(*) || ' | ' || printf('%.4f', avg(cer)) || ' | ' || printf('%.4f', avg(wer)) || ' |' AS line FROM rated WHERE rank = 1 GROUP BY 1")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slice_lines(analysis.slice_metrics(rates(spark, sf_dir).filter("rank = 1"), analysis.field_slice(F.col("speaker_group"))))


@query(f"{RATES} SELECT '{{\"count\":' || count(*) || ',\"key\":\"' || speaker_group || '\",\"kind\":\"slice\",\"schema\":\"report\",\"schema_version\":1}}' AS value FROM rated WHERE rank = 1 GROUP BY speaker_group")
def report_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.slice_metrics(rates(spark, sf_dir).filter("rank = 1"), analysis.field_slice(F.col("speaker_group")))
    return reports.json_lines(t.select("key", "count"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '\\', '\\\\'), '|', '\\|'), chr(10), '\\n') AS cell FROM pages")
def escape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "pages").select("page_id", reports.escaped(reports.html_escaped(F.col("html"))).alias("cell"))


# --- bootstrap -------------------------------------------------------------------------------------------------

REPLICATES = 100
_POISSON = " + ".join(f"(u >= {c}::DOUBLE)::INT" for c in analysis.POISSON)
DRAWS = f"""{RATES}, two AS (SELECT utt_id, speaker_group, max(wer) FILTER (rank = 1) AS a, max(wer) FILTER (rank = 2) AS b FROM rated GROUP BY ALL),
draws AS (SELECT *, {_POISSON} AS w FROM (SELECT *, ('0x' || substr(md5('7:' || rep || ':' || utt_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM two, (SELECT unnest(range({REPLICATES})) AS rep))),
reps AS (SELECT rep, sum(w * (b - a)) / sum(w) AS delta FROM draws GROUP BY rep)"""


def two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rates(spark, sf_dir)
    return t.groupBy("utt_id", "speaker_group").agg(F.max(F.when(F.col("rank") == 1, F.col("wer"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("wer"))).alias("b"))


@query(f"{DRAWS} SELECT round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi, round((count(*) FILTER (delta <= 0) + 1) / (count(*) + 1), 9) AS p_value FROM reps")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.bootstrap(two_systems(spark, sf_dir), "utt_id", "a", "b", REPLICATES, 7)
    return analysis.bootstrap_interval(t).select(*[r9(c).alias(c) for c in ("lo", "hi", "p_value")])


COMPARED = f"""{RATES}, sides AS (SELECT utt_id, unnest(['cer', 'wer']) AS metric, unnest([max(cer) FILTER (rank = 1), max(wer) FILTER (rank = 1)]) AS a, unnest([max(cer) FILTER (rank = 2), max(wer) FILTER (rank = 2)]) AS b FROM rated GROUP BY utt_id),
drawn AS (SELECT *, {_POISSON} AS w FROM (SELECT *, ('0x' || substr(md5('7:' || rep || ':' || utt_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sides, (SELECT unnest(range({REPLICATES})) AS rep))),
deltas AS (SELECT metric, rep, sum(w * (b - a)) / sum(w) AS delta FROM drawn GROUP BY ALL),
ends AS (SELECT metric, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM deltas GROUP BY metric),
means AS (SELECT metric, avg(b) - avg(a) AS d, count(*) AS n FROM sides GROUP BY metric),
pair AS (SELECT max(n) AS n_pairs, max(d) FILTER (metric = 'cer') AS delta_cer, max(lo) FILTER (metric = 'cer') AS cer_lo, max(hi) FILTER (metric = 'cer') AS cer_hi,
  max(d) FILTER (metric = 'wer') AS delta_wer, max(lo) FILTER (metric = 'wer') AS wer_lo, max(hi) FILTER (metric = 'wer') AS wer_hi FROM means JOIN ends USING (metric)),
parts AS (SELECT speaker_group AS key, count(*) AS count, avg(cer) AS cer, avg(wer) AS wer FROM rated WHERE rank = 1 GROUP BY 1)"""
_HEADS = [(0, reports.TITLE + reports.SLICES), (2, ["", *reports.COMPARISONS])]
_LINES = ", ".join(f"({section}, '{n:06d}', '{line}')" for section, lines in _HEADS for n, line in enumerate(lines))


def compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Slices by role, and the comparison of the first hypotheses with the second ones."""
    t = saved(rates(spark, sf_dir).select("utt_id", "speaker_group", "rank", "cer", "wer"), "rated")
    of = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    pairs = t.groupBy("utt_id").agg(*[of(rank, c).alias(f"{c}_{rank}") for c in ("cer", "wer") for rank in (1, 2)])
    found = analysis.paired_intervals(pairs, "utt_id", [("cer_1", "cer_2"), ("wer_1", "wer_2")], REPLICATES, 7)
    slices = analysis.slice_metrics(t.filter("rank = 1"), analysis.field_slice(F.col("speaker_group")))
    return slices, analysis.comparison(found, "cer_2", "wer_2", "first", "second")


@query(
    f"""{COMPARED} SELECT * FROM (VALUES {_LINES}) h(section, key, line)
UNION ALL SELECT 1, key, '| ' || key || ' | ' || count || ' | ' || printf('%.4f', cer) || ' | ' || printf('%.4f', wer) || ' |' FROM parts
UNION ALL SELECT 3, 'first vs second', '| first vs second | ' || n_pairs || ' | ' || printf('%.4f', delta_cer) || ' | [' || printf('%.4f', cer_lo) || ', ' || printf('%.4f', cer_hi) || '] | ' || printf('%.4f', delta_wer) || ' | [' || printf('%.4f', wer_lo) || ', ' || printf('%.4f', wer_hi) || '] |' FROM pair"""
)
def report_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(*compared(spark, sf_dir))


@query(
    f"""{COMPARED} SELECT 'slice' AS kind, key, count, round(cer, 9) AS cer, round(wer, 9) AS wer, NULL AS system_a, NULL AS system_b, NULL AS n_pairs, NULL AS delta_cer, NULL AS delta_wer, NULL AS cer_ci, NULL AS wer_ci FROM parts
UNION ALL SELECT 'comparison', NULL, NULL, NULL, NULL, 'first', 'second', n_pairs, round(delta_cer, 9), round(delta_wer, 9), [round(cer_lo, 9), round(cer_hi, 9)], [round(wer_lo, 9), round(wer_hi, 9)] FROM pair"""
)
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices, found = compared(spark, sf_dir)
    lines = reports.json_lines(slices).unionByName(reports.json_lines(found, "comparison"))
    read = lines.select(F.from_json("value", "kind string, key string, count long, cer double, wer double, system_a string, system_b string, n_pairs long, delta_cer double, delta_wer double, cer_ci array<double>, wer_ci array<double>").alias("r")).select("r.*")
    nine = {c: r9(c) for c in ("cer", "wer", "delta_cer", "delta_wer")} | {c: F.transform(c, r9) for c in ("cer_ci", "wer_ci")}
    return read.withColumns(nine)


@query()
def bootstrap_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rates(spark, sf_dir)
    of = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    t = t.groupBy("utt_id").agg(*[of(rank, c).alias(f"{c}_{rank}") for c in ("cer", "wer") for rank in (1, 2)])
    out = analysis.sequential_bootstrap(t, ["utt_id"], [("cer_1", "cer_2"), ("wer_1", "wer_2")], REPLICATES, 7)
    return out.select("metric", *[r9(c).alias(c) for c in ("delta", "lo", "hi", "p_value")], "n")


@query(
    f"""{DRAWS}, byg AS (SELECT speaker_group AS "group", rep, sum(w * a) / sum(w) AS delta FROM draws GROUP BY 1, 2),
ci AS (SELECT "group", round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi FROM byg GROUP BY 1)
SELECT "group", n, round(wer, 9) AS wer, lo, hi FROM (SELECT speaker_group AS "group", count(*) AS n, avg(a) AS wer FROM two GROUP BY 1) JOIN ci USING ("group")"""
)
def group_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = two_systems(spark, sf_dir).withColumnRenamed("a", "wer")
    out = analysis.group_bias(t, F.col("speaker_group"), "utt_id", REPLICATES, 7)
    return out.select("group", "n", *[r9(c).alias(c) for c in ("wer", "lo", "hi")])


# --- calibration -----------------------------------------------------------------------------------------------

S = f"WITH {SQL_SCORES}"
BIN = "least(9, greatest(0, floor(p * 10)::INT))"


@query(f"{S}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM scores GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 9) AS ece FROM b")
def ece_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.scores(spark, sf_dir).withColumn("bin", calibration.uniform_bin(F.col("p"), 10))
    return calibration.calibration_error(calibration.reliability_bins(t, 10)).select(r9("ece").alias("ece"))


@query(f"{S}, q AS (SELECT *, least(9, (row_number() OVER (ORDER BY p, id) - 1) * 10 // count(*) OVER ()) AS bin FROM scores), b AS (SELECT bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM q GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 9) AS ece FROM b")
def ece_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibration.quantile_bin(bridge.scores(spark, sf_dir), 10)
    return calibration.calibration_error(calibration.reliability_bins(t, 10)).select(r9("ece").alias("ece"))


@query(f"{S}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM scores GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS count, round(coalesce(c, 0), 9) AS confidence, round(coalesce(a, 0), 9) AS accuracy, round(i / 10, 9) AS lo, round((i + 1) / 10, 9) AS hi FROM (SELECT unnest(range(10)) AS i) LEFT JOIN b ON i = bin")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.scores(spark, sf_dir).withColumn("bin", calibration.uniform_bin(F.col("p"), 10))
    return calibration.reliability_curve(t, 10).select("bin", "count", *[r9(c).alias(c) for c in ("confidence", "accuracy", "lo", "hi")])


_LOSS = "-CASE WHEN label = 1 THEN ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, p))) ELSE ln(1 - greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, p))) END"


@query(f"{S} SELECT round(avg((p - label) * (p - label)), 9) AS brier, round(avg({_LOSS}), 9) AS log_loss, round(avg(((p >= 0.5) = (label = 1))::INT), 9) AS accuracy FROM scores")
def brier_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("label")
    return bridge.scores(spark, sf_dir).agg(r9(calibration.brier(p, y)).alias("brier"), r9(F.avg(calibration.log_loss_term(p, y))).alias("log_loss"), r9(F.avg(((p >= 0.5) == (y == 1)).cast("int"))).alias("accuracy"))


@query(f"{S}, m AS (SELECT *, exp(p / 0.7 - max(p / 0.7) OVER (PARTITION BY grp)) AS e FROM scores) SELECT id, round(e / sum(e) OVER (PARTITION BY grp), 9) AS scaled FROM m")
def temperature_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.softmax_scaled(bridge.scores(spark, sf_dir), "p", 0.7, ["grp"]).select("id", r9("scaled").alias("scaled"))


_GRID = "(SELECT unnest(range(1, 101)) * 0.05::DOUBLE AS t)"


@query(
    f"""{S}, h AS (SELECT p, label, count(*) AS c FROM scores GROUP BY 1, 2), g AS (SELECT round(t, 10) AS t, c, label, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, 1 / (1 + exp(-p / round(t, 10))))) AS q FROM h, {_GRID}),
n AS (SELECT t, sum(c * -CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END) / sum(c) AS nll FROM g GROUP BY t) SELECT round(t, 9) AS temperature, round(nll, 9) AS nll FROM n ORDER BY round(nll, 12), t LIMIT 1"""
)
def fit_temperature_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.fit_temperature_nll(bridge.scores(spark, sf_dir)).select(r9("temperature").alias("temperature"), r9("nll").alias("nll"))


ECE_GRID = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
_Q = "greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))"


@query(
    f"""{S}, h AS (SELECT p, label, count(*) AS c FROM scores GROUP BY 1, 2), g AS (SELECT t, c, label, 1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / t)) AS q FROM h, (SELECT unnest({list(ECE_GRID)}::DOUBLE[]) AS t)),
b AS (SELECT t, least(9, greatest(0, floor(q * 10)::INT)) AS bin, sum(c) AS n, sum(q * c) / sum(c) AS cf, sum(label * c) / sum(c) AS ac FROM g GROUP BY 1, 2),
e AS (SELECT t, sum(abs(cf - ac) * n) / sum(n) AS ece FROM b GROUP BY t) SELECT t AS temperature, round(ece, 9) AS ece FROM e ORDER BY round(ece, 12), t LIMIT 1"""
)
def fit_temperature_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.fit_temperature_ece(bridge.scores(spark, sf_dir), ECE_GRID).select("temperature", r9("ece").alias("ece"))


@query(f"{S} SELECT id, round(CASE WHEN p >= 0.6 THEN 1.2 * p - 0.2 WHEN p >= 0.3 THEN p - 0.1 ELSE 0.5 * p END, 9) AS q FROM scores")
def piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = [(0.0, 0.5, 0.0), (0.3, 1.0, -0.1), (0.6, 1.2, -0.2)]
    return bridge.scores(spark, sf_dir).select("id", r9(calibration.piecewise(F.col("p"), segments)).alias("q"))


@query(
    f"""{S.replace("WITH", "WITH RECURSIVE")}, h AS (SELECT p, label, count(*) AS c FROM scores GROUP BY 1, 2), hs AS (SELECT list({{'p': p, 'y': label, 'c': c}} ORDER BY p, label) AS rows, sum(c) AS n FROM h),
gd AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT i + 1, a - 0.1 * list_sum(list_transform(rows, lambda x: x.c * (1 / (1 + exp(-(a * x.p + b))) - x.y) * x.p)) / n, b - 0.1 * list_sum(list_transform(rows, lambda x: x.c * (1 / (1 + exp(-(a * x.p + b))) - x.y))) / n FROM gd, hs WHERE i < 200)
SELECT round(a, 6) AS coefficient, round(b, 6) AS intercept FROM gd WHERE i = 200"""
)
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = calibration.fit_logistic(bridge.scores(spark, sf_dir))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "coefficient double, intercept double")


@query(
    f"{S}, k AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM scores) "
    "SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)::DOUBLE), 9) AS auc FROM k"
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.auc(bridge.scores(spark, sf_dir)).select(r9("auc").alias("auc"))


@query(
    f"""{S}, t AS (SELECT p, CASE WHEN p >= 0.6 THEN 1.2 * p - 0.2 WHEN p >= 0.3 THEN p - 0.1 ELSE 0.5 * p END AS q FROM scores), g AS (SELECT p, min(q) AS lo, max(q) AS hi FROM t GROUP BY p),
w AS (SELECT lo, max(hi) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) SELECT bool_and(coalesce(lo > before, true)) AS preserved FROM w"""
)
def preserves_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = [(0.0, 0.5, 0.0), (0.3, 1.0, -0.1), (0.6, 1.2, -0.2)]
    t = bridge.scores(spark, sf_dir).withColumn("q", calibration.piecewise(F.col("p"), segments))
    return calibration.preserves_ranking(t, "p", "q")


@query(
    f"""WITH {SQL_HYP} SELECT utt_id, rank, round(coalesce(list_avg(posteriors), 0), 9) AS mean, round(coalesce(list_min(posteriors), 0), 9) AS least,
round(CASE WHEN len(posteriors) > 0 THEN exp(list_avg(list_transform(posteriors, lambda x: ln(x)))) ELSE 0 END, 9) AS geometric, round(CASE WHEN len(posteriors) > 0 THEN list_product(posteriors) ELSE 0 END, 9) AS product FROM hyp"""
)
def utterance_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("posteriors")
    names = {"mean": "mean", "min": "least", "geometric": "geometric", "product": "product"}
    return hyps(spark, sf_dir).select("utt_id", "rank", *[r9(calibration.utterance_confidence(p, k)).alias(n) for k, n in names.items()])


@query(
    f"""WITH {SQL_HYP}, s AS (SELECT *, list_reverse_sort(posteriors) AS d FROM hyp) SELECT utt_id, rank, round(coalesce(d[1], 0), 9) AS max_posterior, round(coalesce(list_avg(posteriors), 0), 9) AS mean_posterior,
round(coalesce(list_sum(list_transform(posteriors, lambda x: -x * ln(x))), 0), 9) AS entropy, round(coalesce(d[1], 0) - coalesce(d[2], 0), 9) AS margin, round(coalesce(d[1], 0), 9) AS vote_ratio, len(posteriors)::DOUBLE AS n_tokens, round(acoustic, 9) AS acoustic, round(lm, 9) AS lm FROM s"""
)
def confidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = calibration.confidence_features(F.col("posteriors"), F.col("acoustic"), F.col("lm"))
    return hyps(spark, sf_dir).select("utt_id", "rank", *[r9(c).alias(n) for n, c in f.items()])


# --- language model --------------------------------------------------------------------------------------------


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.utterances(spark, sf_dir).select("utt_id", "speaker_group", F.col("ref").alias("tokens"))


def counts_sql(order: int, where: str = "true", name: str = "counts") -> str:
    pads = "[" + ", ".join(["'<s>'"] * (order - 1)) + "]::VARCHAR[]"
    return f"""{name}_seq AS (SELECT list_concat({pads}, list_append(ref, '</s>')) AS q FROM utt WHERE {where}), {name}_g AS (
  SELECT n, array_to_string(q[i:i + n - 1], ' ') AS ngram FROM (SELECT q, n, unnest(range(1, len(q) - n + 2)) AS i FROM {name}_seq, (SELECT unnest(range(1, {order + 1})) AS n))
), {name} AS (SELECT n::INT AS n, ngram, regexp_replace(ngram, ' ?[^ ]*$', '') AS ctx, count(*) AS c FROM {name}_g GROUP BY 1, 2, 3)"""


def asked_sql(order: int, pad: str = "<s>", where: str = "true") -> str:
    """N-grams of the hypotheses, unknown words replaced."""
    pads = "[" + ", ".join([f"'{pad}'"] * (order - 1)) + "]::VARCHAR[]"
    return f"""vocab AS (SELECT ngram AS w FROM counts WHERE n = 1 UNION SELECT unnest(['<s>', '</s>', '<unk>'])), mapped AS (
  SELECT utt_id, rank, list(coalesce(vocab.w, '<unk>') ORDER BY i) AS toks FROM (SELECT utt_id, rank, unnest(hyp) AS w, generate_subscripts(hyp, 1) AS i FROM hyp WHERE {where}) x LEFT JOIN vocab ON vocab.w = x.w GROUP BY 1, 2
), aq AS (SELECT utt_id, rank, list_concat({pads}, list_append(toks, '</s>')) AS q FROM mapped), asked AS (
  SELECT utt_id, rank, array_to_string(q[i:i + {order - 1}], ' ') AS ngram FROM (SELECT *, unnest(range(1, len(q) - {order - 2})) AS i FROM aq))"""


KATZ2 = """tot AS (SELECT sum(c) AS t FROM counts WHERE n = 1), obs AS (SELECT ctx, sum(c) AS o FROM counts WHERE n = 2 GROUP BY 1),
katz AS (SELECT a.ngram, CASE WHEN k.c IS NOT NULL THEN k.c / coalesce(p.c, k.c) WHEN p.c - coalesce(o, 0) > 0 THEN (p.c - coalesce(o, 0)) / p.c * (p.c / t) ELSE 1.0::DOUBLE / (t + 1) END AS p
  FROM (SELECT DISTINCT ngram, regexp_replace(ngram, ' ?[^ ]*$', '') AS ctx FROM asked) a CROSS JOIN tot LEFT JOIN counts k ON k.n = 2 AND k.ngram = a.ngram LEFT JOIN counts p ON p.n = 1 AND p.ngram = a.ctx LEFT JOIN obs ON obs.ctx = a.ctx)"""
JELINEK2 = """tot AS (SELECT sum(c) AS t FROM counts WHERE n = 1),
jel AS (SELECT a.ngram, greatest(1e-12::DOUBLE, 0.5 * coalesce(u.c, 0) / t + 0.5 * coalesce(k.c, 0) / coalesce(p.c, 1)) AS p
  FROM (SELECT DISTINCT ngram, regexp_replace(ngram, ' ?[^ ]*$', '') AS ctx, regexp_extract(ngram, '([^ ]*)$', 1) AS w FROM asked) a CROSS JOIN tot LEFT JOIN counts k ON k.n = 2 AND k.ngram = a.ngram LEFT JOIN counts p ON p.n = 1 AND p.ngram = a.ctx LEFT JOIN counts u ON u.n = 1 AND u.ngram = a.w)"""


@query(f"WITH {SQL_UTT}, {counts_sql(3)} SELECT n, ngram, c FROM counts")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train(refs(spark, sf_dir), 3).counts.select("n", "ngram", "c")


@query(f"WITH {SQL_UTT}, {counts_sql(3)} SELECT n, count(*) AS kinds, sum(c)::BIGINT AS total FROM counts WHERE n = 1 OR c >= 3 GROUP BY n")
def ngram_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.prune(ngram.train(refs(spark, sf_dir), 3), 3).counts.groupBy("n").agg(F.count("*").alias("kinds"), F.sum("c").alias("total"))


@query(f"WITH {SQL_HYP}, {counts_sql(1)}, w AS (SELECT unnest(hyp) AS w FROM hyp), m AS (SELECT count(*) AS total, count(*) FILTER (w NOT IN (SELECT ngram FROM counts) AND w NOT IN ('<s>', '</s>', '<unk>')) AS oov FROM w) SELECT total, oov, round(oov / total, 9) AS rate FROM m")
def ngram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ngram.coverage(hyps(spark, sf_dir), ngram.train(refs(spark, sf_dir), 1), "hyp")
    return t.select("total", "oov", r9("rate").alias("rate"))


def asked(spark: SparkSession, sf_dir: str, model: ngram.Model, start: str = ngram.BOS) -> DataFrame:
    return ngram.readable(ngram.positions(hyps(spark, sf_dir), model.order, tokens="hyp", start=start), model)


@query(f"WITH {SQL_HYP}, {counts_sql(2)}, {asked_sql(2)}, {KATZ2} SELECT ngram, round(p, 9) AS p FROM katz")
def katz_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram.train(refs(spark, sf_dir), 2)
    return ngram.katz(asked(spark, sf_dir, model), model, 2).select("ngram", r9("p").alias("p"))


@query(f"WITH {SQL_HYP}, {counts_sql(2)}, {asked_sql(2)}, {JELINEK2} SELECT ngram, round(p, 9) AS p FROM jel")
def jelinek_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram.train(refs(spark, sf_dir), 2)
    return ngram.jelinek(asked(spark, sf_dir, model), model, 2).select("ngram", r9("p").alias("p"))


@query(f"WITH {SQL_HYP}, {counts_sql(2)}, {asked_sql(2, where='rank = 1')}, {KATZ2}, px AS (SELECT utt_id, exp(avg(-ln(greatest(p, 1e-12::DOUBLE)))) AS perplexity FROM asked JOIN katz USING (ngram) GROUP BY 1) SELECT utt_id, round(coalesce(perplexity, 1), 6) AS perplexity FROM utt LEFT JOIN px USING (utt_id)")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram.train(refs(spark, sf_dir), 2)
    t = ngram.perplexity(hyps(spark, sf_dir).filter("rank = 1"), model, "utt_id", "hyp")
    return t.select("utt_id", F.round("perplexity", 6).alias("perplexity"))


_MIX = JELINEK2.replace("tot AS", "tot{x} AS").replace("counts", "counts{x}").replace("jel AS", "jel{x} AS").replace("CROSS JOIN tot", "CROSS JOIN tot{x}")


@query(
    f"WITH {SQL_HYP}, {counts_sql(2)}, {asked_sql(2)}, {counts_sql(2, chr(39).join(['speaker_group = ', 'user', '']), 'counts1')}, {counts_sql(2, chr(39).join(['speaker_group <> ', 'user', '']), 'counts2')}, "
    f"{_MIX.replace('{x}', '1')}, {_MIX.replace('{x}', '2')} SELECT ngram, round(log10(greatest(1e-12::DOUBLE, 0.3 * jel1.p + 0.7 * jel2.p)), 9) AS logp FROM jel1 JOIN jel2 USING (ngram)"
)
def ngram_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = refs(spark, sf_dir)
    a, b = (ngram.train(t.filter(w), 2) for w in ("speaker_group = 'user'", "speaker_group <> 'user'"))
    return ngram.mixture(asked(spark, sf_dir, ngram.train(t, 2)), a, b, 0.3, 2).select("ngram", r9("logp").alias("logp"))


@query(
    f"""WITH RECURSIVE {SQL_UTT}, {counts_sql(2)}, tot AS (SELECT sum(c) AS t FROM counts WHERE n = 1), pos AS (SELECT k.c AS m, u.c / t AS p1, k.c / x.c AS p2 FROM counts k CROSS JOIN tot JOIN counts u ON u.n = 1 AND u.ngram = regexp_extract(k.ngram, '([^ ]*)$', 1) JOIN counts x ON x.n = 1 AND x.ngram = k.ctx WHERE k.n = 2),
ps AS (SELECT list({{'m': m, 'a': p1, 'b': p2}}) AS rows FROM pos), em AS (SELECT 0 AS i, 0.5::DOUBLE AS l UNION ALL
  SELECT i + 1, list_sum(list_transform(rows, lambda x: x.m * l * x.a / (l * x.a + (1 - l) * x.b))) / list_sum(list_transform(rows, lambda x: x.m::DOUBLE)) FROM em, ps WHERE i < 5)
SELECT round(l, 7) AS l1, round(1 - l, 7) AS l2 FROM em WHERE i = 5"""
)
def em_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = refs(spark, sf_dir)
    a, b = ngram.fit_weights(t, ngram.train(t, 2))
    return spark.createDataFrame([(round(a, 7), round(b, 7))], "l1 double, l2 double")


ARPA2 = """tot AS (SELECT sum(c) AS t FROM counts WHERE n = 1), p1 AS (SELECT ngram, greatest(c / t, 1e-12::DOUBLE) AS p FROM counts, tot WHERE n = 1),
p2 AS (SELECT k.ngram, k.ctx, regexp_extract(k.ngram, '([^ ]*)$', 1) AS w, greatest(k.c / x.c, 1e-12::DOUBLE) AS p FROM counts k JOIN counts x ON x.n = 1 AND x.ngram = k.ctx WHERE k.n = 2),
b AS (SELECT ctx, 1 - sum(p2.p) AS num, 1 - sum(p1.p) AS den FROM p2 JOIN p1 ON p1.ngram = p2.w GROUP BY ctx)"""


@query(
    f"WITH {SQL_UTT}, {counts_sql(2)}, {ARPA2} SELECT 1 AS n, p1.ngram, round(log10(p1.p), 6) AS logp, round(coalesce(CASE WHEN abs(den) < 1e-12 OR num <= 1e-9 THEN 0.0::DOUBLE ELSE log10(least(1.0::DOUBLE, num / den)) END, 0), 6) AS bow FROM p1 LEFT JOIN b ON ctx = p1.ngram UNION ALL SELECT 2, ngram, round(log10(p), 6), NULL FROM p2"
)
def arpa_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses of under 1e-9 are rounding noise of sums that are exactly 1; they count as none on both sides."""
    model = ngram.train(refs(spark, sf_dir), 2)
    return ngram.arpa_tables(model).select("n", "ngram", F.round("logp", 6).alias("logp"), F.round("bow", 6).alias("bow"))


LM = f"WITH RECURSIVE {SQL_HYP}, {counts_sql(2)}, {asked_sql(2, '</s>')}, {KATZ2}, lms AS (SELECT utt_id, rank, sum(log10(greatest(p, 1e-12::DOUBLE))) AS s FROM asked JOIN katz USING (ngram) GROUP BY 1, 2), scored AS (SELECT hyp.*, coalesce(s, 0) AS lm_score FROM hyp LEFT JOIN lms USING (utt_id, rank))"


@query(f"{LM}, f AS (SELECT utt_id, rank, acoustic + 0.5 * lm_score - 0.1 * len(hyp) AS score FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY round(score, 9) DESC, rank) AS new_rank FROM f) SELECT utt_id, rank, new_rank, round(score, 6) AS score FROM k WHERE new_rank <= 2")
def rescore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram.train(refs(spark, sf_dir), 2)
    t = hyps(spark, sf_dir).select("utt_id", "rank", "hyp", "acoustic", F.size("hyp").alias("words"))
    score = rescoring.shallow_fusion(F.col("acoustic"), F.col("lm_score"), F.col("words"), 0.5, penalty=0.1)
    scored = ngram.lm_scores(t, model, ["utt_id", "rank"], "hyp").drop("hyp")  # words need not be shuffled with the scores
    return rescoring.rescored(scored, score, top=2).select("utt_id", "rank", "new_rank", F.round("score", 6).alias("score"))


@query(
    f"""{RATES}, e AS (SELECT *, CASE WHEN bool_or(len(list_filter(hyp, lambda x: length(x) > 1)) > 0) OVER (PARTITION BY utt_id) THEN levenshtein(rt, array_to_string(hyp, ' ')) / length(rt) ELSE wer END AS error FROM rated), w AS (SELECT unnest([0, 0.1, 0.2, 0.5, 1]::DOUBLE[]) AS weight),
k AS (SELECT utt_id, weight, error, row_number() OVER (PARTITION BY utt_id, weight ORDER BY round(acoustic + weight * lm, 9) DESC, rank) AS rn FROM e, w) SELECT weight, round(avg(error), 9) AS error, count(*) AS n FROM k WHERE rn = 1 GROUP BY weight"""
)
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescoring.weight_sweep(rescoring.with_error(rates(spark, sf_dir))).select("weight", r9("error").alias("error"), "n")


@query(f"WITH {SQL_HYP} SELECT count(*) AS faults FROM hyp a JOIN hyp b ON a.utt_id = b.utt_id AND a.acoustic = b.acoustic AND a.lm < b.lm, (SELECT unnest([0, 0.5, 1]::DOUBLE[]) AS w) WHERE b.acoustic + w * b.lm < a.acoustic + w * a.lm - 1e-12")
def weight_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescoring.not_monotone(hyps(spark, sf_dir), (0.0, 0.5, 1.0)).agg(F.count("*").alias("faults"))


# --- grids, fusion, confusion networks -------------------------------------------------------------------------


def _pass(k: int, depth: int) -> str:
    ops = SQL_OPS.replace("dp AS", f"dp{k} AS").replace("FROM dp", f"FROM dp{k}").replace("paths AS", f"paths{k} AS").replace("FROM pairs", f"FROM pairs{k}")
    gaps = "[" + ", ".join(["'*'"] * depth) + "]"
    return f"""{ops}, ch{k} AS (SELECT pid, unnest(string_split(ops, '')) AS op, generate_subscripts(string_split(ops, ''), 1) AS k FROM paths{k} WHERE ops <> ''),
st{k} AS (SELECT *, (count(*) FILTER (op <> 'I') OVER w)::BIGINT AS gp, (count(*) FILTER (op <> 'D') OVER w)::BIGINT AS hp FROM ch{k} WINDOW w AS (PARTITION BY pid ORDER BY k)),
g{k} AS (SELECT st{k}.pid, list(CASE op WHEN 'I' THEN list_append({gaps}, h[hp]) WHEN 'D' THEN list_append(g[gp], '*') ELSE list_append(g[gp], h[hp]) END ORDER BY k) AS g FROM st{k} JOIN in{k} ON in{k}.pid = st{k}.pid GROUP BY st{k}.pid)"""


GRID = f"""WITH RECURSIVE {SQL_HYP}, wide AS (SELECT utt_id AS pid, max(hyp) FILTER (rank = 1) AS h1, max(hyp) FILTER (rank = 2) AS h2, max(hyp) FILTER (rank = 3) AS h3 FROM hyp GROUP BY 1),
in1 AS (SELECT pid, list_transform(h1, lambda x: [x]) AS g, h2 AS h FROM wide), pairs1 AS (SELECT pid, h1 AS r, h2 AS h FROM wide), {_pass(1, 1)},
in2 AS (SELECT pid, coalesce(g1.g, []) AS g, h3 AS h FROM wide LEFT JOIN g1 USING (pid)), pairs2 AS (SELECT pid, list_transform(g, lambda c: c[1]) AS r, h FROM in2), {_pass(2, 2)},
cols AS (SELECT pid AS utt_id, unnest(g) AS c, generate_subscripts(g, 1) - 1 AS col FROM g2), raw AS (SELECT utt_id, col, unnest(c) AS token, generate_subscripts(c, 1) - 1 AS h FROM cols),
cells AS (SELECT raw.utt_id, col, h AS hyp, token, 1.0::DOUBLE / (1 + edits) AS score, lm, 0.5::DOUBLE + 0.1::DOUBLE * h AS posterior, 1.0::DOUBLE / rank AS hyp_weight FROM raw JOIN hyp ON hyp.utt_id = raw.utt_id AND rank = h + 1)"""


def cells(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Columns of the grids, with those of the hypotheses' scores at each cell that are asked for; others aren't shuffled."""
    made = {"score": 1.0 / (1 + F.col("edits")), "lm": F.col("lm"), "hyp_weight": 1.0 / F.col("rank"), "posterior": 0.5 + 0.1 * (F.col("rank") - 1)}
    return grid.columns(hyps(spark, sf_dir).select("utt_id", "rank", "hyp", *[made[c].alias(c) for c in keep]), keep=keep)


@query(f"{GRID} SELECT utt_id, col, hyp, token FROM cells")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells(hyps(spark, sf_dir)).select("utt_id", "col", "hyp", "token")


@query(f"{GRID} SELECT utt_id, max(col) + 1 AS width, max(hyp) + 1 AS depth FROM cells GROUP BY 1")
def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.shape(grid.cells(hyps(spark, sf_dir)))


@query(f"{GRID} SELECT utt_id, hyp, count(*) FILTER (token <> '*') AS cells FROM cells GROUP BY 1, 2")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.coverage(grid.cells(hyps(spark, sf_dir)))


@query(
    f"""{GRID}, back AS (SELECT utt_id, hyp, coalesce(list(token ORDER BY col) FILTER (token <> '*'), []::VARCHAR[]) AS toks FROM cells GROUP BY 1, 2),
ok AS (SELECT b.utt_id, count(*) FILTER (b.toks = h.hyp) AS given_back FROM back b JOIN hyp h ON h.utt_id = b.utt_id AND h.rank = b.hyp + 1 GROUP BY 1),
col AS (SELECT utt_id, count(*) AS width, count(*) FILTER (n = 0) AS silent FROM (SELECT utt_id, col, count(*) FILTER (token <> '*') AS n FROM cells GROUP BY 1, 2) GROUP BY 1)
SELECT utt_id, width, given_back, silent FROM ok JOIN col USING (utt_id)"""
)
def grid_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses that the grid gives back, and columns without a token, of each utterance."""
    t = hyps(spark, sf_dir).select("utt_id", "rank", "hyp")
    checked = grid.audit(grid.columns(t), t).filter("width > 0")
    lost, silent = (F.size(c).cast("long") for c in ("lost", "silent"))
    return checked.select("utt_id", "width", (F.col("depth") - lost).alias("given_back"), silent.alias("silent"))


#: Every rotation of each utterance's hypotheses, and (turn 3) the sorted order, go through the grid's SQL as pairs of their own.
_TURNS = """wide AS (SELECT utt_id || '/' || turn AS pid, utt_id AS utt, turn, hs[1] AS h1, hs[2] AS h2, hs[3] AS h3 FROM (
  SELECT utt_id, turn, CASE turn WHEN 3 THEN list_transform(list_sort(list_transform(l, lambda x: {'r': CASE len(x) WHEN 0 THEN '()' WHEN 1 THEN '(' || chr(39) || x[1] || chr(39) || ',)' ELSE '(' || chr(39) || array_to_string(x, chr(39) || ', ' || chr(39)) || chr(39) || ')' END, 'x': x})), lambda y: y.x) ELSE list_concat(l[turn + 1:], l[:turn]) END AS hs
  FROM (SELECT utt_id, list(hyp ORDER BY rank) AS l FROM hyp GROUP BY 1), (SELECT unnest([0, 1, 2, 3]) AS turn))),
in1 AS"""


@query(
    f"""{GRID.split('wide AS (')[0]}{_TURNS}{GRID.split('in1 AS', 1)[1].split(', cells AS (')[0]},
txt AS (SELECT utt, turn, md5(coalesce(array_to_string(list_transform(g, lambda c: array_to_string(CASE WHEN turn < 3 THEN list_concat(c[4 - turn:], c[:3 - turn]) ELSE c END, ' ')), chr(10)), '')) AS h FROM wide LEFT JOIN g2 USING (pid))
SELECT utt AS utt_id, count(*) FILTER (turn < 3) AS orders, count(DISTINCT h) FILTER (turn < 3) AS grids, count(DISTINCT h) FILTER (turn = 3) AS sorted_grids, max(h) FILTER (turn = 3) AS sorted_hash FROM txt GROUP BY 1"""
)
def grid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.order_effects(hyps(spark, sf_dir))


def fuse_sql(weight: str = "base", base: str = "1.0::DOUBLE", tie: str = "token", gaps: str = "keep", place: str = "hyp") -> str:
    voting_ = "weighted" if gaps == "vote" else "(SELECT * FROM weighted WHERE token <> '*')"
    silent = "UNION ALL SELECT utt_id, col, '*', 0.0, 0.0, 0.0, 0.0 FROM cells GROUP BY utt_id, col HAVING bool_and(token = '*')" if gaps == "keep" else ""
    return f"""{GRID}, based AS (SELECT *, greatest(0.0::DOUBLE, {base}) AS base FROM cells), weighted AS (SELECT *, {weight} AS weight FROM based),
tok AS (SELECT utt_id, col, token, round(sum(weight), 12) AS mass, sum(base) AS plain, count(*) AS votes, min({place}) AS place, round(max(weight), 12) AS top, min({{'w': -weight, 'p': {place}}}).p AS best FROM {voting_} GROUP BY 1, 2, 3),
st AS (SELECT *, row_number() OVER (PARTITION BY utt_id, col ORDER BY mass DESC, {tie}) AS rn, sum(plain) OVER w AS total, sum(votes) OVER w AS allv,
  coalesce(nth_value(plain, 2) OVER (PARTITION BY utt_id, col ORDER BY plain DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second FROM tok WINDOW w AS (PARTITION BY utt_id, col)),
en AS (SELECT *, sum(CASE WHEN plain > 0 AND total > 0 THEN -(plain / total) * ln(plain / total) ELSE 0 END) OVER (PARTITION BY utt_id, col) AS entropy FROM st),
fused AS (SELECT utt_id, col, token, votes / allv AS confidence, CASE WHEN total > 0 THEN plain / total ELSE 0 END AS agreement, CASE WHEN total > 0 THEN (plain - second) / total ELSE 0 END AS margin, entropy FROM en WHERE rn = 1 {silent})"""


_FUSED = ("confidence", "agreement", "margin", "entropy")
_FUSED_SQL = "SELECT utt_id, col, token, round(confidence, 9) AS confidence, round(agreement, 9) AS agreement, round(margin, 9) AS margin, round(entropy, 9) AS entropy FROM fused"


_OWN = {"lm": ("lm",), "posterior": ("posterior",), "confidence": ("hyp_weight",)}


def _fusion(name: str, config: voting.Fusion, score: str | None = None, **sql: str) -> None:
    @query(f"{fuse_sql(base='score' if score else '1.0::DOUBLE', **sql)} {_FUSED_SQL}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = voting.fuse(cells(spark, sf_dir, *[score] * bool(score), *_OWN.get(config.policy, ())), config, score=score)
        return t.select("utt_id", "col", "token", *[r9(c).alias(c) for c in _FUSED])


_fusion("fuse_majority", voting.Fusion())
_fusion("fuse_score", voting.Fusion("score"), "score")
_fusion("fuse_lm", voting.Fusion("lm", alpha=0.1), weight="base + 0.1::DOUBLE * lm")
_fusion("fuse_posterior", voting.Fusion("posterior"), weight="base * greatest(0.0::DOUBLE, posterior)")
_fusion("fuse_confidence", voting.Fusion("confidence"), "score", weight="base * greatest(0.0::DOUBLE, hyp_weight)")
_fusion("fuse_null_drop", voting.Fusion(gaps="drop"), gaps="drop")
_fusion("fuse_null_vote", voting.Fusion(gaps="vote"), gaps="vote")
_fusion("fuse_tie_first", voting.Fusion(tie_break="first"), tie="place")
_fusion("fuse_tie_highest", voting.Fusion("score", tie_break="highest_score"), "score", tie="top DESC, best")
_fusion("fuse_sorted_first", voting.Fusion(tie_break="first", order="sorted"), tie="place", place="token")


@query()
def fuse_tie_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of a tie is the seeded choice of the standard library's generator; see tests."""
    t = voting.fuse(cells(spark, sf_dir), voting.Fusion(tie_break="seeded", seed=3))
    return t.select("utt_id", "col", "token", r9("confidence").alias("confidence"))


@query(f"{fuse_sql()} SELECT count(*) AS tokens, round(avg(confidence), 9) AS mean_confidence, round(avg((confidence >= 1 - 1e-9)::INT), 9) AS unanimous, round(avg((token = '*')::INT), 9) AS gap_share FROM fused")
def fusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = voting.fusion_summary(voting.fuse(cells(spark, sf_dir)))
    return t.select("tokens", *[r9(c).alias(c) for c in ("mean_confidence", "unanimous", "gap_share")])


@query(f"{fuse_sql()} SELECT utt_id, string_agg(token, ' ' ORDER BY col) AS text FROM fused GROUP BY 1")
def fused_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.fused_text(voting.fuse(cells(spark, sf_dir)), confidences=False).select("utt_id", F.array_join("tokens", " ").alias("text"))


@query(
    f"""{fuse_sql()}, c AS (SELECT f.*, EXISTS (SELECT 1 FROM cells x WHERE x.utt_id = f.utt_id AND x.col = f.col AND x.token = f.token) AS own FROM fused f)
SELECT utt_id, count(*) AS columns, count(*) FILTER (NOT own) + count(*) FILTER (confidence < 0 OR confidence > 1 + 1e-9 OR agreement > 1 + 1e-9) AS faults FROM c GROUP BY 1"""
)
def fusion_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = saved(cells(spark, sf_dir), "cells")
    fused = saved(voting.fuse(c), "fused")
    counted = lambda t, columns, faults: t.select("utt_id", F.lit(columns).alias("columns"), F.lit(faults).alias("faults"))
    both = counted(fused, 1, 0).unionByName(counted(voting.fusion_faults(fused, c), 0, 1))
    return both.groupBy("utt_id").agg(F.sum("columns").alias("columns"), F.sum("faults").alias("faults"))


@query(f"{GRID}, cnt AS (SELECT utt_id, col, token, CASE WHEN token <> '*' THEN count(*) END AS n FROM cells GROUP BY 1, 2, 3) SELECT utt_id, col, round(coalesce(max(n) / sum(n), 0), 9) AS agreement FROM cnt GROUP BY 1, 2")
def agreement_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.agreement(grid.cells(hyps(spark, sf_dir))).select("utt_id", "col", r9("agreement").alias("agreement"))


def network_sql(keep: bool = False) -> str:
    return f"""{GRID}, s AS (SELECT *, bool_and(token = '*') OVER (PARTITION BY utt_id, col) AS silent FROM cells), arcs AS (SELECT utt_id, col, token, sum(greatest(0.0::DOUBLE, score)) AS mass, bool_and(silent) AS silent FROM s WHERE silent OR token <> '*' {'OR true' if keep else ''} GROUP BY 1, 2, 3),
post AS (SELECT *, CASE WHEN silent THEN 1.0::DOUBLE ELSE mass / sum(mass) OVER (PARTITION BY utt_id, col) END AS posterior FROM arcs),
net AS (SELECT utt_id, col, token, posterior, row_number() OVER (PARTITION BY utt_id, col ORDER BY round(posterior, 12) DESC, token) AS place, row_number() OVER (PARTITION BY utt_id, col ORDER BY (token = '*')::INT, round(posterior, 12) DESC, token) = 1 AS "pivot" FROM post)"""


def _network(name: str, keep: bool) -> None:
    @query(f"{network_sql(keep)} SELECT utt_id, col, token, round(posterior, 9) AS posterior, place, \"pivot\" FROM net", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = voting.confusion_network(cells(spark, sf_dir, "score"), score="score", keep_gaps=keep)
        return t.select("utt_id", "col", "token", r9("posterior").alias("posterior"), "place", "pivot")


_network("confusion_network", False)
_network("confusion_network_gaps", True)


@query(f"{network_sql()} SELECT utt_id, string_agg(token, ' ' ORDER BY col) AS text FROM net WHERE \"pivot\" GROUP BY 1")
def network_one_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = voting.one_best(voting.confusion_network(cells(spark, sf_dir, "score"), score="score"))
    return t.select("utt_id", F.array_join("tokens", " ").alias("text"))


@query(f"{network_sql()} SELECT utt_id, count(DISTINCT col) AS columns, count(*) AS arcs, round(sum(posterior), 6) AS mass, string_agg(token, ' ' ORDER BY col, place) AS tokens, 0 AS faults FROM net GROUP BY 1")
def network_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks as they are read from their JSON; columns whose posteriors don't add up to 1 are faults."""
    net = saved(models.network_from_json(models.network_json(voting.confusion_network(cells(spark, sf_dir, "score"), score="score"))), "network")
    listed = F.array_sort(F.collect_list(F.struct("col", "place", "token")))
    t = net.groupBy("utt_id").agg(
        F.count_distinct("col").alias("columns"), F.count("*").alias("arcs"), F.round(F.sum("posterior"), 6).alias("mass"), F.array_join(F.transform(listed, lambda x: x["token"]), " ").alias("tokens")
    )
    faults = voting.network_faults(net).groupBy("utt_id").agg(F.count("*").alias("faults"))
    return t.join(faults, "utt_id", "left").na.fill(0, ["faults"])


@query(
    f"{network_sql()}, {fuse_sql().split('cells AS', 1)[1].split('hyp.utt_id = raw.utt_id AND rank = h + 1), ', 1)[1]}, b AS (SELECT utt_id, token, row_number() OVER (PARTITION BY utt_id ORDER BY col) - 1 AS pos FROM net WHERE \"pivot\"), f AS (SELECT utt_id, token, row_number() OVER (PARTITION BY utt_id ORDER BY col) - 1 AS pos FROM fused) "
    "SELECT utt_id, pos, b.token AS a, f.token AS b FROM b FULL JOIN f USING (utt_id, pos) WHERE b.token IS DISTINCT FROM f.token"
)
def rover_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = saved(cells(spark, sf_dir, "score"), "cells")
    best = voting.one_best(voting.confusion_network(c, score="score"))
    return voting.differing_positions(best, voting.fused_text(voting.fuse(c), confidences=False)).select("utt_id", "pos", "a", "b")


# --- timings ---------------------------------------------------------------------------------------------------

T = f"WITH {SQL_TIMINGS}"


@query(
    f"""{T} SELECT track, idx, fault FROM (SELECT *, CASE WHEN start_s < 0 OR end_s < 0 THEN 'negative' WHEN end_s < start_s THEN 'reversed' WHEN start_s < lag(end_s) OVER (PARTITION BY track ORDER BY idx) - 1e-9 THEN 'overlap' END AS fault
  FROM (SELECT track, idx, start_s, CASE WHEN idx % 50 = 7 THEN end_s + 100000 WHEN idx % 50 = 9 THEN start_s - 1 ELSE end_s END AS end_s FROM timings)) WHERE fault IS NOT NULL"""
)
def timing_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of timings with some ends moved."""
    k = F.pmod("idx", F.lit(50))
    t = bridge.timings(spark, sf_dir).withColumn("end_s", F.when(k == 7, F.col("end_s") + 100000).when(k == 9, F.col("start_s") - 1).otherwise(F.col("end_s")))
    return timings.faults(t).select("track", "idx", "fault")


@query(f"{T}, w AS (SELECT *, coalesce(lag(end_s) OVER o, start_s) AS b, coalesce(lead(start_s) OVER o, end_s) AS a FROM timings WINDOW o AS (PARTITION BY track ORDER BY idx)), g AS (SELECT *, NOT (end_s - start_s > 0) AND a - b > 0 AND a - b <= 20000 AS grow FROM w) SELECT track, idx, round(CASE WHEN grow THEN (b + start_s) / 2 ELSE start_s END, 6) AS start_s, round(CASE WHEN grow THEN (end_s + a) / 2 ELSE end_s END, 6) AS end_s FROM g")
def timing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.fill_gaps(bridge.timings(spark, sf_dir), 20000.0).select("track", "idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"{T} SELECT track, idx, round(floor(start_s / 0.25 + 0.5) * 0.25, 6) AS start_s, round(greatest(floor(start_s / 0.25 + 0.5) * 0.25, floor(end_s / 0.25 + 0.5) * 0.25), 6) AS end_s FROM timings")
def timing_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.snap(bridge.timings(spark, sf_dir), 0.25).select("track", "idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"{T} SELECT CASE WHEN end_s - start_s < 1 THEN '<1.0s' WHEN end_s - start_s < 3 THEN '1.0-3.0s' WHEN end_s - start_s < 8 THEN '3.0-8.0s' ELSE '>=8.0s' END AS bucket, count(*) AS n FROM timings GROUP BY 1")
def timing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.timings(spark, sf_dir).withColumn("bucket", timings.duration_bucket(F.col("end_s") - F.col("start_s")))
    return t.groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    f"""{T}, g AS (SELECT *, greatest(0, start_s - lag(end_s) OVER (PARTITION BY track ORDER BY idx)) AS gap FROM timings), k AS (SELECT track, arg_max(end_s, idx) - arg_min(start_s, idx) AS total, sum(gap) AS gap FROM g GROUP BY 1)
SELECT count(*) AS count, round(avg(total), 4) AS mean_s, round(quantile_disc(total, 0.5), 6) AS median_s, round(quantile_disc(total, 0.95), 6) AS p95_s, round(sum(gap), 3) AS gap_total_s FROM k"""
)
def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timings.timing_report(bridge.timings(spark, sf_dir))
    return t.select("count", F.round("mean_s", 4).alias("mean_s"), F.round("median_s", 6).alias("median_s"), F.round("p95_s", 6).alias("p95_s"), F.round("gap_total_s", 3).alias("gap_total_s"))


@query(f"{T} SELECT track, count(*) AS n, round(arg_max(end_s, idx) - arg_min(start_s, idx), 6) AS total_s, round(sum(end_s - start_s) / (arg_max(end_s, idx) - arg_min(start_s, idx)), 9) AS speaking_ratio FROM timings GROUP BY 1")
def timing_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings.track_totals(bridge.timings(spark, sf_dir)).select("track", "n", F.round("total_s", 6).alias("total_s"), r9("speaking_ratio").alias("speaking_ratio"))


@query(
    f"""WITH RECURSIVE {SQL_TIMINGS}, tr AS (SELECT track AS pid, list(token ORDER BY idx) AS r, list({{'s': start_s, 'e': end_s}} ORDER BY idx) AS rt FROM timings WHERE idx < 400 GROUP BY 1),
th AS (SELECT track AS pid, list(token ORDER BY idx) AS h, list({{'s': start_s, 'e': end_s}} ORDER BY idx) AS ht FROM timings WHERE idx % 9 <> 4 GROUP BY 1), pairs AS (SELECT pid, r, h FROM tr JOIN th USING (pid)), {SQL_OPS},
ch AS (SELECT pid, unnest(string_split(ops, '')) AS o, generate_subscripts(string_split(ops, ''), 1) AS k FROM paths), st AS (SELECT *, count(*) FILTER (o <> 'I') OVER w AS ri, count(*) FILTER (o <> 'D') OVER w AS hi FROM ch WINDOW w AS (PARTITION BY pid ORDER BY k))
SELECT pid AS track, k - 1 AS step, CASE o WHEN 'M' THEN 'MATCH' WHEN 'S' THEN 'SUB' WHEN 'I' THEN 'INS' ELSE 'DEL' END AS op, CASE WHEN o <> 'I' THEN ri - 1 END AS ref_idx, CASE WHEN o <> 'D' THEN hi - 1 END AS hyp_idx,
  CASE WHEN o = 'D' THEN rt[ri].s ELSE ht[hi].s END AS start_s, CASE WHEN o = 'D' THEN rt[ri].e ELSE ht[hi].e END AS end_s FROM st JOIN tr USING (pid) JOIN th USING (pid)""".replace(" WHERE idx < 400", "")
)
def timing_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks against themselves with some tokens missing."""
    t = bridge.timings(spark, sf_dir)
    return timings.align_tracks(t, t.filter(F.pmod("idx", F.lit(9)) != 4))


# --- text, numbers, manifests ----------------------------------------------------------------------------------


def _document(name: str, spark_expr: Callable[[Column], Column], sql: str) -> None:
    @query(f"SELECT doc_id, {sql} AS v FROM documents", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bridge.table(spark, sf_dir, "documents").select("doc_id", spark_expr(F.col("text")).alias("v"))


_WIDE = lambda t: f"translate({t}, '{text.PLAIN}', '{text.WIDE}')"
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"
_document("fullwidth", lambda t: text.halfwidth(F.translate(t, text.PLAIN, text.WIDE)), "text")
_document("strip_punctuation", text.without_punctuation, r"regexp_replace(text, '\p{P}', '', 'g')")
_document("digits_hash", text.digits_hashed, r"regexp_replace(text, '[0-9]', '#', 'g')")
_document("collapse_spaces", text.collapsed, r"trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))")
_document("normalize_ascii", lambda t: text.normalized(F.regexp_replace(t, r"[^\x00-\x7F]", ""), ascii_only=True), rf"trim(regexp_replace(lower(regexp_replace(regexp_replace({_ASCII}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\p{{P}}', '', 'g')), '[ \t\n\r]+', ' ', 'g'))")
_document("tokenize_word", lambda t: F.size(text.tokens(t)).cast("long"), "len(list_filter(string_split(text, ' '), lambda x: x <> ''))")
_document("tokenize_char", lambda t: F.size(text.tokens(t, "char")).cast("long"), "length(replace(text, ' ', ''))")
_document("tokenize_auto", lambda t: F.array_join(text.tokens(t, "auto"), "|"), "array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '|')")


@query(
    """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN n >= 100 THEN ones[n // 100 + 1] || ' hundred' END, CASE WHEN n % 100 >= 20 THEN tens[n % 100 // 10 + 1] END,
  CASE WHEN n % 100 >= 20 AND n % 10 > 0 THEN ones[n % 10 + 1] WHEN n % 100 BETWEEN 1 AND 19 THEN ones[n % 100 + 1] WHEN n = 0 THEN 'zero' END], lambda x: x IS NOT NULL), ' ') AS words, n AS back
FROM (SELECT p_partkey, (p_partkey % 1000)::INT AS n, string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones,
  string_split('x x twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens FROM part)"""
)
def int_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.int_to_english(F.pmod("p_partkey", F.lit(1000))).alias("words"))
    return t.select("id", "words", numbers.english_to_int(F.col("words")).alias("back"))


@query("SELECT o_orderkey AS id, true AS english, true AS chinese, (CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || (o_orderkey % 100000) || '.' || (o_orderkey % 7)) AS digits FROM orders")
def number_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with signs and decimals to words of both languages and back."""
    k = F.col("o_orderkey")
    t = bridge.table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.when(k % 2 == 0, "-").otherwise(""), (k % 100000).cast("string"), F.lit("."), (k % 7).cast("string")).alias("digits"))
    back = lambda lang: numbers.words_to_digits(numbers.digits_to_words(F.col("digits"), lang), lang)
    return t.select("id", (back("en") == F.col("digits")).alias("english"), (back("zh") == F.col("digits")).alias("chinese"), "digits")


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'm' WHEN 2 THEN 's' END AS unit FROM events")
def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(4))
    word = F.when(k == 0, "Kilograms").when(k == 1, "metre").when(k == 2, "SECONDS").otherwise("furlong")
    return bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numbers.unit(word).alias("unit"))


@query("SELECT 'd' || doc_id AS id, nfc_normalize(text) AS nfc, strip_accents(text) AS bare FROM documents UNION ALL SELECT 'p' || page_id, nfc_normalize(html), strip_accents(html) FROM pages")
def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents and pages composed (which decomposes what has to be), and decomposed without their marks."""
    docs = bridge.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    t = docs.unionByName(bridge.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    return t.select("id", text.with_form(F.col("text"), "NFC").alias("nfc"), forms.without_marks(F.col("text")).alias("bare"))


def fold_sql(value: str) -> str:
    """Case folding in SQL: characters that fold to several one by one, the others by translation."""
    table = {c: f for c, f in forms.folds().items() if c != "'"}
    for c, f in table.items():
        if len(f) > 1:
            value = f"replace({value}, '{c}', '{f}')"
    single = [c for c, f in table.items() if len(f) == 1]
    return f"translate({value}, '{''.join(single)}', '{''.join(table[c] for c in single)}')"


_document("case_fold", text.folded, fold_sql("text"))


def number_sql(n: str) -> str:
    """English words of a whole number below a million in SQL."""
    below_hundred = lambda x: f"CASE WHEN {x} >= 20 THEN concat_ws(' ', tens[{x} // 10 + 1], CASE WHEN {x} % 10 > 0 THEN ones[{x} % 10 + 1] END) WHEN {x} > 0 THEN ones[{x} + 1] END"
    below_thousand = lambda x: f"concat_ws(' ', CASE WHEN {x} >= 100 THEN ones[{x} // 100 + 1] || ' hundred' END, {below_hundred(f'({x} % 100)')})"
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN {n} >= 1000 THEN {below_thousand(f'({n} // 1000)')} || ' thousand' END, CASE WHEN {n} % 1000 > 0 THEN {below_thousand(f'({n} % 1000)')} END) END"


SQL_NUMBER_LISTS = f"string_split('{' '.join(numbers.ONES)}', ' ') AS ones, string_split('x x {' '.join(numbers.TENS)}', ' ') AS tens"


@query(
    f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN p[1] BETWEEN '0' AND '9' AND length(ltrim(p, '0')) <= 6 THEN {number_sql("(p::BIGINT)")} ELSE p END), '') AS v
FROM (SELECT *, {SQL_NUMBER_LISTS} FROM documents)"""
)
def digits_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of digits in whole texts as words."""
    return bridge.table(spark, sf_dir, "documents").select("doc_id", numbers.spoken_runs(F.col("text")).alias("v"))


_SQL_CLEAN = r"regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\p{Cf}\x{FE00}-\x{FE0F}]', '', 'g')"
_SQL_WORDS = rf"nfc_normalize(regexp_replace({_SQL_CLEAN}, '\p{{P}}', '', 'g'))"


@query(rf"SELECT doc_id, nfc_normalize(trim(regexp_replace({fold_sql(_SQL_WORDS)}, '[ \t\n\r\p{{Z}}]+', ' ', 'g'))) AS v FROM documents")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through all steps, letters of all scripts kept."""
    return bridge.table(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text"), text.Normal(form="NFC", halfwidth=False)).alias("v"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines of the events, some of them wrong."""
    k = F.pmod("event_id", F.lit(12))
    e = bridge.table(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.pmod("event_id", F.lit(97)).cast("string"))
    value = (
        F.when(k == 1, F.lit("not json"))
        .when(k == 2, F.lit('{"utterance_id": "a"}'))
        .when(k == 3, F.lit('{"schema": 5}'))
        .when(k == 4, F.lit('{"schema": "x.unknown"}'))
        .when(k == 5, F.lit('{"schema": "x.reference", "utterance_id": ""}'))
        .when(k == 6, F.concat(F.lit('{"schema": "x.nbest", "utterance_id": "'), user, F.lit('", "system": "s", "language": "en", "acoustic_log10": true}')))
        .when(k == 7, F.concat(F.lit('{"schema": "x.reference", "utterance_id": "'), user, F.lit('", "schema_version": 2}')))
        .when(k == 8, F.concat(F.lit('{"schema": "x.nbest", "utterance_id": "'), user, F.lit('", "system": "s", "language": "en", "schema_version": 2}')))
        .otherwise(F.concat(F.lit('{"schema": "x.reference", "utterance_id": "'), user, F.lit('"}')))
    )
    v = F.try_parse_json("value")
    t = e.select(F.col("event_id").alias("line_id"), value.alias("value"))
    return t.select("line_id", "value", F.try_variant_get(v, "$.schema", "string").alias("schema"), F.try_variant_get(v, "$.utterance_id", "string").alias("utterance_id"))


@query("SELECT event_id AS line_id, CASE event_id % 12 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'schema is missing' WHEN 3 THEN 'schema is no string' WHEN 4 THEN 'unknown schema' WHEN 5 THEN 'utterance_id must be a non-empty string' WHEN 6 THEN 'acoustic_log10 must be numeric' WHEN 7 THEN 'unknown schema_version' END AS fault FROM events")
def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("line_id", manifests.record_fault(F.col("value")).alias("fault"))


@query(
    """WITH l AS (SELECT event_id AS line_id, CASE WHEN event_id % 12 IN (6, 8) THEN 'x.nbest' ELSE 'x.reference' END AS schema, 'u' || (event_id % 97) AS utterance_id FROM events WHERE event_id % 12 NOT IN (1, 2, 3, 4, 5)),
k AS (SELECT *, row_number() OVER (PARTITION BY schema, utterance_id ORDER BY line_id) AS n, min(line_id) OVER (PARTITION BY schema, utterance_id) AS first_line FROM l) SELECT schema, utterance_id, first_line, line_id AS second_line FROM k WHERE n = 2"""
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.duplicates(lines(spark, sf_dir).filter("schema is not null and utterance_id <> ''"))


@query("SELECT CASE WHEN event_id % 12 IN (6, 8) THEN 'x.nbest' ELSE 'x.reference' END AS schema, count(*) AS rows FROM events WHERE event_id % 12 NOT IN (1, 2, 3, 4) GROUP BY 1")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return manifests.summary(t.filter(manifests.kind_of(F.col("schema")).isin("nbest", "reference")))


_HEAD = "CASE page_id % 6 WHEN 1 THEN '../' WHEN 2 THEN 'x/.././' WHEN 3 THEN '/' WHEN 4 THEN '../../voice/' WHEN 5 THEN '../audio/' ELSE '' END"
_FOLD = "'/' || array_to_string(list_reduce(list_transform(list_filter(string_split(full_path, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:len(a) - 1] ELSE a || x END, []::VARCHAR[]), '/')"


@query(
    f"""WITH r AS (SELECT page_id, {_HEAD} || regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages),
f AS (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE '/data/audio/' || path END AS full_path FROM r), j AS (SELECT *, {_FOLD} AS done FROM f),
k AS (SELECT page_id, path, CASE WHEN done = '/data/audio' OR done LIKE '/data/audio/%' THEN done END AS joined FROM j)
SELECT page_id, path, joined, CASE WHEN joined = '/data/audio' THEN '.' ELSE substr(joined, 13) END AS inner_path,
  CASE WHEN path LIKE '/%' THEN 'not relative' WHEN regexp_matches(path, '(^|/)[.][.]?(/|$)') THEN 'empty or parent segment' WHEN regexp_matches(path, '[^A-Za-z0-9._/-]') THEN 'unsafe characters' END AS fault FROM k"""
)
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.pmod("page_id", F.lit(6))
    head = F.when(case == 1, "../").when(case == 2, "x/.././").when(case == 3, "/").when(case == 4, "../../voice/").when(case == 5, "../audio/").otherwise("")
    t = bridge.table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("path"))
    t = t.withColumn("joined", paths.safe_join(F.lit("/data/audio"), F.col("path")))
    return t.select("page_id", "path", "joined", paths.relative_within(F.lit("/data/audio"), F.col("joined")).alias("inner_path"), paths.audio_join_fault(F.lit("/data/audio"), F.col("path")).alias("fault"))


PATHS = ("a/b.wav", "/abs.wav", "~home.wav", "C:x.wav", "a/../b.wav", "a//b.wav", "a\\b.wav", "a/./b", "dir/", "bad name.wav", "", "..")
_FAULTS = ("", "not relative", "not relative", "drive letter", "empty or parent segment", "", "", "empty or parent segment", "", "unsafe characters", "", "empty or parent segment")
_CLEAN = ("a/b.wav", "/abs.wav", "~home.wav", "C:x.wav", "a/../b.wav", "a/b.wav", "a/b.wav", "a/./b", "dir/", "bad name.wav", "", "..")


@query(f"SELECT event_id AS id, nullif({list(_FAULTS)}[event_id % 12 + 1], '') AS fault, {list(_CLEAN)}[event_id % 12 + 1] AS path FROM events")
def audio_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get(F.array(*[F.lit(x) for x in PATHS]), F.pmod("event_id", F.lit(12)).cast("int"))
    return bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), manifests.audio_path_fault(p).alias("fault"), manifests.clean_path(p).alias("path"))


@query(f"WITH {SQL_HYP} SELECT utt_id, 2 AS schema_version, round(sum(acoustic), 6) AS acoustic, round(sum(CASE WHEN noise_db < 0 THEN 0 ELSE lm END), 6) AS lm, 'color' AS extra FROM hyp GROUP BY 1, noise_db")
def migrate_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-best records of both versions written as JSON, read, checked and migrated."""
    old = F.col("noise_db") < 0
    h = F.struct("rank", F.array_join("hyp", " ").alias("text"), F.col("hyp").alias("tokens"), F.when(old, F.col("acoustic")).alias("score"), F.when(~old, F.col("acoustic")).alias("acoustic_log10"), F.when(~old, F.col("lm")).alias("lm_log10"))
    t = hyps(spark, sf_dir).groupBy("utt_id", "noise_db").agg(F.array_sort(F.collect_list(h)).alias("hypotheses"))
    record = F.struct(F.lit("x.nbest").alias("schema"), F.when(old, 1).otherwise(2).alias("schema_version"), F.col("utt_id").alias("utterance_id"), F.lit("s").alias("system"), F.lit("en").alias("language"), "hypotheses", F.lit(1).alias("color"))
    t = t.select(F.lit(0).alias("line_id"), F.lit("x.nbest").alias("schema"), F.to_json(record).alias("value"))
    p = manifests.parsed(t, "nbest", allow_extra=True)
    total = lambda f: F.round(F.aggregate("hypotheses", F.lit(0.0), lambda s, x: s + F.coalesce(x[f], F.lit(0.0))), 6)
    return p.select(F.col("utterance_id").alias("utt_id"), "schema_version", total("acoustic_log10").alias("acoustic"), total("lm_log10").alias("lm"), F.array_join("extra", ",").alias("extra"))


# --- rows of manifests, and the rest ----------------------------------------------------------------------------


@query(f"{RATES} SELECT utt_id, rank, ops AS steps, word_errors::DOUBLE AS score, NULL AS fault FROM rated")
def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and scores as they are read from rows that were written."""
    t = hyps(spark, sf_dir).select("utt_id", "rank", alignment.edit_ops(F.col("ref"), F.col("hyp")).alias("ops"))
    back = rows.alignments(rows.alignment_rows(t, ["utt_id", "rank"]), ["utt_id", "rank"])
    return back.select("utt_id", "rank", F.array_join(F.transform("ops", lambda o: F.substring(o["op"], 1, 1)), "").alias("steps"), "score", "fault")


@query(f"{fuse_sql()} SELECT utt_id, string_agg(token, ' ' ORDER BY col) AS text, round(sum(confidence), 6) AS confidence, 'majority' AS policy FROM fused WHERE token <> '*' GROUP BY 1")
def fusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = rows.fusions(rows.fusion_rows(voting.fused_text(voting.fuse(cells(spark, sf_dir))), voting.Fusion(), ["a", "b"]))
    total = F.aggregate("confidences", F.lit(0.0), lambda x, y: x + y)
    return back.select("utt_id", F.array_join("tokens", " ").alias("text"), F.round(total, 6).alias("confidence"), "policy")


@query(f"{network_sql()} SELECT utt_id, col, token, round(posterior, 9) AS posterior, place, \"pivot\" FROM net")
def network_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = voting.confusion_network(cells(spark, sf_dir, "score"), score="score")
    return rows.networks(rows.network_rows(t)).select("utt_id", "col", "token", r9("posterior").alias("posterior"), "place", "pivot")


@query(f"WITH {SQL_TIMINGS} SELECT track, idx, token, start_s, end_s, NULL AS fault FROM timings")
def timing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.tracks(rows.timing_rows(bridge.timings(spark, sf_dir))).select("track", "idx", "token", "start_s", "end_s", "fault")


@query(f"{S} SELECT id, round(1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / 1.5)), 9) AS q FROM scores")
def logit_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.scores(spark, sf_dir).select("id", r9(calibration.logit_scaled(F.col("p"), 1.5)).alias("q"))


@query(f"{S} SELECT id, round(1 / (1 + exp(-(1.7 * p - 0.4))), 9) AS q FROM scores")
def logistic_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.scores(spark, sf_dir).select("id", r9(calibration.apply_logistic(F.col("p"), (1.7, -0.4))).alias("q"))


@query(f"{S}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM scores GROUP BY 1), e AS (SELECT sum(abs(c - a) * n) / sum(n) AS ece FROM b) SELECT 'uniform' AS binning, 10 AS bins, count(*) AS n, round(avg((p - label) * (p - label)), 9) AS brier, round(any_value(ece), 9) AS ece, round(avg({_LOSS}), 9) AS log_loss FROM scores, e")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibration.calibration_report(bridge.scores(spark, sf_dir), 10)
    return t.select("binning", "bins", "n", *[r9(c).alias(c) for c in ("brier", "ece", "log_loss")])


@query(
    f"""{fuse_sql()}, f AS (SELECT utt_id, token, row_number() OVER (PARTITION BY utt_id ORDER BY col) AS pos FROM fused), h AS (SELECT utt_id, unnest(hyp) AS token, generate_subscripts(hyp, 1) AS pos FROM hyp)
SELECT utt_id, pos - 1 AS pos, round(coalesce(avg((h.token = f.token)::INT), 0), 9) AS confidence FROM f LEFT JOIN h USING (utt_id, pos) GROUP BY 1, 2"""
)
def vote_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hyps(spark, sf_dir).select("utt_id", "rank", "hyp")
    chosen = voting.fused_text(voting.fuse(grid.columns(t)), confidences=False)
    return voting.vote_confidence(chosen, t, rank="rank").select("utt_id", "pos", r9("confidence").alias("confidence"))


@query(
    f"""WITH {SQL_HYP}, {counts_sql(2)}, {asked_sql(2)}, {ARPA2}, bow AS (SELECT p1.ngram, coalesce(CASE WHEN abs(den) < 1e-12 OR num <= 1e-9 THEN 0.0::DOUBLE ELSE log10(least(1.0::DOUBLE, num / den)) END, 0) AS bow FROM p1 LEFT JOIN b ON ctx = p1.ngram)
SELECT a.ngram, round(coalesce(p2.p, pow(10, coalesce(bow, 0)) * coalesce(p1.p, 1.0::DOUBLE / (SELECT count(*) FROM p1))), 9) AS p FROM (SELECT DISTINCT ngram, regexp_replace(ngram, ' ?[^ ]*$', '') AS c, regexp_extract(ngram, '([^ ]*)$', 1) AS w FROM asked) a
LEFT JOIN p2 ON p2.ngram = a.ngram LEFT JOIN bow ON bow.ngram = a.c LEFT JOIN p1 ON p1.ngram = a.w"""
)
def arpa_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram.train(refs(spark, sf_dir), 2)
    t = saved(ngram.arpa_tables(model), "arpa")  # each of its orders is looked up on its own
    p = ngram.backoff(asked(spark, sf_dir, model).select("ngram").distinct(), t.select("n", "ngram", "logp"), t.filter("n = 1").select("n", "ngram", "bow"), 2)
    return p.select("ngram", r9("p").alias("p"))


@query(rf"WITH {SQL_UTT} SELECT utt_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\p{{P}}', '', 'g')), '[ \t\n\r]+', ' ', 'g')) AS ref, array_to_string(ref, ' ') AS hyp FROM utt")
def normalize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    t = bridge.utterances(spark, sf_dir).select("utt_id", text.normalized_pair(plain, F.array_join("ref", " "), ascii_only=True).alias("p"))
    return t.select("utt_id", "p.ref", "p.hyp")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of each rank."""
    return QUERIES["score_rates"](spark, sf_dir)
