"""Rendering of slices and comparisons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import fixed


def escaped(text: Column) -> Column:
    """For a Markdown table cell: backslashes, bars and line feeds."""
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html_escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def slice_lines(slices: DataFrame) -> DataFrame:
    """(key, line): Markdown rows of (key, count, cer, wer)."""
    line = F.concat(F.lit("| "), escaped(html_escaped(F.col("key"))), F.lit(" | "), F.col("count").cast("string"), F.lit(" | "), fixed(F.col("cer")), F.lit(" | "), fixed(F.col("wer")), F.lit(" |"))
    return slices.select("key", line.alias("line"))


def comparison_lines(comparisons: DataFrame) -> DataFrame:
    """(key, line): Markdown rows of comparisons, as :func:`..operators.analysis.comparison` gives them."""
    ci = lambda a, b: F.concat(F.lit("["), fixed(F.col(a)), F.lit(", "), fixed(F.col(b)), F.lit("]"))
    pair = F.concat_ws(" vs ", "system_a", "system_b")
    cells = [escaped(pair), F.col("n_pairs").cast("string"), fixed(F.col("delta_cer")), ci("cer_lo", "cer_hi"), fixed(F.col("delta_wer")), ci("wer_lo", "wer_hi")]
    return comparisons.select(pair.alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


#: Fixed values of the format: headings and the heads of tables.
TITLE, RUN = ["# Error Analysis Report", ""], "## Run"
SLICES = ["## Slices", "| Slice | Count | CER | WER |", "|---|---|---|---|"]
COMPARISONS = ["## System comparisons (paired bootstrap, 95% CI)", "| Pair | n | Δ CER | CER CI | Δ WER | WER CI |", "|---|---|---|---|---|---|"]


def report_lines(slices: DataFrame, comparisons: DataFrame | None = None, run: Mapping[str, object] | None = None) -> DataFrame:
    """(section, key, line): a whole report, whose order is that of section and key. Rows of slices and comparisons stay
    where they are; only headings and the run's few entries come from the driver."""
    entries = [] if run is None else [RUN, *[f"{k}: {run[k]}" for k in sorted(run)], ""]
    parts = [[*TITLE, *entries, *SLICES], slice_lines(slices), ["", *COMPARISONS], comparison_lines(comparisons) if comparisons is not None else []]
    fixed_rows = [(section, f"{n:06d}", line) for section, part in enumerate(parts) if isinstance(part, list) for n, line in enumerate(part)]
    out = slices.sparkSession.createDataFrame(fixed_rows, "section int, key string, line string")
    for section, part in enumerate(parts):
        if isinstance(part, DataFrame):
            out = out.unionByName(part.select(F.lit(section).alias("section"), "key", "line"))
    return out


def write_markdown(path: str, slices: DataFrame, comparisons: DataFrame | None = None, run: Mapping[str, object] | None = None) -> None:
    """Text files whose lines, read in the order of the files' names, are the report: ranges of lines are sorted and
    written by different tasks."""
    report_lines(slices, comparisons, run).orderBy("section", "key", "line").select("line").write.mode("overwrite").text(path)


def markdown(slices: DataFrame, comparisons: DataFrame | None = None, run: Mapping[str, object] | None = None) -> str:
    """A report of few slices and comparisons as one string, in the order of their keys."""
    return "\n".join(r["line"] for r in report_lines(slices, comparisons, run).orderBy("section", "key", "line").collect())


def json_lines(slices: DataFrame, kind: str = "slice") -> DataFrame:
    """(value): a JSON object for each row, fields sorted. Rows of kind ``comparison`` have their intervals as pairs."""
    t = slices.withColumns({"kind": F.lit(kind), "schema": F.lit("report"), "schema_version": F.lit(1)})
    for k in ("cer", "wer"):
        if kind == "comparison":
            t = t.withColumn(f"{k}_ci", F.array(f"{k}_lo", f"{k}_hi")).drop(f"{k}_lo", f"{k}_hi")
    return t.select(F.to_json(F.struct(*sorted(t.columns))).alias("value"))
