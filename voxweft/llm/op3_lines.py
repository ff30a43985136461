"""Line-first cleaning by DataFrame functions alone.

Every line (text between line feeds) is judged by three rules: *punctuation* (``SYMBOLS_PER_WORD`` marks of the symbol
class or more for each word, or a line of under ``SHORT_LINE`` words without a closing mark), *navigation* (three
separators or more, one for every four words at least) and *boilerplate* (a line of at most ``BOILERPLATE_WORDS``
words that holds a listed phrase). Failing lines go; a document that loses more than ``max_lost`` of the characters
of its words goes too, and so does one that fails the base rules (too few words, too many repeated ones).

All of it is one pass over each text inside a task, with no shuffle. Repeated 3-word windows are found by sorting the
64-bit hashes of a text's own windows, so a very long text costs n log n.

Defined cases: a null text is an empty one, with no words, and fails; blank lines have no words and neither pass nor
fail; repeated rows each get their result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table

WS = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
#: Fixed value: the contract's symbols.
SYMBOLS = r"[#*$%&|<>]"
#: The punctuation rule's symbols: those, and other marks that prose has few of.
MARKS = r"[#*$%&|<>!~^=_@{}\\\[\]]"
SYMBOLS_PER_WORD = 0.3
SHORT_LINE = 8
CLOSING = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x22')\]\x{201D}\x{2019}\x{BB}]*[\x20\x09-\x0D]*$"
SEPARATORS = r"[|>\x{BB}\x{203A}\x{2022}\x{B7}]"
BOILERPLATE_WORDS = 40
#: Phrases of boilerplate lines.
PHRASES = (
    "all rights reserved",
    "cookie policy",
    "we use cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "requires javascript",
    "click here",
    "sign up for our newsletter",
    "licensed under",
    "released under the",
    "lorem ipsum",
)


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WS), ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    n = n_words(line)
    marks = F.regexp_count(line, F.lit(MARKS))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    phrase = F.lower(line).rlike("|".join(PHRASES))
    return (marks >= F.lit(SYMBOLS_PER_WORD) * n) | ((n < SHORT_LINE) & ~line.rlike(CLOSING)) | ((separators >= 3) & (4 * separators >= n)) | ((n <= BOILERPLATE_WORDS) & phrase)


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, WS, ""))


def repeat_words(words: Column, n: Column) -> Column:
    """Words within 3-word windows that occur twice or more."""
    windows = F.when(
        n >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))),
    )
    return windows


def line_first_clean(df: DataFrame, text_col: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """The input's columns, then: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_lines,
    n_lines_removed, lost_share, base_failed, kept, clean_text. Columns of these names in the input are replaced."""
    own = [c for c in df.columns if c not in RESULT]
    t = df.select(F.struct(*own).alias("_row"), F.coalesce(df[text_col], F.lit("")).alias("_t"))
    t = t.select("_row", "_t", F.array_remove(F.split("_t", WS), "").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORDY)).alias("_l"))
    t = t.select("_row", "_t", "_w", "_l", F.size("_w").alias("_n"))
    judged = F.transform("_l", lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"), word_chars(x).alias("chars")))
    t = t.select("_row", "_t", "_l", "_n", repeat_words(F.col("_w"), F.col("_n")).alias("_s"), judged.alias("_j"))
    m = F.size("_s")
    neighbours = F.when(m >= 2, F.zip_with(F.slice("_s", F.lit(1), m - 1), F.slice("_s", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    t = t.select("_row", "_t", "_l", "_n", "_j", neighbours.alias("_d"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.filter("_d", lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("count"))
    step = lambda s, i: F.struct((i + 3).alias("end"), (s["count"] + i + 3 - F.greatest(i, s["end"])).alias("count"))
    total = F.aggregate("_j", F.lit(0), lambda s, x: s + x["chars"])
    lost = F.aggregate("_j", F.lit(0), lambda s, x: s + F.when(x["fails"], x["chars"]).otherwise(0))
    t = t.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        total.cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(positions, start, step, lambda s: s["count"]), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_j").cast("long").alias("n_lines"),
        F.size(F.filter("_j", lambda x: x["fails"])).cast("long").alias("n_lines_removed"),
        lost.cast("long").alias("_lost"),
        F.array_join(F.transform(F.filter("_j", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.when(F.col("word_chars") > 0, F.col("_lost") / F.col("word_chars")).otherwise(F.lit(0.0))
    t = t.withColumns({"base_failed": failed, "lost_share": share})
    t = t.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    return t.select(*[F.col("_row")[c].alias(c) for c in own], *RESULT)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "lost_share", "base_failed", "kept", "clean_text")


def op3_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_first_clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed")


_PHRASES = "|".join(PHRASES)
OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i+1, i+2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
  ) GROUP BY rid
), l0 AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), l AS (
  SELECT rid, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>!~^=_@{{}}\\\[\]]', '', 'g')) AS marks,
    length(line) - length(regexp_replace(line, '[|>\x{{BB}}\x{{203A}}\x{{2022}}\x{{B7}}]', '', 'g')) AS seps
  FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), j AS (
  SELECT *, (marks >= 0.3 * n)
    OR (n < 8 AND NOT regexp_matches(line, '[.!?\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}][\x22'')\]\x{{201D}}\x{{2019}}\x{{BB}}]*[\x20\x09-\x0D]*$'))
    OR (seps >= 3 AND 4 * seps >= n)
    OR (n <= 40 AND regexp_matches(lower(line), '{_PHRASES}')) AS fails
  FROM l
), by_doc AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (fails) AS n_lines_removed, sum(chars) AS chars,
    coalesce(sum(chars) FILTER (fails), 0) AS lost, count(*) - count(DISTINCT line) AS dup
  FROM j GROUP BY rid
), b AS (
  SELECT doc_id, len(w) AS n_words, coalesce(chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(lost, 0) AS lost
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN by_doc USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars = 0 OR lost::DOUBLE / word_chars <= 0.5) AS kept,
  n_lines::BIGINT AS n_lines, n_lines_removed::BIGINT AS n_lines_removed
FROM b
"""
