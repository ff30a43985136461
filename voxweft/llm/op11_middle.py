"""Fill-in-middle: texts cut in prefix, middle and suffix, whose order changes so that a model learns to fill the middle.

A unit grammar says between which neighbouring characters a text may be cut, as pairs of classes (left, right). It is translated to
one regular expression of lookarounds, which matches the empty string between such neighbours and nothing else; Spark's
``split`` at these places gives the units and loses no character. Two hashes of the row's id say after how many units the prefix and
the middle end, two more which form the row takes. All is done by column functions, row by row: nothing is shuffled.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is the text itself.

Defined cases: a null text is an empty one. An empty text has no unit (``split`` would give one, so it is told apart), and is
plain, as is a text that holds one of the markers, since it couldn't be taken apart again. A null id is hashed as an empty one.
Repeated rows get equal results, rows of one id and different texts are cut by the same hashes; an empty table gives an empty
one, texts of any length are cut as a whole, and columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table

ANY = r"[\s\S]"
SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def runs(*classes: str) -> tuple[tuple[str, str], ...]:
    """The cuts of a grammar whose units are runs of one of these character classes (such as ``\\p{L}``), and single characters
    outside them."""
    return tuple((f"[{c}]", f"[^{c}]") for c in classes) + ((f"[^{''.join(classes)}]", ANY),)


#: Unit grammars: the pairs of neighbours between which a text may be cut.
GRAMMARS = {
    "chars": ((ANY, ANY),),
    "graphemes": ((ANY, r"[^\p{M}\x{200D}]"),),
    "words": ((SPACE, OTHER),),
    "lines": ((r"[\n]", ANY),),
    "sentences": ((r"[.!?\x{3002}\x{FF01}\x{FF1F}]", r"[\s\p{IsIdeographic}]"),),
    "tokens": runs(r"\p{L}", r"\p{Nd}", r"\s"),
}
MARKERS = ("<P>", "<S>", "<M>")


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The regular expression that matches the empty string between neighbours of one of the pairs."""
    return "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def units(text: Column, grammar: tuple[tuple[str, str], ...]) -> Column:
    """The units of a text in order; joined, they are the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def hashes(id_: Column, salt: str) -> list[Column]:
    """Four unsigned integers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def check_markers(markers: tuple[str, str, str]) -> None:
    """Texts without markers can be taken apart after them only if no marker ends as it begins and none holds another."""
    for m in markers:
        if not m or any(m[:k] == m[-k:] for k in range(1, len(m))) or sum(m in other for other in markers) > 1:
            raise ValueError(f"{markers} can't be told apart in every text")


def fill_in_middle(
    df: DataFrame, unit: str = "chars", plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS, salt: str = "1", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns: the id, ``text``, ``n_units``, ``form``, ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``.

    ``plain_percent`` of the rows are plain beside those that have to be, ``spm_percent`` of the others are spm.
    """
    check_markers(markers)
    p, s, m = map(F.lit, markers)
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    cut = rows.select("id", "text", units(F.col("text"), GRAMMARS[unit]).alias("units"))
    cut = cut.select("*", F.size("units").cast("long").alias("n_units"), F.array(*hashes(F.col("id"), salt)).alias("h"))
    a, b = (F.col("h")[k] % (F.col("n_units") + 1) for k in (0, 1))
    held = (F.col("text") == "") | F.contains(F.col("text"), p) | F.contains(F.col("text"), s) | F.contains(F.col("text"), m)
    form = F.when(held | (F.col("h")[2] % 100 >= 100 - plain_percent), "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.select("id", "text", "units", "n_units", F.least(a, b).cast("int").alias("at"), F.greatest(a, b).cast("int").alias("to"), form.alias("form"))

    def part(begin: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, size), ""))

    cut = cut.select(
        "id", "text", "n_units", "form",
        part(F.lit(0), F.col("at")).alias("prefix"), part(F.col("at"), F.col("to") - F.col("at")).alias("middle"), part(F.col("to"), F.col("n_units").cast("int") - F.col("to")).alias("suffix"),
    )
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return cut.select(F.col("id").alias(id_col), "text", "n_units", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of."""

    def parted(text: Column, marker: str) -> tuple[Column, Column]:
        at = F.instr(text, F.lit(marker))
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(marker), F.char_length(text))

    def joined(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = parted(F.substring(output, F.lit(len(first) + 1), F.char_length(output)), second)
        return one, *parted(rest, markers[2])

    prefix, suffix, middle = joined(markers[0], markers[1])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = joined(markers[1], markers[0])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_lookaround_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut between code points, with digests of what comes out and of the text rebuilt from it."""
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
 substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""
