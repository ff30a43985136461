"""Text normalisation and tokens.

The steps, in order: Unicode form, full-width letters, control characters, punctuation, digits, case, white space, the form
again, number words. All steps but number words are column expressions; for plain ASCII texts the forms are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .forms import folded, with_form
from .numbers import digits_to_words, spoken_runs, words_to_digits

#: Full-width digits and letters, and what they stand for.
WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127) if chr(c).isalnum())
PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c).isalnum())
CONTROL = r"[\p{Cc}\p{Cf}&&[^\t\n\r]]|[\x{FE00}-\x{FE0F}]|[\x{E0100}-\x{E01EF}]"
SPACES = r"(?U)[\s\x1c-\x1f]+"
CHINESE = r"[\x{4e00}-\x{9fff}]"


@dataclass(frozen=True)
class Normal:
    """What to normalise. ``digits`` is keep, hash, spoken or digits; ``case`` fold, lower or none; ``language`` en or zh."""

    form: str = "NFKC"
    halfwidth: bool = True
    control: bool = True
    punctuation: bool = True
    keep: str = ""
    digits: str = "keep"
    case: str = "fold"
    spaces: bool = True
    language: str = "en"
    itn: bool = False

    def __post_init__(self) -> None:
        for value, allowed in ((self.form, ("NFC", "NFD", "NFKC", "NFKD", "none")), (self.digits, ("keep", "hash", "spoken", "digits")), (self.case, ("fold", "lower", "none")), (self.language, ("en", "zh"))):
            if value not in allowed:
                raise ValueError(f"{value} is none of {allowed}")


#: Named configurations.
PRESETS = {
    "score_en": Normal(),
    "score_zh": Normal(language="zh"),
    "raw": Normal(form="none", halfwidth=False, control=False, punctuation=False, case="none", spaces=False),
    "display": Normal(punctuation=False, case="none"),
}


def halfwidth(text: Column) -> Column:
    """The 62 full-width digits and letters as ASCII; other full-width characters stay."""
    return F.translate(text, WIDE, PLAIN)


def without_control(text: Column) -> Column:
    """Without control and format characters and variation selectors; tab and line ends stay."""
    return F.regexp_replace(text, CONTROL, "")


def without_punctuation(text: Column, keep: str = "") -> Column:
    """Without characters of the punctuation categories, but for those in ``keep``."""
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in keep)
    return F.regexp_replace(text, rf"[\p{{P}}&&[^{kept}]]" if kept else r"\p{P}", "")


def digits_hashed(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "#")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalized(text: Column, config: Normal = Normal(), ascii_only: bool = False) -> Column:  # noqa: B008
    """All steps. With ``ascii_only`` the caller vouches for ASCII texts, whose forms and folding change nothing but
    case, and everything stays in the JVM."""
    forms = config.form != "none" and not ascii_only
    t = with_form(text, config.form) if forms else text
    if config.halfwidth:
        t = halfwidth(t)
    if config.control:
        t = without_control(t)
    if config.punctuation:
        t = without_punctuation(t, config.keep)
        t = with_form(t, config.form) if forms else t
    if config.digits == "hash":
        t = digits_hashed(t)
    elif config.digits == "spoken":
        t = spoken_runs(t, config.language)
    elif config.digits == "digits":
        t = words_to_digits(t, config.language)
    if config.case != "none":
        t = F.lower(t) if config.case == "lower" or ascii_only else folded(t)
    if config.spaces:
        t = collapsed(t)
    if forms:
        t = with_form(t, config.form)
    return words_to_digits(t, config.language) if config.itn else t


def is_chinese(text: Column) -> Column:
    return text.rlike(CHINESE)


def tokens(text: Column, mode: str = "word", hint: str = "") -> Column:
    """word: parts between spaces; char: code points without spaces; char_bigram: neighbouring pairs of a Chinese text, of
    others the words; auto: char for a Chinese text or a hint of zh, else word. No token of an empty text."""
    words = F.filter(F.split(text, " "), lambda x: x != "")
    plain = F.replace(text, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(plain, ""), lambda x: x != "")
    n = F.char_length(plain)
    pairs = F.when(n < 2, chars).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2))))
    if mode == "word":
        return words
    if mode == "char":
        return chars
    if mode == "char_bigram":
        return F.when(is_chinese(text), pairs).otherwise(words)
    if mode == "auto":
        return chars if hint.startswith("zh") else F.when(is_chinese(text), chars).otherwise(words)
    raise ValueError(mode)


def normalized_pair(ref: Column, hyp: Column, config: Normal = Normal(), ascii_only: bool = False) -> Column:  # noqa: B008
    """(ref, hyp, fault): both sides normalised; a blank reference is a fault."""
    blank = F.trim(F.regexp_replace(ref, SPACES, " ")) == ""
    return F.struct(normalized(ref, config, ascii_only).alias("ref"), normalized(hyp, config, ascii_only).alias("hyp"), F.when(blank, "blank reference").alias("fault"))


def report(ref: Column, hyp: Column, config: Normal = Normal(), mode: str = "auto", ascii_only: bool = False) -> Column:  # noqa: B008
    """(ref, hyp, ref_tokens, hyp_tokens, mode, config_hash)."""
    from ..sources.provenance import stable_hash

    r, h = normalized(ref, config, ascii_only), normalized(hyp, config, ascii_only)
    return F.struct(r.alias("ref"), h.alias("hyp"), tokens(r, mode).alias("ref_tokens"), tokens(h, mode).alias("hyp_tokens"), F.lit(mode).alias("mode"), F.lit(stable_hash(config)).alias("config_hash"))


__all__ = ["PRESETS", "Normal", "collapsed", "digits_hashed", "digits_to_words", "folded", "halfwidth", "is_chinese", "normalized", "normalized_pair", "report", "tokens", "with_form", "without_control", "without_punctuation", "words_to_digits"]
