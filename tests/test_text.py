import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from voxweft.functions import forms
from voxweft.functions import numbers as N
from voxweft.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want", "tokens"), [("Hello, World!", "hello world", ["hello", "world"]), ("你好，世界！", "你好世界", list("你好世界")), ("", "", []), ("Straße", "strasse", ["strasse"]), ("ＡＢＣ１２３", "abc123", ["abc123"]), ("a​b️", "ab", ["ab"])])
def test_normalized(spark, raw, want, tokens):
    assert one(spark, raw, T.normalized) == want
    assert one(spark, want, lambda c: T.tokens(c, "auto")) == tokens


def test_forms(spark):
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert one(spark, "é ﬁ Å", lambda c, form=form: T.with_form(c, form)) == unicodedata.normalize(form, "é ﬁ Å")


@pytest.fixture(scope="module")
def odd_texts(spark):
    """Every character, and random texts of characters that compose, decompose and are marks."""
    rng = random.Random(4)
    kinds = [list(forms.classes()), list(forms.changed("NFKD")), list(forms.pairs()), [f for known in forms.pairs().values() for f in known], list("aeiouAN .1-"), list("가각각")]
    texts = [*forms.characters(), "", *["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(2, 14))) for _ in range(3000)]]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string").repartition(8)


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_forms_of_all_characters(odd_texts, form):
    texts, df = odd_texts
    if form in ("NFD", "NFKC"):  # of single characters, two forms are enough
        df = df.filter("char_length(t) <> 1")
    for r in df.select("i", T.with_form(F.col("t"), form).alias("v")).collect():
        assert r["v"] == (unicodedata.normalize(form, texts[r["i"]]) if r["i"] < len(texts) else None)


def test_folding_of_all_characters(odd_texts):
    texts, df = odd_texts
    for r in df.select("i", T.folded(F.col("t")).alias("v")).collect():
        assert r["v"] == (texts[r["i"]].casefold() if r["i"] < len(texts) else None)


def test_forms_use_no_python(spark):
    t = spark.createDataFrame([("é",)], "t string").select(T.normalized(F.col("t")))
    assert "Python" not in t._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        T.with_form(F.col("t"), "NFX")


def test_long_texts(spark):
    text = ("Cafe\u0301 \u0041\u030a\u0323 \uac00\u11a8 plain words here " * 3000) + "e" + "\u0301\u0323" * 40
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[T.with_form(F.col("t"), f).alias(f) for f in forms.FORMS]).first()
    assert all(got[f] == unicodedata.normalize(f, text) for f in forms.FORMS)


def test_presets_and_report(spark):
    assert [one(spark, "Ｃafe\u0301, NO. ５!", lambda c, p=p: T.normalized(c, p)) for p in T.PRESETS.values()] == ["café no 5", "café no 5", "Ｃafe\u0301, NO. ５!", "Café, NO. 5!"]
    r = spark.createDataFrame([("Ab, c", "ab")], "a string, b string").select(T.report(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert (r["ref"], r["hyp"], r["ref_tokens"], r["mode"]) == ("ab c", "ab", ["ab", "c"], "auto") and r["config_hash"]


@pytest.mark.parametrize(("value", "want"), [("in 1999 and 007", "in one thousand nine hundred ninety nine and seven"), ("٣ and ५०", "three and fifty"), ("12345678 x", "12345678 x"), ("0000000012", "twelve"), ("no", "no"), ("", ""), ("3.5", "three.five")])
def test_spoken_runs(spark, value, want):
    assert one(spark, value, N.spoken_runs) == want


@pytest.mark.parametrize("words", ["two thousand million", "hundred", "hundred five", "one hundred two hundred", "thousand one", "one thousand thousand", "twenty-one and", "and", "million", "six x", "one hundred thousand two", ""])
def test_number_words_as_expression(spark, words):
    assert one(spark, words, N.english_to_int) == N.english_value(words.lower().replace("-", " ").split())


def test_bigrams_and_digits(spark):
    assert one(spark, "你好世", lambda c: T.tokens(c, "char_bigram")) == ["你好", "好世"]
    assert one(spark, "room 21b", lambda c: T.normalized(c, T.Normal(digits="spoken"))) == "room twenty oneb"
    assert one(spark, "room 21", lambda c: T.normalized(c, T.Normal(digits="hash"))) == "room ##"
    assert one(spark, "twenty-one", lambda c: T.normalized(c, T.Normal(punctuation=False, digits="digits"))) == "21"


def test_numbers_both_ways():
    for n in (*range(0, 1200), 9999, 10_000, 10_005, 100_100, 999_999):
        assert N.english_value(N.english_number(n).split()) == n
        assert N.chinese_value(N.chinese_number(n)) == n
    assert N.english_number(1_000_000) is None and N.chinese_number(100_000_000) is None


@pytest.mark.parametrize(("words", "digits"), [("one hundred and five", "105"), ("minus three point one four", "-3.14"), ("negative five", "-5"), ("hello", None), ("and", None), ("one point twelve", None), ("two million", "2000000")])
def test_english_phrases(words, digits):
    assert N.english_digits(words) == digits


@pytest.mark.parametrize(("words", "digits"), [("负十五", "-15"), ("三点一四", "3.14"), ("万", "10000"), ("一万万", None), ("点五", "0.5"), ("x", None)])
def test_chinese_phrases(words, digits):
    assert N.chinese_digits(words) == digits


def test_number_expressions(spark):
    df = spark.range(0, 2500, 7).select(F.col("id"), N.int_to_english(F.col("id")).alias("w"))
    for r in df.select("id", "w", N.english_to_int(F.col("w")).alias("v")).collect():
        assert r["w"] == N.english_number(r["id"]) and r["v"] == r["id"]
    assert one(spark, "Kilograms", N.unit) == "kg" and one(spark, "mile", N.unit) is None


@pytest.mark.parametrize("value", ["12", "-3.5", "1.2.3", "abc", "", "1000000"])
def test_roundtrip(spark, value):
    assert one(spark, value, N.roundtrip_stable)


def test_texts_without_marks(spark, odd_texts):
    want = F.regexp_replace(T.with_form(F.col("t"), "NFD"), r"\p{M}", "")
    assert not odd_texts[1].filter(~want.eqNullSafe(forms.without_marks(F.col("t")))).limit(3).collect()
    assert one(spark, "Ǻ가ǭ ﬁ", forms.without_marks) == "A" + unicodedata.normalize("NFD", "가") + "o ﬁ"


def test_query_of_forms_composes_the_text_itself(spark, sf_dir):
    from voxweft.plans.queries import QUERIES

    plan = QUERIES["unicode_forms"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "nfd" not in plan
