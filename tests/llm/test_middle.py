import hashlib
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxweft.llm.op11_middle import GRAMMARS, MARKERS, fill_in_middle, restored, units


def cut(text, grammar):
    """Units by a walk over neighbours."""
    space = " \t\n\x0b\x0c\r"
    kind = lambda c: "L" if c.isalpha() else "N" if c.isdecimal() else "S" if c.isspace() else None
    between = {
        "chars": lambda a, b: True,
        "graphemes": lambda a, b: not unicodedata.category(b).startswith("M") and b != "‍",
        "words": lambda a, b: a in space and b not in space,
        "lines": lambda a, b: a == "\n",
        "tokens": lambda a, b: kind(a) is None or kind(a) != kind(b),
    }[grammar]
    out = []
    for k, c in enumerate(text):
        if k and not between(text[k - 1], c):
            out[-1] += c
        else:
            out.append(c)
    return out


ODD = ["", "a", "\n", "\n\n", " a  b\n", "\U0001f600\U0001f601x\U0001f600", "éá̂ z", "x1y22  你好,\n!", "<P>", "a<S", "\r\n\t\x0b"]


@pytest.mark.parametrize("grammar", ["chars", "graphemes", "words", "lines", "tokens"])
def test_units(spark, corpus, grammar):
    texts = ODD + [t for _, t in corpus if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", units(F.col("t"), GRAMMARS[grammar]).alias("u")).collect()
    for r in rows:
        assert r["u"] == cut(texts[r["i"]], grammar)


def test_sentences(spark):
    text = "One. Two?! Three。四。 3.5 x"
    got = spark.createDataFrame([(text,)], "t string").select(units(F.col("t"), GRAMMARS["sentences"])).first()[0]
    assert got == ["One.", " Two?!", " Three。", "四。", " 3.5 x"]


def expected(i, text, grammar, markers=MARKERS):
    text = text or ""
    got = cut(text, grammar)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(got) + 1) for x in h[:2])
    if not text or any(m in text for m in markers) or h[2] % 100 >= 90:
        return "plain", None, None, None, text, len(got)
    p, m, s = "".join(got[:a]), "".join(got[a:b]), "".join(got[b:])
    if h[3] % 100 < 20:
        return "spm", p, m, s, f"{markers[1]}{s}{markers[0]}{p}{markers[2]}{m}", len(got)
    return "psm", p, m, s, f"{markers[0]}{p}{markers[1]}{s}{markers[2]}{m}", len(got)


@pytest.mark.parametrize("grammar", ["chars", "words"])
def test_forms_and_round_trip(spark, docs, corpus, grammar):
    out = fill_in_middle(docs, grammar).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(corpus) and Counter(r["form"] for r in out).keys() == {"plain", "psm", "spm"}
    texts = dict(corpus)
    for r in out:
        assert (r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["n_units"]) == expected(r["doc_id"], texts[r["doc_id"]], grammar)
        assert r["back"] == (texts[r["doc_id"]] or "")


def test_markers_in_texts(spark):
    """Texts that hold a marker stay as they are; those that end in a part of one are taken apart right."""
    texts = ["a<P>b", "<S>", "x<M>", "a<P", "b<S c<", "<<<<", "<P<S<M", ">>>>"]
    rows = spark.createDataFrame([(i * 10 + k, t) for k, t in enumerate(texts) for i in range(40)], "doc_id long, text string")
    out = fill_in_middle(rows).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in out)
    assert {r["text"] for r in out if r["form"] == "plain"} >= set(texts[:3]) and not {r["text"] for r in out if r["form"] != "plain"} & set(texts[:3])


def test_cases(spark, none):
    rows = [(None, "abc def"), (5, "same text"), (5, "same text"), (5, "another one"), (6, None)]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    for r in out:
        assert (r["form"], r["output"]) == tuple(expected(r["doc_id"], r["text"], "chars")[k] for k in (0, 4))
    assert fill_in_middle(none).count() == 0
    for bad in (("<P>", "<S>", "<S>"), ("aa", "b", "c"), ("", "b", "c"), ("<P>", "<P>x", "y")):
        with pytest.raises(ValueError):
            fill_in_middle(none, markers=bad)


def test_other_columns(spark):
    rows = spark.createDataFrame([("k1", "some text here", 3, "u")], "key string, body string, text long, units string")
    out = fill_in_middle(rows, id_col="key", text_col="body").first()
    assert out["key"] == "k1" and out["text"] == "some text here"
