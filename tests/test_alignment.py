import random
import tracemalloc
from itertools import chain, product

import pytest
from pyspark.sql import functions as F

from voxweft.operators import alignment as A


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def test_known_rates(spark):
    pairs = [("the cat sat", "the bat sat", 1 / 3), ("cat sat", "cat on sat", 1 / 2), ("the big cat", "the cat", 1 / 3), ("", "", 0.0), ("", "a", 1.0)]
    rows = [(r.split(), h.split(), w) for r, h, w in pairs]
    df = spark.createDataFrame(rows, "ref array<string>, hyp array<string>, want double")
    for r in A.with_rates(df).collect():
        assert r["wer"] == pytest.approx(r["want"])


def test_characters_count_code_points(spark):
    df = spark.createDataFrame([("你好世界", "你好时间")], "a string, b string")
    assert df.select(A.char_errors(F.col("a"), F.col("b"))).first()[0] == 2


def test_ties_and_matches():
    ops, cost = A.best_path(["a"], ["b", "a"])
    assert [o[0] for o in ops] == [A.INS, A.MATCH] and cost == 1
    assert [o[0] for o in A.best_path(["a", "b"], ["c"])[0]] == [A.DEL, A.SUB]


def test_paths_equal_distances(spark):
    rng = random.Random(5)
    words = lambda: [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
    rows = [(words(), words()) for _ in range(300)]
    for a, b in rows:
        ops, cost = A.best_path(a, b)
        assert cost == distance(a, b) == sum(o[0] != A.MATCH for o in ops)
        assert [o[1] for o in ops if o[1] is not None] == a and [o[2] for o in ops if o[2] is not None] == b
        if abs(len(a) - len(b)) <= 12:
            assert A.best_path(a, b, band=12)[1] == cost
    df = spark.createDataFrame(rows, "ref array<string>, hyp array<string>")
    df = df.select(A.word_errors(F.col("ref"), F.col("hyp")).alias("n"), F.size(F.filter(A.edit_ops(F.col("ref"), F.col("hyp")), lambda o: o["op"] != A.MATCH)).alias("m"))
    assert df.filter("n <> m").count() == 0


def test_costs_and_bands():
    assert A.best_path(["a"], ["b"], A.Costs(sub=3.0))[1] == 2.0
    assert A.best_path(["a"], ["b"], A.Costs(pairs={("a", "b"): 0.25}))[1] == 0.25
    for bad in (lambda: A.Costs(sub=-1), lambda: A.Costs(ins=float("nan")), lambda: A.best_path(["a"] * 5, ["a"], band=2), lambda: A.best_path(["a"], ["a"], band=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        A.best_path("ab", ["a"])


def test_markdown(spark):
    df = spark.createDataFrame([("a b c".split(), "a x c".split())], "r array<string>, h array<string>")
    md = df.select(A.ops_markdown(A.edit_ops(F.col("r"), F.col("h")), 2)).first()[0]
    assert md.split("\n") == ["| op | ref | hyp |", "|---|---|---|", "| MATCH | 'a' | 'a' |", "| SUB | 'b' | 'x' |", "| ... (1 more) ... | | |"]


def test_pairs_of_many_different_tokens(spark):
    """Pairs of any number of different tokens are counted, and corpus rates have them."""
    ref = [chr(0x3400 + i) for i in range(25_000)]
    hyp = ["x", *ref[1:700], *ref[701:20_000], "y", *ref[20_001:], "z"]
    df = spark.createDataFrame([(ref, hyp), (["a"], ["b"]), (ref, ref), ([], [])], "ref array<string>, hyp array<string>")
    assert [r[0] for r in df.select(A.word_errors(F.col("ref"), F.col("hyp"))).collect()] == [4, 1, 0, 0]
    r = A.corpus_rates(A.with_rates(df.limit(2))).first()
    assert r["n"] == 2 and r["wer_micro"] == 5 / 25_001 and r["wer_macro"] == (4 / 25_000 + 1) / 2


def test_token_distance_is_the_path_s():
    import random

    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert A.token_distance(a, b) == sum(s[0] != A.MATCH for s in A.best_path(a, b)[0])


def test_band_and_whole_table_agree():
    import random

    rng = random.Random(5)
    for _ in range(300):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        whole = A.best_path(ref, hyp)
        assert A.best_path(ref, hyp, band=12) == whole
        width = abs(len(ref) - len(hyp)) + rng.randint(0, 3)
        steps, cost = A.best_path(ref, hyp, band=width)
        assert cost >= whole[1] == sum(s[0] != A.MATCH for s in whole[0]) and cost == sum(s[0] != A.MATCH for s in steps)
        assert [s[1] for s in steps if s[1] is not None] == ref and [s[2] for s in steps if s[2] is not None] == hyp


def test_unit_paths_are_the_best_ones():
    """Steps and ties are those of the table, for all small pairs and random larger ones."""
    rng = random.Random(11)
    small = [list(p) for n in range(5) for p in product("abc", repeat=n)]
    large = [([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 150))], [rng.choice("abcde") for _ in range(rng.randint(0, 150))]) for _ in range(150)]
    for a, b in chain(((a, b) for a in small for b in small), large):
        steps = [(op, None if i is None else a[i], None if j is None else b[j]) for op, i, j in A.unit_path(a, b)]
        assert steps == A.best_path(a, b)[0]


def test_paths_of_long_tracks():
    """25,000 tokens on both sides, within bounded memory."""
    rng = random.Random(3)
    a = [str(rng.randrange(400)) for _ in range(25_000)]
    b = [t for t in a if rng.random() > 0.05]
    b = [t if rng.random() > 0.05 else "other" for t in b]
    tracemalloc.start()
    steps = A.unit_path(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    assert [i for _, i, _ in steps if i is not None] == list(range(len(a))) and [j for _, _, j in steps if j is not None] == list(range(len(b)))
    assert all((op == A.MATCH) == (i is not None and j is not None and a[i] == b[j]) for op, i, j in steps)
    assert sum(op != A.MATCH for op, _, _ in steps) == A.token_distance(a, b)


def test_path_columns(spark):
    rows = [(1, ["a", "b"], ["a", "b"]), (2, ["a"], []), (3, [], []), (4, None, ["x"]), (5, ["a", "b", "c"], ["b", "c", "d"]), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>")
    for r in df.select("k", "r", "h", A.edit_ops(F.col("r"), F.col("h")).alias("o"), A.edit_path(F.col("r"), F.col("h")).alias("p")).collect():
        want = A.best_path(r["r"] or [], r["h"] or [])[0]
        assert [tuple(o) for o in r["o"]] == want and [(o["op"], o["i"] is None, o["j"] is None) for o in r["p"]] == [(w[0], w[1] is None, w[2] is None) for w in want]
