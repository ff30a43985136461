import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweft.operators import alignment, analysis, calibration, draws, grid, ngram, timings, voting
from voxweft.sources import models


def test_grid_of_inserted_columns():
    assert grid.columns_of([["a"], ["b", "a"], ["c", "a"]]) == [["*", "b", "c"], ["a", "a", "a"]]
    with pytest.raises(ValueError):
        grid.columns_of([["*"]])


def test_grid_gives_hypotheses_back(spark):
    rng = random.Random(2)
    rows = [(u, r, [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for u in range(40) for r in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "utt_id int, rank int, hyp array<string>")
    assert grid.inconsistent(grid.cells(df), df).count() == 0


def test_vote(spark):
    columns = [("the", "the", "the"), ("cat", "bat", "cat"), ("sat", "sat", "*")]
    rows = [(1, c, h, t) for c, col in enumerate(columns) for h, t in enumerate(col)]
    got = voting.fuse(spark.createDataFrame(rows, "utt_id int, col int, hyp int, token string")).orderBy("col").collect()
    assert [r["token"] for r in got] == ["the", "cat", "sat"]
    assert [r["confidence"] for r in got] == pytest.approx([1, 2 / 3, 1])


def test_gap_columns(spark):
    df = spark.createDataFrame([(1, 0, 0, "*"), (1, 0, 1, "*"), (1, 1, 0, "a"), (1, 1, 1, "*")], "utt_id int, col int, hyp int, token string")
    got = {g: sorted((r["col"], r["token"], r["confidence"]) for r in voting.fuse(df, voting.Fusion(gaps=g)).collect()) for g in ("keep", "drop", "vote")}
    assert got["keep"] == [(0, "*", 0.0), (1, "a", 1.0)] and got["drop"] == [(1, "a", 1.0)] and got["vote"] == [(0, "*", 1.0), (1, "*", 0.5)]


@pytest.mark.parametrize("n", [1, 64, 65, 1000])
def test_seeded_ties_of_any_size(spark, n):
    tokens = sorted(f"t{k}" for k in range(n))
    df = spark.createDataFrame([("u", 0, k, t) for k, t in enumerate(tokens)], "utt_id string, col int, hyp int, token string")
    got = voting.fuse(df, voting.Fusion(tie_break="seeded", seed=7)).first()["token"]
    assert got == random.Random(7).choice(tokens)


@pytest.mark.parametrize("seed", [0, 3, 8])
def test_seeded_tie(spark, seed):
    df = spark.createDataFrame([(1, 0, h, t) for h, t in enumerate("cab")], "utt_id int, col int, hyp int, token string")
    got = voting.fuse(df, voting.Fusion(tie_break="seeded", seed=seed)).first()["token"]
    assert got == random.Random(seed).choice(["a", "b", "c"])


def test_bad_fusion():
    for bad in ({"policy": "none"}, {"tie_break": "none"}, {"gaps": "none"}, {"order": "none"}):
        with pytest.raises(ValueError):
            voting.Fusion(**bad)


def test_language_model(spark, tmp_path):
    model = ngram.train(spark.createDataFrame([(["a", "b"],)], "tokens array<string>"), 2)
    hyp = spark.createDataFrame([(1, ["a", "b"])], "k int, tokens array<string>")
    assert ngram.lm_scores(hyp, model, ["k"]).first()["lm_score"] == pytest.approx(math.log10(0.25))
    p = {r["ngram"]: r["p"] for r in ngram.katz(spark.createDataFrame([("</s> a",), ("<s> a",)], "ngram string"), model, 2).collect()}
    assert p["</s> a"] == pytest.approx(0.25) and p["<s> a"] == 1.0
    models.write_arpa(model, str(tmp_path / "m"))
    back = models.read_arpa(spark, str(tmp_path / "m"))
    want = {(r["n"], r["ngram"]): round(r["logp"], 4) for r in ngram.arpa_tables(model).collect()}
    assert {(r["n"], r["ngram"]): round(r["logp"], 4) for r in back.arpa.collect()} == want
    assert ngram.lm_scores(hyp, back, ["k"], method="arpa").first()["lm_score"] <= 0


@pytest.mark.parametrize(("n", "block"), [(1, 2), (5, 64), (700, 256), (1024, 1024), ((1 << 33) + 5, 128)])
def test_draws_equal_a_sequential_program(n, block):
    rng, first = random.Random(7), draws.first_state(7)
    powers = draws.jumps(block, 40)
    found = [v for b in range(40) for part in draws.accepted(draws.jumped(first, b, powers), block, n) for v in part.tolist()]
    assert len(found) >= 40 * block // 4 and found == [rng.randrange(n) for _ in found]


def test_draws_by_replicate(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 512)
    rng = random.Random(3)
    want = {rep: sorted(rng.randrange(300) for _ in range(300)) for rep in range(70)}
    got: dict[int, list[int]] = {}
    for r in draws.draws(spark, 300, 70, 3, block=8192).collect():
        assert r["lot"] == r["rep"] // draws.LOT
        got.setdefault(r["rep"], []).extend(r["part"] * draws.WIDTH + np.frombuffer(r["at"], "<u2"))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert draws.draws(spark, 0, 5, 1).count() == 0 and draws.draws(spark, 5, 0, 1).count() == 0


def test_sequential_bootstrap(spark):
    rng = random.Random(4)
    rows = [(f"u{i:03d}", rng.choice([0.0, 0.25, 1 / 3]), rng.choice([0.0, 0.25, 1 / 3])) for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "id string, a double, b double").repartition(5).withColumn("a2", F.col("b") + 1)
    got = {r["metric"]: r for r in analysis.sequential_bootstrap(df, ["id"], [("a", "b"), ("b", "a2")], 90, 1, 0.9).collect()}
    draw = random.Random(1)
    deltas = []
    for _ in range(90):
        at = [draw.randrange(50) for _ in range(50)]
        deltas.append(statistics.fmean(rows[i][2] for i in at) - statistics.fmean(rows[i][1] for i in at))
    lo, hi = np.percentile(deltas, [5, 95])
    assert (got["b"]["lo"], got["b"]["hi"]) == pytest.approx((lo, hi), rel=1e-12, abs=1e-15)
    assert got["b"]["p_value"] == (sum(d <= 0 for d in deltas) + 1) / 91 and got["b"]["n"] == 50
    assert got["a2"]["lo"] == pytest.approx(1) and got["a2"]["delta"] == pytest.approx(1)
    assert analysis.sequential_bootstrap(df.limit(0), ["id"], [("a", "b")], 9, 1).collect() == []
    hole = df.withColumn("b", F.when(F.col("id") != "u007", F.col("b")))
    assert list(analysis.sequential_bootstrap(hole, ["id"], [("a", "b")], 9, 1).first()) == ["b", None, None, None, None, 50]


def test_drawn_means_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(draws, "WIDTH", 16)
    df = spark.range(100).select((99 - F.col("id")).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    draw = random.Random(5)
    want = [statistics.fmean((99 - draw.randrange(100)) % 7 for _ in range(100)) for _ in range(6)]
    got = sorted(draws.drawn_means(df, ["k"], ["v"], 6, 5, block=64).collect())
    assert [r["v"] for r in got] == pytest.approx(want, rel=1e-12)


def test_logistic_fit_of_many_values(spark):
    rng = random.Random(6)
    rows = [(p, int(rng.random() < p)) for p in (rng.random() for _ in range(400))]
    df = spark.createDataFrame([*rows, *rows[:40], (None, 1), (0.5, None)], "p double, label int")
    p, y = np.array([*rows, *rows[:40]], float).T
    a = b = 0.0
    for _ in range(12):
        residual = 1 / (1 + np.exp(-(a * p + b))) - y
        a, b = a - 0.5 * ((residual * p).mean() + 0.01 * a), b - 0.5 * residual.mean()
    assert calibration.fit_logistic(df, 12, 0.5, 0.01) == pytest.approx((a, b), rel=1e-9)
    assert calibration.fit_logistic(df, 12, 0.5, 0.01, most=10) == pytest.approx((a, b), rel=1e-9)
    with pytest.raises(ValueError):
        calibration.fit_logistic(df.filter("label = 1"))


def test_timing_report_of_tied_and_missing_totals(spark):
    rows = [(t, 0, "a", 0.0, float(t % 3) if t != 5 else None) for t in range(21)]
    got = timings.timing_report(spark.createDataFrame(rows, "track int, idx int, token string, start_s double, end_s double")).first()
    known = sorted(r[4] for r in rows if r[4] is not None)
    assert (got["count"], got["median_s"], got["p95_s"]) == (21, known[9], known[18])
    empty = timings.timing_report(spark.createDataFrame([], "track int, idx int, token string, start_s double, end_s double")).first()
    assert list(empty) == [0, 0.0, 0.0, 0.0, 0.0]


def test_utterance_confidence(spark):
    df = spark.createDataFrame([([0.5, 0.25],), ([],)], "p array<double>")
    rows = df.select(*[calibration.utterance_confidence(F.col("p"), k).alias(k) for k in ("mean", "min", "geometric", "product")]).collect()
    assert list(rows[0]) == pytest.approx([0.375, 0.25, math.sqrt(0.125), 0.125]) and list(rows[1]) == [0, 0, 0, 0]


def test_piecewise_must_not_fall():
    for bad in ([(0.0, -1.0, 0.0)], [(0.0, 1.0, 0.0), (0.5, 1.0, -1.0)], [(0.5, 1.0, 0.0), (0.0, 1.0, 0.0)], []):
        with pytest.raises(ValueError):
            calibration.piecewise(None, bad)


def plain_katz(counts, gram):
    """By the definition, order by order; counts by tuples of words."""
    total = sum(c for g, c in counts.items() if len(g) == 1)
    if len(gram) == 1:
        return counts.get(gram, 1) / total
    ctx = gram[:-1]
    if gram in counts:
        return counts[gram] / counts.get(ctx, counts[gram])
    left = counts.get(ctx, 0) - sum(c for g, c in counts.items() if len(g) == len(gram) and g[:-1] == ctx)
    return left / counts[ctx] * plain_katz(counts, ctx) if counts.get(ctx) and left > 0 else 1 / (total + 1)


@pytest.mark.parametrize("least", [1, 2])
def test_katz_of_three_orders(spark, least):
    rng = random.Random(5)
    sentences = [[rng.choice("aaabbc") for _ in range(rng.randint(0, 6))] for _ in range(30)]
    model = ngram.train(spark.createDataFrame([(s,) for s in sentences], "tokens array<string>"), 3)
    model = ngram.prune(model, least)
    counts = {tuple(r["ngram"].split(" ")): r["c"] for r in model.counts.collect()}
    grams = [(a, b, c) for a in ("a", "b", "c", "<s>", "q") for b in ("a", "b", "c", "q") for c in ("a", "c", "</s>", "q")]
    for n in (1, 2, 3):
        asked = sorted({g[-n:] for g in grams})
        got = ngram.katz(spark.createDataFrame([(" ".join(g),) for g in asked + asked], "ngram string"), model, n).collect()
        assert {tuple(r["ngram"].split(" ")): r["p"] for r in got} == pytest.approx({g: plain_katz(counts, g) for g in asked})


def test_scores_with_unknown_words(spark):
    model = ngram.train(spark.createDataFrame([(["a", "b"],), (["a", "<unk>"],)], "tokens array<string>"), 2)
    counts = {tuple(r["ngram"].split(" ")): r["c"] for r in model.counts.collect()}
    rows = [(1, ["a", "x y"]), (2, []), (3, ["zz", "b"]), (4, ["a", "b"]), (5, ["a", "b"])]
    got = {r["k"]: r for r in ngram.perplexity(spark.createDataFrame(rows, "k int, tokens array<string>"), model, "k").collect()}
    for k, tokens in rows:
        seq = ["<s>", *(t if (t,) in counts else "<unk>" for t in tokens), "</s>"]
        p = [plain_katz(counts, tuple(seq[i : i + 2])) for i in range(len(seq) - 1)]
        assert got[k]["perplexity"] == pytest.approx(math.exp(-sum(map(math.log, p)) / len(p)) if tokens else 1.0)


def test_parts_of_ngrams(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("ab c de",), ("",)], "g string")
    got = df.select("g", ngram.context(F.col("g")), ngram.suffix(F.col("g")), ngram.last_word(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [("a", "", "", "a"), ("a b", "a", "b", "b"), ("ab c de", "ab c", "c de", "de"), ("", "", "", "")]


def test_grids_of_all_rotations(spark):
    rng = random.Random(9)
    groups = {u: [[rng.choice("ab") for _ in range(rng.randint(0, 4))] for _ in range(1 + u % 4)] for u in range(24)}
    df = spark.createDataFrame([(u, k, h) for u, hs in groups.items() for k, h in enumerate(hs)], "utt_id int, rank int, hyp array<string>")
    got = {r["utt_id"]: r for r in grid.order_effects(df).collect()}
    for u, hs in groups.items():
        n, seen = len(hs), set()
        for turn in range(n):
            columns = grid.columns_of(hs[turn:] + hs[:turn])
            seen.add(tuple(tuple(c[(k - turn) % n] for k in range(n)) for c in columns))
        assert (got[u]["orders"], got[u]["grids"], got[u]["sorted_grids"]) == (n, len(seen), 1)
    assert max(r["grids"] for r in got.values()) > 1


@pytest.mark.parametrize("config", [{}, {"policy": "lm", "alpha": 0.1}, {"policy": "posterior", "gaps": "vote"}, {"policy": "confidence", "gaps": "drop"}, {"policy": "score", "tie_break": "highest_score"}, {"tie_break": "first"}, {"tie_break": "first", "order": "sorted"}, {"tie_break": "seeded", "seed": 3}, {"policy": lambda w: w * F.col("hyp")}])
def test_columns_and_cells_give_the_same_votes(spark, config):
    rng = random.Random(8)
    rows = [(u, r, [rng.choice("abc") for _ in range(rng.randint(1, 6))], rng.choice([0.0, 0.5, 1.0]), -rng.random(), rng.random(), 1 / r) for u in range(30) for r in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "utt_id int, rank int, hyp array<string>, score double, lm double, posterior double, hyp_weight double")
    columns = grid.columns(df, keep=("score", "lm", "posterior", "hyp_weight")).persist()
    cells = grid.flat(columns).repartition(3)
    assert {(r["utt_id"], r["hyp"] + 1): r["score"] for r in cells.collect()} == {(r[0], r[1]): r[3] for r in rows}
    both = lambda f: [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(t).collect()) for t in (columns, cells)]
    a, b = both(lambda t: voting.fuse(t, voting.Fusion(**config), score="score" if config.get("policy") == "score" else None))
    assert a == b and a
    for keep in (False, True):
        a, b = both(lambda t, keep=keep: voting.confusion_network(t, score="posterior", keep_gaps=keep))
        assert a == b and a
    columns.unpersist()


def test_voting_over_grids_joins_nothing(spark, sf_dir):
    from voxweft.plans import queries

    for name in ("confusion_network", "fuse_score", "fuse_lm", "fuse_majority", "network_one_best"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1


def test_streams_of_chosen_tokens_are_joined_as_wholes(spark):
    chosen = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "utt_id int, tokens array<string>")
    hyps = spark.createDataFrame([(1, ["a", "x"]), (1, ["b", "b", "d"]), (1, []), (4, ["a"])], "utt_id int, hyp array<string>")
    df = voting.vote_confidence(chosen, hyps)
    assert sorted(map(tuple, df.collect())) == [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.0), (2, 0, 0.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "[utt_id, pos" not in plan.replace("#", " ")


def test_faults_of_fusion(spark):
    cells = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "b")], "utt_id int, col int, token string")
    fused = spark.createDataFrame([(1, 0, "a", 1.0, 1.0), (1, 1, "c", 0.5, 0.5), (1, 1, "b", 2.0, 0.5)], "utt_id int, col int, token string, confidence double, agreement double")
    df = voting.fusion_faults(fused, cells)
    assert sorted((r["col"], r["fault"]) for r in df.collect()) == [(1, "range"), (1, "token")]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_orders_met_again_are_aligned_once(spark):
    rows = [(u, r, h) for u, hs in enumerate([[["b"], ["a", "b"], ["a"]], [["a"]] * 3, [["c", "a"], [], ["c"]]]) for r, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "utt_id int, rank int, hyp array<string>")
    out = grid.order_effects(df)
    assert "ArrowEvalPython" in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("grid(") == 0
    assert {r["utt_id"]: r["sorted_grids"] for r in out.collect()} == {0: 1, 1: 1, 2: 1}


def test_bootstrap_sums_are_made_by_tasks(spark):
    from hashlib import md5

    rng = random.Random(11)
    rows = [(rng.choice("pq"), f"u{k}" if k != 7 else None, rng.random(), rng.random() if k != 9 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, id string, a double, b double").coalesce(1)
    got = {(r["g"], r["rep"]): r["delta"] for r in analysis.bootstrap(df, "id", "a", "b", 20, 3, ("g",)).collect()}
    for g in "pq":
        for rep in range(20):
            total = drawn = 0.0
            for group, i, a, b in rows:
                u = int(md5(":".join(["3", str(rep), *([i] if i is not None else [])]).encode()).hexdigest()[:8], 16) / 2**32
                w = sum(u >= c for c in analysis.POISSON)
                if group == g:
                    drawn += w
                    total += w * (b - a) if b is not None else 0
            assert got[g, rep] == pytest.approx(total / drawn)
    plan = analysis.bootstrap(df, "id", "a", "b", 20, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "REPARTITION_BY_NUM" in plan
    assert analysis.bootstrap(df.limit(0), "id", "a", "b", 20, 3).collect() == []


def test_grid_faults_of_hypotheses_and_columns(spark):
    hyps = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a"]), (2, 1, []), (3, 1, ["x"])], "utt_id int, rank int, hyp array<string>")
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "*"), (1, 1, 0, "b"), (1, 1, 1, "*"), (1, 2, 0, "*"), (1, 2, 1, "*"), (4, 0, 0, "*")], "utt_id int, col int, hyp int, token string")
    assert sorted(map(tuple, grid.inconsistent(cells, hyps).collect())) == [(1, -1, "column"), (1, 1, "row"), (3, 0, "row"), (4, -1, "column")]
    assert sorted(map(tuple, grid.audit(grid.columns(hyps), hyps).collect())) == [(1, 2, 2, [], []), (2, 0, 0, [], []), (3, 1, 1, [], [])]


def test_grid_query_shuffles_rows_of_utterances_only(spark, sf_dir):
    from voxweft.plans.queries import QUERIES

    plan = plan_of(QUERIES["grid_consistent"](spark, sf_dir))
    dealt = [x for x in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan) if "conv_id" not in x]
    assert dealt and not any("," in x for x in dealt) and "Window" not in plan and "Broadcast" not in plan


def test_arrays_are_compared_as_wholes(spark):
    a, b = (spark.createDataFrame(t, "utt_id int, tokens array<string>") for t in ([(1, ["a", "b"]), (2, ["c"]), (3, []), (5, [None, "x"])], [(1, ["a", "d", "e"]), (3, []), (4, ["f"]), (5, [None, "y"])]))
    t = voting.differing_positions(a, b)
    assert sorted(map(tuple, t.collect()), key=str) == [(1, 1, "b", "d"), (1, 2, None, "e"), (2, 0, "c", None), (4, 0, None, "f"), (5, 1, "x", "y")]
    assert not re.search(r"Exchange hashpartitioning\(.*pos#", plan_of(t))


def test_invariants_of_fusion_are_counted_without_a_join(spark, sf_dir):
    from voxweft.plans.queries import QUERIES

    assert "Join" not in plan_of(QUERIES["fusion_invariants"](spark, sf_dir))


def test_hypotheses_are_made_once_for_their_ngrams(spark, sf_dir):
    from voxweft.plans import queries

    t = ngram.positions(queries.hyps(spark, sf_dir), 2, tokens="hyp")
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("regexp_extract_all(") == 1


def plan_of(t):
    return t._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [0, 3, 11])
def test_seeded_draws_are_those_of_the_standard_library(spark, seed):
    sizes = [*range(1, 140), 255, 256, 257, 4095, 4096, 70_000, 2**31 - 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", voting.seeded_draw(F.col("n"), seed).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == {n: random.Random(seed).choice(range(1, n + 1)) for n in sizes}


def test_seeded_ties_go_to_python_with_their_grids_only(spark, sf_dir):
    from voxweft.plans.queries import QUERIES

    assert plan_of(QUERIES["fuse_tie_seeded"](spark, sf_dir)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name,kept", [("fuse_majority", ()), ("fuse_tie_seeded", ()), ("fused_text", ()), ("fusion_summary", ()), ("fuse_lm", ("lm",)), ("fuse_posterior", ("posterior",)), ("fuse_tie_highest", ("score",)), ("fuse_confidence", ("score", "hyp_weight")), ("network_one_best", ("score",))])
def test_scores_that_no_vote_needs_are_not_shuffled(spark, sf_dir, name, kept):
    from voxweft.plans.queries import QUERIES

    listed = re.search(r"partial_collect_list\(struct\(rank, rank#\d+, hyp, hyp#\d+(.*?)\), 0", plan_of(QUERIES[name](spark, sf_dir)))[1]
    assert re.findall(r", (\w+), \w+#\d+", listed) == list(kept)


@pytest.mark.parametrize("a,b", [("", ""), ("ab", ""), ("", "ab"), ("abab", "baba"), ("aab", "ab"), ("ab", "aab"), ("xaya", "ayax")])
def test_places_of_paths(a, b):
    olds, news = alignment.unit_places(a, b)
    assert [k for k in olds if k >= 0] == [*range(len(a))] and [k for k in news if k >= 0] == [*range(len(b))]
    steps = [(op, i if op == alignment.INS else a[i], j if op == alignment.DEL else b[j]) for op, i, j in alignment.unit_path(a, b)]
    assert steps == alignment.best_path(list(a), list(b))[0]
    assert grid.grid_rows([a, b]) == [["*" if k < 0 else a[k] for k in olds], ["*" if k < 0 else b[k] for k in news]]
