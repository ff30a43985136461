import hashlib
import pickle
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from voxweft.llm import op1_langid, op2_suffix_tree, op3_lines, op4_paragraphs, op5_quality, op6_secrets, op7_decontaminate, op8_jaccard, op9_bpe, op10_lines
from voxweft.llm.bytetext import span_hashes
from voxweft.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


# --- language ---


def test_language(spark):
    from voxweft.llm.op1_langid import op1_crf_language

    out = op1_crf_language(spark, DATA, sample_docs=60).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 200 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_of_switched_text(spark):
    model = op1_langid.train(["the cat and the dog with this " * 20, "el perro y la gato con este " * 20], ["en", "es"])
    df = spark.createDataFrame([(1, "the cat and the dog with this " * 4 + "el perro y la gato con este " * 4), (2, "123"), (3, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in op1_langid.label_words(df, model, spans_too=True).collect()}
    assert [s["lang"] for s in rows[1]["runs"]] == ["en", "es"] and rows[1]["runs"][0]["n_words"] == 28
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[2]["score"] == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.RandomState(0)
    emit, trans, start = rng.normal(size=(1, op1_langid.RUN, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, _, _ = op1_langid.forward_backward(emit, np.array([4]), trans, start)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(emit[0, i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, s in enumerate(path):
            want[i, s] += w
    assert np.allclose(p[0, :4], want / want.sum(1, keepdims=True))


@pytest.mark.parametrize("sharp", [1, 8])
def test_long_texts_are_one_chain(sharp):
    """Marginals of texts cut in runs are those of a chain over the whole text."""
    rng = np.random.RandomState(sharp)
    counts = np.array([63, 0, 64, 65, 1, 129, 10_000, 128])
    trans, start = sharp * rng.normal(size=(3, 3)), rng.normal(size=3)
    words_ = sharp * rng.normal(size=(counts.sum(), 3))
    place, row, length = op1_langid.runs(counts)
    table = np.zeros((len(length) * op1_langid.RUN, 3))
    table[place] = words_
    got = op1_langid.chained(table.reshape(-1, op1_langid.RUN, 3), length, row, trans, start).reshape(-1, 3)[place]
    ends = np.cumsum(counts)
    for n, end in zip(counts, ends, strict=True):
        if n:
            want, _, _ = op1_langid.forward_backward(words_[None, end - n : end], np.array([n]), trans, start)
            assert np.allclose(got[end - n : end], want[0], atol=1e-9)


def test_language_switch_at_a_run_end(spark):
    model = op1_langid.train(["the cat and the dog with this " * 20, "el perro y la gato con este " * 20], ["en", "es"])
    text = " ".join((["the", "cat", "and", "dog"] * 16) + (["el", "perro", "y", "gato"] * 16))
    r = op1_langid.label_words(spark.createDataFrame([(1, text)], "doc_id int, text string"), model, spans_too=True).first()
    assert [(s["lang"], s["first_word"]) for s in r["runs"]] == [("en", 0), ("es", 64)]


def test_language_cases(docs, none):
    model = op1_langid.train(*op1_langid.sample(docs, "doc_id", "text", "lang", 50))
    assert op1_langid.label_words(docs, model, min_score=0.1).columns == docs.columns
    assert op1_langid.label_words(none, model).count() == 0
    assert op1_langid.train(*op1_langid.sample(none, "doc_id", "text", "lang", 50)) is None
    assert {r["lang_pred"] for r in op1_langid.label_words(docs, None).collect()} == {"und"}


# --- language model ---


def test_base_scores(spark, scratch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in op2_suffix_tree.op2_suffix_tree(spark, DATA).collect()}
    tokens = {d: brute.WORD.findall(brute.lower(t)) + [None] for d, t in rows.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in rows}
    c = Counter(w for d in rows if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, r in got.items():
        want = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d])
        assert r["base_score"] == pytest.approx(want) and r["n_known"] == sum(c[w] > 0 for w in tokens[d]) and r["train_tokens"] == n and r["held_out"] == held[d]
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def class_of(word):
    h = op2_suffix_tree.end_hash() if word is None else span_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word.encode())]))[0]
    return int(h) >> (64 - op2_suffix_tree.CLASS_BITS)


def tree_texts():
    """A hot word, a hot pair, a hot passage, copies, rare words, and texts that aren't learned from."""
    rng = random.Random(3)
    lexicon = [f"w{int(rng.paretovariate(0.4)) % 20000}" for _ in range(900)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(300)) for _ in range(30)]
    texts += [f"{t[:600]} odd{i}" for i, t in enumerate(texts[:20])] + [None, "", "new words", "the", "THE of"]
    texts += [" ".join(rng.choice(["the", "of the", "in the old house by the sea", rng.choice(lexicon)]) for _ in range(120)) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("top", "cell"), [(1 << 20, 1 << 21), (50, 4000), (0, 600), (20, 150)])
def test_scores_equal_brute_force(spark, scratch, top, cell):
    """Scores don't depend on what is frequent, how many cells there are, or which contexts are hot."""
    texts = tree_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    tree = brute.Tree([t for i, t in enumerate(texts) if i % 4], 4, 2, 0.05, class_of)
    assert {len(s) for s in tree.kept} == {1, 2, 3, 4}
    assert any(s not in tree.kept for s, d in tree.follow.items() if sum(d.values()) >= 2)
    got = {r["doc_id"]: r["score"] for r in op2_suffix_tree.score_texts(df, scratch, F.col("doc_id") % 4 != 0, top=top, cell=cell).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([tree.score(t) for t in texts], rel=1e-9)


def test_probabilities_add_up():
    texts = tree_texts()
    tree = brute.Tree(texts, 4, 2, 0.05, class_of)
    tokens = [*tree.single, "zz"]
    for s in random.Random(1).sample(sorted(tree.kept), 20):
        assert sum(tree.prob(s, a) for a in tokens) == pytest.approx(1)


def test_scores_cases(docs, none, scratch, corpus):
    got = {r["doc_id"]: r for r in op2_suffix_tree.score_texts(docs, scratch, F.col("doc_id") > 2).collect()}
    assert len(got) == len(corpus) and got[0]["n_tokens"] == got[1]["n_tokens"] == 1
    assert op2_suffix_tree.score_texts(none, scratch, F.lit(True)).count() == 0
    alone = op2_suffix_tree.score_texts(docs, scratch, F.lit(False)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in alone)


# --- rules ---


def test_line_rules(spark):
    rng = random.Random(6)
    text = "\n".join(" ".join(f"word{rng.randrange(500)}" for _ in range(12)) + "." for _ in range(8))
    rows = [(1, text), (2, text.replace(" ", "!! ")), (3, "home | about | login | help | more\n" * 12), (4, text + "\nAll rights reserved."), (5, None), (6, "a b c " * 40)]
    got = {r["doc_id"]: r for r in op3_lines.line_first_clean(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["kept"] and got[4]["kept"] and got[4]["n_lines_removed"] == 1 and "rights" not in got[4]["clean_text"]
    assert not got[2]["kept"] and not got[3]["kept"] and not got[5]["kept"] and got[6]["n_repeat_words"] == 120 and got[6]["base_failed"]


def test_line_rules_cases(docs, none):
    out = op3_lines.line_first_clean(docs)
    assert out.count() == docs.count() and op3_lines.line_first_clean(none).count() == 0
    assert len(set(out.columns)) == len(out.columns)


# --- repeats ---


def test_repeated_passages(docs, none, scratch, corpus):
    got = op4_paragraphs.near_paragraphs(docs, scratch).collect()
    seen = Counter()
    for _, t in corpus:
        w = (t or "").split()
        seen.update({tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    again = {d for d, t in corpus for w in [(t or "").split()] if any(seen[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50))}
    found = {r["doc"] for r in got}
    assert again <= found
    assert not found & {d for d, t in corpus if t is None or len(t) < 20}
    assert op4_paragraphs.near_paragraphs(none, scratch).count() == 0


def test_short_lines_and_sentences_in_passages(spark):
    """Passages of short lines, of sentences of 6 and 7 words, and without any mark are found in other surroundings."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.randrange(900)}"
    some = lambda n: " ".join(word() for _ in range(n))
    verse = "\n".join(some(4 + i % 4) for i in range(24))
    mixed = " ".join(some(7 if i % 2 else 6) + "." for i in range(16))
    bare = some(120)
    rows = []
    for i, passage in enumerate((verse, mixed, bare)):
        rows += [(2 * i, f"{some(43)} {passage} {some(31)}"), (2 * i + 1, f"{some(18)}.\n{some(5)}\n{passage}\n{some(50)}")]
    rows.append((9, some(200)))
    got = op4_paragraphs.near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()
    covered = {d: {w for r in got if r["doc"] == d for w in range(r["first"], r["first"] + r["n"])} for d, _ in rows}
    assert all(len(covered[d]) >= 60 for d in range(6)) and not covered[9]
    assert {r["doc"] for r in got if r["removed"]} == {1, 3, 5}


def test_near_copies_of_whole_lines(spark):
    """A line with one changed word in each 30 is linked as a whole, and nothing of the first copy is removed."""
    rng = random.Random(13)
    line = [f"w{rng.randrange(5000)}" for _ in range(60)]
    copy = [*line[:30], "other", *line[31:]]
    short = [f"v{rng.randrange(5000)}" for _ in range(50)]
    rows = [(1, " ".join(line) + "\nfirst tail"), (2, "head\n" + " ".join(copy)), (3, " ".join(short)), (4, " ".join([*short[:24], "x", *short[25:]]))]
    got = op4_paragraphs.near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()
    for d, first, n in ((1, 0, 60), (2, 1, 60), (3, 0, 50), (4, 0, 50)):
        assert any((r["doc"], r["first"], r["n"]) == (d, first, n) for r in got)
    assert {r["doc"] for r in got if r["removed"]} == {2, 4}


# --- quality ---


def test_quality(spark):
    out = op5_quality.op5_neighbours(spark, DATA, 150).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(held) > 10 and sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_vote_equals_brute_force(spark):
    """Scores are the votes of the nearest labelled vectors, whichever block a text is in; clashing labels are settled."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    clash = labels.union(labels.withColumn("quality", F.lit(1)))
    texts, y = op5_quality.sample(docs, clash, "doc_id", "text", "quality", 60)
    assert (texts, y) == op5_quality.sample(docs.union(docs), clash.union(labels), "doc_id", "text", "quality", 60)
    model = op5_quality.fit(texts, y, rank=8, neighbours=5)
    got = {r["doc_id"]: r["score"] for r in op5_quality.vote(docs, model).collect()}
    for r in docs.limit(60).collect():
        v = model.project(op5_quality.counts(pa.array([r["text"]], pa.string())))[0]
        if not r["text"]:
            continue
        near = sorted(((float(v @ u), float(t)) for u, t in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        w = [min(1.0, max(1e-6, c)) ** 4 for c, _ in near]
        assert got[r["doc_id"]] == pytest.approx(sum(a * t for a, (_, t) in zip(w, near, strict=True)) / sum(w), abs=2e-3)


def test_equal_neighbours_vote_in_any_order():
    """Of 60 equal labelled texts all vote, wherever they stand among the others."""
    texts = ["the same words again"] * 60 + [f"other {i} text, number {i * i}" for i in range(40)]
    labels = [int(i % 3 == 0) for i in range(60)] + [1] * 40
    asked, found = pa.array(["the same words again", "the same word again", "something else", ""]), []
    for seed in range(3):
        order = list(range(100))
        random.Random(seed).shuffle(order)
        found.append(op5_quality.fit([texts[i] for i in order], [labels[i] for i in order], rank=8, neighbours=7).score(asked))
    assert found[0][0] == pytest.approx(1 / 3, abs=1e-6)
    assert np.allclose(found[0], found[1], atol=1e-3) and np.allclose(found[0], found[2], atol=1e-3)


def test_quality_cases(spark, docs, none):
    labels = spark.createDataFrame([(8, 1), (9, 0), (50, None), (None, 1)], "doc_id long, quality int")
    model = op5_quality.fit(*op5_quality.sample(docs, labels, "doc_id", "text", "quality", 10))
    got = {r["doc_id"]: r["score"] for r in op5_quality.vote(docs, model).collect()}
    assert got[0] == got[1] == 0.5 and len(got) == docs.count()
    assert op5_quality.vote(none, model).count() == 0
    assert op5_quality.fit(*op5_quality.sample(none, labels, "doc_id", "text", "quality", 10)) is None
    assert {r["score"] for r in op5_quality.vote(docs, None).collect()} == {0.5}


# --- secrets ---

KEY = "AKIA" + "ABCDEFGHIJ123456"
HEX = "0123456789abcdef" * 2


def base_spans(text):
    found = []
    for k, (name, pattern, group, least) in enumerate((("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        found += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(n, s, e) for s, _, n, e in sorted(found)]


def test_secrets(spark, scratch):
    texts = [None, "", f"é password = {HEX} x", f"{KEY} and {KEY}Z token:short secret=token:longvalue123 API_KEY='abcdefgh'", f"token=token={HEX}", "AKIASHORT " + HEX[:31], "\U0001f600" + HEX, "ghp_" + "a1B2" * 9]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(100 + i, f"key {KEY}", f"o{i}") for i in range(4)]
    got = {r["doc_id"]: r["secrets"] for r in op6_secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string, source string"), scratch).collect()}
    base = {k.name for k in op6_secrets.BASE_KINDS}
    for i, t, _ in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in base] == base_spans(t)
    assert {s["verdict"] for s in got[100]} == {"example"} and got[100][0]["n_owners"] == 5
    assert {s["verdict"] for s in got[4] if s["kind"] == "assign"} == {"live"} and "github" in {s["kind"] for s in got[7]}


def test_secrets_digest(spark, tmp_path):
    spark.createDataFrame([(1, f"password={HEX}", "a")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    r = op6_secrets.op6_ownership(spark, str(tmp_path)).first()
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(f"password={HEX}"))
    assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and (r["n_assign"], r["n_hex"]) == (1, 1)


def test_secrets_cases(docs, none, scratch):
    assert op6_secrets.find_secrets(docs, scratch).count() == docs.count()
    assert op6_secrets.find_secrets(none, scratch).count() == 0


# --- benchmark ---


@pytest.mark.parametrize("block_bytes", [16_000_000, 900])
def test_leaks(spark, docs, corpus, block_bytes):
    whole = corpus[-1][1].split()
    items = [(0, " ".join(whole[5000:5040])), (1, " ".join(whole[100:120]).upper()), (2, " ".join(whole[7:10])), (3, ""), (4, None), (5, " ".join([*whole[60:90], "odd"])), (6, "nowhere to be found at all in here"), (0, " ".join(whole[:30]))]
    df = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontaminate.find_items(docs, df, block_bytes=block_bytes).collect()}
    assert got == brute.leaks(corpus, items, 5, 0.8) and len(got) == 4


def test_leaks_cases(spark, docs, none):
    empty = spark.createDataFrame([], "item_id int, text string")
    assert op7_decontaminate.find_items(docs, empty).count() == 0
    assert op7_decontaminate.find_items(none, spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")).count() == 0


# --- near copies ---


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (3, 60)])
def test_jaccard(docs, corpus, scratch, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_jaccard.ngram_join(docs, scratch, k=k, num=num, den=100).collect()}
    assert got == brute.components(corpus, k, num, 100)


def test_jaccard_of_real_rows(spark, scratch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_jaccard.ngram_join(docs, scratch, k=3, num=90).collect()}
    assert got == brute.components([tuple(r) for r in docs.collect()], 3, 90, 100)


def test_jaccard_cases(docs, none, scratch):
    assert op8_jaccard.ngram_join(none, scratch).count() == 0
    twice = op8_jaccard.ngram_join(docs.union(docs), scratch).select("doc_id", "n_shingles", "component_id").collect()
    once = op8_jaccard.ngram_join(docs, scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(twice) == Counter(once + once)


def by_id(rows, k, num):
    """Components where rows of one id are one document, by comparison of all pairs of rows."""
    n, root = len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (rows[a][0] is not None and rows[a][0] == rows[b][0]) or (both and 100 * both >= num * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return Counter((rows[a][0], len(sets[a]), least.get(find(a))) for a in range(n))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_jaccard_of_repeated_ids(spark, scratch, kind):
    """One id with two texts connects what either is linked with, in any order of rows."""
    rng = random.Random(2)
    a, b, c = ([f"w{rng.randrange(500)}" for _ in range(160)] for _ in range(3))
    near = lambda t, k: " ".join([*t[: 20 * k], "other", *t[20 * k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 1)), (3, near(b, 2)), (4, " ".join(c)), (4, None), (5, near(c, 3)), (7, "alone"), (7, "alone"), (None, near(c, 4)), (None, "x y"), (6, "x y"), (9, ""), (9, " ".join(a))]
    rows = [(i if i is None or kind == "long" else f"d{i}", t) for i, t in rows]
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        got = op8_jaccard.ngram_join(df, scratch, k=3, num=90).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == by_id(rows, 3, 90)
    first = {r[2] for r in by_id(rows, 3, 90) if r[0] in (1, 2, 3, "d1", "d2", "d3")}
    assert first == {1 if kind == "long" else "d1"}


# --- tokens ---


def test_bpe(spark, docs, corpus, none):
    from tokenizers import Tokenizer

    path = op9_bpe.default_tokenizer()
    own = Tokenizer.from_file(path)
    rng = random.Random(0)
    extra = ["".join(rng.choice("abc  \n\t.,'é中\U0001f600 ") for _ in range(60)) for _ in range(200)] + ["aaaa" * 50, "   x", "x   ", "a  b", "a \n b", "<|endoftext|> a <|endoftext|>", "it's we'll", " ", "\n", " \n"]
    rows = corpus + list(enumerate(extra, 1000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op9_bpe.bpe_encode(df, path).collect()}
    for d, t in rows:
        want = own.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[d]["ids"]), "<u4").tolist() == want and got[d]["n_tokens"] == len(want)
        assert got[d]["decoded"] == own.decode(want, skip_special_tokens=False) == (t or "")
    assert op9_bpe.bpe_encode(none, path).count() == 0
    assert op9_bpe.bpe_encode(docs, path, keep=("h", "id")).columns == ["doc_id", "h", "id", "n_tokens", "ids", "decoded"]


# --- lines ---


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 2)))
        for k in (1, 2, 3):
            assert op10_lines.within(a, b, k) == (brute.distance(a, b) <= k)


@pytest.mark.parametrize("tau", [1, 2])
def test_lines(docs, corpus, scratch, tau):
    got = op10_lines.near_lines(docs, scratch, tau=tau, min_chars=20).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], set()).add((r["doc"], r["no"]))
    assert {frozenset(v) for v in classes.values()} == brute.line_classes(corpus, tau, 20)
    assert all(r["removed"] == ((r["doc"], r["no"]) != min(classes[r["class_id"]])) for r in got)


def test_lines_of_many_variants(spark, scratch):
    rng = random.Random(8)
    base = "the quick brown fox jumps over the lazy dog and runs away"
    rows = []
    for d in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        rows.append((d, "".join(t)))
    got = op10_lines.near_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], set()).add((r["doc"], r["no"]))
    assert {frozenset(v) for v in classes.values()} == brute.line_classes(rows, 2, 24)


def test_short_lines(spark):
    """Exact copies of lines of any length, and near copies by the threshold of the shorter line, are reported."""
    rng = random.Random(4)
    lines = ["}", "ok", "All rights reserved.", "Of, edti oner.", "    ", "x" * 24, "x" * 23 + "y", "x" * 22]
    for n in (5, 7, 8, 9, 12, 22, 23, 24, 25, 26):
        for _ in range(4):
            base = "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "z"
            lines += [base, base[:3] + "Q" + base[4:], base[:2] + base[3:], base[:1] + "R" + base[1:-1] + "S", base + "!"]
    rows = [(d, "\n".join(rng.sample(lines, 60))) for d in range(8)]
    rows += [(8, "}\n\n   \nok\n}"), (9, "\n   \nok"), (10, "once")]
    got = op10_lines.near_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test"), short_chars=8).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], set()).add((r["doc"], r["no"]))
    at = {}
    for d, t in rows:
        for i, x in enumerate(t.split("\n")):
            if x.strip():
                at.setdefault(x, set()).add((d, i))
    u = brute.Classes()
    for x in at:
        for y in at:
            n = min(len(x), len(y))
            if x == y or n >= 8 and brute.distance(x, y) <= (2 if n >= 24 else 1):
                u.join(x, y)
    want = {}
    for x in at:
        want.setdefault(u.find(x), set()).update(at[x])
    assert {frozenset(v) for v in classes.values()} == {frozenset(v) for v in want.values() if len(v) > 1}
    assert all(r["removed"] == ((r["doc"], r["no"]) != min(classes[r["class_id"]])) for r in got)


def test_short_lines_of_the_query(spark):
    rows = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    docs_of = {}
    for d, lines in rows.items():
        for x in lines:
            docs_of.setdefault(x, set()).add(d)
    want = {(d, i) for d, lines in rows.items() for i, x in enumerate(lines) if x.strip(" \t\r\v\f") and len(docs_of[x]) > 1}
    assert any(len(rows[d][i]) < 24 for d, i in want)
    assert want <= {(r["doc_id"], r["line_no"]) for r in op10_lines.op10_segment_edit(spark, DATA).collect()}


def test_line_dedup(docs, none, scratch, corpus):
    out = op10_lines.dedup_lines(docs, scratch, min_chars=20)
    assert out.columns == docs.columns and op10_lines.dedup_lines(none, scratch).count() == 0
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 9 not in got and got[8] == corpus[8][1] and got[0] is None and got[1] == ""


def test_line_dedup_of_any_columns(spark, scratch):
    """Text ids, columns named as the operator's own, and the same row twice."""
    line, other = "a line that stands in two documents", "another line that stands in one"
    rows = [("x", f"{line}\n{other}", 1, 2, 3, 4), ("y", f"{line}\nshort", 5, 6, 7, 8), ("z", None, 0, 0, 0, 0), ("y", f"{line}\nshort", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _id int, _gone int, gone int, doc int")
    got = sorted(op10_lines.dedup_lines(df, scratch).collect(), key=str)
    assert Counter(map(tuple, got)) == Counter([rows[0], ("y", "short", *rows[1][2:]), rows[2], ("y", "short", *rows[1][2:])])
    assert {r["text"] for r in got} == {rows[0][1], "short", None} and df.columns == got[0].__fields__


def test_line_dedup_of_empty_rows_beside_removed_lines(spark, scratch):
    """Null and empty texts stay also where another row of their id loses lines; what is left keeps its order."""
    line = "a line that stands in two documents"
    rows = [(1, line), (2, f"first\n{line}\n\nlast"), (2, None), (2, ""), (3, line)]
    got = op10_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], (2, "first\n\nlast"), (2, None), (2, "")])


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(p.STAGES) == 5 and 0 < len(out) <= len(docs) and {r["doc_id"] for r in out} <= set(docs)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] > 0 for r in out)


def test_pipeline_decodes(spark, docs, corpus):
    import corpus_pipeline as p

    got = {r["doc_id"]: r["decoded_sha256"] for r in p.encode(spark, docs, DATA).collect()}
    assert got == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in corpus}


def test_pipeline_cases(spark, docs, none):
    """Stages keep clashing columns, take nulls, repeated rows and empty tables, and drop only what they are for."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, none.limit(0), DATA).count() == 0
        out = stage(spark, docs.union(docs), DATA)
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert set(ids.values()) == {2}, name
        if name == "encode":
            continue
        assert out.columns == docs.columns
        if name != "language":
            assert {0, 1, 2} <= set(ids), name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = p.near_duplicates(spark, docs, DATA)
    groups = brute.components(sorted(rows.items()), 5, 80, 100)
    assert {r["doc_id"] for r in near.collect()} == {d for d, (_, c) in groups.items() if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = p.decontaminate(spark, docs, DATA)
    assert {r["doc_id"] for r in clean.collect()} == set(rows) - {d for d, _ in brute.leaks(sorted(rows.items()), items, 5, 0.8)}
    assert near.columns == clean.columns == p.language(spark, docs, DATA).columns == p.line_dedup(spark, docs, DATA).columns == docs.columns


# --- the SQL of this subpackage ---


def test_sql(spark):
    from tests.oracle import connect, same
    from voxweft.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert not same(queries.queries()[name](spark, DATA), connect(DATA), sql)


# --- tiles ---


def test_tiles_join_what_all_pairs_join():
    from voxweft.llm.tiles import jaccard_links

    rng = random.Random(2)
    for _ in range(40):
        rows = [{"key": 1, "i": 0, "j": 0, "id": k, "cluster": k if rng.random() < 0.8 else 0, "block": 0, "s": sorted(rng.sample(range(14), rng.randint(1, 12)))} for k in range(rng.randint(2, 40))]
        want, got = brute.Classes(), brute.Classes()
        for a in rows:
            for b in rows:
                if len(set(a["s"]) & set(b["s"])) >= 0.8 * len(set(a["s"]) | set(b["s"])):
                    want.join(a["cluster"], b["cluster"])
        for a, b in jaccard_links(80, 100, 5)(rows):
            got.join(rows[a]["cluster"], rows[b]["cluster"])
        assert all(want.find(r["cluster"]) == got.find(r["cluster"]) for r in rows)


def test_tiles_of_many_blocks(spark):
    from voxweft.llm.tiles import in_tiles, jaccard_links

    rng = random.Random(4)
    sets = {k: sorted(rng.sample(range(9), rng.randint(6, 8))) for k in range(120)}
    rows = spark.createDataFrame([(1, k, k) for k in sets], "key long, id long, cluster long")
    payload = spark.createDataFrame(list(sets.items()), "id long, s array<long>")
    want, got = brute.Classes(), brute.Classes()
    for a in sets:
        for b in sets:
            if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])):
                want.join(a, b)
    for r in in_tiles(rows, payload, jaccard_links(80, 100), Scratch(spark, "test"), size=16).collect():
        assert want.find(r["a"]) == want.find(r["b"])
        got.join(r["a"], r["b"])
    assert all(want.find(k) == got.find(k) for k in sets)


def test_tiles_of_a_hot_key_copy_little(spark):
    """A key of one large cluster and a few strangers is not copied for pairs inside the cluster, and no pair is lost."""
    from voxweft.llm.tiles import overlaps, tiles, with_partner

    rows = spark.range(2000).selectExpr("7L key", "id", "if(id % 500 = 3, id, -1L) cluster")
    payload = rows.select("id", (F.col("id") % 2).alias("odd"))
    made = tiles(rows, payload, Scratch(spark, "test"), size=64)
    assert made.count() < 2.2 * 2000 and made.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= 160
    near = with_partner(rows, payload, lambda t, x, y: (t.column("odd").to_numpy()[x] == t.column("odd").to_numpy()[y]), Scratch(spark, "test"), size=64)
    assert {r["id"] for r in near.collect()} == {i for i in range(2000) if i % 2 == 1}
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 60, n)) for n in (0, 1, 30, 30, 50)]
    off = np.cumsum([0, *map(len, sets)])
    x, y = np.triu_indices(5, 1)
    assert overlaps(np.concatenate(sets), off, x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)]


def test_saved_tables_leave_no_shuffle_files(spark, scratch):
    """What a write shuffled is gone when it ends, though its frame is still held; the frame can be written again."""
    jvm = spark._jvm
    listed = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    files = lambda: {n for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed()) if re.fullmatch(r"shuffle_.*\.data", n := f.getName())}
    before, frame = files(), spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count()
    for _ in range(2):
        assert sorted(r["count"] for r in scratch.save(frame).collect()) == [400] * 5
    for _ in range(20):
        if left := files() - before:
            time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_suffix_tree_sends_words_and_counts_only():
    rng = np.random.RandomState(3)
    h = np.unique(rng.randint(0, 1 << 62, 50_000)).astype(np.uint64)
    n = rng.randint(1, 9, len(h))
    hot = [(op2_suffix_tree.Lookup(h[k : k + 3]), np.array([2, 1, 3])) for k in range(4)]
    own = op2_suffix_tree.Common(h, n, hot, 3, 4, 0.4, int(n.sum()), len(h), np.zeros(1 << op2_suffix_tree.CLASS_BITS))
    sent = pickle.dumps(own)
    got = pickle.loads(sent)
    assert len(sent) < 16 * len(h) + 8 * len(own.mass) + 10_000
    for name in ("hashes", "rank", "root", "base", "mass"):
        assert np.array_equal(getattr(own, name), getattr(got, name))
    assert np.array_equal(own.codes(h), got.codes(h)) and sorted(own.codes(h)) == list(range(1, len(h) + 1))
    assert all(np.array_equal(a.keys, b.keys) and np.array_equal(a.bits, b.bits) and np.array_equal(x, y) for (a, x), (b, y) in zip(own.hot, got.hot, strict=True))


def test_lines_keep_no_keys(spark, docs, scratch):
    """The keys of lines, most of what is written of them, are gone when the classes are known, and the classes can still be read."""
    own = Path(scratch.root.removeprefix("file://"))
    there = set(own.parent.glob("lines-*"))
    found = op10_lines.near_lines(docs, scratch, min_chars=20)
    tables = [p for d in {own, *own.parent.glob("lines-*")} - there for p in d.rglob("*.parquet")]
    assert tables and not any({"own", "probes"} & set(pq.read_schema(p).names) for p in tables)
    assert found.filter("removed").count() > 0
