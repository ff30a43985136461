import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxweft.llm import op12_merkle
from voxweft.llm.op12_merkle import fold, leaf, manifest, proof_digest, tree_of
from voxweft.llm.scratch import Scratch


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(leaves):
    """The root, and each leaf's proof as (digests left, digests right) by level."""
    proofs, nodes, own = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        above, owners = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k, who in enumerate(own[a : a + 3]):
                for w in who:
                    proofs[w].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            owners.append([w for who in own[a : a + 3] for w in who])
        nodes, own = above, owners
    return nodes[0], proofs


def expected(rows):
    """rows of (source, key, hash): the root, and by (source, key, hash) the subroot and proof."""
    sources = sorted({s for s, _, _ in rows}, key=lambda s: b"" if s is None else b"=" + s.encode())
    found, roots = {}, []
    for s in sources:
        mine = sorted([(k, x) for src, k, x in rows if src == s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        root, proofs = climb([x for _, x in mine])
        roots.append(root)
        for r, p in zip(mine, proofs, strict=True):
            found.setdefault((s, *r), []).append((root, p))
    root, tops = climb(roots)
    place = {s: k for k, s in enumerate(sources)}
    return root, {key: [(sub, p + tops[place[key[0]]]) for sub, p in got] for key, got in found.items()}


def compare(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "source string, key long, x string").repartition(parts)
    out, root = manifest(df.select(tree_of(F.col("source")).alias("tree"), "key", leaf(F.col("x")).alias("hash"), "source"), Scratch(spark, "merkle"))
    got = out.withColumn("folded", fold(F.col("leaf"), F.col("steps"))).withColumn("digest", proof_digest(F.col("steps"))).collect()
    want_root, want = expected([(s, k, h(field(x))) for s, k, x in rows])
    assert root == want_root and len(got) == len(rows)
    have = {}
    for r in got:
        assert r["folded"] == root
        steps = [(s.split("_")[0], s.split("_")[1]) for s in r["steps"]]
        have.setdefault((r["source"], r["key"], r["leaf"]), []).append((r["subroot"], steps))
        assert r["digest"] == h(*[a + b for a, b in steps])
    flat = {key: sorted((sub, [("".join(a), "".join(b)) for a, b in p]) for sub, p in v) for key, v in want.items()}
    assert {k: sorted(v) for k, v in have.items()} == flat


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 200])
def test_one_source(spark, n):
    compare(spark, [("a", k, f"x{k}") for k in range(n)])


def test_many_sources(spark):
    """A hot source, a null one, lone leaves, repeated ids and rows, null ids and fields."""
    rng = random.Random(3)
    rows = [("hot", k, f"x{rng.random()}") for k in range(400)] + [(None, k, None) for k in range(7)] + [(f"s{k}", 1, "y") for k in range(30)]
    rows += [("", 2, ""), ("é", 5, "z"), ("-", 1, "q"), ("rep", 4, "a"), ("rep", 4, "a"), ("rep", 4, "b"), ("rep", None, "c"), ("rep", None, None)]
    rng.shuffle(rows)
    compare(spark, rows)


def test_several_scans(spark, monkeypatch):
    """Trees higher than a block are scanned in steps."""
    monkeypatch.setattr(op12_merkle, "DEPTH", 2)
    rows = [("a", k, f"x{k}") for k in range(250)] + [("b", k, "y") for k in range(10)] + [(f"c{k}", 1, "z") for k in range(12)] + [("d", k, "y") for k in range(9)] + [("e", k, "y") for k in range(81)]
    compare(spark, rows)


def test_changed_rows_are_found(spark):
    rows = [("a", k, f"x{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "source string, key long, x string")
    now = F.when(F.col("key") % 7 == 0, F.concat("x", F.lit("!"))).otherwise(F.col("x"))
    out, root = manifest(df.select(tree_of(F.col("source")).alias("tree"), "key", leaf(F.col("x")).alias("hash"), leaf(now).alias("now")), Scratch(spark, "merkle"))
    got = out.select("key", (fold(F.col("now"), F.col("steps")) == root).alias("ok")).collect()
    assert {r["key"] for r in got if not r["ok"]} == {k for k in range(50) if k % 7 == 0}


def test_order_and_partitions_change_nothing(spark, docs):
    def root(df):
        return manifest(df.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").alias("key"), leaf(F.col("text"), F.col("lang"), F.col("h")).alias("hash")), Scratch(spark, "merkle"))[1]

    assert root(docs) == root(docs.orderBy(F.desc("text")).repartition(11))


def test_empty(spark, none):
    out, root = manifest(none.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("hash")), Scratch(spark, "merkle"))
    assert root is None and out.count() == 0 and {"tree", "idx", "leaf", "subroot", "steps", "key"} <= set(out.columns)


def test_fields_are_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("1:a", "b"), ("é", "-"), ("é", None)], "a string, b string")
    got = [r[2] for r in df.select("a", "b", leaf(F.col("a"), F.col("b"))).collect()]
    assert len(set(got)) == 7 and got[5] == h("2:é1:-") and got[6] == h("2:é-")
