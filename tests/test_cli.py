import json

import pytest

from voxweft.operators import neural
from voxweft.plans import cli
from voxweft.sources import fixtures
from voxweft.streaming.manifests import fuse_arriving


@pytest.fixture(scope="module")
def manifest(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "manifest")
    fixtures.manifest_rows(spark, fixtures.Fixture(n=12, seed=3, sub=0.2)).coalesce(1).write.text(path)
    return path


def out(capsys, *args):
    code = cli.main(list(args))
    return code, capsys.readouterr()


def test_commands(spark, manifest, capsys, tmp_path):
    both = ("--nbest", manifest, "--reference", manifest)
    assert out(capsys, "validate", manifest)[1].out == "25 records\n"
    assert json.loads(out(capsys, "score", *both)[1].out)["n"] == 12
    for by in cli.SLICES:
        assert "| Slice |" in out(capsys, "analyze", *both, "--by", by)[1].out
    assert '"kind":"slice"' in out(capsys, "report", *both, "--format", "json")[1].out
    assert len(out(capsys, "align", "--nbest", manifest)[1].out.splitlines()) == 12
    assert len(out(capsys, "fuse", "--nbest", manifest)[1].out.splitlines()) == 12
    corpus = tmp_path / "c.txt"
    corpus.write_text("the cat sat\nhello world\n")
    ranked = [json.loads(x) for x in out(capsys, "rescore", "--nbest", manifest, "--corpus", str(corpus), "--top", "1")[1].out.splitlines()]
    assert len(ranked) == 12 and {r["new_rank"] for r in ranked} == {1}
    assert json.loads(out(capsys, "normalize", "--ref", "Hello, World!", "--hyp", "HELLO")[1].out) == {"ref": "hello world", "hyp": "hello"}
    scaled = [json.loads(x)["scaled"] for x in out(capsys, "calibrate", "1,2")[1].out.splitlines()]
    assert sum(scaled) == pytest.approx(1) and scaled[1] > scaled[0]
    assert "| Slice |" in out(capsys, "demo", "--out", str(tmp_path), "-n", "5")[1].out


def test_user_errors(spark, manifest, capsys):
    for args in (("validate", "/none"), ("validate", manifest, "--schema", "x"), ("normalize", "--ref", " ", "--hyp", "a"), ("calibrate", "a,b"), ("rescore", "--nbest", manifest)):
        assert out(capsys, *args)[0] == 2


def test_fixture_rates(spark):
    with pytest.raises(ValueError):
        fixtures.Fixture(sub=0.9, ins=0.9)
    f = fixtures.Fixture(group_bias={"A": 2.0}, rank_decay=0.5)
    assert f.rates("A", 0.0, 2)[0] == pytest.approx(0.05 * 2 * 2) and f.rates("B", 0.0, 0)[0] == 0.05
    a = fixtures.utterances(spark, fixtures.Fixture(n=30)).orderBy("utterance_id").collect()
    b = fixtures.utterances(spark, fixtures.Fixture(n=30)).repartition(3).orderBy("utterance_id").collect()
    assert a == b and len(a) == 30
    assert fixtures.calibration_set(spark, 500).filter("label = 1").count() > 100


def test_network(spark):
    df = fixtures.confidence_set(spark, 400)
    net = neural.fit(df)
    right = df.withColumn("p", net.predict(df["x"])).filter("(p >= 0.5) = (label = 1)").count()
    assert right > 380


def test_stream(spark, manifest, tmp_path):
    q = fuse_arriving(spark, manifest, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
