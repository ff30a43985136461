import json
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from voxweft.sources import manifests, models, paths, provenance, reports

RECORDS = [
    {"schema": "x.nbest", "utterance_id": "u1", "system": "s", "language": "en", "hypotheses": [{"rank": 1, "text": "a b", "tokens": ["a", "b"], "score": -1.5}]},
    {"schema": "x.reference", "utterance_id": "u1", "text": "a b"},
]


def write(tmp_path, records):
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    return str(path)


def test_reads_and_migrates(spark, tmp_path):
    t = manifests.read_manifest(spark, write(tmp_path, RECORDS))
    row = manifests.parsed(t, "nbest").first()
    assert row["schema_version"] == 2 and row["fault"] is None
    h = row["hypotheses"][0]
    assert (h["acoustic_log10"], h["lm_log10"], h["tokens"]) == (-1.5, 0.0, ["a", "b"])
    assert manifests.hypothesis_rows(manifests.parsed(t, "nbest")).first()["acoustic"] == -1.5
    assert manifests.missing_kinds(t, ["nbest", "system"]) == ["system"]


@pytest.mark.parametrize(("record", "fault"), [("{", "not JSON"), ("[]", "not an object"), ({"schema": "x.reference"}, "utterance_id"), ({"schema": "x.nbest", "utterance_id": "u", "system": "s", "language": "en", "lm_log10": "x"}, "numeric"), ({"schema": "x.reference", "utterance_id": "u", "schema_version": True}, "integer"), ({"schema": "x.reference", "utterance_id": "u", "schema_version": 0}, "unknown schema_version")])
def test_faults(spark, tmp_path, record, fault):
    t = manifests.read_manifest(spark, write(tmp_path, [record]), strict=False)
    assert fault in t.first()["fault"]
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, write(tmp_path, [record]))


def test_repeated_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="u1"):
        manifests.read_manifest(spark, write(tmp_path, [*RECORDS, RECORDS[1]]))


def test_unknown_fields(spark, tmp_path):
    t = manifests.read_manifest(spark, write(tmp_path, [RECORDS[1] | {"color": 1}]))
    assert "color" in manifests.parsed(t, "reference").first()["fault"]


def test_writes(spark, tmp_path):
    df = spark.createDataFrame([("u1", "a")], "utterance_id string, text string")
    manifests.write_manifest(df, str(tmp_path / "out"), "x.reference", single=True)
    assert manifests.read_manifest(spark, str(tmp_path / "out")).count() == 1


def test_scores_and_corpus(spark, tmp_path):
    assert [r["score"] for r in models.read_scores(spark, "0.5, x,1", inline=True).orderBy("pos").collect()] == [0.5, None, 1.0]
    (tmp_path / "c").write_text("a b\n\n  c\n")
    assert sorted(r["tokens"] for r in models.read_corpus(spark, str(tmp_path / "c")).collect()) == [["a", "b"], ["c"]]


def test_report(spark):
    df = spark.createDataFrame([("a|<b>", 2, 0.03125, 0.5)], "key string, count long, cer double, wer double")
    assert "| a\\|&lt;b&gt; | 2 | 0.0312 | 0.5000 |" in reports.markdown(df, run={"seed": 1})
    assert json.loads(reports.json_lines(df).first()["value"])["count"] == 2


def test_report_with_comparisons_is_written_in_order(spark, tmp_path):
    slices = spark.createDataFrame([(f"s{i:04d}", i, i / 7, 0.5) for i in range(500)], "key string, count long, cer double, wer double").repartition(7)
    both = spark.createDataFrame([("b|", "c", 9, 0.1, 0.05, 0.15, -0.25, -0.5, 0.0), ("a", "b", 8, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "system_a string, system_b string, n_pairs int, delta_cer double, cer_lo double, cer_hi double, delta_wer double, wer_lo double, wer_hi double")
    reports.write_markdown(str(tmp_path / "r"), slices, both, {"seed": 3, "n": None})
    lines = [x for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    assert lines[:7] == ["# Error Analysis Report", "", "## Run", "n: None", "seed: 3", "", "## Slices"]
    assert lines[9:509] == [f"| s{i:04d} | {i} | {i / 7:.4f} | 0.5000 |" for i in range(500)]
    assert lines[-2:] == ["| a vs b | 8 | 0.0000 | [0.0000, 0.0000] | 1.0000 | [1.0000, 1.0000] |", "| b\\| vs c | 9 | 0.1000 | [0.0500, 0.1500] | -0.2500 | [-0.5000, 0.0000] |"]
    assert "\n".join(lines) == reports.markdown(slices, both, {"seed": 3, "n": None})
    assert reports.markdown(slices.limit(0)).split("\n")[-1] == reports.COMPARISONS[-1]
    record = json.loads(reports.json_lines(both.filter("n_pairs = 9"), "comparison").first()["value"])
    assert record["cer_ci"] == [0.05, 0.15] and record["wer_ci"] == [-0.5, 0.0] and "cer_lo" not in record and record["kind"] == "comparison"


def test_provenance(spark, tmp_path):
    from voxweft.functions.text import Normal

    assert provenance.stable_hash({"b": 1, "a": [1, 2]}) == provenance.stable_hash({"a": (1, 2), "b": 1})
    provenance.save_config(Normal(case="lower"), str(tmp_path / "c.json"))
    assert provenance.load_config(Normal, str(tmp_path / "c.json")) == Normal(case="lower")
    with pytest.raises(ValueError):
        provenance.merged(Normal(), {"none": 1})
    run = provenance.capture(spark, Normal(), seed=3)
    df = provenance.with_run(spark.range(2), run)
    assert provenance.run_matches(df, run) and not provenance.run_matches(df, provenance.capture(spark, Normal(), seed=4))
    (tmp_path / "f").write_bytes(b"abc")
    assert provenance.fingerprints(spark, [str(tmp_path / "f")]).first()["sha256"].startswith("ba7816bf")


def test_paths(spark):
    df = spark.createDataFrame([("a/b",), ("a/../b",), ("",)], "p string")
    assert [r[0] is None for r in df.select(manifests.audio_path_fault(F.col("p"))).collect()] == [True, False, True]


def test_joined_paths_stay_under_their_base(spark):
    rng = random.Random(8)
    names = ["a", "b", "..", ".", "", "...", "ä", "d.wav"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.randint(0, 6)))
    rows = [(i, rng.choice(["/a", "/a/b", "/", "/a/../b/", "/a//b/."]), path(), path()) for i in range(600)]
    rows += [(600, None, "a", "b"), (601, "/a", None, "b"), (602, "a", "b", "c"), (603, "/a", "x/" * 5000 + "../" * 5000, "y"), (604, "/a", "../ab", "c")]
    df = spark.createDataFrame(rows, "id int, base string, p string, q string")
    df = df.withColumn("joined", paths.safe_join(F.col("base"), F.col("p"), F.col("q")))
    df = df.withColumn("inner", paths.relative_within(F.col("base"), F.col("joined")))
    for r in df.collect():
        if None in (r["base"], r["p"]) or not r["base"].startswith("/"):
            assert r["joined"] is None and r["inner"] is None
            continue
        base, full = r["base"], r["base"]
        for part in (r["p"], r["q"]):
            full = part if part.startswith("/") else f"{full}/{part}"
        base, full = (posixpath.normpath("/" + x.lstrip("/")) for x in (base, full))
        under = full == base or full.startswith(base.rstrip("/") + "/")
        assert r["joined"] == (full if under else None), r
        assert r["inner"] == (posixpath.relpath(full, base) if under else None), r


def test_audio_joins(spark):
    rows = [("a.wav", "/m/a.wav"), ("", "/m"), ("a\\\\b.wav", "/m/a/b.wav"), ("/etc/x", None), ("C:/x", None), ("../x", None), ("a/../x", None), ("a b", None), ("x\0y", None), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string")
    got = df.withColumns({"at": paths.safe_audio_join(F.lit("/m"), F.col("p")), "fault": paths.audio_join_fault(F.lit("/m"), F.col("p"))}).collect()
    assert [r["at"] for r in got] == [r["want"] for r in got]
    assert all((r["fault"] is None) == (r["at"] is not None or r["p"] is None) for r in got)


def test_confusables():
    from voxweft.sources.fixtures import WORDS, Fixture

    pairs = tuple((w, w.upper()) for w in WORDS)
    for i in range(30):
        u = Fixture(sub=1.0, ins=0.0, dele=0.0, confusables=pairs).utterance(i)
        assert all(h["tokens"] == [w.upper() for w in u["ref"]] for h in u["hypotheses"])
    extra = {t for i in range(30) for h in Fixture(sub=0.0, ins=1.0, dele=0.0, confusables=(("a", "b"),)).utterance(i)["hypotheses"] for t in h["tokens"]}
    assert extra == {"a", "b"}
    some = [w for i in range(200) for w in Fixture(sub=0.3, ins=0.0, dele=0.0, n_best=1, confusables=(("a", "b"), ("c", "d"))).utterance(i)["hypotheses"][0]["tokens"]]
    assert set(some) == {*"abcd"} and 0.25 < sum(w in "bd" for w in some) / len(some) < 0.35
