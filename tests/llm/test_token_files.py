import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxweft.llm import op13_token_files
from voxweft.llm.op13_token_files import default_tokenizer, ids_crc32, op13_token_files as query, parts_at_spaces, read_places, read_tokens, write_tokens
from voxweft.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_tokenizer())
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture
def path(spark):
    return Scratch(spark, "tokens").folder("files")


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in query(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    start = 0
    for d in sorted(docs):
        ids = library(docs[d])
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_ids_of_odd_texts(library):
    """Words encoded apart give the ids of the whole text."""
    with open(default_tokenizer(), encoding="utf-8") as f:
        c = op13_token_files.Coder(f.read())
    assert c.by_word
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "é", "́", " ", " ", "\n", "\t", "\r", " ", "　", "\x1c", "\x85", ".", ",", "...", "?.", "A", "H", "j", "̱", "̌", "<|ENDOFTEXT|>", "A.", "'s", "'", "1", "<|endoftext|>", "Σ", "İ", "\U0001f600", "你", "ᄀ", "ᅡ", "?!", "‍", "ſ"]
    for text in ["", " ", "\n", *["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(3000)]]:
        assert c.encode(pa.array([text], pa.string()))[0].tolist() == library(text)[:-1], repr(text)


def test_words_are_kept_in_bounds(library, monkeypatch):
    monkeypatch.setattr(op13_token_files, "KEPT", 50)
    with open(default_tokenizer(), encoding="utf-8") as f:
        c = op13_token_files.Coder(f.read())
    rng = random.Random(8)
    for _ in range(60):
        texts = [" ".join(f"w{rng.randrange(10 ** rng.randrange(1, 4))}" for _ in range(20)) for _ in range(3)] + ["", "x" * 99]
        ids, sizes = c.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [library(t)[:-1] for t in texts]
        assert len(c.kept) <= 50 and len(c.old) <= 50


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    assert not parts_at_spaces(content)
    text = " two  spaces\nand a line"
    assert op13_token_files.Coder(content).encode(pa.array([text]))[0].tolist() == Tokenizer.from_str(content).encode(text).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, docs, corpus, library, path, encoding):
    write_tokens(docs, path, default_tokenizer(), 2, encoding, row_group=1 << 16, page=1 << 12, keep=("source",))
    got = read_tokens(spark, path).orderBy("doc_id").collect()
    start = 0
    for r, (d, text) in zip(got, sorted(corpus), strict=True):
        assert (r["doc_id"], r["start"], r["ids"], r["source"]) == (d, start, library(text), f"s{d % 4}")
        start += len(r["ids"])
    last = -1
    for name in sorted(glob.glob(f"{local(path)}/tokens/*.parquet")):
        file = pq.ParquetFile(name)
        ids = file.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for g in range(file.metadata.num_row_groups):
            columns = {c.path_in_schema: c for c in (file.metadata.row_group(g).column(k) for k in range(file.metadata.num_columns))}
            assert all(c.has_offset_index for c in columns.values()) and all(columns[c].has_column_index for c in ("doc_id", "at", "n_tokens"))
            assert columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",)
            assert ("RLE_DICTIONARY" in columns["ids.list.element"].encodings) == (encoding == "dictionary")
            assert ("DELTA_BINARY_PACKED" in columns["ids.list.element"].encodings) == (encoding == "delta")


def test_row_groups_are_cut(spark, path):
    docs = spark.createDataFrame([(k, " ".join(str(random.Random(k * 1000 + j).randrange(10**6)) for j in range(400))) for k in range(200)], "doc_id long, text string").coalesce(1)
    groups = []
    for size in (1 << 15, 1 << 24):
        write_tokens(docs, path, default_tokenizer(), row_group=size, page=1 << 12)
        groups.append(max(pq.ParquetFile(n).metadata.num_row_groups for n in glob.glob(f"{local(path)}/tokens/*.parquet")))
    assert groups[0] > 1 == groups[1]


def test_selective_reads(spark, docs, path):
    write_tokens(docs, path, default_tokenizer(), 2)
    plan = read_tokens(spark, path).filter("doc_id = 9").select("doc_id", "start")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,9)" in plan and "ids" not in plan.split("ReadSchema: struct<")[1].split(">")[0]
    flat = [i for r in read_tokens(spark, path).orderBy("start").collect() for i in r["ids"]]
    for begin, end in ((0, 1), (0, 10), (57, 4000), (len(flat) - 3, len(flat) + 5), (len(flat), len(flat) + 1), (200, 200)):
        part = [i for r in read_places(spark, path, begin, end).orderBy("start").collect() for i in r["part"]]
        assert part == flat[begin:end]


def test_cases(spark, none, path, library):
    write_tokens(none, path, default_tokenizer(), 2)
    assert read_tokens(spark, path).count() == 0 and read_places(spark, path, 0, 5).count() == 0
    rows = [(None, "null id"), (3, "same"), (3, "same"), (3, "other text"), (1, None), (2, "")]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, default_tokenizer(), 2)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3] and [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
    assert got[0]["ids"] == library("null id") and got[1]["ids"] == got[2]["ids"] == [2] and sorted(r["ids"] for r in got[3:]) == sorted(map(library, ["same", "same", "other text"]))
    with pytest.raises(ValueError):
        write_tokens(none.withColumnRenamed("key", "ids"), path, default_tokenizer(), keep=("ids",))
    with pytest.raises(ValueError):
        write_tokens(none, path, default_tokenizer(), encoding="plain")


def test_checksum_of_sliced_lists(spark):
    rows = spark.createDataFrame([(k, list(range(k))) for k in range(50)], "k int, ids array<int>").filter("k % 3 = 1")
    for r in rows.select("k", ids_crc32(F.col("ids")).alias("c")).collect():
        assert r["c"] == zlib.crc32(np.arange(r["k"], dtype="<u4").tobytes())
