"""Token ids in Parquet files whose encodings, row groups and pages are chosen for selective reads.

A set of token files is a folder. ``tokens`` has a row for each text, in ascending order of ids: ``run`` (the file's place in that
order), ``doc_id``, ``at`` (ids of the run before it), ``n_tokens`` and ``ids``, a list column of 32-bit integers. ``runs`` has a row for
each run: how many ids stand before it, in it, and how many texts it has. A text's place among all ids is the sum of two
columns, so files are written once, in one pass, by tasks that don't know each other.

Ids are dictionary-encoded: a dictionary of 49 thousand ids takes 200 KB in each column chunk and 16 bits for each id at most. The
columns that ascend or are small integers are delta-encoded. Row groups are cut by bytes. Pages are small, and the page
indexes that Parquet keeps at a file's end give each page's least and greatest values, so that one text, or a range of places, is read
from the pages that have it, and metadata is read without the ids.

Rows are dealt to runs by ranges of (id, hash of the text) and sorted there before they are encoded: the order is made of
short keys, and range partitions, which sample their input, don't encode it twice. Files are written by Spark's
writer: what a lost task wrote doesn't count.

Defined cases: a null text is an empty one and has the end id alone. Null ids come first. Rows of one id are all kept, in the
order of their texts' hashes; equal rows in any order, which is the same. An empty table gives files without rows. Texts are encoded
whole. Other columns of the input are kept only if asked for, and may not have the names of the files' own.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .bytetext import release
from .scratch import Scratch, read_table

OWN = ("run", "at", "n_tokens", "ids", "start")
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 1000
ENCODINGS = ("dictionary", "delta")
#: Words whose ids a worker keeps, for each of two generations (some 60 MB), and the longest of them.
KEPT, KEPT_CHARS = 250_000, 40
#: A Latin letter, and a mark after it that belongs to no contraction and no added token.
LETTER_AND_MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])"

_loaded: dict = {}


class Coder:
    """Ids of texts by the tokenizers library. Where a vocabulary's pattern takes no white space, no token reaches over
    a space, so texts are encoded word by word, and words that a worker meets again once, as far as a bounded store holds them:
    two generations of ``KEPT`` words; when the younger is full it becomes the older, and words met again come back from there."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = made = Tokenizer.from_str(content)
        made.no_truncation()
        made.no_padding()
        self.by_word = parts_at_spaces(content)
        self.marks = self.by_word and all(len(made.pre_tokenizer.pre_tokenize_str(f"é{m}")) == 2 for m in ".,;:!?")
        self.lowers = '"Lowercase"' in json.dumps(json.loads(content).get("normalizer"))
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in order, and their number by text."""
        if self.by_word:
            split = pc.split_pattern(pc.replace_substring(self.likened(texts), "\n", " "), " ")
            coded = split.flatten().dictionary_encode()
            of, ends = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
            words = coded.dictionary.to_pylist()
        else:
            words, of, ends = texts.to_pylist(), np.arange(len(texts)), np.arange(len(texts) + 1)
        got = self.known(words) if self.by_word else self.whole(words)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, begins = np.frombuffer(b"".join(got), "<i4"), np.cumsum(sizes) - sizes
        size = sizes[of]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(before[-1], dtype=np.int32)
        at += np.repeat((begins[of] - before[:-1]).astype(np.int32), size)
        ids = flat.take(at)
        return ids, np.diff(before[ends])

    def likened(self, texts: pa.Array) -> pa.Array:
        """The texts with fewer different words and the same ids: a space before a mark that ends a run of letters, where a
        pre-token ends anyway, and small ASCII letters for capitals where no mark may compose with one and no added token begins."""
        apart = pc.replace_substring_regex(texts, LETTER_AND_MARK, r"\1 \2") if self.marks else texts
        return pc.if_else(pc.match_substring_regex(apart, "[\u0300-\u036f]|<\\|"), apart, pc.ascii_lower(apart)) if self.lowers else apart

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        got = list(map(self.kept.get, words))
        missing = [k for k, g in enumerate(got) if g is None]
        again = [self.old.get(words[k]) for k in missing]
        new = [k for k, g in zip(missing, again, strict=True) if g is None]
        for k, g in chain(zip(missing, again, strict=True), zip(new, self.whole([words[k] for k in new]), strict=True)):
            if g is not None:
                got[k] = g
                if len(self.kept) >= KEPT:
                    self.old, self.kept = self.kept, {}
                if len(words[k]) <= KEPT_CHARS:
                    self.kept[words[k]] = g
        return got


def parts_at_spaces(content: str) -> bool:
    """Whether a tokenizer file drops white space: its words end with a suffix, its pre-tokens are what a pattern without
    white space matches, and no added token holds any."""
    spec = json.loads(content)
    steps = spec.get("pre_tokenizer") or {}
    split = (steps.get("pretokenizers") or [steps])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and " " not in split["pattern"].get("Regex", " ")
    return bool(drops and spec["model"].get("end_of_word_suffix")) and not any(c.isspace() or c in ".,;:!?" or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []) for c in t["content"])


def coder(content: str) -> Coder:
    """Made once for each worker process."""
    if content not in _loaded:
        _loaded.clear()
        _loaded[content] = Coder(content)
    return _loaded[content]


def write_tokens(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> None:
    """Encodes every text and writes the folder ``path``; each text's ids end with ``end_id`` if one is given.

    The tokenizer file is read by the driver (about 2 MB) and goes to the workers with the function.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"{encoding} is none of {ENCODINGS}")
    if clash := {id_col, *keep} & {*OWN} or {*keep} & {id_col}:
        raise ValueError(f"columns {sorted(clash)} have names of the files' own")
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    prepare(df.sparkSession)
    rows = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"), *[df[c] for c in keep])
    rows = rows.withColumn("_order", F.xxhash64("_text")).repartitionByRange("_id", "_order").sortWithinPartitions("_id", "_order")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, place, at = coder(content), TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                ids, sizes = c.encode(batch.column(1))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends = at + np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                columns = {"run": pa.array(np.full(len(sizes), place, np.int32)), "_id": batch.column(0), "at": pa.array(ends - sizes), "n_tokens": pa.array(sizes)}
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.ListArray.from_arrays(offsets, pa.array(ids))} | {name: batch.column(name) for name in keep})
                at = int(ends[-1]) if len(ends) else at
        finally:
            release()

    out = rows.mapInArrow(run, f"run int, _id {kinds['_id']}, at long, n_tokens long, ids array<int>" + "".join(f", `{c}` {kinds[c]}" for c in keep))
    written(out.withColumnRenamed("_id", id_col), f"{path}/tokens", encoding, row_group, page)
    runs = df.sparkSession.read.schema("run int, n_tokens long").parquet(f"{path}/tokens").groupBy("run").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"))
    # one row for each run, so the order of all runs is a small table's
    runs.selectExpr("run", "sum(n_tokens) OVER (ORDER BY run) - n_tokens AS before", "n_tokens", "n_texts").write.mode("overwrite").parquet(f"{path}/runs")


def written(out: DataFrame, path: str, encoding: str, row_group: int, page: int) -> None:
    """The second version of the format delta-encodes integers that have no dictionary."""
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "compression": "zstd",
    }
    out.write.mode("overwrite").options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a folder's texts, with ``start``, the ids of all texts before. Columns that aren't selected aren't read, and
    filters by id go to the files' indexes."""
    tokens, runs = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/runs").select("run", "before")
    out = tokens.join(runs, "run")
    return out.select((F.col("before") + F.col("at")).alias("start"), *[c for c in tokens.columns if c not in ("run", "at")])


def read_places(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Rows of the texts that have ids at the places from ``begin`` to before ``end``, with ``part``: their ids at these places. Only
    runs and pages that have such places are read."""
    runs = spark.read.parquet(f"{path}/runs")
    hit = runs.filter((F.col("before") < end) & (F.col("before") + F.col("n_tokens") > begin)).agg(F.min("run").alias("a"), F.max("run").alias("b"), F.min("before").alias("c")).first()
    rows = read_tokens(spark, path).filter("n_tokens > 0")
    if hit["a"] is None:
        return rows.filter("false").withColumn("part", F.col("ids"))
    tokens = spark.read.parquet(f"{path}/tokens").filter(F.col("run").between(hit["a"], hit["b"]))
    if hit["a"] == hit["b"]:
        tokens = tokens.filter((F.col("at") < end - hit["c"]) & (F.col("at") + F.col("n_tokens") > begin - hit["c"]))
    rows = tokens.join(runs.select("run", "before"), "run").withColumn("start", F.col("before") + F.col("at"))
    rows = rows.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    first = F.greatest(F.lit(begin) - F.col("start"), F.lit(0))
    part = F.slice("ids", (first + 1).cast("int"), (F.least(F.lit(end) - F.col("start"), F.col("n_tokens")) - first).cast("int"))
    return rows.select("start", *[c for c in tokens.columns if c not in ("run", "at")], part.alias("part"))


def ids_crc32(ids: Column) -> Column:
    """The checksum of ids as little-endian integers of 32 bits."""

    @F.arrow_udf("long")
    def checksum(values: pa.Array) -> pa.Array:
        flat = values.values.to_numpy(zero_copy_only=False).astype("<u4")
        cuts = values.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64())

    return checksum(ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document's place and ids, as read back from token files in the shared folder."""
    path = Scratch(spark, "op13").folder("files")
    write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path or default_tokenizer(), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids")).alias("ids_crc32"))
