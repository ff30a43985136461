"""A training-data pipeline over ``documents``: language, repeated lines, near duplicates, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; ``run`` writes each stage's
rows to the shared folder and reads them again. The first four return the columns of ``documents``; the last returns
doc_id, source, n_tokens, ids (binary, four bytes each) and decoded_sha256, a digest of the text that the ids decode to.

Every stage reads whole texts of any length, keeps further columns whatever their names, gives an empty table for an empty
one, and settles ties by the least doc_id. What it does with nulls, empty texts and repeated rows is told at each.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweft.llm.op1_langid import SAMPLE_DOCS, label_words, sample, train
from voxweft.llm.op7_decontaminate import find_items
from voxweft.llm.op8_jaccard import ngram_join
from voxweft.llm.op9_bpe import bpe_encode, default_tokenizer
from voxweft.llm.op10_lines import dedup_lines
from voxweft.llm.scratch import Scratch, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which words of a known language are found and one language has a fair share of them. Null and empty texts, and
    those without a letter, have no language and go. Rows without a label are judged, but not learned from; without any
    label nothing has a language. Repeated rows are judged alike."""
    model = train(*sample(docs, "doc_id", "text", "lang", SAMPLE_DOCS))
    return label_words(docs, model, min_score=0.35)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; one that had lines and has none left goes. Null and empty texts stay.
    Lines of a repeated row repeat the first row's, and rows of one doc_id lose the same lines."""
    return dedup_lines(docs, Scratch(spark, "pipeline-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a Jaccard index of 0.8), that of the least id. Null and empty
    texts are copies of nothing and stay. Rows of one doc_id stay or go together."""
    scratch = Scratch(spark, "pipeline-near")
    groups = ngram_join(docs.select("doc_id", "text"), scratch, k=5, num=80, den=100)
    gone = scratch.save(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay, repeated rows are judged alike."""
    found = find_items(docs, read_table(spark, sf_dir, "benchmark"))
    gone = Scratch(spark, "pipeline-leaks").save(found.select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of what they decode to; null is an empty text, without ids. Repeated rows each get
    their result."""
    out = bpe_encode(docs, default_tokenizer(), keep=("source",))
    return out.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: Language labels, edit-distance classes and token ids aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
