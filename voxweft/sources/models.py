"""Readers and writers of language models, corpora, scores, and confusion networks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ngram import Model, arpa_tables

END = "\\end\\"


def fixed(value: Column, digits: int = 4) -> Column:
    """A number with so many decimals; exact ties go to the even digit, as printf does, which Spark's formats don't."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return run(value)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(tokens): a sentence for each line that isn't blank."""
    t = spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("tokens"))
    return t.filter(F.size("tokens") > 0)


def read_scores(spark: SparkSession, source: str, inline: bool = False) -> DataFrame:
    """(pos, score) of a comma-separated string, or of lines of a file; what is no number is null."""
    if inline:
        t = spark.createDataFrame([(source,)], "v string").select(F.posexplode(F.split("v", ",")).alias("pos", "v"))
    else:
        t = spark.read.text(source).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("v"))
    return t.filter(F.trim("v") != "").select("pos", F.expr("try_cast(trim(v) AS double)").alias("score"))


def arpa_lines(model: Model) -> DataFrame:
    """(section, ngram, line) of a model's backoff table; sections are orders."""
    t = arpa_tables(model) if model.arpa is None else model.arpa
    bow = F.when((F.col("n") < model.order) & F.col("bow").isNotNull(), F.concat(F.lit("\t"), fixed(F.col("bow")))).otherwise("")
    return t.select(F.col("n").alias("section"), "ngram", F.concat(fixed(F.col("logp")), F.lit("\t"), F.col("ngram"), bow).alias("line"))


def write_arpa(model: Model, path: str) -> None:
    """One text file in the ARPA format, n-grams in order. The file is one part by its format."""
    lines = arpa_lines(model)
    counts = lines.groupBy("section").agg(F.count("*").alias("c"))
    head = counts.select(F.lit(0).alias("a"), F.col("section").alias("b"), F.lit("").alias("c"), F.concat(F.lit("ngram "), F.col("section").cast("string"), F.lit("="), F.col("c").cast("string")).alias("line"))
    spark = lines.sparkSession
    marks = [(0, 0, "", "\\data\\"), *[(n, 0, "", f"\n\\{n}-grams:") for n in range(1, model.order + 1)], (model.order + 1, 0, "", "\n" + END)]
    body = lines.select(F.col("section").alias("a"), F.lit(1).alias("b"), F.col("ngram").alias("c"), "line")
    every = head.unionByName(spark.createDataFrame(marks, "a int, b int, c string, line string")).unionByName(body)
    every.repartition(1).sortWithinPartitions("a", "b", "c").select("line").write.mode("overwrite").text(path)


def read_arpa(spark: SparkSession, path: str) -> Model:
    """A backoff model; lines find their section by their number of words, so the file needs no order."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 2)
    t = t.select(F.expr("try_cast(p[0] AS double)").alias("logp"), F.get("p", F.lit(1)).alias("ngram"), F.expr("try_cast(get(p, 2) AS double)").alias("bow")).filter("logp is not null")
    t = t.withColumn("n", F.size(F.split("ngram", " "))).select("n", "ngram", "logp", "bow")
    order = t.agg(F.max("n")).first()[0] or 1
    counts = t.select("n", "ngram", F.lit(0).cast("long").alias("c"), F.regexp_replace("ngram", r" ?[^ ]*$", "").alias("ctx"), F.regexp_extract("ngram", r"([^ ]*)$", 1).alias("word"))
    return Model(order, counts, t)


def network_json(network: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """(keys, value): a confusion network as JSON of slots with pivots and arcs."""
    arcs = F.array_sort(F.collect_list(F.struct("place", "posterior", "token")))
    slots = network.groupBy(*keys, "col").agg(F.transform(arcs, lambda a: F.struct(a["posterior"].alias("posterior"), a["token"].alias("token"))).alias("arcs"), F.max(F.when(F.col("pivot"), F.col("token"))).alias("pivot"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("col", "arcs", "pivot"))), lambda s: F.struct(s["arcs"].alias("arcs"), s["pivot"].alias("pivot")))
    return slots.groupBy(*keys).agg(F.to_json(F.struct(F.lit("confusion").alias("schema"), F.lit(1).alias("schema_version"), listed.alias("slots"))).alias("value"))


def network_from_json(rows: DataFrame, keys: Sequence[str] = ("utt_id",)) -> DataFrame:
    """The rows of a network again."""
    t = rows.select(*keys, F.from_json("value", "slots array<struct<arcs:array<struct<posterior:double,token:string>>,pivot:string>>").alias("v"))
    t = t.select(*keys, F.posexplode("v.slots").alias("col", "s"))
    return t.select(*keys, "col", "s.pivot", F.posexplode("s.arcs").alias("place", "a")).select(*keys, "col", "a.token", "a.posterior", (F.col("place") + 1).alias("place"), (F.col("a.token") == F.col("pivot")).alias("pivot"))
