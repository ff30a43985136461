"""Manifests as they arrive: faults, and fused hypotheses of each utterance.

Records are whole utterances, so checking and fusing need no state; repeated ids within a window are dropped by a
watermark on the time of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grid, voting
from ..sources import manifests


def arriving(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """(value, schema, utterance_id, fault, at) of a folder that grows."""
    t = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(path).filter(F.trim("value") != "")
    v = F.try_parse_json("value")
    return t.select("value", F.try_variant_get(v, "$.schema", "string").alias("schema"), F.try_variant_get(v, "$.utterance_id", "string").alias("utterance_id"), manifests.record_fault(F.col("value")).alias("fault"), F.current_timestamp().alias("at"))


def fuse_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, config: voting.Fusion = voting.Fusion(), delay: str = "10 minutes") -> StreamingQuery:  # noqa: B008
    """Writes (utterance_id, tokens, confidences) of every new n-best record to ``out`` until what is there is done."""
    good = arriving(spark, path).filter(F.col("fault").isNull() & (manifests.kind_of(F.col("schema")) == "nbest"))
    once = good.withWatermark("at", delay).dropDuplicatesWithinWatermark(["schema", "utterance_id"])

    def batch(df: DataFrame, _: int) -> None:
        records = df.withColumn("line_id", F.lit(0).cast("long"))
        hyps = manifests.hypothesis_rows(manifests.parsed(records, "nbest", allow_extra=True))
        cells = grid.cells(hyps, ["utterance_id"], "position", "tokens")
        voting.fused_text(voting.fuse(cells, config, ["utterance_id"]), ["utterance_id"]).write.mode("append").parquet(out)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
