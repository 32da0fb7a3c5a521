"""Query pairs that arrive as files: each micro-batch is mined as one batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strikegraph.operators.graph import KnowledgeGraph


def mine_arriving(spark: SparkSession, kg: KnowledgeGraph, folder: str, out: str, checkpoint: str, run: Callable[[KnowledgeGraph, DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Lines ``target context`` of new files in ``folder``; results go to ``out`` by batch, so a repeated batch overwrites itself."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.readStream.text(folder).where("trim(value) rlike '^[0-9]+\\\\s+[0-9]+$'").select(p[0].cast("long").alias("target"), p[1].cast("long").alias("context"))

    def batch(pairs: DataFrame, epoch: int) -> None:
        queries = pairs.distinct().select(F.xxhash64("target", "context").alias("qid"), "target", "context")
        run(kg, queries).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
