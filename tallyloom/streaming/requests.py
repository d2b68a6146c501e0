"""Answers a growing folder of request files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BatchSession


def request_stream(session: BatchSession, folder: str, out: str, checkpoint: str):
    """Each micro-batch of request lines (``F`` lines are skipped) is answered once.

    Writes (request, answer) rows as Parquet under ``out``, one folder a
    micro-batch, overwritten if the micro-batch is repeated after a failure.
    """

    def answer(batch: DataFrame, number: int) -> None:
        lines = [r["value"].strip() for r in batch.where("trim(value) not in ('', 'F')").collect()]
        rows = list(zip(lines, session.batch(lines))) if lines else []
        session.spark.createDataFrame(rows, "request string, answer string").write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines = session.spark.readStream.format("text").load(folder).select(F.col("value"))
    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
