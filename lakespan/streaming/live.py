"""Structured Streaming forms: spans of arriving documents, windowed counts, sessions, stateful priors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import detected
from ..sources import scratch
from ..sources.tables import SCHEMAS


def arriving(spark: SparkSession, path: str, name: str, files: int = 10) -> DataFrame:
    """A stream of a known table's Parquet files."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files).parquet(path)


def spans(documents: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Spans of arriving documents: the batch expressions, row by row, without state."""
    return detected(documents, categories)


def event_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; later events than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of sessions parted by a gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    alpha, beta, side, streak = state.get if state.exists else (1.0, 1.0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
    for accepted in rows["accepted"].tolist():
        way = 1 if accepted else -1
        if way == side and streak >= 5:
            continue
        alpha, beta = alpha + (way > 0), beta + (way < 0)
        if alpha + beta > 50:
            scale = 50 / (alpha + beta)
            alpha, beta = max(1.0, alpha * scale), max(1.0, beta * scale)
        side, streak = way, min(255, streak + 1) if way == side else 1
    state.update((float(alpha), float(beta), int(side), int(streak)))
    yield pd.DataFrame({"category": [key[0]], "alpha": [float(alpha)], "beta": [float(beta)]})


def priors(decisions: DataFrame) -> DataFrame:
    """category, alpha, beta after each micro-batch of decisions(category, ts, id, accepted), folded in their order."""
    return decisions.groupBy("category").applyInPandasWithState(_fold, "category string, alpha double, beta double", "alpha double, beta double, side int, streak int", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's result after all that is there now, through an in-memory table: for aggregates of a bounded number of rows."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def landed(stream: DataFrame, name: str) -> DataFrame:
    """The rows that are there now, appended to a Parquet table in the shared folder and read from it; none passes the driver."""
    spark = stream.sparkSession
    path = f"{scratch.folder(spark)}/lakespan-stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
