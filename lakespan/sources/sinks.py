"""Sinks: audit records as CSV or JSON, coverage snapshots, redacted text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_csv(records: DataFrame, path: str, run: str) -> None:
    """CSV with every cell quoted; metadata stands in a column, as files of a distributed write have no common head."""
    records.withColumn("run", F.lit(run)).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def audit_json(records: DataFrame, path: str, run: str) -> None:
    """One object a line, keys sorted."""
    names = sorted([*records.columns, "run"])
    records.withColumn("run", F.lit(run)).select(F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").text(path)


def coverage_lines(report: DataFrame) -> DataFrame:
    """metric, value: the totals, then a line for each category."""
    rows = report.select(F.coalesce("category", F.lit("all")).alias("category"), F.expr("stack(3, 'candidates', candidates, 'documents', documents, 'below', below) AS (name, value)"))
    return rows.select(F.concat_ws(".", "category", "name").alias("metric"), "value")


def coverage_csv(report: DataFrame, path: str) -> None:
    coverage_lines(report).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def redacted_text(out: DataFrame, path: str) -> None:
    """The redacted texts as Parquet, to be read again by the verification layers."""
    out.write.mode("overwrite").parquet(path)


def _lines(parts: DataFrame, path: str, end: str) -> None:
    """Lines(place, value) written in the order of their places, part files too, with one line end."""
    parts.repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").option("lineSep", end).text(path)


def audit_document_csv(records: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Audit records as CSV: metadata in lines that begin with #, the names, the rows by id; lines end with CR LF.

    The part files, one after the other, are the document.
    """
    cell = lambda c: F.when(F.col(c).rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    head = [f"# {k}: {v}" for k, v in metadata.items()] + [",".join(records.columns)]
    first = records.sparkSession.createDataFrame([("0" + f"{i:06}", h) for i, h in enumerate(head)], "place string, value string")
    rows = records.select(F.concat(F.lit("1"), F.col(records.columns[0])).alias("place"), F.concat_ws(",", *(cell(c) for c in records.columns)).alias("value"))
    _lines(first.unionByName(rows), path, "\r\n")


def audit_document_json(records: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Audit records as one JSON object {metadata, records} with sorted keys; the part files, one after the other, are the document."""
    names = sorted(records.columns)
    one = F.to_json(F.struct(*names))
    rows = records.select(F.concat(F.lit("1"), F.col(records.columns[0])).alias("place"), one.alias("value"))
    least = rows.agg(F.min("place")).first()[0]
    rows = rows.withColumn("value", F.when(F.col("place") == F.lit(least), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))))
    edges = [("0", '{"metadata": ' + json.dumps(metadata, sort_keys=True) + ', "records": ['), ("2", "]}")]
    _lines(records.sparkSession.createDataFrame(edges, "place string, value string").unionByName(rows), path, "\n")


def coverage_json(report: DataFrame, path: str) -> None:
    """The same lines as coverage_lines, as JSON objects."""
    coverage_lines(report).select(F.to_json(F.struct("metric", "value")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
