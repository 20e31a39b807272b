"""Telemetry tables: explicit schemas, CSV and JSON-lines readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "intervals": "round BIGINT, avg DOUBLE, frac DOUBLE, time BIGINT, algo STRING",
    "acceptance": "round BIGINT, rate DOUBLE, initial STRING, degree DOUBLE",
    "insertions": "insertions BIGINT, acc STRING, algo STRING",
    "cycledist": "round DOUBLE, weight DOUBLE, initial STRING",
    "apsp": "round BIGINT, mean DOUBLE, max DOUBLE",
    "cyclecover": "nodes BIGINT, min_weight TINYINT, max_weight TINYINT, steps BIGINT, runs BIGINT, num_valid_encodings BIGINT, count_of_frequencies ARRAY<STRUCT<freq: BIGINT, cnt: BIGINT>>, completion_run BIGINT, runtime_ms BIGINT",
}


def read(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """Replicas' files read as one table; cyclecover is JSON lines, the others are CSV with a header."""
    reader = spark.read.schema(SCHEMAS[kind])
    return reader.json(list(paths)) if kind == "cyclecover" else reader.option("header", True).csv(list(paths))


def write(rows: DataFrame, kind: str, path: str) -> None:
    names = [part.split(" ")[0] for part in SCHEMAS[kind].replace("ARRAY<STRUCT<freq: BIGINT, cnt: BIGINT>>", "ARRAY").split(", ")]
    out = rows.select(*names).write.mode("overwrite")
    out.json(path) if kind == "cyclecover" else out.option("header", True).csv(path)
