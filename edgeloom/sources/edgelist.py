"""Edge-list text files: comments, a header `p n m`, then rows `u,v` (or `u,v,w`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.graph import undirected as both_ways


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("%"))


def header(spark: SparkSession, path: str) -> tuple[int, int, str]:
    """n, m and the text of the first line that isn't a comment."""
    first = _lines(spark, path).first()
    if first is None:
        raise ValueError(f"{path}: there is no header")
    fields = first["value"].split(" ")
    if len(fields) < 3:
        raise ValueError(f"{path}: the header has {len(fields)} fields, not 3")
    try:
        n, m = int(fields[1]), int(fields[2])
    except ValueError:
        raise ValueError(f"{path}: the header's counts {fields[1:3]} aren't numbers") from None
    if n < 0 or m < 0:
        raise ValueError(f"{path}: negative counts in the header")
    return n, m, first["value"]


def parsed(lines: DataFrame, n: int, weighted: bool = False) -> DataFrame:
    """src, dst, w and the fault of each row value: null, 'fields', 'number' or 'range'."""
    parts = F.split("value", ",")
    number = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("bigint"))
    rows = lines.select(F.size(parts).alias("fields"), number(0).alias("src"), number(1).alias("dst"), F.get(parts, F.lit(2)).try_cast("double").alias("w"))
    fault = F.when(F.col("fields") != (3 if weighted else 2), "fields").when(F.col("src").isNull() | F.col("dst").isNull() | (F.lit(weighted) & F.col("w").isNull()), "number")
    return rows.withColumn("fault", fault.when((F.col("src") >= n) | (F.col("dst") >= n), "range"))


def violations(rows: DataFrame, m: int) -> DataFrame:
    """One row with the number of each fault of parsed rows, and of rows beyond m."""
    one = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(f"bad_{kind}")
    return rows.agg(one("fields"), one("number"), one("range"), F.greatest(F.count("*") - m, F.lit(0)).cast("long").alias("excess"))


def read(spark: SparkSession, path: str, undirected: bool = False, weighted: bool = False) -> tuple[DataFrame, int]:
    """(edges, n); raises ValueError with the numbers of faults, if there are any.  Fewer than m rows are accepted."""
    n, m, line = header(spark, path)
    body = _lines(spark, path).where(F.col("value") != line)  # no row can equal it: it has blanks and no comma
    rows = parsed(body, n, weighted)
    bad = violations(rows, m).first().asDict()
    if any(bad.values()):
        raise ValueError(f"{path}: {', '.join(f'{k} {v}' for k, v in bad.items() if v)}")
    edges = rows.select("src", "dst", *(["w"] if weighted else []))
    return (both_ways(edges) if undirected else edges), n


def write(edges: DataFrame, path: str) -> None:
    """`src,dst,w` without a header, in order of (src, dst) within and across files."""
    edges.select("src", "dst", "w").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").csv(path)
