"""Spark-side helpers: tables, lineage cuts, Arrow maps and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.arrays import release, slices
from edgeloom.plans.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_md5() -> F.Column:
    """With an id, what tells rows apart that share it (16 bytes); null where the text is null."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most_bytes: int = 2_000_000) -> DataFrame:
    """Runs fn over bounded slices of the rows; map-only, so a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, most_bytes):
                if (out := fn(piece)) is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def id_crc(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded(df: DataFrame, most: int, key: str = "doc_id", parts: int = 8) -> DataFrame:
    """About `most` rows at the most, chosen by the hash of their id, in `parts` partitions.

    Only for fitting models.  The bound is what makes collecting from it safe; the
    choice depends on ids alone, so the same rows are taken on every run.
    """
    n = df.count()
    if n > most:
        share = int(most / n * (1 << 31))
        df = df.where(F.pmod(F.xxhash64(F.lit(977), F.col(key)), F.lit(1 << 31)) < share)
    return df.repartition(parts)


def taught(documents: DataFrame, known: DataFrame, most_bytes: int = 96_000_000) -> DataFrame:
    """doc_id, text and y of the documents whose id is in known (doc_id, y; bounded, an id once), for fitting only.

    One text for each id - of several the one with the least hash - so rows are bounded by
    `known`; of more than `most_bytes` of text a share, chosen by the hash of the ids, and no
    text of more than an eighth of that.  Null texts are empty ones.
    """
    text = F.coalesce("text", F.lit(""))
    few = documents.select("doc_id", text.alias("text")).where(F.octet_length("text") <= most_bytes // 8).join(F.broadcast(known), "doc_id")
    return within(few.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).repartition(8), most_bytes)


def within(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows (doc_id, text, ...), cut; if their texts are longer than `most_bytes` in all, a share by the hash of the ids.  For fitting only."""
    rows = cut(rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(311), "doc_id"), F.lit(1 << 31)) < int(most_bytes / size * (1 << 31)))
    return rows


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


__all__ = ["bounded", "cut", "fresh_name", "id_crc", "map_texts", "quoted", "span_digest", "table", "taught", "text_md5", "within"]
