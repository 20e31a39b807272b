"""The corpus pipeline: filter, de-duplicate, decontaminate, mask secrets, pack.

Every stage's result is written as Parquet under the shared folder and read back as the next
one's documents; a stage that is written through has its _SUCCESS mark.  A run that
spark.edgeloom.pipeline.run gives a name to is gone on with where it ended, by whatever driver
runs it next; one without a name begins anew.  A result that the next stage has used up is deleted.

Defined results, for any stage but the last (which returns pieces):
a document with a null or an empty text goes or stays as the classifier scores an empty text,
links with nothing, is never contaminated and has no secrets; rows are told apart by id and
text, so what shares an id with a removed row, or has none, is judged by itself; of rows that
agree in both one stays if they have a word; columns beyond those of documents go along,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontaminate, jaccard, packing, quality, secrets
from edgeloom.llm.frames import table
from edgeloom.llm.queries import tokenizer_path
from edgeloom.plans.lineage import delete, exists, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; every other stays as it is."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more) stays: the one with the smallest id."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found, in whatever encoding, is replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near_copies", keep_one_of_each), ("benchmark", drop_benchmark), ("secrets", mask_secrets), ("packing", pack)]
#: Not expressible in SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's result is written to the shared folder before the next reads it."""
    named = spark.conf.get("spark.edgeloom.pipeline.run", None)
    folder = f"{shared_folder(spark).rsplit('/', 1)[0] if named else shared_folder(spark)}/pipeline-{named or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    done = max((k for k, path in enumerate(paths) if exists(spark, f"{path}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        if k <= done:
            continue
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            delete(spark, paths[k - 1])
    return STAGES[-1][1](spark, docs, sf_dir)
