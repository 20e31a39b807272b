"""Cutting lineage between the rounds of an iterated plan, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where the session is local and names none."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="edgeloom-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, bare: bool = False, dealt: list[str] | None = None) -> DataFrame:
    """df by way of a reliable checkpoint.

    bare: without the size and the constraints that the optimiser foretells of it: a
    checkpoint hands them on, and in a loop of joins they double with every round.  dealt: bare, and
    known to be dealt by these columns, as its last step is a repartition() by them; what joins
    it on them then goes to it, and it stays where it is.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    if not bare and dealt is None:
        return out
    try:
        return _rebuilt(out, dealt)
    except Py4JError:  # another release may build its plans otherwise; then it is only slower
        return out


def _rebuilt(out: DataFrame, dealt: list[str] | None) -> DataFrame:
    spark = out.sparkSession
    plan, jvm = out._jdf.queryExecution().logical(), spark._jvm
    physical = jvm.org.apache.spark.sql.catalyst.plans.physical
    parts = plan.rdd().getNumPartitions()
    where = physical.UnknownPartitioning(parts)
    if dealt:
        columns = {a.name(): a for a in (plan.output().apply(i) for i in range(plan.output().size()))}
        where = physical.HashPartitioning(jvm.scala.jdk.javaapi.CollectionConverters.asScala(jvm.java.util.ArrayList([columns[c] for c in dealt])).toSeq(), parts)
    none = getattr(jvm.scala, "None$").__getattr__("MODULE$")
    made = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), where, plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, made), spark)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared ones, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the checkpoints that cut() wrote for these; nothing may read them any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (path := plan.rdd().getCheckpointFile()).isDefined():
            delete(df.sparkSession, path.get())
