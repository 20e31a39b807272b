"""Chains on the simple cycle, and coverage of its states.

On one cycle a weighting is legal exactly if its sum isn't negative, so a chain needs no
search.  Coverage runs short chains on a few edges, each a higher-order fold over its steps
that keeps the weights and their sum; the whole sweep is one plan, its rows are chains, and
no Python is in it.  A long chain on many edges is a task of its own that changes one weight
in place for each step, as a fold would copy all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.prng import SPAN, draw, python_draw
from edgeloom.functions.weights import parse_initial


def _step(state: Column, low: int, high: int, n: int, seed: int, chain: Column, step: Column) -> tuple[Column, Column]:
    """(weights, total) after one proposal."""
    edge = F.pmod(draw(seed, chain, step, 0), F.lit(n))
    w = F.lit(low).cast("bigint") + F.pmod(draw(seed, chain, step, 1), F.lit(high - low + 1))
    total = state["total"] - F.get(state["weights"], edge.cast("int")) + w
    weights = F.transform(state["weights"], lambda x, i: F.when(i == edge, w).otherwise(x))
    return F.when(total >= 0, weights).otherwise(state["weights"]), F.when(total >= 0, total).otherwise(state["total"])


def fold(chain: Column, n: int, low: int, high: int, initial: int, first: int, last: Column | int, seed: int) -> Column:
    """The state (weights, total) after the steps first .. last; last may differ by row."""
    start = F.struct(F.array_repeat(F.lit(initial).cast("bigint"), n).alias("weights"), F.lit(n * initial).cast("bigint").alias("total"))

    def merge(state: Column, step: Column) -> Column:
        weights, total = _step(state, low, high, n, seed, chain, step)
        return F.struct(weights.alias("weights"), total.alias("total"))

    last = F.lit(last) if isinstance(last, int) else last
    steps = F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, merge)


def cycle_chain(spark: SparkSession, n: int, low: float, high: float, initial: str = "m", chains: int = 1, seed: int = 1, partitions: int | None = None, integral: bool = True) -> DataFrame:
    """chain, at, edge and weight after n/2, n, 2n, 5n and 10n steps (of 10n + 1, counted from 0).

    initial: m(ax), z(ero), u(niform) or a number.  A step costs the same whatever n is.
    """
    if low >= high or high < 0:
        raise ValueError("the least weight must be below the largest, which must not be negative")
    dumps, how = {n // 2, n, 2 * n, 5 * n, 10 * n}, parse_initial(initial)
    kind = "bigint" if integral else "double"

    def begin(chain: int) -> list:
        if how.kind == "u":
            draws = [python_draw(seed, chain, e, 3) for e in range(n)]
            return [x % (int(high) + 1) if integral else x / SPAN * high for x in draws]
        value = {"m": high, "z": 0}.get(how.kind, min(max(how.value, 0), high))
        return [int(value) if integral else float(value)] * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chain in batch.column(0).to_pylist():
                weights = begin(chain)
                total = sum(weights)
                for t in range(10 * n + 1):
                    edge, x = python_draw(seed, chain, t, 0) % n, python_draw(seed, chain, t, 1)
                    w = low + x % (int(high) - int(low) + 1) if integral else low + x / SPAN * (high - low)
                    after = total - weights[edge] + w
                    if after >= 0:
                        weights[edge], total = w, after
                    if t in dumps:
                        columns = [np.full(n, chain), np.full(n, t), np.arange(n), np.array(weights, np.int64 if integral else np.float64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chain", "at", "edge", "weight"])

    rows = spark.range(0, chains, 1, partitions or min(chains, spark.sparkContext.defaultParallelism))
    return rows.mapInArrow(run, f"chain bigint, at bigint, edge bigint, weight {kind}")


def cycledist(spark: SparkSession, n: int, low: float, high: float, initial: str = "m", chains: int = 1, seed: int = 1, integral: bool = True) -> DataFrame:
    """Telemetry of cycle chains: round (steps for each edge), weight and initial."""
    out = cycle_chain(spark, n, low, high, initial, chains, seed, integral=integral)
    return out.select((F.col("at") / n).alias("round"), F.col("weight").cast("double").alias("weight"), F.lit(parse_initial(initial).char).alias("initial"))


def encode(weights: Column, low: int, high: int) -> Column:
    """A state as a number in base high - low + 1, its first weight the lowest digit."""
    base = high - low + 1
    return F.aggregate(F.reverse(weights), F.lit(0).cast("bigint"), lambda acc, x: acc * base + x.cast("bigint") - low)


def valid_states(spark: SparkSession, n: int, low: int = -1, high: int = 1) -> DataFrame:
    """enc and total of every legal state, by taking the digits of 0 .. base**n - 1 apart."""
    base = high - low + 1
    total = F.lit(n * low).cast("bigint")
    for i in range(n):
        total = total + F.pmod(F.expr(f"id div {base**i}"), F.lit(base))
    return spark.range(base**n).select(F.col("id").alias("enc"), total.alias("total")).where("total >= 0")


def final_states(spark: SparkSession, n: int, low: int, high: int, steps: int, runs: int, seed: int, partitions: int | None = None) -> DataFrame:
    """run and enc of `runs` chains of `steps` steps from all zeros."""
    rows = spark.range(0, runs, 1, partitions or spark.sparkContext.defaultParallelism)
    return rows.select(F.col("id").alias("run"), encode(fold(F.col("id"), n, low, high, 0, 1, steps, seed)["weights"], low, high).alias("enc"))


def uniform_states(spark: SparkSession, n: int, low: int, high: int, runs: int, seed: int) -> DataFrame:
    """run and enc, each run a uniform draw from the legal states: what chains of endless length give."""
    valid = valid_states(spark, n, low, high)
    count = valid.count()
    from edgeloom.graph import index_edges

    place = index_edges(valid.select(F.col("enc").alias("src"), F.lit(0).alias("dst"))).select(F.col("eid").alias("place"), F.col("src").alias("enc"))
    drawn = spark.range(runs).select(F.col("id").alias("run"), F.pmod(draw(seed, "id", 0, 5), F.lit(count)).alias("place"))
    return drawn.join(place, "place").select("run", "enc")


def legal(states: DataFrame, valid: DataFrame) -> DataFrame:
    """The states (..., enc) that are legal."""
    return states.join(valid.select("enc"), "enc", "left_semi")


def histogram(states: DataFrame) -> DataFrame:
    return states.groupBy("enc").agg(F.count("*").alias("cnt"))


def frequency_of_frequencies(states: DataFrame, valid: DataFrame) -> DataFrame:
    """freq and cnt: how many legal states came up freq times, 0 included."""
    seen = valid.select("enc").join(histogram(states), "enc", "left")
    return seen.select(F.coalesce("cnt", F.lit(0)).alias("freq")).groupBy("freq").agg(F.count("*").alias("cnt"))


def completion(states: DataFrame, valid: int, share: int = 100) -> DataFrame:
    """One row: completion_run, the first run (from 0) by which all but valid // share states came up; null if never.

    Only each state's first run counts.  Runs are summed by blocks first, so that no task
    ranks all of them: the block is found by a window over blocks, the run within it.
    """
    wanted = valid - valid // share
    first = states.groupBy("enc").agg(F.min("run").alias("run"))
    size = 4096
    blocks = first.groupBy(F.expr(f"run div {size}").alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = blocks.withColumn("before", before).where((F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted))
    inside = first.withColumn("block", F.expr(f"run div {size}")).join(F.broadcast(here), "block")
    rank = inside.select("run", (F.row_number().over(Window.partitionBy("block").orderBy("run")) + F.col("before")).alias("seen"))
    return rank.where(F.col("seen") == wanted).agg(F.min("run").alias("completion_run"))


def run_count(valid: int, runs: int, override: int | None = None) -> int:
    """Runs of an experiment: `runs` for each legal state unless given."""
    return override or runs * valid


def coverage(spark: SparkSession, n: int = 8, low: int = -1, high: int = 1, steps: int = 16, runs: int = 1, repetitions: int = 1, seed: int = 1, total_runs: int | None = None, quit_early: bool = False, partitions: int | None = None) -> DataFrame:
    """A row for each repetition and step setting s < steps: chains of n * s // 4 steps (uniform draws where that is 0).

    One plan whatever the sweep's size.  completion_run is the first run by which all but a
    hundredth of the legal states came up (null if none is); quit_early: an experiment that
    completes has no frequencies.  An illegal state, or frequencies that don't add up to the
    runs, are errors.  runtime_ms is null: experiments don't run one after another.
    """
    from edgeloom.graph import index_edges
    from edgeloom.plans.lineage import cut

    valid = cut(valid_states(spark, n, low, high))
    count = valid.count()
    number, wanted = run_count(count, runs, total_runs), count - count // 100
    ids = spark.range(0, repetitions * steps * number, 1, partitions or spark.sparkContext.defaultParallelism)
    setting = F.expr(f"id div {number} % {steps}")
    grid = ids.select("id", F.expr(f"id div {steps * number}").alias("repetition"), setting.alias("setting"), (F.col("id") % number).alias("run"), F.expr(f"{n} * (id div {number} % {steps}) div 4").alias("scaled"))
    state = fold(F.col("id"), n, low, high, 0, 1, F.col("scaled"), seed)
    walked = grid.where("scaled > 0").withColumn("s", state)
    walked = walked.select("repetition", "setting", "run", F.when(F.col("s.total") >= 0, encode(F.col("s.weights"), low, high)).otherwise(F.raise_error(F.lit("a chain left the legal states"))).alias("enc"))
    place = index_edges(valid.select(F.col("enc").alias("src"), F.lit(0).alias("dst"))).select(F.col("eid").alias("place"), F.col("src").alias("enc"))
    drawn = grid.where("scaled = 0").withColumn("place", F.pmod(draw(seed, "id", 0, 5), F.lit(count))).join(place, "place").select("repetition", "setting", "run", "enc")
    keys = ("repetition", "setting")
    first = walked.unionByName(drawn).groupBy(*keys, "enc").agg(F.min("run").alias("run"), F.count("*").alias("freq"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("run"))
    done = first.select(*keys, "run", rank.alias("seen")).where(F.col("seen") == wanted).select(*keys, F.col("run").alias("completion_run"))
    sizes = first.groupBy(*keys, "freq").agg(F.count("*").alias("cnt"))
    per = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("freq", "cnt"))).alias("listed"), F.sum(F.col("freq") * F.col("cnt")).alias("total"), F.sum("cnt").alias("distinct"))
    unseen = F.lit(count) - F.col("distinct")
    listed = F.when(unseen > 0, F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("freq"), unseen.alias("cnt"))), F.col("listed"))).otherwise(F.col("listed"))
    checked = F.when(F.col("total") == number, listed).otherwise(F.raise_error(F.lit("frequencies don't add up to the runs")))
    if quit_early:
        checked = F.when(F.col("completion_run").isNotNull(), F.slice(listed, 1, 0)).otherwise(checked)
    out = per.join(done, list(keys), "left")
    fixed = [F.lit(n).cast("bigint").alias("nodes"), F.lit(low).cast("tinyint").alias("min_weight"), F.lit(high).cast("tinyint").alias("max_weight")]
    return out.select(*keys, *fixed, F.expr(f"{n} * setting div 4").alias("steps"), F.lit(runs).cast("bigint").alias("runs"), F.lit(count).cast("bigint").alias("num_valid_encodings"), checked.alias("count_of_frequencies"), "completion_run", F.lit(None).cast("bigint").alias("runtime_ms"))
