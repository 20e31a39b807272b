"""Reports over chains' telemetry: ordinary aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.prng import unit


def intervals(trace: DataFrame, every: int) -> DataFrame:
    """chain, round and rate at each multiple of `every` steps: the share accepted so far."""
    so_far = F.sum(F.col("accepted").cast("long")).over(Window.partitionBy("chain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    marked = trace.select("chain", "step", (so_far.cast("double") / F.col("step")).alias("rate"))
    return marked.where(F.col("step") % every == 0).select("chain", F.expr(f"step div {every}").alias("round"), "rate")


def step_times(rows: DataFrame, every: int = 10_000) -> DataFrame:
    """Interval telemetry with step (rounds in steps) and us_per_step (from the milliseconds of an interval)."""
    return rows.withColumn("step", F.col("round") * every).withColumn("us_per_step", F.col("time") * 1000 / every)


def window_end(step: Column) -> Column:
    """The step at which the log window that holds `step` is written.

    Windows are 100 steps long up to step 10,000 and ten times longer from each hundredfold
    of their length on.
    """
    size = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.ceil(F.log10(step.cast("double")) - 1e-12).cast("int") - 4)).cast("bigint") * 100
    return F.ceil(step / size).cast("bigint") * size


def acceptance(trace: DataFrame) -> DataFrame:
    """chain, round and rate: the mean over each complete log window of the running acceptance ratio."""
    so_far = F.sum(F.col("accepted").cast("long")).over(Window.partitionBy("chain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    marked = trace.select("chain", "step", (so_far.cast("double") / F.col("step")).alias("ratio"), window_end(F.col("step")).alias("round"))
    return marked.groupBy("chain", "round").agg(F.avg("ratio").alias("rate"), F.max("step").alias("last")).where("last = round").select("chain", "round", "rate")


def insertions(trace: DataFrame) -> DataFrame:
    """insertions and acc ('acc' or 'rej') of the steps that searched."""
    return trace.where("kind = 'search'").select("insertions", F.when(F.col("accepted"), "acc").otherwise("rej").alias("acc"))


def min_group_size(rows: DataFrame, keys: list[str], more_than: int = 9) -> DataFrame:
    """Rows whose group has more than so many."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") > more_than).drop("_n")


def recode(rows: DataFrame, column: str, names: dict) -> DataFrame:
    """Replaces the values that `names` has; others stay."""
    out = F.col(column)
    for k, v in names.items():
        out = F.when(F.col(column) == F.lit(k), F.lit(v)).otherwise(out)
    return rows.withColumn(column, out)


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn(tag, F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def normalise_coverage(rows: DataFrame) -> DataFrame:
    """Adds opt_mean, normalised, frac_coverage and x to rows (nodes, steps, completion_run)."""
    opt = F.when(F.col("steps") == 0, F.col("completion_run"))
    by_nodes, by_both = Window.partitionBy("nodes"), Window.partitionBy("nodes", "steps")
    out = rows.withColumn("opt_mean", F.avg(opt.cast("double")).over(by_nodes))
    out = out.withColumn("normalised", F.col("completion_run").cast("double") / F.when(F.col("opt_mean") != 0, F.col("opt_mean")))
    out = out.withColumn("frac_coverage", F.count("completion_run").over(by_both).cast("double") / F.count("*").over(by_both))
    return out.withColumn("x", F.col("steps").cast("double") / F.col("nodes"))


def quartiles(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return rows.groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.element_at("q", i + 1).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


def letter_values(rows: DataFrame, value: str, keys: list[str], depth: int = 4) -> DataFrame:
    """keys, letter (1: median, 2: quarters, 3: eighths, ...), low and high."""
    shares = [2.0**-k for k in range(1, depth + 1)]
    both = F.percentile(value, F.array(*[F.lit(s) for s in shares], *[F.lit(1 - s) for s in shares]))
    out = rows.groupBy(*keys).agg(both.alias("q"))
    letters = F.array(*[F.struct(F.lit(k + 1).alias("letter"), F.element_at("q", k + 1).alias("low"), F.element_at("q", depth + k + 1).alias("high")) for k in range(depth)])
    return out.select(*keys, F.explode(letters).alias("l")).select(*keys, "l.*")


#: P(X <= k) of a Poisson variable of mean 1, k = 0 .. 8: fixed values, exp(-1) * sum(1 / k!).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)


def mean_interval(rows: DataFrame, value: str, keys: list[str], row_id: str, resamples: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """keys, mean, low and high: a Poisson bootstrap interval of the mean.

    In each resample a row counts a Poisson number of times, drawn from its id; resamples
    are exploded and summed within a task, so only their sums are shuffled.
    """
    u = unit(seed, "_b", "_id")
    times = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    each = rows.select(*keys, F.col(row_id).alias("_id"), F.col(value).cast("double").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")).withColumn("_t", times)
    means = each.groupBy(*keys, "_b").agg((F.sum(F.col("_x") * F.col("_t")) / F.sum("_t")).alias("_m"))
    tail = (1 - level) / 2
    ends = means.groupBy(*keys).agg(F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"))
    return rows.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("mean")).join(ends, keys)
