"""Serving analytics: latency, throughput, regressions, counters, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.order_stats import quantiles
from larkspur.operators.ordered import running


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 by the clock of the value itself, with or without a time zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    whole = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, mean, interpolated p50, p95 and p99, max of every group; quantiles are exact, and no task holds a group."""
    total = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    ps = quantiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    return total.alias("t").join(ps.alias("q"), same, "left").select(*[f"t.{c}" for c in by], "n", "min", "mean", "p50", "p95", "p99", "max")


def throughput(df: DataFrame, by: list[str], ts: str, failed: Column) -> DataFrame:
    """Successes a second of the time spanned, and the share of failures."""
    span = F.greatest(epoch_micros(F.max(ts)) - epoch_micros(F.min(ts)), F.lit(1)) / 1e6
    bad = F.sum(failed.cast("long"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), bad.alias("n_failed"), ((F.count(F.lit(1)) - bad) / span).alias("per_second"), (bad / F.count(F.lit(1))).alias("error_rate"))


def regressions(before: DataFrame, after: DataFrame, key: str, cols: list[str], threshold: float = 0.1) -> DataFrame:
    """(key, metric, before, after, delta, percent, regressed) of all shared keys; percent is null from 0."""
    wide = lambda d, p: d.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.col(c).cast("double") for c in cols]))).alias("metric", p))
    j = wide(before, "before").join(wide(after, "after"), [key, "metric"])
    d = F.col("after") - F.col("before")
    share = F.when(F.col("before") != 0, d / F.col("before"))
    return j.select(key, "metric", "before", "after", d.alias("delta"), share.alias("percent"), F.coalesce(share > threshold, F.lit(False)).alias("regressed"))


def rate_limit(df: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Adds window_id, allowed and retry_after (whole seconds, 1 at least; null where allowed): the first `limit` of a key in each window pass."""
    now = epoch_seconds(F.col(ts))
    w = Window.partitionBy(key, "window_id").orderBy(ts, order)
    d = df.withColumn("window_id", F.floor(now / seconds)).withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= limit)
    return d.withColumn("retry_after", F.when(~F.col("allowed"), F.greatest((F.col("window_id") + 1) * seconds - now, F.lit(1)))).drop("n")


def counters(df: DataFrame, name: str, labels: dict[str, Column]) -> DataFrame:
    """(labels, n) of the allowed labels; those of high cardinality are refused by the caller's list."""
    return df.groupBy(*[c.alias(k) for k, c in labels.items()]).agg(F.count(F.lit(1)).alias(name))


def last_n(df: DataFrame, channel: str, order: list[str], n: int) -> DataFrame:
    """The newest n of each channel with the number dropped: a bounded buffer.  Tasks keep n rows of a channel before the shuffle."""
    newest = Window.partitionBy(channel).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("i", F.row_number().over(newest)).filter(F.col("i") <= n).drop("i")
    size = df.groupBy(F.col(channel).alias("_channel")).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("dropped"))
    return kept.join(size, F.col(channel).eqNullSafe(F.col("_channel"))).drop("_channel")


def overlap(df: DataFrame, start: str, end: str) -> DataFrame:
    """Most intervals that run at once: running sum over starts and ends, ends first at equal times."""
    moves = df.select(F.col(start).alias("t"), F.lit(1).alias("d")).union(df.select(F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = moves.groupBy("t").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("ends"))
    return running(steps, [F.asc("t")], "d", "running").agg(F.max("running").alias("most"))
