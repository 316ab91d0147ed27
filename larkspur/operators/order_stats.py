"""Exact order statistics of groups of any size: histograms of values are refined until each wanted rank is bracketed.

Equal values are counted first.  Then, for each group and wanted rank, the values between the bracket's ends
are counted in BUCKETS equal parts, and the part that holds the rank, tightened to its least and largest value, is
the next bracket; a bracket of one value is the answer.  A task sees counts of buckets, never a group's values, and
the brackets are written between rounds.  Two or three rounds do for ordinary values; each leaves out at least one end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.session import written

BUCKETS = 1024
#: Brackets that are broadcast; more are joined by shuffle.
BROADCAST = 100_000


def _same(by: list[str], a: str, b: str):
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def at_ranks(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, x): of values (by, x, c: how often), the one at each wanted (by, rank), from 0, in rising order."""
    ends = values.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    brackets = written(wanted.alias("w").join(ends.alias("e"), _same(by, "w", "e")).select(*[f"w.{c}" for c in by], "rank", F.lit(0).cast("long").alias("below"), "lo", "hi"), "rank-brackets")
    done = brackets.filter("lo = hi").select(*by, "rank", F.col("lo").alias("x"))
    todo = brackets.filter("lo < hi")
    while n := todo.count():
        held = F.broadcast(todo) if n <= BROADCAST else todo
        inside = values.alias("v").join(held.alias("t"), _same(by, "v", "t") & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the whole width may overflow
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))
        counted = inside.select(*[f"t.{c}" for c in by], "rank", "below", bucket.alias("bucket"), "x", "c").groupBy(*by, "rank", "below", "bucket").agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        next_ = counted.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        brackets = written(next_.select(*by, "rank", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi"), "rank-brackets")
        done = done.unionByName(brackets.filter("lo = hi").select(*by, "rank", F.col("lo").alias("x")))
        todo = brackets.filter("lo < hi")
    return done


def quantiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(by, one column for each name of ps): linearly interpolated quantiles of the finite values; groups without any are left out."""
    x = F.col(value).cast("double")
    values = written(df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(*by, x.alias("x")).agg(F.count(F.lit(1)).alias("c")), "value-counts")
    sizes = values.groupBy(*by).agg(F.sum("c").alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in ps.items()])
    places = written(sizes.select(*by, "n", F.inline(names)).withColumn("at", (F.col("n") - 1) * F.col("p")), "wanted-ranks")
    ranks = places.select(*by, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = at_ranks(values, ranks, by)
    part = F.col("at") - F.floor("at")
    near = places.alias("p").join(found.alias("f"), _same(by, "p", "f") & F.col("f.rank").isin(F.floor("at"), F.ceil("at")))
    each = near.select(*[f"p.{c}" for c in by], "name", F.when(F.col("rank") == F.floor("at"), F.col("x")).alias("lo"), F.when(F.col("rank") == F.ceil("at"), F.col("x")).alias("hi"), part.alias("part"))
    g = each.groupBy(*by, "name").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("part").alias("part"))
    return g.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))).alias(k) for k in ps])
