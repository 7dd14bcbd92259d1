"""Order statistics over whole relations that no single task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, kept


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df and each row's place (1, 2, ...) in the given order.

    The rows are dealt out by ranges of all order columns together, so a value that many rows share is split by the next
    column. The ranges rest on a sample, hence they are held in the shared folder; a row's place is its place in its range
    and the number of rows in the ranges before, of which there are as many as shuffle partitions. Rows that are equal in
    all order columns get places in an undefined order; nulls come where the order columns put them; an empty relation
    stays empty.
    """
    part, before = "range of a rank", "rows before it"
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long")
    return dealt.withColumn(name, place).join(F.broadcast(starts), part).select(*(F.col(f"`{c}`") for c in df.columns), (F.col(name) + F.col(before)).alias(name))


def mid_ranks(counted: DataFrame, x: str, *keys: str) -> DataFrame:
    """counted (one row for each keys and x, with n, how often it occurs) and each value's mean place `mid` among its keys' values.

    Values are dealt out by ranges of (keys, x); a running sum within a range, the ranges' sums before it and the sum before
    the keys give the place, so no task holds all values. Nulls are not counted.
    """
    part = "range of a value"
    n = max(2, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c).asc() for c in (*keys, x)]
    dealt = cut(counted.filter(F.col(x).isNotNull()).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part, *keys).agg(F.sum("n").alias("n in it"))  # as many rows as ranges and keys together, at most
    before = Window.partitionBy(*keys).orderBy(part) if keys else Window.orderBy(part)
    starts = sums.select(part, *keys, (F.sum("n in it").over(before) - F.col("n in it")).alias("n before it"))
    upto = F.sum("n").over(Window.partitionBy(part, *keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    mid = F.col("n before it") + F.col("n up to it") - (F.col("n") - 1) / 2
    placed = dealt.withColumn("n up to it", upto).join(F.broadcast(starts), [part, *keys])
    return placed.withColumn("mid", mid).select(*counted.columns, "mid")


#: Ranges into which a sketch parts a relation's values, and values that one task may put in order.
RANGES, IN_ORDER = 256, 100_000
#: Groups whose bounds may be broadcast.
FEW = 20_000


def quantiles(df: DataFrame, x: str, at: dict[str, float], *keys: str, ends: bool = False, in_order: int = IN_ORDER) -> DataFrame:
    """keys, n (values) and one column for each name in `at`: the exact quantile, linearly interpolated, of x in each group.

    With ends, a column holds the two values between which the quantile lies and its part of the way, as a struct
    (left, right, part), for a caller that interpolates on another scale.

    A sketch parts each group's values into RANGES ranges; the rows before the range that holds a quantile are counted, and
    only its own rows go on: to the next sketch while they have more than in_order different values, else into the order
    from which the quantile is read. So no task puts a whole group in order, and each pass has about a hundredth of the rows
    of the one before. Nulls do not count; without keys an empty relation gives one row of nulls.
    """
    group = [*keys] or ["all rows"]
    rows = df.select(*keys, *([] if keys else [F.lit(0).alias("all rows")]), F.col(x).cast("double").alias("x")).filter("x IS NOT NULL")
    grid = [k / RANGES for k in range(RANGES + 1)]
    sketch = [F.count("*").alias("inside"), F.percentile_approx("x", grid, 10_000).alias("splits"), F.min("x").alias("least"), F.max("x").alias("most")]
    spread = cut(rows.groupBy(*group).agg(*sketch))
    sizes = spread.select(*group, F.col("inside").alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in at.items())))
    want = spread.withColumn("asked", asked).select(*group, "inside", "splits", "least", "most", "asked.name", (F.col("asked.q") * (F.col("inside") - 1)).alias("place")).withColumn("before", F.lit(0).cast("long"))
    most = None
    while True:
        # Places are counted from 0; the sketch may be off by one place in RANGES, so the ranges next to it count as well.
        first = F.floor((F.floor("place") - F.col("before")) * RANGES / F.col("inside")) - 2
        last = F.ceil((F.ceil("place") - F.col("before") + 1) * RANGES / F.col("inside")) + 2
        low = F.when(first <= 0, F.col("least")).otherwise(F.element_at("splits", F.greatest(first, F.lit(0)).cast("int") + 1))
        high = F.when(last >= RANGES, F.col("most")).otherwise(F.element_at("splits", F.least(last, F.lit(RANGES)).cast("int") + 1))
        bounds = cut(want.select(*group, "name", "place", "before", low.alias("low"), high.alias("high")))
        by = [c for c in (*group, "name") if c in rows.columns]
        met = rows.join(F.broadcast(bounds) if bounds.count() <= FEW else bounds, by)
        under = met.groupBy(*group, "name").agg(F.count(F.when(F.col("x") < F.col("low"), 1)).alias("under"))
        rows = kept(met.filter(F.col("x").between(F.col("low"), F.col("high"))).select(*group, "name", "x"))
        bounds = bounds.select(*group, "name", "place", "before").join(under, [*group, "name"]).withColumn("before", F.col("before") + F.col("under")).drop("under")
        values = rows.groupBy(*group, "name", "x").agg(F.count("*").alias("n"))
        largest = values.groupBy(*group, "name").count().agg(F.max("count")).first()[0] or 0
        if largest <= in_order or largest == most:  # some five ranges are the least that a pass can leave
            break
        most = largest
        want = cut(bounds.join(rows.groupBy(*group, "name").agg(*sketch), [*group, "name"]))
    upto = F.sum("n").over(Window.partitionBy(*group, "name").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    running = values.withColumn("upto", upto).join(bounds, [*group, "name"]).withColumn("upto", F.col("upto") + F.col("before"))
    pair = [F.min(F.when(F.col("upto") > F.expr(f"{f}(place)"), F.col("x"))).alias(c) for f, c in (("floor", "left"), ("ceil", "right"))]
    found = running.groupBy(*group, "name", "place").agg(*pair)
    part = F.col("place") - F.floor("place")
    value = F.struct("left", "right", part.alias("part")) if ends else F.col("left") + part * (F.col("right") - F.col("left"))
    return found.join(sizes, group).groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, value)).alias(name) for name in at))
