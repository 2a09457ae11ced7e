"""Order statistics of groups of any size: ranks, neighbours, running sums, exact quantiles.

Everything works on the distinct values of each group with their counts, ranked once by placed(). While the
largest group has at most ``GROUP_ROWS`` of them, ranks are a window over each group, and whatever
follows by the same keys needs no further shuffle. Beyond that a window would be one task's work for a
whole group; then all groups are range-partitioned together, each partition works on its own stretch, and a small table
of stretches (one row for each group and partition) carries what comes before. Both ways give the same rows;
the second one's have a column ``stretch``. No percentile buffer holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.stages import written

#: Values of one group that one task may sort.
GROUP_ROWS = 2_000_000


def distinct_values(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, n): how often each non-null value occurs."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def placed(values: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, n, keep) with prev (the next smaller value or null) and before (how many occurrences are
    smaller). Values are distinct within each group. A job runs."""
    values = written(values.select(*keys, "value", "n", *keep))
    largest = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    if largest <= GROUP_ROWS:
        own = Window.partitionBy(*keys).orderBy("value")
        before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return values.withColumns({"prev": F.lag("value").over(own), "before": before})
    dealt = written(values.repartitionByRange(*keys, "value").withColumn("stretch", F.spark_partition_id()))
    own = Window.partitionBy("stretch", *keys).orderBy("value")
    ends = dealt.groupBy("stretch", *keys).agg(F.max("value").alias("last"), F.sum("n").alias("held"))
    ahead = Window.partitionBy(*keys).orderBy("stretch")
    ends = ends.select("stretch", *keys, F.lag("last").over(ahead).alias("carried"), F.coalesce(F.sum("held").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    local = dealt.withColumns({"own": F.lag("value").over(own), "inside": F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return joined(local, ends, ["stretch", *keys]).select(*keys, "stretch", "value", "n", *keep, F.coalesce("own", "carried").alias("prev"), (F.col("offset") + F.col("inside")).alias("before"))


def running(rows: DataFrame, keys: list[str], amount: Column, into: str) -> DataFrame:
    """Adds the running sum of ``amount`` by value, the row's own included, to what placed() gave."""
    rows = rows.withColumn(into, amount)
    if "stretch" not in rows.columns:
        return rows.withColumn(into, F.sum(into).over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("stretch", *keys).agg(F.sum(into).alias("held"))
    sums = sums.select("stretch", *keys, F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    own = Window.partitionBy("stretch", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return joined(rows.withColumn(into, F.sum(into).over(own)), sums, ["stretch", *keys]).withColumn(into, F.col(into) + F.col("offset")).drop("offset")


def with_group(rows: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates of each group to its rows, which placed() gave."""
    if "stretch" not in rows.columns:
        return rows.withColumns({name: c.over(Window.partitionBy(*keys)) for name, c in aggregates.items()})
    return joined(rows, rows.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()]), keys)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the right side's keys go. Without keys the right side is one
    row, which is broadcast."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(c).alias(f"{c}__r" if c in on else c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return left.join(renamed, cond, how).drop(*[f"{c}__r" for c in on])


def at_rank(rank: Column) -> Column:
    """An aggregate over what placed() gave: the value whose occurrences hold a rank, counted from 0."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))


def at_share(share: Column, total: Column) -> Column:
    """An aggregate: the value at a share of the ranks of ``total`` occurrences, between neighbours by the line."""
    return at_place((total - 1) * share)


def at_place(rank: Column) -> Column:
    """An aggregate: the value at a rank that may lie between two."""
    low, high = at_rank(F.floor(rank)), at_rank(F.ceil(rank))
    return low + (high - low) * F.max(rank - F.floor(rank))


def quantiles(rows: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """(keys, one column for each share): exact quantiles with linear interpolation between ranks."""
    return quantiles_of(placed(distinct_values(rows, keys, value), keys), keys, shares)


def quantiles_of(found: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """quantiles() of what placed() gave."""
    counted = with_group(found, keys, {"all": F.sum("n")})
    return counted.groupBy(*keys).agg(*[at_share(F.lit(float(q)), F.col("all")).alias(name) for name, q in shares.items()])


def middle_gap(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``middle``, the median difference of neighbouring values, to what placed() gave; null without any."""
    gap = F.col("value") - F.col("prev")
    if "stretch" in found.columns:
        gaps = found.where("prev is not null").select(*keys, gap.alias("value"))
        return joined(found, quantiles(gaps, keys, {"middle": 0.5}), keys, "left")
    own = Window.partitionBy(*keys)
    ranked = found.withColumns({"gap": gap, "at": F.row_number().over(own.orderBy(gap.asc_nulls_last())) - 1, "gaps": F.count(gap).over(own)})
    rank = (F.col("gaps") - 1) / 2
    low, high = (F.max(F.when(F.col("at") == end(rank), F.col("gap"))).over(own) for end in (F.floor, F.ceil))
    return ranked.withColumn("middle", low + (high - low) * (rank - F.floor(rank))).drop("gap", "at", "gaps")
