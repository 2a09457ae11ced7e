"""Sequences by position: runs, clusters, neighbours, autocorrelation, steps, polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import ordered
from tallystone.functions.ordered import joined
from tallystone.operators.metrics import middle


def clusters(rows: DataFrame, by: str, at: str, reach: float) -> DataFrame:
    """(by, n, n_clusters): positions at most ``reach`` from the one before belong together. Works on
    distinct positions, so a series of any length is dealt over many tasks."""
    found = ordered.placed(ordered.distinct_values(rows, [by], at), [by])
    opens = F.col("prev").isNull() | (F.col("value") - F.col("prev") > reach)
    return found.groupBy(by).agg(F.sum("n").alias("n"), F.count_if(opens).alias("n_clusters"))


def neighbour_gaps(rows: DataFrame, by: str, at: str) -> DataFrame:
    """(by, n, median_gap, reach): differences of consecutive positions, equal ones counting 0."""
    found = ordered.placed(ordered.distinct_values(rows, [by], at), [by])
    between = found.where("prev is not null").select(by, (F.col("value") - F.col("prev")).alias("value"), F.lit(1).alias("w"))
    same = found.where("n > 1").select(by, F.lit(0).cast("double").alias("value"), (F.col("n") - 1).alias("w"))
    steps = between.withColumn("value", F.col("value").cast("double")).unionByName(same)
    weighed = steps.groupBy(by, "value").agg(F.sum("w").alias("n"))
    ends = weighed.groupBy(by).agg(F.sum("n").alias("n"), (F.max("value") - F.min("value")).alias("reach"))
    return joined(ends, ordered.quantiles_of(ordered.placed(weighed, [by]), [by], {"median_gap": 0.5}), [by])


def threshold(profile: DataFrame, by: list[str], share: float = 0.06) -> DataFrame:
    """(by, level): the larger of the 5 % quantile and a share of the 90 % quantile of what is above 0."""
    low = ordered.quantiles(profile, by, {"low": 0.05})
    high = ordered.quantiles(profile.where("value > 0"), by, {"high": 0.9})
    return joined(low, high, by, "left").select(*by, F.greatest("low", F.coalesce(F.lit(share) * F.col("high"), F.lit(0.0))).alias("level"))


def runs(profile: DataFrame, by: list[str], share: float = 0.06, least: int = 2) -> DataFrame:
    """(by, first, last, total): stretches of consecutive positions with a value above the level, of at
    least ``least`` positions. profile: (by, at, value) with whole positions, each once. Neighbours have equal differences
    of position and rank, so a series of any length is dealt over many tasks."""
    above = joined(profile, threshold(profile, by, share), by).where(F.col("value") > F.col("level"))
    ranked = ordered.placed(above.select(*by, F.col("at").alias("value"), F.lit(1).alias("n"), F.col("value").alias("amount")), by, ("amount",))
    grouped = ranked.withColumn("run", F.col("value") - F.col("before")).groupBy(*by, "run")
    found = grouped.agg(F.min("value").alias("first"), F.max("value").alias("last"), F.sum("amount").alias("total"))
    return found.where(F.col("last") - F.col("first") + 1 >= least).drop("run")


def columns(profile: DataFrame, by: list[str], gaps: DataFrame | None = None, gap: int = 6, share: float = 0.13, narrow: int = 10) -> DataFrame:
    """(by, first, end): the columns of text that empty strips part. profile: (by, at, value), the ink of each position
    from 0 to the last one; gaps: (by, gap), else ``gap`` for all.

    A position is empty if its ink is at most ``share`` of the 90 % quantile of what is above 0. Full positions
    with fewer than ``gap`` empty ones between them are one column; the first column begins at 0 unless a strip does, the
    last one ends with the profile; columns of more than ``narrow`` positions stay, cut to their first and last ink."""
    peak = ordered.quantiles(profile.where("value > 0"), by, {"peak": 0.9})
    ends = profile.groupBy(*by).agg((F.max("at") + 1).alias("size"))
    known = joined(joined(profile, peak, by), ends, by)
    known = known.withColumn("gap", F.lit(gap)) if gaps is None else joined(known, gaps.select(*by, "gap"), by)
    full = known.where(F.col("value") > share * F.col("peak")).select(*by, F.col("at").alias("value"), F.lit(1).alias("n"), "gap", "size")
    ranked = ordered.placed(full, by, ("gap", "size"))
    opens = (F.col("prev").isNull() | (F.col("value") - F.col("prev") - 1 >= F.col("gap"))).cast("long")
    found = ordered.running(ranked, by, opens, "number").groupBy(*by, "number", "gap", "size").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    count = found.groupBy(*by).agg(F.max("number").alias("most"))
    found = joined(found, count, by)
    begin = F.when((F.col("number") == 1) & (F.col("first") < F.col("gap")), 0).otherwise(F.col("first"))
    end = F.when(F.col("number") == F.col("most"), F.col("size")).otherwise(F.col("last") + 1)
    wide = found.select(*by, "number", "first", "last", begin.alias("begin"), end.alias("stop"), "most").where(F.col("stop") - F.col("begin") > narrow)
    # only before the first column and behind the last one is there ink that is not full: all other ends are full
    faint = profile.where("value > 0").groupBy(*by).agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    cut_ = joined(wide, faint, by)
    return cut_.select(
        *by,
        F.when(F.col("begin") < F.col("first"), F.greatest("begin", "low")).otherwise(F.col("first")).alias("first"),
        F.when(F.col("number") == F.col("most"), F.least("stop", "high")).otherwise(F.col("last") + 1).alias("end"),
    )


def autocorrelation(profile: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, lag, r) for lags 0..most of a gapless profile (by, at, value): an equi-join of each position
    with the later ones in reach, ``most`` + 1 rows for each."""
    means = profile.groupBy(*by).agg(F.avg("value").alias("mean"))
    level = joined(profile, means, by).select(*by, "at", (F.col("value") - F.col("mean")).alias("d"))
    later = level.select(*by, "at", "d", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag")).withColumn("at", F.col("at") - F.col("lag"))
    products = joined(later.withColumnRenamed("d", "later"), level, [*by, "at"]).groupBy(*by, "lag").agg(F.sum(F.col("d") * F.col("later")).alias("s"))
    base = products.where("lag = 0").select(*by, F.col("s").alias("s0")).where("s0 > 0")
    return joined(products, base, by).select(*by, "lag", (F.col("s") / F.col("s0")).alias("r"))


def first_peak(correlation: DataFrame, by: list[str], least: int, floor: float = 0.25) -> DataFrame:
    """(by, lag, r): the smallest lag from ``least`` on that is higher than both neighbours and ``floor``."""
    row = Window.partitionBy(*by).orderBy("lag")
    around = correlation.withColumns({"left": F.lag("r").over(row), "right": F.lead("r").over(row)})
    peaks = around.where((F.col("lag") >= least) & (F.col("r") > F.col("left")) & (F.col("r") >= F.col("right")) & (F.col("r") > floor))
    return peaks.groupBy(*by).agg(F.min(F.struct("lag", "r")).alias("p")).select(*by, "p.lag", "p.r")


#: Positions of a series that one task looks at.
STRETCH = 65_536


def steps(profile: DataFrame, by: list[str], reach: int) -> DataFrame:
    """(by, at, step): how far the median of the next ``reach`` positions is from that of the ``reach``
    before, where both are whole. profile: (by, at, value) with whole positions without gaps. Series are looked at in
    stretches of ``STRETCH`` positions, which share ``reach`` positions with their neighbours."""
    size = F.lit(max(STRETCH, reach))
    own, near = F.floor(F.col("at") / size), F.array_distinct(F.array(F.floor((F.col("at") - reach) / size), F.floor(F.col("at") / size), F.floor((F.col("at") + reach) / size)))
    dealt = profile.select(*by, "at", "value", own.alias("own"), F.explode(near).alias("stretch"))
    row = Window.partitionBy(*by, "stretch").orderBy("at")
    after, before = row.rowsBetween(0, reach - 1), row.rowsBetween(-reach, -1)
    found = dealt.withColumns({"a": middle(F.collect_list("value").over(after)), "b": middle(F.collect_list("value").over(before)), "na": F.count("value").over(after), "nb": F.count("value").over(before)})
    whole = (F.col("na") == reach) & (F.col("nb") == reach) & (F.col("own") == F.col("stretch"))
    return found.where(whole).select(*by, "at", F.abs(F.col("a") - F.col("b")).alias("step"))


def bands(profile: DataFrame, by: list[str], step: float = 48.0, least: int = 48) -> DataFrame:
    """(by, band, first, end): stretches of a series, from 0 to its end, cut where the level steps by ``step`` or more;
    the largest steps come first and cuts are ``least`` apart. Series of fewer than 2 * ``least`` positions are one."""
    found = steps(profile, by, least).where(F.col("step") >= step)
    cuts = found.groupBy(*by).agg(spread_out(F.collect_list(F.struct("step", "at")), least).alias("cuts"))
    ends = profile.groupBy(*by).agg((F.max("at") + 1).cast("long").alias("size"))
    edges = joined(ends, cuts, by, "left").withColumn("cuts", F.coalesce("cuts", F.expr("cast(array() as array<bigint>)")))
    zero = F.array(F.lit(0).cast("long"))
    pairs = F.arrays_zip(F.concat(zero, "cuts").alias("first"), F.concat("cuts", F.array("size")).alias("end"))
    return edges.select(*by, F.posexplode(pairs).alias("band", "z")).select(*by, "band", "z.*")


def spread_out(candidates: Column, apart: int) -> Column:
    """Of an array of structs (step, at), the positions that stay if the largest steps come first and
    each must be ``apart`` from those before it; equal steps by position."""
    ordered_ = F.array_sort(candidates, lambda a, b: F.when(a["step"] != b["step"], F.when(a["step"] > b["step"], -1).otherwise(1)).otherwise(F.when(a["at"] < b["at"], -1).otherwise(1)))
    at = F.transform(ordered_, lambda c: c["at"])
    kept = F.aggregate(at, F.expr("cast(array() as array<bigint>)"), lambda done, p: F.when(F.exists(done, lambda q: F.abs(q - p) < apart), done).otherwise(F.concat(done, F.array(p.cast("long")))))
    return F.array_sort(kept)


def polarity(rows: DataFrame, by: list[str], share: float = 0.72) -> DataFrame:
    """(by, p5, p50, p95, inverted, level): whether the bright side is the longer one, so that ink is
    bright, and the ink threshold, a share of the median (of what is left after inversion to 255 - v)."""
    q = ordered.quantiles(rows, by, {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    inverted = (F.col("p95") - F.col("p50")) > (F.col("p50") - F.col("p5"))
    return q.select(*by, "p5", "p50", "p95", inverted.alias("inverted"), (share * F.when(inverted, 255.0 - F.col("p50")).otherwise(F.col("p50"))).alias("level"))


def ink_profile(rows: DataFrame, by: list[str], at: str, ink: Column) -> DataFrame:
    """(by, at, value): how many pixels of each row or column are ink."""
    return rows.groupBy(*by, F.col(at).alias("at")).agg(F.count_if(ink).alias("value"))
