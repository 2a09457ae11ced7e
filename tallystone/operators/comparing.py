"""Corpora side by side: medians with intervals, which corpora are apart, and cards of all metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import ordered
from tallystone.functions.ordered import joined
from tallystone.functions.stages import written
from tallystone.operators.judging import catalog, layers, representative
from tallystone.schemas import BLOCKED, EXCLUDED, METRICS, NO_VALUE

#: Fixed value: half the width of a 95 % interval, in deviations of the normal distribution.
NORMAL_95 = 1.959964
#: Bits of a hash that a resampled weight is drawn from, and roots of a group's size to both sides of its middle that are drawn value by value.
BITS, REACH = 256, 4.0
#: Metrics that are compared within their largest layer.
LAYERED = ("lead_over_cap", "gap_px", "asc_over_xh")


def largest_layer(observations: DataFrame, metrics: tuple[str, ...] = LAYERED) -> DataFrame:
    """Observations of ``metrics`` outside the largest layer of their corpus go; all others stay."""
    keys = ["corpus", "metric"]
    some = observations.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull())
    best = representative(layers(some, keys), keys).select(*keys, "lowest", "highest")
    kept = joined(some, best, keys).where(F.col("value").between(F.col("lowest"), F.col("highest"))).select(*observations.columns)
    return kept.unionByName(observations.where(~F.col("metric").isin(*metrics) & F.col("value").isNotNull()))


def _intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """median_intervals() without rounding the median."""
    found = ordered.placed(ordered.distinct_values(rows, keys), keys)
    counted = ordered.with_group(found, keys, {"all": F.sum("n")})
    half, last = F.lit(NORMAL_95) * F.sqrt("all") / 2, F.col("all") - 1
    low, high = F.greatest(last / 2 - half, F.lit(0.0)), F.least(last / 2 + half, last.cast("double"))
    ends = counted.groupBy(*keys).agg(F.max("all").alias("n"), ordered.at_share(F.lit(0.5), F.col("all")).alias("median"), ordered.at_place(low).alias("ci_lo"), ordered.at_place(high).alias("ci_hi"))
    return ends.select(*keys, "n", "median", *[F.when(F.col("n") >= 3, F.bround(c, 4)).alias(c) for c in ("ci_lo", "ci_hi")])


def median_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, ci_lo, ci_hi): the median and its 95 % interval from the order statistics.

    How many of n resampled values are below a rank is binomial, so the resampled median moves between ranks that
    only n decides: the middle one and 1.96 deviations, each half the root of n, to both sides. The values at these
    ranks, between neighbours by the line, are what resampling tends to; nothing is drawn, and a group of any size
    takes the same steps. Groups of fewer than 3 values have no interval."""
    return _intervals(rows, keys).withColumn("median", F.bround("median", 4))


def _ones(digest: Column, n: Column) -> Column:
    """How many of the first ``n`` bits of a hexadecimal SHA-256 are set."""
    found = F.lit(0)
    for word in range(BITS // 32):
        taken = F.greatest(F.least(n - 32 * word, F.lit(32)), F.lit(0)).cast("int")
        bits = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")
        found = found + F.bit_count(F.call_function("shiftright", bits, 32 - taken))
    return found


def _resampled(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """resampled_intervals() without rounding the median."""
    counted = ordered.with_group(ordered.placed(ordered.distinct_values(rows, keys), keys), keys, {"all": F.sum("n")})
    ends = counted.groupBy(*keys).agg(F.max("all").alias("all"), ordered.at_share(F.lit(0.5), F.col("all")).alias("median"))
    middle, reach = (F.col("all") - 1) / 2, REACH * F.sqrt("all")
    below, above = F.col("before") + F.col("n") - 1 < middle - reach, F.col("before") > middle + reach
    near = counted.where("all >= 3").withColumn("place", F.when(below, F.lit(-1)).when(above, F.col("all")).otherwise(F.col("before")))
    near = written(near.groupBy(*keys, "place").agg(F.sum("n").alias("n"), F.when(F.col("place") < 0, F.max("value")).otherwise(F.min("value")).alias("value")))
    # dealt as the windows below need it before anything is hashed, so the few values are not one task's work
    drawn = near.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(*keys, "replicate")
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), "replicate", "place", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"), 256)
    n = F.col("n")
    weight = F.when(n <= BITS, 16 * F.col("ones")).otherwise(8 * n + F.floor(F.sqrt(n) * (F.col("ones") - BITS // 2)))
    drawn = drawn.withColumn("digest", digest).withColumn("ones", _ones(F.col("digest"), F.least(n, F.lit(BITS))))
    own = Window.partitionBy(*keys, "replicate")
    drawn = drawn.select(*keys, "replicate", "place", "value", weight.alias("weight")).withColumns({"up_to": F.sum("weight").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("weight").over(own)})
    low, high = (F.min(F.when(c, F.col("value"))) for c in (2 * F.col("up_to") >= F.col("whole"), 2 * F.col("up_to") > F.col("whole")))
    medians = drawn.groupBy(*keys, "replicate").agg(((low + high) / 2).alias("m")).where("m is not null")
    listed = medians.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("t"))

    def at(share: float) -> Column:
        rank = (F.size("t") - 1) * F.lit(share)
        first, last = F.get("t", F.floor(rank).cast("int")), F.get("t", F.ceil(rank).cast("int"))
        return F.bround(first + (last - first) * (rank - F.floor(rank)), 4)

    shown = listed.select(*keys, at(0.025).alias("ci_lo"), at(0.975).alias("ci_hi"))
    return joined(ends.withColumnRenamed("all", "n"), shown, keys, "left")


def resampled_intervals(rows: DataFrame, keys: list[str], replicates: int = 4000, seed: int = 0) -> DataFrame:
    """(keys, n, median, ci_lo, ci_hi) as median_intervals() gives them, from medians of ``replicates`` resamplings.

    In a replicate each occurrence counts twice or not at all, as one bit of a hash of seed, replicate, place and keys says, so
    the n occurrences of a value weigh n with a variance of n, as in drawing with replacement; for more than 256 of them the bits
    stand for the deviation. Weights are whole numbers, and the same seed gives the same rows on every
    cluster. A replicate's median lies within a few roots of the group's size around the middle rank, so only the values
    in 8 deviations to both sides are drawn one by one; those below and above are one weight each, and
    a replicate that left the stretch would take its last value. A group of n costs a multiple of its root for each replicate,
    and none is gathered. Null values go; groups of fewer than 3 values have no interval; without rows there is none."""
    return _resampled(rows, keys, replicates, seed).withColumn("median", F.bround("median", 4))


def separated(bands: DataFrame, corpus: str, by: list[str], lo: str, hi: str) -> DataFrame:
    """(by, one, other, apart) of each pair of corpora: whether their bands do not meet. Pairs without
    a band are never apart. ``bands`` has a row for each corpus and ``by``; only these are paired."""
    a = bands.select(*[F.col(c).alias(f"a_{c}") for c in by], F.col(corpus).alias("one"), F.col(lo).alias("lo1"), F.col(hi).alias("hi1"))
    b = bands.select(*by, F.col(corpus).alias("other"), F.col(lo).alias("lo2"), F.col(hi).alias("hi2"))
    cond = F.col("one") < F.col("other")
    for c in by:
        cond = cond & F.col(f"a_{c}").eqNullSafe(F.col(c))
    apart = F.coalesce((F.col("hi1") < F.col("lo2")) | (F.col("hi2") < F.col("lo1")), F.lit(False))
    return a.join(b, cond).select(*by, "one", "other", apart.alias("apart"))


def compare(observations: DataFrame, metrics: tuple[str, ...] = LAYERED, replicates: int | None = None, seed: int = 0) -> DataFrame:
    """Per metric with at least two corpora: n_corpora, spread (largest over smallest median, where that
    is above 0), n_separated, n_pairs and the pairs that are apart as ``one/other``, comma-joined. With
    ``replicates`` the intervals are resampled."""
    kept, keys = largest_layer(observations, metrics), ["metric", "corpus"]
    bands = written(_intervals(kept, keys) if replicates is None else _resampled(kept, keys, replicates, seed))
    per = bands.groupBy("metric").agg(F.count(F.lit(1)).alias("n_corpora"), F.max("median").alias("most"), F.min("median").alias("least")).where("n_corpora >= 2")
    named = F.array_join(F.array_sort(F.collect_list(F.when(F.col("apart"), F.concat_ws("/", "one", "other")))), ",")
    pairs = separated(bands, "corpus", ["metric"], "ci_lo", "ci_hi").groupBy("metric").agg(F.count_if("apart").alias("n_separated"), F.count(F.lit(1)).alias("n_pairs"), named.alias("separated"))
    spread = F.when(F.col("least") > 0, F.bround(F.col("most") / F.col("least"), 3)).alias("spread")
    return per.join(pairs, "metric").select("metric", "n_corpora", spread, "n_separated", "n_pairs", "separated")


def card(rules: DataFrame, metrics: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """One row for each metric of the catalog, with its rule and, if observations of several corpora
    are given, the comparison."""
    shown = catalog(rules, metrics, NO_VALUE)
    return shown if observations is None else shown.join(compare(observations), "metric", "left")


def style_card(rules: DataFrame, posters: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row for each metric of the registry, measured or not, and each that is declared but blocked, of each
    corpus of ``posters``: label, unit, the rule's numbers and layers, how many entities it came from, how many were
    excluded as rotated, and the comparison with ``references`` (observations of several corpora, these ones included)."""
    corpora = posters.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_posters"), F.count_if(F.abs(F.coalesce("angle", F.lit(0.0))) >= 1).alias("n_rotated"))
    names = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("metric", "label", "unit", "blocked"), (m, label, unit, None), strict=True)]) for m, label, unit in METRICS]
    names += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("unit"), F.lit("blocked").alias("blocked")) for m in BLOCKED]
    names = [F.struct(n["metric"].alias("metric"), n["label"].alias("label"), n["unit"].alias("unit"), n["blocked"].cast("string").alias("blocked")) for n in names]
    listed = corpora.select("corpus", "n_posters", "n_rotated", F.explode(F.array(*names)).alias("m")).select("corpus", "n_posters", "n_rotated", "m.*")
    entry = rules.drop("is_rule", "n_entities_all").withColumnRenamed("n_layers", "parts")
    shown = joined(listed, entry, ["corpus", "metric"], "left")
    excluded = F.when(F.col("metric").isin(*EXCLUDED) & F.col("verdict").isNotNull(), F.col("n_rotated"))
    found = shown.select(
        "corpus", "metric", "label", "unit", F.coalesce("verdict", "blocked", F.lit(NO_VALUE)).alias("verdict"), "n", "median", "lo", "hi", "min", "max", "cv",
        F.when(F.col("verdict").isNotNull(), F.greatest("parts", F.lit(1))).alias("n_layers"), F.when(F.col("parts") > 1, F.col("layers")).alias("layers"), "n_all", "n_entities", "n_posters", excluded.alias("n_excluded"),
    )
    return found if references is None else found.join(compare(references), "metric", "left")


def with_references(own: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """The observations of a corpus and of reference corpora under their names."""
    return reduce(DataFrame.unionByName, [own, *[o.withColumn("corpus", F.lit(name)) for name, o in others.items()]])
