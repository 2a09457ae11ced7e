"""Layers, verdicts and rules over observations; every function takes any key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType
from pyspark.sql.window import Window

from tallystone.functions import ordered
from tallystone.functions.ordered import joined
from tallystone.functions.stages import written
from tallystone.operators import metrics
from tallystone.schemas import CONSTRAINT, CV_MAX, FREE, INSUFFICIENT, LAYER_GAP, MIXED, N_MIN

DIGITS = 3
#: Most groups of a corpus that an entity's bits stand for.
BITS = metrics.BITS


def verdict(n: Column, cv: Column) -> Column:
    return F.when(n < N_MIN, INSUFFICIENT).when(cv <= CV_MAX, CONSTRAINT).otherwise(FREE)


def judge(rows: DataFrame, keys: list[str], value: str = "value", digits: int = DIGITS) -> DataFrame:
    """(keys, n, median, lo, hi, min, max, cv, verdict) of each group's non-null values.

    lo and hi are the 10 % and 90 % quantiles, cv the population deviation over the mean (9.9 where
    the mean is 0). The verdict is decided before cv is rounded."""
    return _judged(ordered.placed(ordered.distinct_values(rows, keys, value), keys), keys, digits)


def _judged(found: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """judge() of what ordered.placed() gave, from the same ranks."""
    n, v = F.col("n"), F.col("value").cast("double")
    with_mean = ordered.with_group(found, keys, {"all": F.sum("n"), "total": F.sum(v * n)}).withColumn("mean", F.col("total") / F.col("all"))
    off = v - F.col("mean")
    spread = with_mean.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.max("mean").alias("mean"), F.sqrt(F.sum(off * off * n) / F.sum("n")).alias("dev"),
        *[ordered.at_share(F.lit(q), F.col("all")).alias(c) for c, q in (("median", 0.5), ("lo", 0.1), ("hi", 0.9))],
    )
    both = spread.withColumn("cv", F.when(F.col("mean") == 0, 9.9).otherwise(F.col("dev") / F.col("mean")))
    rounded = {c: F.bround(F.col(c).cast("double"), digits) for c in ("median", "lo", "hi", "min", "max", "cv")}
    return both.select(*keys, "n", *[rounded[c].alias(c) for c in ("median", "lo", "hi", "min", "max", "cv")], verdict(F.col("n"), F.col("cv")).alias("verdict"))


def layers(rows: DataFrame, keys: list[str], value: str = "value", factor: float = LAYER_GAP) -> DataFrame:
    """(keys, value, n, layer): the distinct values of each group with their layer, from 1 upward.

    A layer begins where the gap to the next smaller value is over ``factor`` times the median of the
    positive gaps. Groups of fewer than 4 values are one layer."""
    return _layered(ordered.placed(ordered.distinct_values(rows, keys, value), keys), keys, factor).select(*keys, "value", "n", "layer")


def _layered(found: DataFrame, keys: list[str], factor: float = LAYER_GAP) -> DataFrame:
    """What ordered.placed() gave, with layers."""
    limited = ordered.with_group(ordered.middle_gap(found, keys), keys, {"all": F.sum("n")})
    limit = F.when(F.col("all") >= 4, factor * F.col("middle"))
    opens = F.coalesce((F.col("value") - F.col("prev")) > limit, F.lit(False)).cast("long")
    return ordered.running(limited, keys, opens, "layer").withColumn("layer", F.col("layer") + 1).drop("all", "middle")


def representative(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the layer with most values, the lower one of equals: (keys, layer, n, lowest, highest)."""
    sizes = found.groupBy(*keys, "layer").agg(F.sum("n").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("layer")).alias("back"), "lowest", "highest")).alias("b"))
    return best.select(*keys, (-F.col("b.back")).alias("layer"), F.col("b.n").alias("n"), F.col("b.lowest").alias("lowest"), F.col("b.highest").alias("highest"))


def _parted(found: DataFrame, keys: list[str]) -> DataFrame:
    """Layered values with ``part``, their layer if it has N_MIN values and 0, the mixed rest, for all
    others; ``before`` counts within the part."""
    sized = ordered.with_group(found, [*keys, "layer"], {"size": F.sum("n"), "first": F.min("before")})
    sized = sized.withColumn("part", F.when(F.col("size") >= N_MIN, F.col("layer")).otherwise(F.lit(0)))
    rest = ordered.running(sized, keys, F.when(F.col("part") == 0, F.col("n")).otherwise(F.lit(0)), "rest")
    return rest.withColumn("before", F.when(F.col("part") == 0, F.col("rest") - F.col("n")).otherwise(F.col("before") - F.col("first"))).drop("size", "first", "rest")


def _entities(observations: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, n_entities), how many entities give a value, and (corpus, n_entities_all). While each corpus has the same few groups, an
    entity is one row with a bit for each of them, so that no row for each entity and group is shuffled."""
    rest = keys[1:]
    plain = all(isinstance(observations.schema[c].dataType, (StringType, IntegralType)) for c in rest)
    groups = found.select(*rest).distinct().limit(BITS + 1).collect() if plain and rest else [()] if not rest else []
    if not plain or len(groups) > BITS:
        seen = observations.groupBy(*keys, "entity").agg(F.max(F.col("value").isNotNull()).alias("has"))
        covered = seen.where("has").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities"))
        return covered, seen.select(keys[0], "entity").distinct().groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n_entities_all"))
    value = lambda g, c: F.lit(g[c]).cast(observations.schema[c].dataType)
    bit = F.lit(0).cast("long")
    for i, g in enumerate(groups):
        same = F.col("value").isNotNull()
        for c in rest:
            same = same & F.col(c).eqNullSafe(value(g, c))
        bit = F.when(same, F.lit(1 << i).cast("long")).otherwise(bit)
    return _covered(observations.select(keys[0], "entity", bit.alias("bits")), [[value(g, c).alias(c) for c in rest] for g in groups], keys, found)


def _covered(marked: DataFrame, groups: list[list[Column]], keys: list[str], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_entities() of (corpus, entity, bits), in which the bits stand for ``groups``."""
    marked = marked.groupBy(keys[0], "entity").agg(F.bit_or("bits").alias("bits"))
    counts = [F.count_if(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"n_{i}") for i in range(len(groups))]
    counted = written(marked.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n_entities_all"), *counts))
    if not groups:
        return found.select(*keys, F.lit(0).cast("long").alias("n_entities")).limit(0), counted
    listed = F.array(*[F.struct(*g, F.col(f"n_{i}").alias("n_entities")) for i, g in enumerate(groups)])
    return counted.select(keys[0], F.explode(listed).alias("g")).select(keys[0], "g.*").where("n_entities > 0"), counted.select(keys[0], "n_entities_all")


def derive(observations: DataFrame, entities: DataFrame | None = None, keys: tuple[str, ...] = ("corpus", "metric"), marked: tuple[list[str], DataFrame] | None = None) -> DataFrame:
    """One row for each group: the judged representative, and what it stands for.

    observations: keys, entity, value. entities: (corpus, n_entities), else counted from the
    observations. marked: the metrics and (corpus, entity, bits), a bit for each metric that the entity has a value
    of, so that entities are counted from a row for each record and not from each observation. Columns: keys, n, median, lo, hi, min, max, cv, verdict, n_all, n_layers (0 where
    the values are one layer of enough values), layers (judged parts by median), n_entities,
    n_entities_all, is_rule.

    The representative is the adopted layer with most values, the lower of equals; without one, the
    whole group is judged. The rest of small layers is always mixed and never a rule. A group of fewer
    than N_MIN values has a single, mixed part beside its own verdict. The values are ranked once; layers, parts and all
    quantiles come from those ranks. Jobs run while the result is built."""
    keys = list(keys)
    found = ordered.placed(ordered.distinct_values(observations, keys), keys)
    whole = _judged(found, keys)
    judged = _judged(_parted(_layered(found, keys), keys), [*keys, "part"]).withColumn("verdict", F.when(F.col("part") == 0, MIXED).otherwise(F.col("verdict")))
    entry = F.struct("median", "part", "n", "lo", "hi", "min", "max", "cv", "verdict")
    listed = judged.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("layers"),
        F.max(F.when(F.col("verdict") == CONSTRAINT, F.struct("n", (-F.col("median")).alias("back"), (-F.col("part")).alias("low"), entry.alias("e"))))["e"].alias("best"),
    )
    if marked is None:
        covered, counted = _entities(observations, found, keys)
    else:
        covered, counted = _covered(marked[1], [[F.lit(m).alias(keys[1])] for m in marked[0]], keys, found)
    entities = counted if entities is None else entities.select(keys[0], F.col("n_entities").alias("n_entities_all"))
    both = joined(joined(joined(whole.withColumn("n_all", F.col("n")), listed, keys), covered, keys), entities, keys[:1], "left")
    plain = (F.size("layers") == 1) & (F.col("layers")[0]["part"] > 0)
    names = ("n", "median", "lo", "hi", "min", "max", "cv", "verdict")
    pick = [F.when(~plain & F.col("best").isNotNull(), F.col(f"best.{c}")).otherwise(F.col(c)).alias(c) for c in names]
    return both.select(*keys, *pick, "n_all", F.when(plain, 0).otherwise(F.size("layers")).alias("n_layers"), "layers", "n_entities", "n_entities_all").withColumn("is_rule", F.col("verdict") == CONSTRAINT)


def derive_measured(table: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """derive() of all observations in what metrics.measured() gave; it should be written, since it is read for the values and
    for the entities."""
    found = metrics.names(table)
    marked = (found, table.select("corpus", "entity", "bits").where("bits <> 0")) if len(found) <= metrics.BITS else None
    return derive(metrics.unpivoted(table), entities, marked=marked)


def coverage(rows: DataFrame, corpus: str, entity: str, has_value: Column) -> DataFrame:
    """(corpus, n_entities, n_entities_all, share): entities that give a value, of all."""
    per = rows.groupBy(corpus, entity).agg(F.max(F.coalesce(has_value, F.lit(False)).cast("int")).alias("has"))
    found = per.groupBy(corpus).agg(F.sum("has").cast("long").alias("n_entities"), F.count(F.lit(1)).alias("n_entities_all"))
    return found.withColumn("share", F.bround(F.col("n_entities") / F.col("n_entities_all"), 6))


def position(value: Column, lo: Column, hi: Column, least: Column, most: Column) -> Column:
    """Where a value lies against a rule: in the band, only in the observed range, or outside."""
    return F.when(value.between(lo, hi), "in_band").when(value.between(F.coalesce(least, lo), F.coalesce(most, hi)), "observed").otherwise("outside")


def catalog(rules: DataFrame, metrics: DataFrame, no_value: str) -> DataFrame:
    """Every metric of the catalog with its rule's numbers; without a rule the verdict is ``no_value``."""
    return metrics.join(rules, "metric", "left").withColumn("verdict", F.coalesce("verdict", F.lit(no_value)))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last one by ``order``, with all columns."""
    names = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *names)).alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.`{c}`").alias(c) for c in rows.columns])


def top(rows: DataFrame, label: str, k: int) -> DataFrame:
    """The ``k`` most frequent labels, equals by label: (rank, label, n)."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "label").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("n"), "label")).cast("long").alias("rank"), "label", "n")
