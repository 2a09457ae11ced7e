"""Ink as rows: runs, connected components, size classes, closing, border trim.

Pictures are tables of ink pixels (by, y, x). A row's pixels become runs, runs of neighbouring rows
that touch become edges, and components of these edges are the letters. All pictures are worked on
together, so none of them is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import graph, ordered
from tallystone.functions.ordered import joined
from tallystone.functions.stages import written
from tallystone.operators.spatial import cells

#: Columns of a picture that runs are looked up by.
CELL = 64


def row_runs(ink: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x1, x2): stretches of neighbouring ink pixels within a row, both ends included."""
    row = Window.partitionBy(*by, "y").orderBy("x")
    return ink.select(*by, "y", "x").distinct().withColumn("run", F.col("x") - F.row_number().over(row)).groupBy(*by, "y", "run").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("run")


def labelled_runs(ink: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """row_runs() with ``component``: the first run of the component as (by, y, x1). Pixels that share a
    side belong together, with ``diagonal`` those that share a corner too."""
    runs = written(row_runs(ink, by)).withColumn("node", F.struct(*by, "y", "x1"))
    reach = int(diagonal)
    upper = runs.withColumn("cell", F.explode(cells(F.col("x1") - reach, F.col("x2") + reach, CELL)))
    lower = runs.select(*[F.col(c).alias(f"l_{c}") for c in (*by, "x1", "x2")], (F.col("y") - 1).alias("l_y"), F.col("node").alias("l_node"))
    lower = lower.withColumn("l_cell", F.explode(cells(F.col("l_x1"), F.col("l_x2"), CELL)))
    near = (F.col("x1") <= F.col("l_x2") + reach) & (F.col("l_x1") <= F.col("x2") + reach)
    for c in (*by, "y", "cell"):
        near = near & (F.col(c) == F.col(f"l_{c}"))
    found = graph.components(upper.join(lower, near).select(F.col("node").alias("a"), F.col("l_node").alias("b")))
    return runs.join(found, "node", "left").select(*by, "y", "x1", "x2", F.coalesce("component", "node").alias("component"))


def components(ink: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """(by, component, area, x1, y1, x2, y2): each connected component's pixels and half-open box."""
    return labelled_runs(ink, by, diagonal).groupBy(*by, "component").agg(
        F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), F.min("x1").alias("x1"), F.min("y").alias("y1"), (F.max("x2") + 1).alias("x2"), (F.max("y") + 1).alias("y2")
    )


def body_height(found: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, body): the median height of components of at least ``least`` rows, 0 without any."""
    tall = found.select(*by, (F.col("y2") - F.col("y1")).cast("double").alias("value")).where(F.col("value") >= least)
    return joined(found.select(*by).distinct(), ordered.quantiles(tall, by, {"body": 0.5}), by, "left").select(*by, F.coalesce("body", F.lit(0.0)).alias("body"))


def strata(found: DataFrame, by: list[str], ratio: float = 3.0) -> DataFrame:
    """Components with ``body`` and ``tall``: whether they are more than ``ratio`` times the body height."""
    return joined(found, body_height(found, by), by).withColumn("tall", (F.col("body") > 0) & (F.col("y2") - F.col("y1") > ratio * F.col("body")))


def least_area(width: Column, height: Column) -> Column:
    """Fewer pixels than that are no shape in a picture of this size."""
    return F.greatest(F.lit(12.0), 0.0004 * width * height)


def classes(ink: DataFrame, by: list[str], color: str, sizes: DataFrame, share: float = 0.002) -> DataFrame:
    """(by, color, share, area, n_comp, top1, top3, solidity, place): the shape of each colour of pictures (by, y, x, color)
    of the sizes (by, width, height), largest share first. Colours of less than ``share`` of the picture, and components
    of fewer pixels than least_area(), are left out."""
    whole = F.col("width") * F.col("height")
    counted = joined(ink.groupBy(*by, color).agg(F.count(F.lit(1)).alias("pixels")), sizes, by).where(F.col("pixels") >= share * whole)
    kept = joined(ink, counted.select(*by, color), [*by, color])
    parts = joined(components(kept, [*by, color]), sizes, by)
    formed = joined(shape(parts, [*by, color], least_area(F.col("width"), F.col("height"))), sizes, by)
    formed = formed.withColumn("share", F.bround(F.col("area") / whole, 4)).drop("width", "height")
    return formed.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("share"), color)))


def shape(found: DataFrame, by: list[str], floor: Column | None = None) -> DataFrame:
    """(by, area, n_comp, top1, top3, solidity) of components of at least ``floor`` pixels: the shares of
    the largest and the three largest, and the median share of its box that a component fills."""
    kept = found.where(F.col("area") >= (F.lit(12) if floor is None else floor))
    row = Window.partitionBy(*by).orderBy(F.desc("area"), "component")
    top = kept.withColumn("place", F.row_number().over(row)).where("place <= 3").groupBy(*by).agg(F.max("area").alias("one"), F.sum("area").alias("three"))
    filled = F.col("area") / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    sums = kept.groupBy(*by).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n_comp"))
    solid = ordered.quantiles(kept.select(*by, filled.alias("value")), by, {"solidity": 0.5})
    both = joined(joined(sums, top, by), solid, by)
    return both.select(*by, "area", "n_comp", F.bround(F.col("one") / F.col("area"), 3).alias("top1"), F.bround(F.col("three") / F.col("area"), 3).alias("top3"), F.bround("solidity", 3).alias("solidity"))


def closed(ink: DataFrame, by: list[str], plate: Column | None = None, reach: int = 1) -> DataFrame:
    """Ink after growing by ``reach`` pixels on all sides and shrinking by as many; ``plate`` says which
    pixels (y, x) the picture has, and none beyond it counts as ink."""
    side = F.sequence(F.lit(-reach), F.lit(reach))

    def spread(rows: DataFrame) -> DataFrame:
        up = rows.select(*by, "y", "x", F.explode(side).alias("dy"))
        return up.select(*by, (F.col("y") + F.col("dy")).alias("y"), "x", F.explode(side).alias("dx")).select(*by, "y", (F.col("x") + F.col("dx")).alias("x"))

    grown = spread(ink.select(*by, "y", "x")).distinct()
    if plate is not None:
        grown = grown.where(plate)
    return spread(grown).groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == (2 * reach + 1) ** 2).drop("n")


def _border(values: Column, share: float, fringe: int) -> Column:
    """How many of an array's first shares are border: those above ``share``, and if there are any, up to
    ``fringe`` more that are above 0."""
    first = lambda flags: F.coalesce(F.nullif(F.array_position(flags, True), F.lit(0)) - 1, F.size(flags)).cast("int")
    dark = first(F.transform(values, lambda v: v <= share))
    return F.when(dark > 0, dark + first(F.transform(F.slice(values, dark + 1, fringe), lambda v: v <= 0))).otherwise(0)


def trimmed(shares: DataFrame, by: list[str], share: float = 0.8, fringe: int = 3) -> DataFrame:
    """(by, first, end): what is left of an axis without its dark borders; shares: (by, at, value) is the
    share of ink in each of its rows or columns, from 0 on without gaps. All dark gives first >= end."""
    axis = shares.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("values"))
    return axis.select(*by, _border(F.col("values"), share, fringe).alias("first"), (F.size("values") - _border(F.reverse("values"), share, fringe)).alias("end"))


def dark_edges(ink: DataFrame, boxes: DataFrame, by: list[str], limit: float = 0.35) -> DataFrame:
    """(by, side, share) of sides of a trimmed box (by, x1, y1, x2, y2) whose outermost pixels are ink by
    more than ``limit``: remains of a border, since letters never fill a side."""
    inside = joined(ink, boxes, by).where("x >= x1 and x < x2 and y >= y1 and y < y2")
    sides = {"left": (F.col("x") == F.col("x1"), "h"), "right": (F.col("x") == F.col("x2") - 1, "h"), "top": (F.col("y") == F.col("y1"), "w"), "bottom": (F.col("y") == F.col("y2") - 1, "w")}
    seen = inside.groupBy(*by).agg(*[F.count_if(at).alias(name) for name, (at, _) in sides.items()], F.max(F.col("x2") - F.col("x1")).alias("w"), F.max(F.col("y2") - F.col("y1")).alias("h"))
    listed = F.array(*[F.struct(F.lit(name).alias("side"), (F.col(name) / F.col(length)).alias("share")) for name, (_, length) in sides.items()])
    return seen.select(*by, F.explode(listed).alias("s")).select(*by, "s.side", F.bround("s.share", 3).alias("share"), (F.col("s.share") > limit).alias("bad")).where("bad").drop("bad")
