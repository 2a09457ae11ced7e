"""Smaller pictures, palettes by median cut, and palettes whose near colours are one.

Pictures are tables of pixels (by, y, x, r, g, b). All pictures go through each step together; weights and means are
whole numbers, so every step has one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.ordered import joined
from tallystone.functions.stages import cut
from tallystone.operators import ink

CHANNELS = ("r", "g", "b")
#: Longest side of a picture for its colours and for its forms, colours of a palette, and the distance under
#: which two colours are one.
COLOR_SIDE, FORM_SIDE, COLORS, NEAR = 200, 300, 10, 26


def _nearest(sum_: Column, n: Column) -> Column:
    """sum / n to the nearest whole number, halves up."""
    return F.floor((2 * sum_ + n) / (2 * n))


def thumbnail_sizes(sizes: DataFrame, by: list[str], most: int = COLOR_SIDE) -> DataFrame:
    """(by, width, height, w, h): sizes, and what they are when the longer side is at most ``most``."""
    width, height = F.col("width").cast("long"), F.col("height").cast("long")
    longest = F.greatest(width, height)
    side = lambda v: F.when(longest <= most, v).otherwise(F.greatest(F.lit(1).cast("long"), _nearest(v * most, longest)))
    return sizes.select(*by, width.alias("width"), height.alias("height"), side(width).alias("w"), side(height).alias("h"))


def _parts(at: str, from_: str, to: str) -> Column:
    """The cells of an axis of ``to`` cells that a pixel of an axis of ``from_`` lies in, with the share of each in whole
    numbers: all shares of a cell sum to ``from_``. A pixel is no longer than a cell, so it is in one or two."""
    begin, end = F.col(at).cast("long") * F.col(to), (F.col(at).cast("long") + 1) * F.col(to)
    first, last = F.floor(begin / F.col(from_)), F.floor((end - 1) / F.col(from_))
    return F.transform(F.sequence(first, last), lambda c: F.struct(c.alias("c"), (F.least(end, (c + 1) * F.col(from_)) - F.greatest(begin, c * F.col(from_))).alias("m")))


def thumbnail(pixels: DataFrame, sizes: DataFrame, by: list[str], most: int = COLOR_SIDE, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(by, y, x, channels) of pictures of the sizes (by, width, height), made smaller until no side is over ``most``: each
    pixel counts for the cells it lies in by the area in each. Smaller pictures stay as they are."""
    all_ = joined(pixels, thumbnail_sizes(sizes, by, most), by)
    rows = all_.select(*by, *channels, "width", "height", F.explode(_parts("y", "height", "h")).alias("down"), _parts("x", "width", "w").alias("row"))
    cells = rows.select(*by, *channels, "width", "height", "down", F.explode("row").alias("across")).withColumn("share", F.col("down.m") * F.col("across.m"))
    summed = cells.groupBy(*by, F.col("down.c").alias("y"), F.col("across.c").alias("x")).agg(F.max(F.col("width") * F.col("height")).alias("area"), *[F.sum(F.col("share") * F.col(c)).alias(c) for c in channels])
    return summed.select(*by, "y", "x", *[_nearest(F.col(c), F.col("area")).cast("int").alias(c) for c in channels])


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, g, b, n): how many pixels have a colour."""
    return pixels.groupBy(*by, *CHANNELS).agg(F.count(F.lit(1)).alias("n"))


def median_cut(colors: DataFrame, by: list[str], most: int = COLORS) -> DataFrame:
    """(by, r, g, b, n, box): the box of each colour of histograms (by, r, g, b, n), at most ``most`` boxes a picture.

    In each round every picture's box with most pixels, of those with two colours or more and of equal ones the oldest, is
    split along its longest side (of equal ones r, then g): at the first value up to which it has half of its pixels,
    which is lowered if nothing were above it. All rounds are windows over the colours of a picture, so they are one job with one
    shuffle; a picture of at most 200 by 200 pixels has at most 40 000 colours."""
    held = colors.select(*by, *CHANNELS, "n", F.lit(0).alias("box"))
    whole, each = Window.partitionBy(*by), Window.partitionBy(*by, "box")
    for new in range(1, most):
        ends = {f"{c}{i}": f(c).over(each) for c in CHANNELS for i, f in ((1, F.min), (2, F.max))}
        held = held.withColumns({"all": F.sum("n").over(each), **ends})
        sides = [F.col(f"{c}2") - F.col(f"{c}1") for c in CHANNELS]
        axis = F.coalesce(*[F.when(side == F.greatest(*sides), F.lit(i)) for i, side in enumerate(sides)])
        held = held.withColumn("of", F.max(F.when(F.greatest(*sides) > 0, F.struct("all", (-F.col("box")).alias("box"), axis.alias("axis")))).over(whole))
        along = lambda names: F.element_at(F.array(*[F.col(c) for c in names]), F.col("of.axis") + 1)
        mine = F.coalesce(F.col("box") == -F.col("of.box"), F.lit(False))
        held = held.select(*by, *CHANNELS, "n", "box", "all", mine.alias("mine"), along(CHANNELS).alias("v"), along([f"{c}2" for c in CHANNELS]).alias("top"))
        held = held.withColumn("upto", F.sum("n").over(each.orderBy("v").rangeBetween(Window.unboundedPreceding, 0)))
        below = F.col("mine") & (F.col("v") < F.col("top"))
        at = F.coalesce(F.min(F.when(below & (2 * F.col("upto") >= F.col("all")), F.col("v"))).over(whole), F.max(F.when(below, F.col("v"))).over(whole))
        held = held.withColumn("at", at).select(*by, *CHANNELS, "n", F.when(F.col("mine") & (F.col("v") > F.col("at")), F.lit(new)).otherwise(F.col("box")).alias("box"))
    return held


def palette(boxed: DataFrame, by: list[str]) -> DataFrame:
    """(by, box, r, g, b, n, place): the mean colour of each box of median_cut(), the one with most pixels first."""
    mean = [_nearest(F.sum(F.col(c).cast("long") * F.col("n")), F.sum("n")).cast("int").alias(c) for c in CHANNELS]
    found = boxed.groupBy(*by, "box").agg(*mean, F.sum("n").alias("n"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "box")))


def merged(colors: DataFrame, by: list[str], near: int = NEAR) -> DataFrame:
    """(by, place, leader): in the order of their places, each colour of a palette (by, place, r, g, b) belongs to the first leader
    it is less than ``near`` away from, or leads itself. A picture's palette, some ten colours, is one array."""
    listed = colors.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", *CHANNELS))).alias("all"))
    apart = lambda a, b: sum((((a[c] - b[c]) * (a[c] - b[c])) for c in CHANNELS), F.lit(0))
    start = F.expr("cast(array() as array<struct<place:int,r:int,g:int,b:int>>)")
    leaders = F.aggregate("all", start, lambda held, c: F.when(F.exists(held, lambda h: apart(h, c) < near * near), held).otherwise(F.concat(held, F.array(c))))
    led = F.transform("all", lambda c: F.struct(c["place"].alias("place"), F.get(F.filter("leaders", lambda h: apart(h, c) < near * near), F.lit(0))["place"].alias("leader")))
    return listed.withColumn("leaders", leaders).select(*by, F.explode(led).alias("c")).select(*by, "c.place", "c.leader")


def segmented(pixels: DataFrame, sizes: DataFrame, by: list[str], most: int = FORM_SIDE, colors: int = COLORS) -> DataFrame:
    """(by, y, x, color): the class of each pixel of the smaller pictures: the place of the leader of its palette colour."""
    small = cut(thumbnail(pixels, sizes, by, most))
    boxed = cut(median_cut(histogram(small, by), by, colors))
    shown = palette(boxed, by)
    names = joined(shown.select(*by, "box", "place"), merged(shown, by), [*by, "place"]).select(*by, "box", F.col("leader").alias("color"))
    told = joined(boxed.select(*by, *CHANNELS, "box"), names, [*by, "box"])
    return joined(small, told, [*by, *CHANNELS]).select(*by, "y", "x", "color")


def forms(pixels: DataFrame, sizes: DataFrame, by: list[str], most: int = FORM_SIDE, colors: int = COLORS) -> DataFrame:
    """ink.classes() of whole colour pictures: made smaller, parted into colour classes, each closed by one pixel."""
    small = thumbnail_sizes(sizes, by, most).select(*by, F.col("w").alias("width"), F.col("h").alias("height"))
    classed = segmented(pixels, sizes, by, most, colors)
    large = joined(classed.groupBy(*by, "color").agg(F.count(F.lit(1)).alias("n")), small, by).where("n >= 0.002 * width * height").select(*by, "color", "width", "height")
    key = [*by, "color", "width", "height"]
    whole = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    closed = ink.closed(joined(classed, large, [*by, "color"]), key, whole)
    return ink.classes(closed.drop("width", "height"), by, "color", small, share=0.0)
