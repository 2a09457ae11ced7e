"""Lines of text from ink profiles and components, and the blocks that they form.

A line's rows, and a column's lines, are as many as a picture has rows at most; they are gathered
into arrays, and everything is a projection over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.ordered import joined
from tallystone.operators.layout import gaps
from tallystone.operators.metrics import middle

# Where blocks part.
GAP_RATIO, SIZE_RATIO, SIZE_LEAST, AXIS = 1.5, 0.25, 2.0, 2.0
#: Fixed value: the row after the last one of a letter's body is its baseline.
BASE_OFFSET = 1


def baselines(profile: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """(by, base): the row after the last one whose ink is at least ``share`` of what the fuller half of
    the rows has; null without ink. profile: (by, at, value), the rows of each line."""
    inked = F.col("value") > 0
    rows = profile.groupBy(*by).agg(F.collect_list(F.when(inked, F.struct("at", "value"))).alias("rows"))
    value = F.transform("rows", lambda r: r["value"].cast("double"))
    rows = rows.withColumn("half", middle(value))
    rows = rows.withColumn("level", share * middle(F.filter(value, lambda v: v >= F.col("half"))))
    return rows.select(*by, (F.array_max(F.transform(F.filter("rows", lambda r: r["value"] >= F.col("level")), lambda r: r["at"])) + BASE_OFFSET).alias("base"))


def marks(profile: DataFrame, parts: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, x_top, cap, mark_top, n_mark, kind) of each line. x_top is the first row with half of the
    most ink; components (by, y1, y2, half-open) that end above it are marks, the others body; the
    body's top is the cap if it is ``least`` rows above x_top. kind: ascender, x_only or none."""
    rows = profile.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows"), F.max("value").alias("most"))
    tops = rows.select(*by, F.get(F.filter("rows", lambda r: r["value"] >= 0.5 * F.col("most")), F.lit(0))["at"].alias("x_top"), (F.col("most") > 0).alias("inked"))
    above = F.col("y2") <= F.col("x_top")
    both = joined(tops, parts.select(*by, "y1", "y2"), by, "left").groupBy(*by, "x_top", "inked").agg(F.min(F.when(~above, F.col("y1"))).alias("body"), F.min(F.when(above, F.col("y1"))).alias("mark_top"), F.count_if(above).alias("n_mark"))
    high = F.col("inked") & (F.col("x_top") - F.col("body") >= least)
    kind = F.when(F.col("body").isNull() | ~F.col("inked"), "none").when(high, "ascender").otherwise("x_only")
    return both.select(*by, "x_top", F.when(high, F.col("body")).alias("cap"), "mark_top", "n_mark", kind.alias("kind"))


def descenders(parts: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, desc): below the lowest component of at least ``least`` rows, of those found in the rows under
    each line's baseline (by, y1, y2, half-open); null where all are thinner."""
    return parts.groupBy(*by).agg(F.max(F.when(F.col("y2") - F.col("y1") >= least, F.col("y2"))).alias("desc"))


def on_grid(bases: Column, lead: Column, apart: float = 2.0) -> Column:
    """struct(fitted, lead, residual) of a block's ordered baselines on a grid of equal steps, ``lead``
    being what the autocorrelation gives; its phase is the mean of what is left. With fewer than three
    baselines, no lead, or one more than ``apart`` from the median step, the baselines stay as they are."""
    fit = F.coalesce((F.size(bases) >= 3) & (lead > 0) & (F.abs(lead - middle(gaps(bases))) <= apart), F.lit(False))
    first, n = F.get(bases, F.lit(0)), F.size(bases)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    steps = F.transform(bases, lambda b: F.rint((b - first) / lead))
    phase = total(F.zip_with(bases, steps, lambda b, k: b - k * lead)) / n
    fitted = F.transform(F.array(phase), lambda p: F.transform(steps, lambda k: F.rint(p + k * lead)))[0]
    off = total(F.zip_with(bases, fitted, lambda b, f: F.abs(f - b))) / n
    plain = F.struct(bases.cast("array<double>").alias("fitted"), F.lit(None).cast("double").alias("lead"), F.lit(0.0).alias("residual"))
    return F.when(fit, F.struct(fitted.alias("fitted"), lead.cast("double").alias("lead"), off.alias("residual"))).otherwise(plain)


def block_numbers(lines: Column) -> Column:
    """For an array of struct(base, xs, xe, xh), ordered by base, the number of each line's block, from 0.

    A block ends where the step is over GAP_RATIO times the median one, where no left, right or middle
    axis is shared within AXIS, or where this line and the next both differ in size from the median of
    the block so far; one odd line alone, or the last one, is no change of size."""
    usual = middle(gaps(F.transform(lines, lambda s: s["base"])))
    start = F.struct(F.array(F.lit(0)).alias("numbers"), F.slice(F.transform(lines, lambda s: s["xh"].cast("double")), 1, 1).alias("sizes"), usual.alias("usual"))

    def step(done: Column, i: Column) -> Column:
        a, b, after = F.get(lines, i - 1), F.get(lines, i), F.get(lines, i + 1)
        axis = (F.abs(a["xs"] - b["xs"]) <= AXIS) | (F.abs(a["xe"] - b["xe"]) <= AXIS) | (F.abs(a["xs"] + a["xe"] - b["xs"] - b["xe"]) <= 2 * AXIS)

        def ends(size: Column) -> Column:
            other = lambda s: (F.abs(size - s["xh"]) > SIZE_LEAST) & (F.abs(size - s["xh"]) > SIZE_RATIO * F.least(size, s["xh"]))
            return (b["base"] - a["base"] > GAP_RATIO * done["usual"]) | ~axis | (other(b) & F.coalesce(other(after), F.lit(False)))

        def placed(new: Column) -> Column:
            number = F.element_at(done["numbers"], -1) + F.when(new, 1).otherwise(0)
            own = F.array(b["xh"].cast("double"))
            return F.struct(F.concat(done["numbers"], F.array(number)).alias("numbers"), F.when(new, own).otherwise(F.concat(done["sizes"], own)).alias("sizes"), done["usual"].alias("usual"))

        # medians and the decision are bound once: each use would work them out anew
        return F.get(F.transform(F.transform(F.array(middle(done["sizes"])), ends), placed), F.lit(0))

    n = F.size(lines)
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(2)) - 1), start, step, lambda d: d["numbers"])).when(n == 1, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))


def numbered(rows: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, base, xs, xe, xh, top, keep): the lines of each column with the number of their block."""
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("base", "xs", "xe", "xh", "top", *keep))).alias("lines"))
    both = listed.withColumn("numbers", block_numbers(F.col("lines")))
    return both.select(*by, F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("numbers").alias("block"))).alias("z")).select(*by, "z.block", "z.line.*")


def blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, n, x1, y1, x2, y2, height, xh): the blocks of the lines (by, top, base, xs, xe, xh) of
    each column, with their box, the median line height and the median x-height to one place."""
    return numbered(rows, by).groupBy(*by, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("xs").alias("x1"), F.min("top").alias("y1"), F.max("xe").alias("x2"), F.max("base").alias("y2"),
        middle(F.collect_list((F.col("base") - F.col("top")).cast("double"))).alias("height"), F.bround(middle(F.collect_list(F.col("xh").cast("double"))), 1).alias("xh"),
    )


#: How low and narrow a fragment is beside its line, and how far away.
FRAGMENT_HEIGHT, FRAGMENT_WIDTH, FRAGMENT_GAP, FRAGMENT_NEAR = 0.5, 0.40, 0.6, 3.0


def absorbed(strips: Column, least: int = 4) -> Column:
    """Strips of ink, struct(s, e, x0, x1) in order, of which fragments have gone into the line beside them: those that
    lie within its width, with a pixel to spare, are at most half as high and FRAGMENT_WIDTH as wide, and near. The nearer
    neighbour takes them, of equals the next one, and grows by their rows, so later strips meet it as it is then. Strips of
    fewer than ``least`` rows that nothing takes are dropped."""
    whole = F.transform(strips, lambda t: F.struct(t["s"].cast("long").alias("s"), t["e"].cast("long").alias("e"), t["x0"].cast("long").alias("x0"), t["x1"].cast("long").alias("x1"), F.lit(False).alias("kept")))
    high = lambda t: t["e"] - t["s"]
    width = lambda t: t["x1"] - t["x0"]

    def step(done: Column, i: Column) -> Column:
        own = F.get(done, i)

        def taker(other: Column, gap: Column, order: int, at: Column) -> Column:
            inside = (own["x0"] >= other["x0"] - 1) & (own["x1"] <= other["x1"] + 1)
            small = (high(own) <= FRAGMENT_HEIGHT * high(other)) & (width(own) <= FRAGMENT_WIDTH * F.greatest(width(other), F.lit(1)))
            fits = other.isNotNull() & (high(other) > high(own)) & inside & small & (gap <= F.greatest(F.lit(FRAGMENT_NEAR), FRAGMENT_GAP * high(other)))
            return F.when(fits, F.struct(gap.alias("gap"), F.lit(order).alias("order"), at.alias("at")))

        after, before = F.get(done, i + 1), F.when(i > 0, F.get(done, i - 1))
        best = F.array_min(F.array_compact(F.array(taker(after, after["s"] - own["e"], 0, i + 1), taker(before, own["s"] - before["e"], 1, i - 1))))

        def moved(taken: Column) -> Column:
            grown = lambda t: F.struct(F.least(t["s"], own["s"]).alias("s"), F.greatest(t["e"], own["e"]).alias("e"), t["x0"].alias("x0"), t["x1"].alias("x1"), t["kept"].alias("kept"))
            settled = lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["x0"].alias("x0"), t["x1"].alias("x1"), (taken.isNull() & (high(t) >= least)).alias("kept"))
            return F.transform(done, lambda t, k: F.when(k == taken["at"], grown(t)).when(k == i, settled(t)).otherwise(t))

        # the neighbour is found once: each use would look for it anew
        return F.get(F.transform(F.array(best), moved), F.lit(0))

    n = F.size(strips)
    left = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), whole, step)).otherwise(whole)
    return F.transform(F.filter(left, lambda t: t["kept"]), lambda t: t.dropFields("kept"))


def spread(values: Column) -> Column:
    """The population standard deviation of an array of numbers."""
    n, total = F.size(values), lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, F.sqrt(F.get(F.transform(F.array(total(values) / n), lambda m: total(F.transform(values, lambda x: (x - m) * (x - m)))), F.lit(0)) / n))


def alignment(left: Column, right: Column, loose: float = 3.0) -> Column:
    """struct(align, left, right, center) of arrays of line ends: the spread of each axis and the name of
    the smallest, ``none`` if it is over ``loose``, null with fewer than two lines. Of equal ones, to nine
    places so that no rounding error decides, left comes before right and right before center."""
    ends = {"left": left, "right": right, "center": F.zip_with(left, right, lambda a, b: (a + b) / 2)}
    axes = {k: F.bround(spread(v), 9) for k, v in ends.items()}
    least = F.least(*axes.values())
    name = F.coalesce(*[F.when(s == least, k) for k, s in axes.items()])
    return F.struct(F.when(F.size(left) >= 2, F.when(least <= loose, name).otherwise("none")).alias("align"), *[F.bround(s, 2).alias(k) for k, s in axes.items()])
