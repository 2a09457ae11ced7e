"""Angles of print and turned pictures, as sums over projected pixels and as an equi-join of target with source pixels.

Sines and cosines are taken to 1/65 536 and all places are whole numbers from there on, so the row of a pixel, the source
of a target and every weight are the same on every machine, and ties are ties. A picture is turned about its middle, to the left
for angles above 0, onto a plate that holds all of it; `sources.unrotated` leads points of it back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tallystone.functions import ordered
from tallystone.functions.ordered import joined
from tallystone.functions.stages import written

_BITS = 16
_ONE = 1 << _BITS
#: Pixels around a box that belong to its crop, least width of a box, least side of a crop, and the share of
#: the median that ink is darker than.
PAD, LEAST_WIDTH, LEAST_SIDE, DARK = 6, 40.0, 8, 0.72
#: Most pixels of a picture that one task projects at once, rows of a band of a larger one, and projections worked out at a time.
PICTURE, BAND, _PROJECTED = 1 << 20, 64, 1 << 20
#: Pixels of a cell that boxes and pixels are looked up by.
CELL = 64


def _turn(angle: Column) -> tuple[Column, Column]:
    """Cosine and sine in 65 536ths."""
    return tuple(F.rint(f(F.radians(angle)) * _ONE).cast("long") for f in (F.cos, F.sin))


def plate(width: Column, height: Column, cosine: Column, sine: Column) -> tuple[Column, Column]:
    """The size of the plate that holds a turned picture."""
    up = lambda v: F.shiftright(v + (_ONE - 1), _BITS)
    return up(F.abs(cosine) * width + F.abs(sine) * height), up(F.abs(sine) * width + F.abs(cosine) * height)


def _tried(spark: SparkSession, reach: float, step: float) -> list[tuple[int, int, int]]:
    """(k, cosine, sine) of all angles from -reach to reach, worked out once by Spark and not for each pixel."""
    k = F.col("id")
    rows = spark.range(0, round(2 * reach / step) + 1, 1, 1).select(k, *[v.alias(n) for v, n in zip(_turn(k * step - reach), "cs", strict=True)])
    return sorted((r["id"], r["c"], r["s"]) for r in rows.collect())


def _best(tried: list[tuple[int, int, int]], by: list[str], coarse: int):
    """Of the pixels (by, y, x, width, height) of one picture: (by, k, score, n) of its best angle."""
    last, cosines, sines = len(tried) - 1, np.array([c for _, c, _ in tried]), np.array([s for _, _, s in tried])

    def best(table: pa.Table) -> pa.Table:
        y, x, (w, h) = table["y"].to_numpy(), table["x"].to_numpy(), (table[c][0].as_py() for c in ("width", "height"))
        down, along = 2 * y + 1 - h, 2 * x + 1 - w

        def scores(ks: np.ndarray) -> np.ndarray:
            found = []
            for some in np.array_split(ks, -(-len(ks) * len(y) // _PROJECTED)):
                c, s = cosines[some], sines[some]
                high = (np.abs(s) * w + np.abs(c) * h + (_ONE - 1)) >> _BITS
                row = (c[:, None] * down - s[:, None] * along + (high * _ONE)[:, None]) >> (_BITS + 1)
                row -= row.min()
                span = int(row.max()) + 1
                row += np.arange(len(some))[:, None] * span
                if span <= 4 * len(y) + 1024:
                    n = np.bincount(row.ravel(), minlength=span * len(some)).reshape(len(some), span)
                    squares = (n * n).sum(axis=1)
                else:
                    at, n = np.unique(row.ravel(), return_counts=True)
                    squares = np.add.reduceat(n * n, np.searchsorted(at // span, np.arange(len(some))))
                found.append(squares * high)
            return np.concatenate(found)

        # the first of equal scores, as argmax takes it
        ks = np.arange(0, last + 1, coarse)
        score = scores(ks)
        if coarse > 1:
            near = int(ks[score.argmax()])
            ks = np.arange(max(0, near - coarse + 1), min(last, near + coarse - 1) + 1)
            score = scores(ks)
        top = int(score.argmax())
        told = table.select(by).slice(0, 1)
        for name, value in (("k", int(ks[top])), ("score", int(score[top])), ("n", len(y))):
            told = told.append_column(name, pa.array([value], pa.int64()))
        return told

    return best


def _scores(ink: DataFrame, sizes: DataFrame, by: list[str], angles: Column) -> DataFrame:
    """(by, k, score, n): for each of an array of struct(k, c, s) the squares of the ink in each row of the turned picture, times
    its rows; the larger, the more the ink is in few of them. Pixels are dealt by bands of rows, within which they are summed."""
    dealt = ink.select(*by, "y", "x", F.floor(F.col("y") / BAND).alias("__band")).repartition(*by, "__band").distinct().drop("__band")
    spread = joined(dealt, sizes, by).withColumn("a", F.explode(angles))
    c, s = F.col("a.c"), F.col("a.s")
    high = plate(F.col("width"), F.col("height"), c, s)[1]
    row = F.shiftright(c * (2 * F.col("y") + 1 - F.col("height")) - s * (2 * F.col("x") + 1 - F.col("width")) + high * _ONE, _BITS + 1)
    rows = spread.groupBy(*by, F.col("a.k").alias("k"), high.alias("high"), row.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*by, "k", "high").agg((F.sum(F.col("n") * F.col("n")) * F.col("high")).alias("score"), F.sum("n").alias("n")).drop("high")


def _sharpest_large(ink: DataFrame, sizes: DataFrame, by: list[str], tried: list[tuple[int, int, int]], coarse: int) -> DataFrame:
    """(by, k, score, n) of the best angle of pictures that no task holds."""
    listed = lambda some: F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("kcs", t, strict=True)]) for t in some])
    # the first of equal scores: the largest of the negative numbers
    top = F.max(F.struct("score", (-F.col("k")).alias("k"), "n")).alias("top")
    found = _scores(ink, sizes, by, listed(tried[::coarse])).groupBy(*by).agg(top)
    if coarse > 1:
        near, last = found.select(*by, (-F.col("top.k")).alias("near")), len(tried) - 1
        first, to = F.greatest(F.lit(0), F.col("near") - coarse + 1), F.least(F.lit(last), F.col("near") + coarse - 1)
        around = F.slice(listed(tried), (first + 1).cast("int"), (to - first + 1).cast("int"))
        found = _scores(ink, joined(sizes, near, by), by, around).groupBy(*by).agg(top)
    return found.select(*by, (-F.col("top.k")).alias("k"), F.col("top.score").alias("score"), F.col("top.n").alias("n"))


def sharpest(ink: DataFrame, sizes: DataFrame, by: list[str], reach: float = 90.0, step: float = 0.5, coarse: int = 1) -> DataFrame:
    """(by, angle, sharpness): the angle from -reach to reach at which the ink of pictures (by, y, x) of the sizes (by, width,
    height) varies most from row to row, the first of equal ones, and there the deviation of the rows' ink as a share of its mean.

    Pictures of at most ``PICTURE`` pixels are each projected where their pixels are, so that only pixels are shuffled; larger ones
    are dealt by bands of rows, and the rows' sums are shuffled. The sizes are written once to tell whether there are any.
    With ``coarse`` above 1 only each so many-th angle is tried, and then those around the best, so a peak narrower than that can
    be missed; the angles are as many as for 1 in the result, but far fewer are tried. Pictures without ink have no row."""
    sizes = written(sizes.select(*by, F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")))
    ink = ink.where("y is not null and x is not null").select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    tried = _tried(ink.sparkSession, reach, step)
    fits = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") <= PICTURE / F.col("height")), F.lit(False))
    large = sizes.where(~fits)
    held = joined(ink.distinct(), sizes.where(fits), by)
    schema = StructType([*[held.schema[c] for c in by], *[StructField(c, LongType()) for c in ("k", "score", "n")]])
    found = held.groupBy(*by).applyInArrow(_best(tried, by, coarse), schema)
    if not large.isEmpty():
        found = found.unionByName(_sharpest_large(joined(ink, large.select(*by), by), large, by, tried, coarse))
    score = F.sqrt(F.greatest(F.col("score") / F.col("n") / F.col("n") - 1, F.lit(0.0)))
    return found.select(*by, (F.col("k") * step - reach).cast("double").alias("angle"), score.alias("sharpness"))


def crops(pixels: DataFrame, boxes: DataFrame, by: list[str], pad: int = PAD) -> tuple[DataFrame, DataFrame]:
    """(by, box, y, x, gray) of what the boxes (by, box, quad) hold of pictures, with ``pad`` pixels around and numbered from 0, and
    (by, box, width, height). Boxes and pixels meet on cells, so no picture is compared with all its boxes."""
    xs, ys = F.transform("quad", lambda p: p["x"]), F.transform("quad", lambda p: p["y"])
    ends = {"x1": F.array_min(xs).cast("long") - pad, "y1": F.array_min(ys).cast("long") - pad, "x2": F.array_max(xs).cast("long") + pad, "y2": F.array_max(ys).cast("long") + pad}
    ends = boxes.select(*by, "box", *[F.greatest(e, F.lit(0).cast("long")).alias(c) if c in ("x1", "y1") else e.alias(c) for c, e in ends.items()])
    cell = lambda c: F.floor(F.col(c) / CELL)
    looked = ends.withColumn("cx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("cy", F.explode(F.sequence(cell("y1"), cell("y2"))))
    inside = joined(pixels.withColumns({"cx": cell("x"), "cy": cell("y")}), looked, [*by, "cx", "cy"]).where("x >= x1 and x < x2 and y >= y1 and y < y2")
    cut = written(inside.select(*by, "box", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray"))
    return cut, cut.groupBy(*by, "box").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def dark(pixels: DataFrame, by: list[str], share: float = DARK) -> DataFrame:
    """The pixels that are darker than a share of their picture's median."""
    level = ordered.quantiles(pixels, by, {"level": 0.5}, "gray")
    return joined(pixels, level, by).where(F.col("gray") < F.col("level") * share).drop("level")


def box_angles(pixels: DataFrame, boxes: DataFrame, by: list[str], step: float = 0.5, coarse: int = 1) -> DataFrame:
    """(by, box, w, angle, sharpness) of text boxes (by, box, quad) of pictures (by, y, x, gray) that are wide enough and not cut to
    nothing; a quarter turn cannot be told from this alone."""
    a, b = F.get("quad", F.lit(0)), F.get("quad", F.lit(1))
    wide = boxes.withColumn("w", F.hypot(b["x"] - a["x"], b["y"] - a["y"])).where(F.col("w") >= LEAST_WIDTH)
    held, sizes = crops(pixels, wide, by)
    key = [*by, "box"]
    large = sizes.where((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    found = sharpest(dark(joined(held, large.select(*key), key), key), large, key, step=step, coarse=coarse)
    return joined(found, wide.select(*key, "w"), key).select(*key, "w", "angle", "sharpness")


def _nearest(angle: Column, middle: Column, half: float) -> Column:
    """The angle, one turn of twice ``half`` away if it is more than ``half`` from the middle."""
    return F.when(angle - middle > half, angle - 2 * half).when(middle - angle > half, angle + 2 * half).otherwise(angle)


def read_angles(found: DataFrame, readings: DataFrame, by: list[str]) -> DataFrame:
    """(by, box, w, angle, coarse, score, text): which of the four quarter turns of each box's angle was read best, the first of equal
    ones. readings: (by, box, angle, conf, text), what a reader saw in the crop turned by the angle; a turn's score is the
    largest of conf times length of text. Boxes that were not read at any of the four are left out."""
    key = [*by, "box"]
    whole = lambda a: a - 360 * F.rint(a / 360)
    # boxes meet their readings once; each reading then names the first of the four turns that it is of
    seen = readings.where("text is not null and conf is not null").select(*key, F.col("angle").alias("at"), (F.col("conf") * F.length("text")).alias("score"), "text")
    both = joined(seen, found.select(*key, "w", F.col("angle").alias("coarse")), key)
    turn = F.coalesce(*[F.when(F.col("at").eqNullSafe(whole(F.col("coarse") + t)), i) for i, t in enumerate((0, 90, -90, 180))])
    turned = F.element_at(F.array(*[whole(F.col("coarse") + t) for t in (0, 90, -90, 180)]), F.col("turn") + 1)
    both = both.withColumn("turn", turn).where("turn is not null").withColumn("angle", turned)
    best = both.groupBy(*key).agg(F.max(F.struct("score", (-F.col("turn")).alias("turn"), "text", "angle", "coarse", "w")).alias("b"))
    return best.select(*key, "b.w", "b.angle", "b.coarse", F.bround("b.score", 2).alias("score"), "b.text")


def poster_angle(read: DataFrame, by: list[str]) -> DataFrame:
    """(by, angle, n): the median of the boxes' angles, each half a turn away where it is nearer to the median then."""
    # all on the distinct angles, so whatever the readings come from runs once
    found = ordered.placed(ordered.distinct_values(read, by, "angle"), by)
    middle = ordered.quantiles_of(found, by, {"middle": 0.5})
    moved = joined(found, middle, by).select(*by, _nearest(F.col("value"), F.col("middle"), 90.0).alias("value"), "n")
    again = ordered.with_group(ordered.placed(moved.groupBy(*by, "value").agg(F.sum("n").alias("n")), by), by, {"all": F.sum("n")})
    return again.groupBy(*by).agg(ordered.at_share(F.lit(0.5), F.col("all")).alias("angle"), F.max("all").alias("n"))


def _middle(values: str) -> Column:
    """The median of a sorted array; null without values."""
    at = lambda i: F.get(values, F.floor(i / 2).cast("int"))
    return (at(F.size(values) - 1) + at(F.size(values))) / 2


def _deviation(values: str, middle: str) -> Column:
    """The population deviation of an array, which is summed in its order about a value in the middle of it; null without values."""
    n = F.size(values)
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda t, v: t + f(v - F.col(middle)))
    first, squares = total(lambda d: d), total(lambda d: d * d)
    return F.when(n > 0, F.sqrt(F.greatest(n * squares - first * first, F.lit(0.0))) / n)


def skew_by_reading(found: DataFrame, readings: DataFrame, by: list[str], widest: int = 8, looked: int = 2) -> DataFrame:
    """(by, angle, spread): the angle to turn pictures by. The median of the widest boxes' angles (by, box, w, angle), those over 45
    from it a quarter turn nearer, or a quarter turn from that, whichever was read best: by the sum over the ``looked`` widest boxes of
    the best conf times length of text, the first of equal ones. 0 if it is under 1 or over 10, or the angles are
    spread over more than 2. readings: (by, box, turn, conf, text) with turn 0, 90 or -90 from the median.
    The spread is their population deviation, worked out from the sorted angles, so that a border of exactly 2 doesn't
    depend on the order of rows; on angles that are multiples of a half or another power of two it is exact."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "box"))
    best = found.withColumn("place", place).where(F.col("place") <= widest)
    # at most ``widest`` rows of a picture are left
    held = best.groupBy(*by).agg(F.array_sort(F.collect_list("angle")).alias("angles")).withColumn("angle", _middle("angles"))
    moved = held.withColumn("angles", F.array_sort(F.transform("angles", lambda a: _nearest(a, F.col("angle"), 45.0)))).withColumn("angle", _middle("angles"))
    middle = moved.select(*by, "angle", _deviation("angles", "angle").alias("spread"))
    heads = best.where(F.col("place") <= looked).select(*by, "box")
    # a box is one row with its three turns
    turns = {0: 0, 90: -1, -90: -2}
    score = F.col("conf") * F.length("text")
    own = {t: F.when(F.col("turn") == t, score) for t in turns}
    read = readings.where("turn in (0, 90, -90)").groupBy(*by, "box").agg(*[F.max(c).alias(f"s{i}") for i, c in enumerate(own.values())])
    sums = joined(read, heads, [*by, "box"]).groupBy(*by).agg(*[F.sum(F.coalesce(f"s{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(turns))])
    # a turn that nobody read has the score 0, so the median itself wins where nothing was read
    listed = [F.when(F.col(f"s{i}") > 0, F.struct(F.col(f"s{i}").alias("score"), F.lit(o).alias("order"), F.lit(t).alias("turn"))) for i, (t, o) in enumerate(turns.items())]
    won = sums.select(*by, F.greatest(*listed)["turn"].alias("turn"))
    told = joined(middle, won, by, "left")
    turned = F.col("angle") + F.when(F.abs("angle") < 1, 0).otherwise(F.coalesce("turn", F.lit(0)))
    keep = (F.abs("angle") >= 1) & (F.abs(turned) <= 10) & (F.col("spread") <= 2)
    return told.select(*by, F.when(keep, turned).otherwise(0.0).alias("angle"), "spread")


def turned_sizes(sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, width, height) of pictures (by, width, height, angle) after they are turned."""
    c, s = _turn(F.col("angle"))
    w, h = plate(F.col("width").cast("long"), F.col("height").cast("long"), c, s)
    return sizes.select(*by, w.alias("width"), h.alias("height"))


def turned(pixels: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x, gray) of pictures (by, y, x, gray) of the sizes (by, width, height, angle), turned by their angles.

    Each target pixel names up to four source pixels around the place it comes from, with weights that sum to 1; at
    the edge the outermost ones stand for those beyond. Source and target meet in an equi-join, so no picture is held by a task.
    What comes from beyond the picture is filled with its median, cut to a whole number."""
    c, s = _turn(F.col("angle"))
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    wide, high = plate(w, h, c, s)
    to = sizes.select(*by, w.alias("w"), h.alias("h"), c.alias("c"), s.alias("s"), wide.alias("wide"), high.alias("high"))
    zero = F.lit(0).cast("long")
    to = to.withColumn("ty", F.explode(F.sequence(zero, F.col("high") - 1))).withColumn("tx", F.explode(F.sequence(zero, F.col("wide") - 1)))
    dx, dy = 2 * F.col("tx") + 1 - F.col("wide"), 2 * F.col("ty") + 1 - F.col("high")
    unit = _ONE * 2
    to = to.select(*by, "ty", "tx", "w", "h", (F.col("c") * dx - F.col("s") * dy + F.col("w") * _ONE).alias("u"), (F.col("s") * dx + F.col("c") * dy + F.col("h") * _ONE).alias("v"))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("w") * unit) & (F.col("v") >= 0) & (F.col("v") < F.col("h") * unit)
    to = to.withColumn("inside", inside)

    def ends(at: str, size: str) -> Column:
        """The two source places around a place along one axis, within the picture, and their weights."""
        middle = F.col(at) - _ONE
        low, part = F.shiftright(middle, _BITS + 1), F.pmod(middle, F.lit(unit))
        within = lambda p: F.greatest(zero, F.least(p, F.col(size) - 1))
        return F.array(F.struct(within(low).alias("p"), (F.lit(unit) - part).alias("m")), F.struct(within(low + 1).alias("p"), part.alias("m")))

    named = to.where("inside").select(*by, "ty", "tx", F.explode(ends("v", "h")).alias("a"), ends("u", "w").alias("row")).where("a.m > 0")
    named = named.select(*by, "ty", "tx", "a", F.explode("row").alias("b")).where("b.m > 0")
    named = named.select(*by, "ty", "tx", F.col("a.p").alias("y"), F.col("b.p").alias("x"), (F.col("a.m") * F.col("b.m")).alias("m"))
    source = pixels.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "gray")
    drawn = joined(named, source, [*by, "y", "x"]).groupBy(*by, "ty", "tx").agg((F.sum(F.col("m") * F.col("gray")) / (unit * unit)).alias("gray"))
    fill = ordered.quantiles(pixels, by, {"fill": 0.5}, "gray")
    empty = joined(to.where("not inside").select(*by, "ty", "tx"), fill, by).select(*by, "ty", "tx", F.floor("fill").cast("double").alias("gray"))
    return drawn.unionByName(empty).withColumnsRenamed({"ty": "y", "tx": "x"})
