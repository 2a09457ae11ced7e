"""Joins on rectangles, intervals and bands, bucketed so that no pairs far apart are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.stages import written


def cells(lo: Column, hi: Column, width: float) -> Column:
    """The numbers of the grid cells an interval touches."""
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))


def uncovered(rows: DataFrame, covers: DataFrame, by: list[str], width: float) -> DataFrame:
    """Rows (by, row_id, lo, hi) whose half-open interval meets none of ``covers`` (by, lo, hi)."""
    a = rows.withColumn("cell", F.explode(cells(F.col("lo"), F.col("hi"), width)))
    b = covers.select(*[F.col(c).alias(f"c_{c}") for c in by], F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    b = b.withColumn("c_cell", F.explode(cells(F.col("c_lo"), F.col("c_hi"), width)))
    cond = (F.col("cell") == F.col("c_cell")) & (F.col("c_lo") < F.col("hi")) & (F.col("lo") < F.col("c_hi"))
    for c in by:
        cond = cond & (F.col(c) == F.col(f"c_{c}"))
    met = a.join(b, cond, "left_semi").select("row_id").distinct()
    return rows.join(met, "row_id", "left_anti")


def uncovered_boxes(rows: DataFrame, covers: DataFrame, by: str, width: float = 256.0) -> DataFrame:
    """Boxes (by, row_id, x1, y1, x2, y2) that overlap none of ``covers`` (by, x1, y1, x2, y2)."""
    a = rows.withColumn("cell", F.explode(cells(F.col("x1"), F.col("x2"), width)))
    b = covers.select(F.col(by).alias("c_by"), *[F.col(c).alias(f"c_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = b.withColumn("c_cell", F.explode(cells(F.col("c_x1"), F.col("c_x2"), width)))
    meets = (F.col("c_x1") < F.col("x2")) & (F.col("x1") < F.col("c_x2")) & (F.col("c_y1") < F.col("y2")) & (F.col("y1") < F.col("c_y2"))
    met = a.join(b, (F.col(by) == F.col("c_by")) & (F.col("cell") == F.col("c_cell")) & meets, "left_semi").select("row_id").distinct()
    return rows.join(met, "row_id", "left_anti")


def padded(boxes: DataFrame, pad: int = 4) -> DataFrame:
    """Boxes (w, h, x1, y1, x2, y2, ...) grown by ``pad`` on all sides, within their picture of w by h."""
    low = lambda c: F.greatest(F.floor(F.col(c)) - pad, F.lit(0)).cast("int")
    high = lambda c, most: F.least(F.floor(F.col(c)) + pad, F.col(most)).cast("int")
    return boxes.withColumns({"x1": low("x1"), "y1": low("y1"), "x2": high("x2", "w"), "y2": high("y2", "h")})


def seeds(boxes: DataFrame, pad: int = 4) -> DataFrame:
    """Padded boxes that are large enough to look for lines in: 8 pixels wide and 6 high."""
    return padded(boxes, pad).where((F.col("x2") - F.col("x1") >= 8) & (F.col("y2") - F.col("y1") >= 6))


def measurable(boxes: DataFrame, pad: int = 3) -> DataFrame:
    """Padded boxes with ``why``: too_small under 4 pixels either way, else null."""
    small = (F.col("x2") - F.col("x1") < 4) | (F.col("y2") - F.col("y1") < 4)
    return padded(boxes, pad).withColumn("why", F.when(small, "too_small"))


def without_shadows(boxes: DataFrame, by: str, share: float = 0.45, pad: int = 5) -> DataFrame:
    """Boxes (by, x1, y1, x2, y2, ...) that lie within no larger box of the same poster, padded, of
    which they have at most ``share`` (not over 1) of height and width.

    A hierarchical grid: each box is stored in the at most four cells it touches on the level whose cells are as
    large as itself, and looked up by its corner on all levels from its own on, so pairs are in proportion to boxes, however many
    a poster has. A job runs: the boxes are written, and the levels they are on, some forty at most, are listed."""
    row = "row"
    while row in boxes.columns:
        row += "_"
    boxes = written(boxes.withColumn(row, F.monotonically_increasing_id()))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    level = F.ceil(F.log2(F.greatest(w, h, F.lit(0)) + 2 * pad + 1)).cast("int")
    levels = sorted(r[0] for r in boxes.select(level).distinct().collect() if r[0] is not None)
    cell = lambda v, on: F.floor(v / F.pow(F.lit(2.0), on))
    stored = boxes.select(F.col(by).alias("o_by"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")], level.alias("o_level"))
    for c in ("x", "y"):
        stored = stored.withColumn(f"o_c{c}", F.explode(F.sequence(cell(F.col(f"o_{c}1") - pad, F.col("o_level")), cell(F.col(f"o_{c}2") + pad, F.col("o_level")))))
    looked = boxes.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= level)))
    looked = looked.withColumns({"cx": cell(F.col("x1"), F.col("level")), "cy": cell(F.col("y1"), F.col("level"))})
    ow, oh = F.col("o_x2") - F.col("o_x1"), F.col("o_y2") - F.col("o_y1")
    inside = (F.col("x1") >= F.col("o_x1") - pad) & (F.col("y1") >= F.col("o_y1") - pad) & (F.col("x2") <= F.col("o_x2") + pad) & (F.col("y2") <= F.col("o_y2") + pad)
    same = (F.col(by) == F.col("o_by")) & (F.col("level") == F.col("o_level")) & (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy"))
    lost = looked.join(stored, same & (ow * oh > w * h) & (h <= share * oh) & (w <= share * ow) & inside, "left_semi").select(row).distinct()
    return boxes.join(lost, row, "left_anti").drop(row)


def dominated_removed(rows: DataFrame, by: str, values: tuple[str, str] | list[str], share: float) -> DataFrame:
    """Rows of a group of which no row is so much larger in both ``values``: whose two values are not at most a share of
    another one's. A sweep from the largest first value down keeps the largest second value met so far, so a group of n
    rows is sorted once and no two of its rows are compared; the sort spills. Rows with a null stay."""
    first, second = values
    row = F.struct(*[F.col(c) for c in rows.columns])
    points = rows.select(F.col(by).alias("key"), (share * F.col(first)).cast("double").alias("at"), F.lit(0).alias("kind"), (share * F.col(second)).cast("double").alias("reach"), F.when(F.lit(False), row).alias("row"))
    asked = rows.select(F.col(by).alias("key"), F.col(first).cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("reach"), row.alias("row"))
    down = Window.partitionBy("key").orderBy(F.desc_nulls_last("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(asked).withColumn("reach", F.max("reach").over(down)).where("kind = 1")
    lost = F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col(f"row.{second}").cast("double") <= F.col("reach"))
    return met.where(~F.coalesce(lost, F.lit(False))).select("row.*")


def classify(rows: DataFrame, bands: DataFrame, value: str, adopted: str) -> DataFrame:
    """Adds status and band: ``accepted`` by the first adopted band (lo..hi) that holds the value, else
    ``held`` by the first other one whose observed range (min..max) does, else ``violation``.

    bands: (band, verdict, lo, hi, min, max). A rule set has a few bands, a layer each; they are
    gathered into one row, so the rows are never shuffled and each of them looks at the bands once."""
    listed = bands.agg(F.array_sort(F.collect_list(F.struct("band", "verdict", "lo", "hi", "min", "max"))).alias("listed"))
    v = F.col(value)
    accepted = F.filter("listed", lambda b: (b["verdict"] == adopted) & v.between(b["lo"], b["hi"]))
    held = F.filter("listed", lambda b: (b["verdict"] != adopted) & v.between(F.coalesce(b["min"], b["lo"]), F.coalesce(b["max"], b["hi"])))
    found = rows.join(F.broadcast(listed)).withColumns({"a": F.get(accepted, F.lit(0)), "h": F.get(held, F.lit(0))})
    status = F.when(F.col("a").isNotNull(), "accepted").when(F.col("h").isNotNull(), "held").otherwise("violation")
    return found.withColumns({"status": status, "band": F.coalesce("a.band", "h.band")}).drop("listed", "a", "h")
