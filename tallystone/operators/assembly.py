"""From pixels to poster records, as joins and groups over tables of pixels.

Pictures are tables (by, y, x, gray) with a row for each pixel. All pictures go through each step together, so none of
them is held by one task; only what is at most as long as a picture is high (its lines, cuts and profiles) is gathered into
arrays. Steps: cut the dark border off, part the plate into bands where its ground changes, settle ink for each band anew,
part the ink into sizes and columns, find lines and what belongs to them, and group them into blocks. Jobs run
while a result is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import ordered
from tallystone.functions.ordered import joined
from tallystone.functions.rounding import exact_round
from tallystone.functions.stages import written
from tallystone.operators import ink, lines, profiles, spatial
from tallystone.operators.layout import gaps
from tallystone.operators.metrics import middle

#: The steps of a picture and why it may not get through each.
STEPS = (("trim", "nothing within the border"), ("ink", "no ink"), ("columns", "no column"), ("lines", "no line"), ("blocks", "no block"))
#: Least strip between columns and its share of the letters' height; rows before and behind a block's lines
#: that its step is looked for in; greatest step; rows below a baseline that a descender is looked for in.
COLUMN_GAP, COLUMN_SHARE, ABOVE, BELOW, LEAD_MOST, DEPTH = 6, 0.5, 20, 8, 60, 6


def ink_of(pixels: DataFrame, by: list[str], part: list[str] | None = None) -> DataFrame:
    """Pixels with ``inked``: darker than the ground's share of each picture, or of each ``part`` of it, after bright ink on
    dark ground is turned over."""
    keys = part or by
    levels = profiles.polarity(pixels.select(*keys, F.col("gray").alias("value")), keys).select(*keys, "inverted", "level")
    return joined(pixels, levels, keys).withColumn("inked", F.when(F.col("inverted"), 255 - F.col("gray")).otherwise(F.col("gray")) < F.col("level")).drop("inverted", "level")


def trim(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels without the dark borders of a scan, numbered anew from 0, with ``left`` and ``top``, what was cut off."""
    seen = written(ink_of(pixels, by))
    share = lambda at: seen.groupBy(*by, F.col(at).alias("at")).agg(F.avg(F.col("inked").cast("int")).alias("value"))
    across, down = ink.trimmed(share("x"), by).toDF(*by, "x1", "x2"), ink.trimmed(share("y"), by).toDF(*by, "y1", "y2")
    inside = joined(seen.drop("inked"), joined(across, down, by), by).where("x >= x1 and x < x2 and y >= y1 and y < y2")
    return inside.select(*by, (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray", F.col("x1").alias("left"), F.col("y1").alias("top"))


def banded(pixels: DataFrame, by: list[str], step: float = 48.0, least: int = 48) -> DataFrame:
    """Pixels with ``band`` and their row within it; ``top`` and ``left`` are the band's place in the picture."""
    ground = ordered.quantiles(pixels, [*by, "y"], {"value": 0.5}, "gray").withColumnRenamed("y", "at")
    found = profiles.bands(ground, by, step, least)
    rows = found.select(*by, "band", "first", F.explode(F.sequence("first", F.col("end") - 1)).alias("y"))
    both = joined(pixels, rows, [*by, "y"])
    return both.select(*by, "band", (F.col("y") - F.col("first")).alias("y"), "x", "gray", "left", (F.col("top") + F.col("first")).alias("top"))


def _row_profile(inked: DataFrame, sizes: DataFrame, by: list[str], at: str, size: str) -> DataFrame:
    """(by, at, value): the ink of each row or column of pictures of the sizes (by, width, height), those without any included."""
    counts = inked.groupBy(*by, F.col(at).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("value"))
    every = sizes.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1)).alias("at"))
    return joined(every, counts, [*by, "at"], "left").select(*by, "at", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def column_count(inked: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_columns) of ink (by, y, x)."""
    return profiles.columns(_row_profile(inked, sizes, by, "x", "width"), by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_columns"))


def panels(inked: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, stratum, column, y, x): ink parted by the size of its components, large ones apart, and each
    of the two into columns, named by where they begin; the strips between them grow with the letters."""
    runs = written(ink.labelled_runs(inked, by))
    parts = runs.groupBy(*by, "component").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"))
    sized = ink.strata(parts, by).withColumn("stratum", F.col("tall").cast("int"))
    body = ink.body_height(sized.drop("body", "tall"), [*by, "stratum"])
    strips = body.select(*by, "stratum", F.greatest(F.lit(COLUMN_GAP), F.floor(COLUMN_SHARE * F.col("body")).cast("int")).alias("gap"))
    named = joined(runs, sized.select(*by, "component", "stratum"), [*by, "component"])
    pixels = written(named.select(*by, "stratum", "y", F.explode(F.sequence("x1", "x2")).alias("x")))
    keys = [*by, "stratum"]
    plates = joined(pixels.select(*keys).distinct(), sizes, by)
    found = profiles.columns(_row_profile(pixels, plates, keys, "x", "width"), keys, strips)
    places = found.select(*keys, F.col("first").alias("column"), F.explode(F.sequence("first", F.col("end") - 1)).alias("x"))
    return joined(pixels.withColumn("x", F.col("x").cast("long")), places, [*keys, "x"]).select(*keys, "column", "y", "x")


def text_lines(inked: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """The lines of panels (by, y, x) in pictures of the sizes (by, height): (by, s, e, top, base, x_top, cap, mark_top, desc, kind,
    n_mark, ink_top, xh, xs, xe)."""
    inked = written(inked)
    profile = _row_profile(inked, sizes, by, "y", "height")
    strips = profiles.runs(profile, by).select(*by, F.col("first").alias("s"), (F.col("last") + 1).alias("e"))
    rows = strips.select(*by, "s", "e", F.explode(F.sequence("s", F.col("e") - 1)).alias("y"))
    spans = joined(inked.withColumn("y", F.col("y").cast("long")), rows, [*by, "y"]).groupBy(*by, "s", "e").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    listed = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("s", "e", "x0", "x1"))).alias("strips"))
    kept = listed.select(*by, F.explode(lines.absorbed(F.col("strips"))).alias("t")).select(*by, "t.*")
    kept = written(kept)
    key = [*by, "s"]
    own = kept.select(*by, "s", "e", "x0", "x1", F.explode(F.sequence("s", F.col("e") - 1)).alias("at"))
    bases = lines.baselines(joined(own.select(*key, "at", *[c for c in by if c not in key]), profile, [*by, "at"]).select(*key, "at", "value"), key)
    pixels = written(joined(inked.withColumn("at", F.col("y").cast("long")), own, [*by, "at"]).where("x >= x0 and x < x1").select(*key, "y", "x"))
    narrow = joined(own.select(*key, "at"), pixels.groupBy(*key, F.col("y").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("value")), [*key, "at"], "left")
    parts = ink.components(pixels, key, diagonal=True)
    marked = lines.marks(narrow.select(*key, "at", F.coalesce("value", F.lit(0)).alias("value")), parts.select(*key, "y1", "y2"), key)
    based = joined(kept, bases, key).where("base is not null")
    under = based.select(*key, "x0", "x1", F.explode(F.sequence("base", F.col("base") + DEPTH - 1)).alias("at"))
    below = joined(inked.withColumn("at", F.col("y").cast("long")), under, [*by, "at"]).where("x >= x0 and x < x1").select(*key, "y", "x")
    lowest = lines.descenders(ink.components(below, key, diagonal=True).select(*key, "y1", "y2"), key)
    found = joined(joined(based, marked, key), lowest, key, "left")
    return found.select(
        *by, "s", "e", F.coalesce("cap", "x_top").alias("top"), "base", "x_top", "cap", "mark_top", "desc", "kind", "n_mark",
        F.col("s").alias("ink_top"), (F.col("base") - F.col("x_top")).alias("xh"), F.col("x0").alias("xs"), F.col("x1").alias("xe"),
    )


def leads(blocks: DataFrame, profile: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, lead): of blocks of at least three lines (by, block, bases) the step at which the ink around them repeats."""
    some = blocks.where(F.size("bases") >= 3)
    first, last = F.array_min("bases"), F.array_max("bases")
    around = some.select(*by, "block", F.explode(F.sequence(F.greatest(first - ABOVE, F.lit(0.0)).cast("long"), (last + BELOW - 1).cast("long"))).alias("at"))
    part = written(joined(around, profile, [*by, "at"]))
    keys = [*by, "block"]
    rows = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    waves = joined(profiles.autocorrelation(part, keys, LEAD_MOST - 1), rows, keys).where(F.col("lag") <= F.col("rows") - 2)
    return profiles.first_peak(waves, keys, 6).select(*keys, F.col("lag").alias("lead"))


def text_blocks(found: DataFrame, profile: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of lines, with their step fitted: (by, block, n, x1, y1, x2, y2, h, xh, lead, residual, lines); lines are structs with
    base_grid and shift beside what was measured, which stays as it was."""
    fields = ("x_top", "cap", "mark_top", "desc", "kind", "n_mark", "ink_top")
    each = lines.numbered(found, by, fields)
    grouped = each.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("base", "top", "xs", "xe", "xh", *fields))).alias("lines"))
    grouped = written(grouped.withColumn("bases", F.transform("lines", lambda t: t["base"].cast("double"))))
    fitted = joined(grouped, leads(grouped, profile, by), [*by, "block"], "left").withColumn("grid", lines.on_grid(F.col("bases"), F.col("lead")))
    least, most = (lambda c: F.array_min(F.transform("lines", lambda t: t[c]))), (lambda c: F.array_max(F.transform("lines", lambda t: t[c])))
    shown = F.transform(F.arrays_zip(F.col("lines").alias("t"), F.col("grid.fitted").alias("g")), lambda z: F.struct(*[z["t"][c].alias(c) for c in ("base", "top", "xs", "xe", "xh", *fields)], z["g"].alias("base_grid"), (z["g"] - z["t"]["base"]).alias("shift")))
    return fitted.select(
        *by, "block", F.size("lines").alias("n"), least("xs").alias("x1"), least("top").alias("y1"), most("xe").alias("x2"), most("base").alias("y2"),
        F.bround(middle(F.transform("lines", lambda t: t["base"] - t["top"])), 1).alias("h"), F.bround(middle(F.transform("lines", lambda t: t["xh"])), 1).alias("xh"),
        F.col("grid.lead").alias("lead"), F.bround("grid.residual", 2).alias("residual"), shown.alias("lines"),
    )


def _moved(block_lines: Column, left: Column, top: Column) -> Column:
    down, right = ("base", "top", "x_top", "cap", "mark_top", "desc", "ink_top", "base_grid"), ("xs", "xe")
    return F.transform(block_lines, lambda t: F.struct(*[(t[c] + top).alias(c) for c in down], *[(t[c] + left).alias(c) for c in right], t["xh"].alias("xh"), t["kind"].alias("kind"), t["n_mark"].alias("n_mark"), t["shift"].alias("shift")))


def blocks_of(pixels: DataFrame, by: list[str], step: float = 48.0, least: int = 48) -> tuple[DataFrame, DataFrame]:
    """(blocks, counts) of pictures: each block with its box and lines in the picture's pixels and without what lies in
    the shadow of a larger one; counts: (by, n_columns), the most of any band."""
    blocks, counts, _ = _followed(pixels, by, step, least)
    return blocks, counts


def _followed(pixels: DataFrame, by: list[str], step: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blocks_of() and (by, reached): how many of STEPS each picture got through."""
    plate = written(banded(trim(pixels, by), by, step, least))
    band = [*by, "band"]
    places = plate.groupBy(*band).agg(F.min("left").alias("left"), F.min("top").alias("over"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    places = written(places)
    sizes = places.select(*band, "width", "height")
    inked = written(ink_of(plate, by, band).where("inked").select(*band, "y", "x"))
    counts = column_count(inked, sizes, band).groupBy(*by).agg(F.max("n_columns").cast("int").alias("n_columns"))
    found = written(panels(inked, sizes, band))
    panel = [*band, "stratum", "column"]
    plates = joined(found.select(*panel).distinct(), sizes, band)
    seen = written(text_lines(found, plates, panel))
    blocks = text_blocks(seen, _row_profile(found, plates, panel, "y", "height"), panel)
    placed = joined(blocks, places.select(*band, "left", "over"), band)
    placed = placed.withColumn("lines", _moved(F.col("lines"), F.col("left"), F.col("over")))
    placed = placed.withColumns({**{c: F.col(c) + F.col("left") for c in ("x1", "x2")}, **{c: F.col(c) + F.col("over") for c in ("y1", "y2")}}).drop("left", "over", "block", "stratum", "column")
    key = F.struct(*by)
    placed = written(placed)
    through = [t.select(*by).distinct().withColumn("reached", F.lit(i + 1)) for i, t in enumerate((places, inked, found, seen, placed))]
    reached = reduce(DataFrame.unionByName, through).groupBy(*by).agg(F.max("reached").alias("reached"))
    lit = spatial.without_shadows(placed.withColumn("picture", key), "picture")
    return lit.drop("picture", "band"), counts, reached


def assemble(pixels: DataFrame, failures: DataFrame, step: float = 48.0, least: int = 48) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of pictures (file, y, x, gray): poster records, and a row (file, step, reason) for each picture that gives
    none, after those in ``failures`` (as sources.usable() tells them). A picture fails at the step that left nothing of it, or
    at once if a pixel has no place or value; pictures never stop each other. Every picture is in one of the two."""
    bare = F.col("y").isNull() | F.col("x").isNull() | F.col("gray").isNull()
    seen = written(pixels.groupBy("file").agg(F.max(bare).alias("bare")))
    kept = joined(pixels, seen.where("not bare").select("file"), ["file"])
    blocks, counts, reached = _followed(kept, ["file"], step, least)
    names, why = (F.array(*[F.lit(s[i]) for s in STEPS]) for i in (0, 1))
    told = joined(seen, reached, ["file"], "left").withColumn("at", F.coalesce("reached", F.lit(0)))
    lost = told.where(F.col("bare") | (F.col("at") < len(STEPS)))
    lost = lost.select("file", F.when(F.col("bare"), "pixels").otherwise(F.get(names, "at")).alias("step"), F.when(F.col("bare"), "pixels without a place or value").otherwise(F.get(why, "at")).alias("reason"))
    found = joined(records(blocks, counts, "file"), told.where(F.col("at") == len(STEPS)).select("file"), ["file"])
    return found, failures.select("file", "step", "reason").unionByName(lost)


def seeded(pixels: DataFrame, boxes: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of the lines within text boxes (by, x1, y1, x2, y2) that no block covers; each box is looked at as a picture of
    its own, and the lines of all of a picture's boxes are grouped together."""
    sizes = pixels.groupBy(*by).agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    found = spatial.seeds(joined(boxes, sizes, by)).withColumns({"picture": F.to_json(F.struct(*by)), "row_id": F.concat_ws("-", F.to_json(F.struct(*by)), "x1", "y1", "x2", "y2")}).dropDuplicates(["row_id"])
    open_ = spatial.uncovered_boxes(found, blocks.withColumn("picture", F.to_json(F.struct(*by))), "picture")
    rows = open_.select(*by, "row_id", "x1", "x2", "y1", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    part = joined(pixels.withColumn("y", F.col("y").cast("int")), rows, [*by, "y"]).where("x >= x1 and x < x2")
    part = written(part.select(*by, "row_id", "x1", "y1", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray"))
    seed = [*by, "row_id"]
    places = part.groupBy(*seed, "x1", "y1").agg((F.max("y") + 1).alias("height"))
    inked = ink_of(part.drop("x1", "y1"), seed).where("inked").select(*seed, "y", "x")
    each = joined(text_lines(inked, places.select(*seed, "height"), seed), places.select(*seed, "x1", "y1"), seed)
    down, right = ("base", "top", "x_top", "cap", "mark_top", "desc", "ink_top"), ("xs", "xe")
    moved = each.withColumns({**{c: F.col(c) + F.col("y1") for c in down}, **{c: F.col(c) + F.col("x1") for c in right}})
    whole = ink_of(pixels, by).where("inked").groupBy(*by, F.col("y").cast("long").alias("at")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return text_blocks(moved, whole, by).drop("block").withColumn("seeded", F.lit(True))


def records(blocks: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """(file, n_columns, region, blocks): poster records, with a block's lines as arrays beside each other."""
    whole = lambda c: F.transform("lines", lambda t: t[c].cast("int"))
    block = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2", "n")], F.col("xh").cast("double").alias("xh"), F.col("lead").cast("int").alias("lead"), whole("base").alias("bases"), whole("cap").alias("caps"), whole("x_top").alias("xtops"))
    listed = blocks.groupBy(by).agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.array(*[f(c).cast("double") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]).alias("region"))
    return counts.join(listed, by, "full_outer").select(F.col(by).alias("file"), "n_columns", "region", "blocks")


def box_measure(found: DataFrame, by: list[str], steps: DataFrame | None = None) -> DataFrame:
    """What is told about the lines of each box: (by, n_lines, baselines, x_tops, caps, x_heights, xh_median, lead, lead_measured,
    lead_over_xh, grid_resid, align, align_left, align_right, align_center, x_starts, x_ends, box_ink), arrays in the order of the baselines.

    found: (by, base, top, x_top, cap, xh, xs, xe). steps: (by, lead), the step at which a box's ink repeats; lead is null and
    grid_resid 0 where it is not known or does not fit the baselines. lead_measured is the median step between them, null with one
    line; lead_over_xh is null without a step or an x-height, and the align columns with one line. Boxes without lines give no row."""
    each = ("base", "top", "x_top", "cap", "xh", "xs", "xe")
    listed = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*each))).alias("t"))
    if steps is None:
        listed = listed.withColumn("step", F.lit(None).cast("double"))
    else:
        listed = joined(listed, steps.select(*by, F.col("lead").cast("double").alias("step")), by, "left")
    told = lambda c: F.transform("t", lambda x: x[c].cast("double"))
    each_told = listed.select(*by, "step", *[told(c).alias(c) for c in each])
    seen = each_told.withColumns({"grid": lines.on_grid(F.col("base"), F.col("step")), "axes": lines.alignment(F.col("xs"), F.col("xe")), "gap": middle(gaps(F.col("base"))), "usual": middle(F.col("xh"))})
    known, several = F.array_compact("cap"), F.size("base") >= 2
    return seen.select(
        *by, F.size("base").cast("long").alias("n_lines"), F.col("base").alias("baselines"), F.col("x_top").alias("x_tops"), F.col("cap").alias("caps"), F.col("xh").alias("x_heights"),
        exact_round(F.col("usual"), 1).alias("xh_median"), exact_round(F.col("grid.lead"), 2).alias("lead"), exact_round(F.col("gap"), 1).alias("lead_measured"),
        exact_round(F.when(F.col("usual") != 0, F.col("gap") / F.col("usual")), 3).alias("lead_over_xh"), exact_round(F.col("grid.residual"), 2).alias("grid_resid"),
        "axes.align", *[F.when(several, F.col(f"axes.{c}")).alias(f"align_{c}") for c in ("left", "right", "center")],
        F.col("xs").alias("x_starts"), F.col("xe").alias("x_ends"), F.array(F.array_min("xs"), F.array_min("top"), F.array_max("xe"), F.array_max("base")).alias("box_ink"),
    )


def measured_boxes(pixels: DataFrame, boxes: DataFrame, by: list[str], box: str = "box") -> DataFrame:
    """A row (by, box, why, n_lines, ...) for each named box (by, box, x1, y1, x2, y2) of the pictures (by, y, x, gray), with what box_measure()
    tells about it, places in the picture's pixels. Boxes are grown by 3 pixels and each is looked at as a picture of its own: its own ground,
    ink, lines and step. why: ``too_small`` under 4 pixels either way, ``no_lines``, ``no_picture``, else null; the first three have
    n_lines 0. Boxes may overlap; their pixels are told apart by an equi-join on rows."""
    sizes = pixels.groupBy(*by).agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    key = [*by, box]
    asked = written(spatial.measurable(joined(boxes.select(*key, "x1", "y1", "x2", "y2"), sizes, by, "left")).withColumn("why", F.when(F.col("w").isNull(), "no_picture").otherwise(F.col("why"))))
    rows = asked.where("why is null").select(*key, "x1", "x2", "y1", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"))
    part = joined(pixels.withColumn("y", F.col("y").cast("int")), rows, [*by, "y"]).where("x >= x1 and x < x2")
    part = part.select(*key, (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray")
    inked = written(ink_of(part, key).where("inked").select(*key, "y", "x"))
    places = asked.where("why is null").select(*key, "x1", "y1", (F.col("y2") - F.col("y1")).alias("height"))
    seen = written(text_lines(inked, places.select(*key, "height"), key))
    one = seen.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("base").cast("double"))).alias("bases")).withColumn("block", F.lit(0))
    steps = leads(one, _row_profile(inked, places, key, "y", "height"), key).select(*key, "lead")
    moved = joined(seen, places.select(*key, F.col("x1").alias("left"), F.col("y1").alias("over")), key)
    moved = moved.withColumns({**{c: F.col(c) + F.col("over") for c in ("base", "top", "x_top", "cap")}, **{c: F.col(c) + F.col("left") for c in ("xs", "xe")}})
    told = joined(asked.select(*key, "why"), box_measure(moved, key, steps), key, "left")
    none = F.col("n_lines").isNull()
    return told.withColumns({"why": F.when(F.col("why").isNull() & none, "no_lines").otherwise(F.col("why")), "n_lines": F.coalesce("n_lines", F.lit(0).cast("long"))})
