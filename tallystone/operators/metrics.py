"""The metrics of poster records as observations: one row for each value a poster, block or line gives.

posters has the columns of ``schemas.POSTER``. Each extractor gives array columns over its nested arrays, one for
each metric, and observe() explodes them all in one projection: posters are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most metrics of a poster that a bit stands for.
BITS = 62


def middle(values: Column) -> Column:
    """The median of an array of numbers without nulls; null for an empty one."""
    half = lambda o: F.when(F.size(o) > 0, (F.get(o, F.shiftright(F.size(o) - 1, 1)) + F.get(o, F.shiftright(F.size(o), 1))) / 2)
    # the sorted array is bound once: each use would sort it anew
    return F.get(F.transform(F.array(F.sort_array(values.cast("array<double>"))), half), F.lit(0))


def heights(block) -> Column:
    """Of a block's lines with a known cap: baseline minus cap."""
    return F.filter(F.zip_with(block["bases"], block["caps"], lambda b, c: (b - c).cast("double")), lambda d: d.isNotNull())


def leading() -> dict[str, Column]:
    """lead_over_cap and gap_px of blocks of at least 3 lines with a leading and a known cap."""
    fit = F.filter("blocks", lambda b: (F.coalesce(b["lead"], F.lit(0)) != 0) & (b["n"] >= 3) & F.array_max(b["caps"]).isNotNull())
    both = F.transform(fit, lambda b: F.struct(b["lead"].alias("lead"), middle(heights(b)).alias("cap")))
    # one array gives both metrics, so it is worked out once
    both = F.transform(both, lambda x: F.struct(F.when(x["cap"] != 0, x["lead"] / x["cap"]).alias("ratio"), (x["lead"] - x["cap"]).alias("gap")))
    return {"lead_over_cap": both["ratio"], "gap_px": both["gap"]}


def ascenders() -> dict[str, Column]:
    """asc_over_xh of each line with a cap, an x-height above 0 and an ascender no lower than that."""
    over = lambda top: lambda b: F.zip_with(b["bases"], b[top], lambda base, t: base - t)
    # numbers of lines instead of a record for each: functions of arrays are not compiled, and each step in them costs
    share = lambda c, x: F.when((x > 0) & (c >= x), c / x)
    found = F.transform("blocks", lambda b: F.zip_with(over("caps")(b), over("xtops")(b), share))
    return {"asc_over_xh": F.filter(F.flatten(found), lambda v: v.isNotNull())}


def chained(values: Column, reach: float) -> Column:
    """How many clusters an array's numbers form if neighbours at most ``reach`` apart belong together."""
    apart = lambda o: F.size(F.filter(o, lambda x, i: (i == 0) | (x - F.get(o, i - 1) > reach)))
    # bound once, as in middle()
    return F.get(F.transform(F.array(F.sort_array(values)), apart), F.lit(0))


def alignment(reach: int = 2) -> dict[str, Column]:
    """align_ratio of posters with at least 3 blocks: clusters of left edges over blocks."""
    edges = F.col("blocks")["x1"]
    return {"align_ratio": F.when(F.size("blocks") >= 3, F.array(chained(edges, reach) / F.size("blocks")))}


def upright() -> Column:
    """Whether a poster is not rotated and its size is known."""
    return (F.abs(F.coalesce("angle", F.lit(0.0))) < 1) & (F.coalesce(F.get("size", F.lit(0)), F.lit(0)) > 0) & (F.coalesce(F.get("size", F.lit(1)), F.lit(0)) > 0)


def margins() -> dict[str, Column]:
    """The four margins of upright posters with a region."""
    w, h = F.get("size", F.lit(0)), F.get("size", F.lit(1))
    x1, y1, x2, y2 = (F.get("region", F.lit(i)) for i in range(4))
    fit = upright() & F.col("region").isNotNull()
    shares = {"margin_left": x1 / w, "margin_right": (w - x2) / w, "margin_top": y1 / h, "margin_bottom": (h - y2) / h}
    return {m: F.when(fit, F.array(v)) for m, v in shares.items()}


def counts() -> dict[str, Column]:
    """n_columns where it is not 0, n_blocks where there are any."""
    return {"n_columns": F.when(F.col("n_columns") != 0, F.array("n_columns")), "n_blocks": F.when(F.size("blocks") > 0, F.array(F.size("blocks")))}


def letter_range() -> dict[str, Column]:
    """cap_range: largest over smallest x-height above 0, of at least two."""
    found = F.filter(F.col("blocks")["xh"], lambda x: x > 0)
    return {"cap_range": F.when(F.size(found) >= 2, F.array(F.array_max(found) / F.array_min(found)))}


def text_area() -> dict[str, Column]:
    """Summed block areas over the plate of upright posters; 0 without blocks."""
    side = lambda a, b: F.greatest(b - a, F.lit(0)).cast("double")
    area = F.aggregate(F.coalesce("blocks", F.expr("array()")), F.lit(0.0), lambda s, b: s + side(b["x1"], b["x2"]) * side(b["y1"], b["y2"]))
    return {"text_area": F.when(upright(), F.array(area / (F.get("size", F.lit(0)) * F.get("size", F.lit(1)))))}


def colors() -> dict[str, Column]:
    names = ("ground_share", "n_colors", "saturation", "value", "gray_share")
    return {m: F.when(F.col("color").isNotNull(), F.array(F.col(f"color.{m}"))) for m in names}


#: More metrics can be added here: a function that gives an array column over poster records for each of its metrics.
EXTRACTORS = {"leading": leading, "ascenders": ascenders, "alignment": alignment, "margins": margins, "counts": counts, "letter_range": letter_range, "text_area": text_area, "colors": colors}


def measured(posters: DataFrame, extractors=EXTRACTORS) -> DataFrame:
    """(corpus, entity, ord, bits, one array of values for each metric): a row for each poster, and a bit for each metric that
    it has a value of, null if they are more than BITS. Where values are used more than once, this is what to write: a poster's
    observations are some twenty rows, each with its name."""
    found = {m: v.cast("array<double>") for extract in extractors.values() for m, v in extract().items()}
    each = posters.select("corpus", F.col("file").alias("entity"), "ord", *[v.alias(m) for m, v in found.items()])
    bits = F.lit(None if len(found) > BITS else 0).cast("long")
    for i, m in enumerate(list(found)[:BITS]):
        # array_max passes over nulls, and is null where there is nothing else
        bits = bits.bitwiseOR(F.when(F.array_max(m).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return each.select("corpus", "entity", "ord", bits.alias("bits"), *found)


def unpivoted(table: DataFrame) -> DataFrame:
    """(corpus, entity, ord, metric, value) of what measured() gave; null arrays and nulls in them give nothing."""
    found = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("values")) for m in names(table)]
    # arrays first, then their values: both are plain columns, which Spark compiles; functions within functions of arrays are not.
    # explode_outer, since for explode() Spark adds a filter in which it works the arrays out again; empty ones give a null, which goes
    listed = table.select("corpus", "entity", "ord", F.array(*found).alias("listed"))
    each = listed.select("corpus", "entity", "ord", F.explode_outer("listed").alias("m")).select("corpus", "entity", "ord", "m.metric", "m.values")
    return each.select("corpus", "entity", "ord", "metric", F.explode_outer("values").alias("value")).where("value is not null")


def names(table: DataFrame) -> list[str]:
    """The metrics of what measured() gave."""
    return table.columns[4:]


def observe(posters: DataFrame, extractors=EXTRACTORS) -> DataFrame:
    """(corpus, entity, ord, metric, value) of all metrics; null arrays and nulls in them give nothing."""
    return unpivoted(measured(posters, extractors))


def region(block: Column) -> Column:
    """An aggregate over blocks that are rows still: [x1, y1, x2, y2] around all of a poster."""
    return F.array(*[edge(block[c]).cast("double") for edge, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
