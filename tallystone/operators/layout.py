"""Layout candidates against the rules, and text placed on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.stages import written
from tallystone.operators.judging import position
from tallystone.operators.metrics import middle
from tallystone.schemas import CONSTRAINT

#: Lines touch where leading exceeds the letters by less.
LEAST_GAP = 1.0
LEADING = "lead_over_cap"


def gaps(values: Column) -> Column:
    """Differences of an array's ordered numbers, nulls left out."""
    steps = lambda o: F.filter(F.transform(o, lambda x, i: x - F.get(o, i - 1)), lambda d: d.isNotNull())
    # the sorted array is bound once, as in metrics.middle(): else every number would sort it anew
    return F.get(F.transform(F.array(F.sort_array(values)), steps), F.lit(0))


def grid_lines(height: Column, grid: Column, ratio: Column) -> Column:
    """How many grid steps a line takes: next to height * ratio, and at least LEAST_GAP over the height."""
    near = F.greatest(F.lit(1.0), F.rint(height * ratio / grid))
    return F.greatest(near, F.ceil((height + LEAST_GAP) / grid).cast("double")).cast("long")


def place(blocks: DataFrame, ratio: float) -> DataFrame:
    """blocks: (layout, grid_lead, id, x, y, cap_height, n_lines) -> grid, lead, ratio and baselines.

    A null grid is made from the layout's smallest cap height. Blocks without a cap height and grids
    that are not above 0 give null leads; no lines give no baselines."""
    least = blocks.groupBy(F.col("layout").alias("l")).agg(F.min(F.when(F.col("cap_height") > 0, F.col("cap_height"))).alias("least"))
    grid = F.coalesce("grid_lead", F.greatest(F.lit(1.0), F.rint(F.col("least") * ratio)))
    height, y = F.col("cap_height"), F.coalesce("y", F.lit(0.0))
    both = blocks.join(least, F.col("layout") == F.col("l"), "left").withColumn("grid", grid)
    fit = (F.col("grid") > 0) & (height > 0)
    both = both.withColumn("lead", F.when(fit, grid_lines(height, F.col("grid"), F.lit(ratio)) * F.col("grid")))
    n = F.coalesce("n_lines", F.lit(1))
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.bround(y + height + i * F.col("lead"), 1))).otherwise(F.expr("array()"))
    return both.select("layout", "id", "x", "grid", "lead", F.bround(F.col("lead") / height, 3).alias("ratio"), F.when(F.col("lead").isNotNull(), lines).alias("baselines"))


def layer_list(rules: DataFrame, metric: str = LEADING) -> DataFrame:
    """(corpus, metric, layer, median, n, lo, hi, min, max, cv, verdict): the layers of a metric, numbered from 1 by their
    median; an entry that is one layer is that itself."""
    return rules.where(F.col("metric") == metric).select("corpus", "metric", F.explode(_bands()).alias("b")).select("corpus", "metric", "b.*")


def _bands() -> Column:
    names = ("median", "n", "lo", "hi", "min", "max", "cv", "verdict")
    whole = F.array(F.struct(F.lit(1).alias("layer"), *[F.col(c) for c in names]))
    return F.when(F.col("n_layers") > 0, F.transform("layers", lambda p, i: F.struct((i + 1).alias("layer"), *[p[c].alias(c) for c in names]))).otherwise(whole)


def rule_sets(rules: DataFrame) -> DataFrame:
    """(corpus, bands, adopted, others): what layouts of a corpus are held against, a row for each corpus: the layers of
    the leading, its entry where that is a rule, and the other metrics' entries by name."""
    own = F.col("metric") == LEADING
    entry = F.struct(F.lit(0).alias("layer"), *[F.col(c) for c in ("median", "n", "lo", "hi", "min", "max", "cv", "verdict")])
    return rules.groupBy("corpus").agg(
        F.first(F.when(own, _bands()), ignorenulls=True).alias("bands"),
        F.first(F.when(own & F.col("is_rule"), entry), ignorenulls=True).alias("adopted"),
        F.map_from_entries(F.collect_list(F.when(~own, F.struct("metric", F.struct("lo", "hi", "min", "max", "verdict", "median"))))).alias("others"),
    )


def _sets(layouts: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layouts with a column corpus, rule_sets()); without a column ``corpus`` the rules must be of one. The
    sets, a row for each corpus, are written once: whatever the rules come from is not run again, and their size is known."""
    sets = written(rule_sets(rules))
    if "corpus" not in layouts.columns:
        names = [r[0] for r in sets.select("corpus").limit(2).collect()]
        if len(names) > 1:
            raise ValueError("rules of several corpora: layouts need a column corpus")
        layouts = layouts.withColumn("corpus", F.lit(names[0] if names else None).cast("string"))
    return layouts, sets


def _chosen() -> Column:
    """The layer asked for, where there is one."""
    asked = F.col("layer")
    return F.when(asked.isNotNull() & (asked >= 1), F.get(F.col("bands"), asked - 1))


def _held_against(layouts: DataFrame, rules: DataFrame) -> DataFrame:
    """Layouts with ``error``, why they cannot be held against their corpus's rule set, or null."""
    layouts, sets = _sets(layouts, rules)
    return _unfit(layouts.join(sets, "corpus", "left").withColumn("forced", _chosen()), F.col("others").isNull(), F.col("forced").isNull())


def _unfit(both: DataFrame, no_rules: Column, no_layer: Column) -> DataFrame:
    error = F.when(no_rules, "no_rules").when(F.col("layer").isNotNull() & no_layer, "no_such_layer").when(F.coalesce(F.size("blocks"), F.lit(0)) <= 0, "no_blocks")
    return both.withColumn("error", error)


def place_text(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Text blocks on one grid by the rule of the leading, or by the layer asked for.

    requests: (layout, layer, grid_lead, blocks; corpus if the rules are of several). Without an adopted rule the lowest layer
    is taken. One row for each block: layout, corpus, id, x, cap_height, grid, lead, multiple, ratio, baselines, in_band,
    notes; blocks without a cap height have a note and nothing else. Requests that cannot be placed have one
    row with ``error``: no_rules, no_such_layer, no_blocks, no_leading, no_cap_height or bad_grid (not above 0)."""
    both = _held_against(requests, rules).withColumn("band", F.coalesce("forced", "adopted", F.get("bands", F.lit(0))))
    caps = F.filter(F.col("blocks")["cap_height"], lambda c: c > 0)
    grid = F.coalesce("grid_lead", F.when(F.size(caps) > 0, F.greatest(F.lit(1.0), F.rint(F.array_min(caps) * F.col("band.median")))))
    both = both.withColumn("grid", grid)
    both = both.withColumn("error", F.coalesce("error", F.when(F.col("band").isNull(), "no_leading").when(F.col("grid").isNull(), "no_cap_height").when(F.col("grid") <= 0, "bad_grid")))
    each = both.select("layout", "corpus", "grid", "band", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("blocks"))).alias("b"))
    height = F.col("b.cap_height")
    fit = (height > 0) & F.col("error").isNull()
    each = each.withColumn("multiple", F.when(fit, grid_lines(height, F.col("grid"), F.col("band.median"))))
    each = each.withColumn("lead", F.col("multiple") * F.col("grid")).withColumn("ratio", F.col("lead") / height)
    n, first = F.coalesce("b.n_lines", F.lit(1)), F.coalesce("b.y", F.lit(0.0)) + height
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.bround(first + i * F.col("lead"), 1))).otherwise(F.expr("array()"))
    inside = F.col("ratio").between(F.col("band.lo"), F.col("band.hi"))
    placed = F.col("error").isNull()
    notes = F.array_compact(F.array(F.when(placed & ~F.coalesce(height > 0, F.lit(False)), "no_cap_height"), F.when(~inside, "outside_band"), F.when(placed & (F.col("band.verdict") != CONSTRAINT), "not_adopted")))
    return each.select("layout", "corpus", F.col("b.id").alias("id"), F.col("b.x").alias("x"), height.alias("cap_height"), F.when(placed, F.col("grid")).alias("grid"), "lead", "multiple", F.bround("ratio", 2).alias("ratio"), F.when(F.col("lead").isNotNull(), lines).alias("baselines"), inside.alias("in_band"), notes.alias("notes"), "error")


def _spanned(layouts: DataFrame) -> DataFrame:
    """Adds ``spans``, of each block its width, right edge, top and bottom, and ``caps``, the cap heights above 0."""
    some = F.coalesce("blocks", F.expr("array()"))
    # array_min and array_max pass over nulls: a block without a baseline has neither top nor bottom
    span = lambda b: F.struct(
        b["x_width"].alias("wide"), (b["x"] + b["x_width"]).alias("right"),
        (F.array_min(b["lines"]["baseline"]) - F.coalesce(b["cap_height"], F.lit(0.0))).alias("top"), F.array_max(b["lines"]["baseline"]).alias("bottom"),
    )
    return layouts.withColumns({"spans": F.transform(some, span), "caps": F.filter(some["cap_height"], lambda c: c > 0)})


def _measured() -> dict[str, Column]:
    """What a layout candidate measures, in the metrics of the rules, from what _spanned() gave; nulls where it can't."""
    caps, spans = F.col("caps"), F.col("spans")
    w, h = F.col("canvas.w"), F.col("canvas.h")
    own = lambda b: F.coalesce(F.coalesce(b["wide"], F.lit(0.0)) * (b["bottom"] - b["top"]), F.lit(0.0))
    area = F.nullif(F.aggregate(spans, F.lit(0.0), lambda s, b: s + own(b)), F.lit(0.0))
    return {
        "cap_range": F.when(F.size(caps) >= 2, F.array_max(caps) / F.array_min(caps)),
        "n_blocks": F.when(F.size(spans) > 0, F.size(spans).cast("double")),
        "margin_left": F.when(w > 0, F.array_min(F.col("blocks")["x"]) / w),
        "margin_right": F.when(w > 0, (w - F.array_max(spans["right"])) / w),
        "margin_top": F.when(h > 0, F.array_min(spans["top"]) / h),
        "margin_bottom": F.when(h > 0, (h - F.array_max(spans["bottom"])) / h),
        "text_area": F.when((w > 0) & (h > 0), area / (w * h)),
    }


def candidates(layouts: DataFrame) -> DataFrame:
    """(layout, metric, value): what a layout candidate measures. Colours of its picture are sources.color_records()."""
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in _measured().items()])
    return _spanned(layouts).select("layout", listed.alias("listed")).select("layout", F.explode_outer("listed").alias("m")).select("layout", "m.*").where("value is not null")


def _finding(block: Column | None, rule: Column | str | None, status: Column | str | None, value: Column | None, lo=None, hi=None, fix=None, layer=None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    return F.struct(text(block).alias("block"), text(rule).alias("rule"), text(status).alias("status"), number(value).alias("value"), number(lo).alias("lo"), number(hi).alias("hi"), number(fix).alias("fix"), (F.lit(None) if layer is None else layer).cast("int").alias("layer"))


def _of_block() -> list[Column]:
    """The findings about one block with a leading, or nulls: its ratio, lines that touch, uneven lines."""
    aim, fit, seen = F.coalesce(F.col("forced"), F.col("adopted"), F.get("bands", F.lit(0))), F.col("fit"), F.col("seen")
    block, value = F.col("block"), F.bround(F.col("ratio"), 2)
    ratio = (
        F.when(fit.isNotNull(), _finding(block, LEADING, "accepted", value, fit["lo"], fit["hi"], None, fit["layer"]))
        .when(seen.isNotNull(), _finding(block, LEADING, "held", value, seen["lo"], seen["hi"], None, seen["layer"]))
        .otherwise(_finding(block, LEADING, "violation", value, aim["lo"], aim["hi"], F.bround(F.col("height") * aim["median"], 1)))
    )
    apart, reach = F.col("lead") - F.col("height"), F.array_max("gaps") - F.array_min("gaps")
    touching = (apart < LEAST_GAP, _finding(block, "overlap", "violation", F.bround(apart, 1), F.lit(LEAST_GAP)))
    uneven = ((F.size("gaps") >= 2) & (reach > 1), _finding(block, "regularity", "violation", F.bround(reach, 2), None, F.lit(1.0)))
    told = F.col("ratio").isNotNull()
    return [F.when(told, ratio), *[F.when(told & c, f) for c, f in (touching, uneven)]]


def _of_layout(metric: str) -> Column:
    """The finding about one measured metric, or null: only adopted ones can be violated, others are located."""
    e, value = F.col(f"of_{metric}"), F.col(f"m_{metric}")
    at = position(value, e["lo"], e["hi"], e["min"], e["max"])
    broken = (e["verdict"] == CONSTRAINT) & (at != "in_band")
    return F.when(value.isNotNull() & e.isNotNull(), _finding(None, metric, F.when(broken, "violation").otherwise(at), F.bround(value, 4), e["lo"], e["hi"], F.when(broken, e["median"])))


def check(layouts: DataFrame, rules: DataFrame) -> DataFrame:
    """(layout, corpus, block, rule, status, value, lo, hi, fix, layer): every block's leading against the layers of
    ``lead_over_cap`` or the one layer asked for, lines that touch or are uneven, and all other metrics against their rules.

    layouts: (layout, layer, canvas, blocks; corpus if the rules are of several). Blocks without two lines or a cap
    height are left out, and so are the checks of blocks where there is no entry for leading. Only adopted metrics can
    be violated; others are located: in_band, observed or outside. A right margin that no width gives is a ``note``. Layouts
    that cannot be checked have one row of status ``error``, with no_rules, no_such_layer or no_blocks as rule; those
    without any finding have one row with nulls. Layouts are read once, joined with one row for each corpus, and then a row for each
    block: its findings are plain columns of that row, and those of the layout are told with its first block."""
    layouts, sets = _sets(layouts, rules)
    measured = {f"m_{m}": v.cast("double") for m, v in _measured().items()}
    # a layout itself needs little of its rules; the sets are joined once more with its blocks' rows, so that no row carries them along
    n_bands = F.greatest(F.coalesce(F.size("bands"), F.lit(0)), F.lit(0))
    brief = sets.select("corpus", n_bands.alias("n_bands"), F.col("others").isNotNull().alias("has_rules"), *[F.coalesce(F.map_contains_key("others", m[2:]), F.lit(False)).alias(f"has_{m[2:]}") for m in measured])
    both = layouts.join(brief, "corpus", "left").withColumn("n_bands", F.coalesce("n_bands", F.lit(0)))
    asked = F.col("layer")
    both = _spanned(_unfit(both, F.col("has_rules").isNull() | ~F.col("has_rules"), ~((asked >= 1) & (asked <= F.col("n_bands")))))
    sound = F.col("error").isNull()
    # a layout whose blocks are all left out may be without any finding; only where nothing else is found, its blocks are asked for that
    judged = lambda x: (middle(gaps(x["lines"]["baseline"])) != 0) & (x["cap_height"] > 0)
    no_width = sound & (F.col("canvas.w") > 0) & F.array_min(F.col("blocks")["x"]).isNotNull() & F.array_max(F.col("spans")["right"]).isNull()
    both = both.withColumns(measured | {"no_width": F.coalesce(no_width, F.lit(False))})
    silent = sound & ~F.col("no_width")
    for m in measured:
        silent = silent & (F.col(m).isNull() | ~F.col(f"has_{m[2:]}"))
    silent = F.when(silent, ~((F.col("n_bands") > 0) & F.coalesce(F.exists("blocks", judged), F.lit(False)))).otherwise(False)
    held = both.select("layout", "corpus", "layer", "error", "n_bands", *measured, "no_width", silent.alias("silent"), "blocks")
    each = held.select(*[c for c in held.columns if c != "blocks"], F.posexplode_outer("blocks").alias("at", "b"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    each = each.select(*[c for c in each.columns if c not in ("b", "at")], first.alias("first"), F.col("b.id").alias("block"), F.col("b.cap_height").alias("height"), F.when(sound & (F.col("n_bands") > 0), gaps(F.col("b")["lines"]["baseline"])).alias("gaps"))
    each = each.withColumn("lead", middle(F.col("gaps")))
    each = each.withColumn("ratio", F.when((F.col("lead") != 0) & (F.col("height") > 0), F.col("lead") / F.col("height")))
    each = each.join(sets, "corpus", "left").withColumn("forced", _chosen())
    each = each.withColumns({"cands": F.when(asked.isNotNull(), F.array("forced")).otherwise(F.col("bands"))} | {f"of_{m[2:]}": F.try_element_at("others", F.lit(m[2:])) for m in measured})
    value = F.col("ratio")
    fit = F.get(F.filter("cands", lambda c: (c["verdict"] == CONSTRAINT) & value.between(c["lo"], c["hi"])), F.lit(0))
    seen = F.get(F.filter("cands", lambda c: (c["verdict"] != CONSTRAINT) & value.between(F.coalesce(c["min"], c["lo"]), F.coalesce(c["max"], c["hi"]))), F.lit(0))
    each = each.withColumn("fit", F.when(value.isNotNull(), fit)).withColumn("seen", F.when(value.isNotNull() & F.col("fit").isNull(), seen))
    own = [F.when(~sound, _finding(None, F.col("error"), "error", None)), *[F.when(sound, _of_layout(m[2:])) for m in measured], F.when(F.col("no_width"), _finding(None, "margin_right", "note", None)), F.when(F.col("silent"), _finding(None, None, None, None))]
    of_block = _of_block()
    told = each.select("layout", "corpus", F.when(F.col("first"), F.array(*own, *of_block)).otherwise(F.array(*of_block)).alias("found"))
    # explode_outer, whose array is never empty: for explode() Spark adds a filter in which it works the whole array out again
    return told.select("layout", "corpus", F.explode_outer("found").alias("f")).where("f is not null").select("layout", "corpus", "f.*")


def totals(checked: DataFrame) -> DataFrame:
    """(layout, corpus, n_violations, n_held, ok)."""
    return checked.groupBy("layout", "corpus").agg(F.count_if(F.col("status") == "violation").alias("n_violations"), F.count_if(F.col("status") == "held").alias("n_held"), (F.count_if(F.col("status").isin("violation", "error")) == 0).alias("ok"))
