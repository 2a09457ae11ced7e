"""Snapshots: nested records as path and value rows, what differs between two of them, and regressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.stages import written

#: Differences of a record that a report lists.
SHOWN = 10


def flatten(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of every leaf, with paths like ``a.b[0].c``; a null object, an empty one, and text that is no JSON
    give none; a leaf that is no object's has the path "value". Values are texts, JSON's null is null. One job for each
    level, and a row for each value, however deep or wide a record is."""
    kind = F.schema_of_variant("v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    found = []
    while True:
        level = written(level.withColumn("nested", nested))
        path = F.when(F.col("path") == "", F.lit("value")).otherwise(F.col("path"))
        found.append(level.where("not nested").select(key, path.alias("path"), F.col("v").cast("string").alias("value")))
        level = level.where("nested")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        spread = level.sparkSession.tvf.variant_explode(F.col("v").outer())
        inner = level.select(key, F.col("path").alias("above"), "v").lateralJoin(spread.toDF("__pos", "__name", "__child"))
        path = F.when(F.col("__name").isNull(), F.concat("above", F.lit("["), "__pos", F.lit("]"))).when(F.col("above") == "", F.col("__name")).otherwise(F.concat_ws(".", "above", "__name"))
        level = inner.select(key, path.alias("path"), F.col("__child").alias("v"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, before, after) of what differs; absent and null are equal."""
    a = old.select(*keys, F.col(value).alias("before"))
    b = new.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def snapshot(posters: DataFrame, cases: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(name, record): each case's poster as JSON, with its angle, its number of blocks and its blocks by place, null
    where it was not measured; and the rules' numbers as one record ``_rules``. cases: (file, why)."""
    block = lambda b: F.struct(F.struct(b["y1"].alias("y"), b["x1"].alias("x")).alias("at"), F.struct(b["n"].alias("n"), b["lead"].alias("lead"), b["xh"].alias("xh"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box")).alias("block"))
    blocks = F.transform(F.array_sort(F.transform(F.coalesce("blocks", F.expr("array()")), block)), lambda x: x["block"])
    record = F.to_json(F.struct("angle", F.size(blocks).alias("n_blocks"), blocks.alias("blocks")), {"ignoreNullFields": "false"})
    found = cases.select("file").join(posters.select("file", record.alias("record")), "file", "left").select(F.col("file").alias("name"), "record")
    if rules is None:
        return found
    entry = F.struct("n", "median", "lo", "hi", "min", "max", "cv", "verdict")
    told = rules.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", entry))))).alias("record"))
    return found.unionByName(told.select(F.lit("_rules").alias("name"), "record"))


def bless(found: DataFrame, path: str) -> None:
    """Make a snapshot the one to compare with."""
    found.write.mode("overwrite").json(path, ignoreNullFields=False)


def blessed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, record string").json(path)


def regression(old: DataFrame, new: DataFrame, cases: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(name, why, n_changed, changed): each record that differs, how many of its leaves do, the first of them by path as
    (path, before, after), and what the case is there for. Both are (name, record)."""
    both = reduce(DataFrame.unionByName, [rows.select("name", "record", F.lit(side).alias("side")) for side, rows in enumerate((old, new))])
    own = Window.partitionBy("name")
    alike = (F.count_if(F.col("side") == 0).over(own) == 1) & (F.count_if(F.col("side") == 1).over(own) == 1) & F.min("record").over(own).eqNullSafe(F.max("record").over(own)) & F.count("record").over(own).isin(0, 2)
    # records of one text have no leaves that differ; a record is written at most once for both snapshots
    leaves = flatten(both.where("name is not null").withColumn("alike", alike).where("not alike").select(F.struct("name", "side").alias("of"), "record"), "of", "record")
    a, b = (leaves.where(F.col("of.side") == side).select("of.name", "path", "value") for side in (0, 1))
    differs = diff(a, b, ["name", "path"])
    ranked = differs.withColumns({"place": F.row_number().over(own.orderBy("path")), "n_changed": F.count(F.lit(1)).over(own)}).where(F.col("place") <= shown)
    first = ranked.groupBy("name").agg(F.max("n_changed").alias("n_changed"), F.array_sort(F.collect_list(F.struct("path", "before", "after"))).alias("changed"))
    return first.join(cases.select(F.col("file").alias("name"), "why"), "name", "left").select("name", "why", "n_changed", "changed")
