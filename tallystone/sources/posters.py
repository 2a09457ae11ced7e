"""Reading and writing corpora: images, poster records, rules, and the failures beside them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import ordered
from tallystone.functions.stages import written
from tallystone.operators.judging import last_wins, top
from tallystone.schemas import POSTER, RULES

MANIFEST = "number long, folder string"
#: The column that takes lines which are no records.
BROKEN = "_broken"
PATTERN = "*.{jpg,jpeg,png,JPG,PNG}"


def images(spark: SparkSession, folder: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, errors) of the pictures in one folder, not below it; ``limit`` takes the first paths.

    images: (file, path, height, width, n_channels, data as BGR bytes); errors: (file, reason). With a
    limit, paths alone are sorted before anything is decoded."""
    paths = [folder]
    if limit:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(folder).select("path")
        paths = [r["path"] for r in listed.orderBy("path").limit(limit).collect()]
        if not paths:
            limit = None
            paths = [folder]
    read = spark.read.format("image").option("pathGlobFilter", PATTERN).load(paths).select("image.*")
    path = F.regexp_replace(F.col("origin"), "^file:/+", "/")
    named = read.select(F.element_at(F.split(path, "/"), -1).alias("file"), path.alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    good = F.col("height") > 0
    return named.where(good), named.where(~good).select("file", F.lit("not a readable image").alias("reason"))


def usable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, failures): pictures whose pixels can be told, and a row (file, step, reason) for each that has no
    name, no size, other than 1, 3 or 4 channels, no data or not as many bytes as its size needs, or a name that others have too."""
    repeated = images.where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n_named")).where("n_named > 1")
    need = F.col("height").cast("long") * F.col("width") * F.col("n_channels")
    reason = (
        F.when(F.col("file").isNull(), "no name")
        .when(~F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False)), "no size")
        .when(~F.coalesce(F.col("n_channels").isin(1, 3, 4), F.lit(False)), "channels are not 1, 3 or 4")
        .when(F.col("data").isNull(), "no data")
        .when(F.octet_length("data") != need, F.concat(F.octet_length("data"), F.lit(" bytes where "), need, F.lit(" are needed")))
        .when(F.col("n_named").isNotNull(), "several pictures have this name")
    )
    told = ordered.joined(images, repeated, ["file"], "left").withColumn("reason", reason)
    return told.where("reason is null").select(*images.columns), told.where("reason is not null").select("file", F.lit("read").alias("step"), "reason")


def pixels(images: DataFrame) -> DataFrame:
    """(file, y, x, gray): a row for each pixel of images of 1, 3 or 4 channels."""
    n, at = F.col("n_channels"), F.col("p") * F.col("n_channels")
    byte = lambda i: F.conv(F.hex(F.substring("data", (at + i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    each = images.select("file", "width", "n_channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("p"))
    gray = F.when(n == 1, byte(0).cast("double")).otherwise((299 * byte(2) + 587 * byte(1) + 114 * byte(0)) / 1000)
    return each.select("file", F.floor(F.col("p") / F.col("width")).alias("y"), F.pmod("p", "width").alias("x"), gray.alias("gray"))


def rgb(images: DataFrame) -> DataFrame:
    """(file, y, x, r, g, b): a row for each pixel; a gray picture has three equal values."""
    n, at = F.col("n_channels"), F.col("p") * F.col("n_channels")
    byte = lambda i: F.conv(F.hex(F.substring("data", (at + i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    each = images.select("file", "width", "n_channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("p"))
    shown = [F.when(n == 1, byte(0)).otherwise(byte(i)).alias(c) for c, i in (("r", 2), ("g", 1), ("b", 0))]
    return each.select("file", F.floor(F.col("p") / F.col("width")).alias("y"), F.pmod("p", "width").alias("x"), *shown)


def color_levels(pixels_rgb: DataFrame) -> DataFrame:
    """(file, saturation, value) of pixels (file, r, g, b): the median distance of the largest from the
    smallest of the three as a share of the largest, and the median of the largest as a share of 255."""
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    levels = F.array(F.struct(F.lit("saturation").alias("level"), F.when(most > 0, (most - least) / most).otherwise(0.0).alias("value")), F.struct(F.lit("value").alias("level"), (most / 255).alias("value")))
    found = ordered.quantiles(pixels_rgb.select("file", F.explode(levels).alias("s")).select("file", "s.*"), ["file", "level"], {"m": 0.5})
    return found.groupBy("file").agg(*[F.bround(F.max(F.when(F.col("level") == c, F.col("m"))), 4).alias(c) for c in ("saturation", "value")])


def color_records(pixels_rgb: DataFrame) -> DataFrame:
    """(file, color): the five colour metrics of a poster record."""
    both = colors(pixels_rgb).join(color_levels(pixels_rgb), "file")
    return both.select("file", F.struct("ground_share", F.col("n_colors").cast("int").alias("n_colors"), "saturation", "value", "gray_share").alias("color"))


def colors(pixels_rgb: DataFrame) -> DataFrame:
    """(file, ground_share, n_colors, gray_share) of pixels (file, r, g, b): shares of 64 colour cells."""
    cell = F.floor(F.col("r") / 64) * 16 + F.floor(F.col("g") / 64) * 4 + F.floor(F.col("b") / 64)
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    gray = F.count_if(F.when(most > 0, (most - least) / most).otherwise(0.0) < 0.12)
    cells = pixels_rgb.groupBy("file", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), gray.alias("gray"))
    share = F.col("n") / F.col("all")
    total = cells.groupBy("file").agg(F.sum("n").alias("all"))
    return cells.join(total, "file").groupBy("file").agg(
        F.bround(F.max(share), 4).alias("ground_share"), F.count_if(share > 0.02).alias("n_colors"), F.bround(F.sum("gray") / F.max("all"), 4).alias("gray_share")
    )


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path has anything to read, as Spark's own readers see it."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _read(spark: SparkSession, corpora: dict[str, str], schema: str) -> DataFrame:
    found = []
    for name, path in corpora.items():
        if not _there(spark, path):
            continue
        read = spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN)
        frame = read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else read.parquet(path)
        found.append(frame.withColumn("corpus", F.lit(name)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def read_posters(spark: SparkSession, corpora: dict[str, str]) -> DataFrame:
    """Poster records of several corpora, each a folder of Parquet or JSON lines; a missing folder gives
    none. Of records of the same file the last one stays."""
    return last_wins(_read(spark, corpora, POSTER), ["corpus", "file"], ["ord"])


def checked_posters(spark: SparkSession, corpora: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(posters, failures): read_posters() of the records that can be read, and a row (corpus, file, step, reason) for each
    line that is no record and each record without a name. The records are written once; the others go on."""
    found = written(_read(spark, corpora, f"{POSTER}, {BROKEN} string"))
    reason = F.when(F.col(BROKEN).isNotNull(), "not a record").when(F.col("file").isNull(), "no name")
    told = found.withColumn("reason", reason)
    good = told.where("reason is null").drop("reason", BROKEN)
    return last_wins(good, ["corpus", "file"], ["ord"]), told.where("reason is not null").select("corpus", "file", F.lit("record").alias("step"), "reason")


def read_rules(spark: SparkSession, corpora: dict[str, str]) -> DataFrame:
    """Rules as judging.derive() gave them, of several corpora; a corpus whose folder is missing has none."""
    return _read(spark, corpora, RULES)


def write_posters(posters: DataFrame, path: str) -> None:
    posters.write.mode("overwrite").partitionBy("corpus").parquet(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Replace the rules in a folder, a corpus each below it."""
    rules.write.mode("overwrite").partitionBy("corpus").parquet(path)


def replace_rules(rules: DataFrame, path: str) -> None:
    """Put rules of all corpora in the place of those in a folder, at once: they are written to a folder of their own, and only when
    that is complete a row of the manifest beside it names it. Readers see the rules before or the new ones, never a part of
    either; a write that is stopped leaves the old ones. Earlier versions stay until someone clears them. One writer at a time."""
    spark, folder = rules.sparkSession, f"version-{uuid.uuid4().hex}"
    number = max((r["number"] for r in _manifest(spark, path).collect()), default=0) + 1
    rules.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(number, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """(number, folder): a row for each complete version."""
    at = f"{path}/manifest"
    return spark.read.schema(MANIFEST).parquet(at) if _there(spark, at) else spark.createDataFrame([], MANIFEST)


def current_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules that replace_rules() put there last; none if it never did."""
    last = _manifest(spark, path).orderBy(F.desc("number")).limit(1).collect()
    return spark.read.schema(RULES).parquet(f"{path}/{last[0]['folder']}") if last else spark.createDataFrame([], RULES)


def union_box(boxes: DataFrame, pad: int = 6) -> DataFrame:
    """(img, x1, y1, x2, y2) around all text boxes of an image (img, w, h, quad), padded and clamped."""
    xs, ys = F.transform("quad", lambda p: p["x"]), F.transform("quad", lambda p: p["y"])
    ends = boxes.groupBy("img").agg(F.min(F.array_min(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y1"), F.max(F.array_max(xs)).alias("x2"), F.max(F.array_max(ys)).alias("y2"), F.max("w").alias("w"), F.max("h").alias("h"))
    low = lambda c: F.greatest(F.lit(0), (F.col(c) - pad).cast("int"))
    return ends.select("img", low("x1").alias("x1"), low("y1").alias("y1"), F.least("w", (F.col("x2") + pad).cast("int")).alias("x2"), F.least("h", (F.col("y2") + pad).cast("int")).alias("y2"))


def skew(boxes: DataFrame, least: float = 40.0, widest: int = 8) -> DataFrame:
    """(img, angle, spread): median angle of the widest boxes of an image, in degrees, and 0 where it is
    below 1, above 10 or the angles are spread over more than 2. Angles over 45 from the median are
    read as a quarter turn away. boxes: (img, quad, conf)."""
    a, b = F.get("quad", F.lit(0)), F.get("quad", F.lit(1))
    wide = boxes.select("img", F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("w"), F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])).alias("angle")).where(F.col("w") >= least)
    row = Window.partitionBy("img").orderBy(F.desc("w"), "angle")
    best = wide.withColumn("place", F.row_number().over(row)).where(F.col("place") <= widest)
    # at most ``widest`` rows of an image are left, so its exact median is small
    usual = best.groupBy("img").agg(F.median("angle").alias("usual"))
    off = F.col("angle") - F.col("usual")
    turned = best.join(usual, "img").withColumn("angle", F.col("angle") - F.when(off > 45, 90.0).when(off < -45, -90.0).otherwise(0.0))
    middle = turned.groupBy("img").agg(F.median("angle").alias("m"), F.stddev_pop("angle").alias("spread"))
    keep = (F.abs("m") >= 1) & (F.abs("m") <= 10) & (F.col("spread") <= 2)
    return middle.select("img", F.when(keep, F.col("m")).otherwise(0.0).alias("angle"), "spread")


#: Objects that only photos show.
PHOTO_LABELS = ("person", "bicycle", "motorcycle", "car", "bottle", "wine glass", "bus", "truck", "dog", "cat", "horse", "bird", "train", "boat")


def sure_objects(objects: Column, least: float = 0.9, labels: tuple[str, ...] = PHOTO_LABELS) -> Column:
    """Of an array of struct(label, score) those that a detector is sure of and that tell photos from drawings."""
    return F.filter(objects, lambda o: (o["score"] >= least) & o["label"].isin(*labels))


def photo_verdict(depth: Column, objects: Column, strong: float = 0.0026, weak: float = 0.0018) -> Column:
    """yes: sure objects and a deep picture; no: none and a flat one; else unknown."""
    seen = F.size(sure_objects(objects)) > 0
    return F.when(seen & (depth >= strong), "yes").when(~seen & (depth < weak), "no").otherwise("unknown")


def gradient(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, gradient): the mean steepness of pictures (by, y, x, value) whose values go from 0 to 1: half the difference
    of both neighbours along each axis, at the edges the whole difference to the only one; 0 for flat pictures."""
    ends = pixels.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    reach = F.col("high") - F.col("low")
    level = ordered.joined(pixels, ends, by).select(*by, "y", "x", F.when(reach > 0, (F.col(value) - F.col("low")) / reach).otherwise(0.0).alias("v"))

    def steep(along: str, across: str) -> Column:
        row = Window.partitionBy(*by, across).orderBy(along)
        before, after = F.lag("v").over(row), F.lead("v").over(row)
        return F.when(before.isNull() & after.isNull(), 0.0).otherwise((F.coalesce(after, F.col("v")) - F.coalesce(before, F.col("v"))) / F.when(before.isNull() | after.isNull(), 1).otherwise(2))

    return level.withColumns({"gx": steep("x", "y"), "gy": steep("y", "x")}).groupBy(*by).agg(F.avg(F.hypot("gx", "gy")).alias("gradient"))


def unrotated(x: Column, y: Column, angle: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """struct(x, y): where a point of a picture turned by ``angle`` degrees is in the picture before;
    the two sizes are (width, height), and both turn about their middle."""
    dx, dy, a = x - after[0] / 2, y - after[1] / 2, F.radians(angle)
    return F.struct((F.cos(a) * dx - F.sin(a) * dy + before[0] / 2).alias("x"), (F.sin(a) * dx + F.cos(a) * dy + before[1] / 2).alias("y"))


def tallies(posters: DataFrame) -> DataFrame:
    """(corpus, n_posters, n_rotated, n_judged, n_yes, n_no, n_unknown): turned posters, and photo
    verdicts of those that were judged."""
    verdict = F.when(F.col("photo").isNotNull(), F.coalesce("photo.verdict", F.lit("unknown")))
    return posters.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_posters"), F.count_if(F.abs(F.coalesce("angle", F.lit(0.0))) >= 1).alias("n_rotated"), F.count_if(F.col("photo").isNotNull()).alias("n_judged"), *[F.count_if(verdict == v).alias(f"n_{v}") for v in ("yes", "no", "unknown")]
    )


def seen_objects(posters: DataFrame, k: int = 6) -> DataFrame:
    """(rank, label, n): the objects that photos show most often."""
    return top(posters.select(F.explode("photo.objects").alias("o")).select(F.col("o.label").alias("label")), "label", k)
