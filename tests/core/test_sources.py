"""Images, poster files and the stream, on files made here."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallystone.functions import ordered  # noqa: F401
from tallystone.operators import judging, metrics, profiles
from tallystone.sources import posters as sources
from tallystone.streaming import ingest
from tests.core.test_operators import posters


def png(path, rows):
    """rows of (r, g, b)"""
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    white, black, red = (255, 255, 255), (0, 0, 0), (250, 0, 0)
    png(tmp_path / "a.png", [[white] * 8, [black] * 6 + [white] * 2, [white] * 8, [red] + [white] * 7])
    png(tmp_path / "b.PNG", [[white] * 2] * 2)
    (tmp_path / "c.jpg").write_bytes(b"no picture")
    (tmp_path / "d.txt").write_bytes(b"no picture")
    good, bad = sources.images(spark, str(tmp_path))
    assert {r["file"]: (r["height"], r["width"]) for r in good.collect()} == {"a.png": (4, 8), "b.PNG": (2, 2)}
    assert [r["file"] for r in bad.collect()] == ["c.jpg"]
    assert [r["file"] for r in sources.images(spark, str(tmp_path), 1)[0].collect()] == ["a.png"]
    pixels = sources.pixels(good.where("file = 'a.png'"))
    assert pixels.count() == 32 and pixels.where("y = 3 and x = 0").first()["gray"] == 299 * 250 / 1000
    level = profiles.polarity(pixels.select("file", F.col("gray").alias("value")), ["file"]).first()
    assert not level["inverted"]
    ink = profiles.ink_profile(pixels, ["file"], "y", F.col("gray") < level["level"])
    assert {r["at"]: r["value"] for r in ink.collect()} == {0: 0, 1: 6, 2: 0, 3: 1}
    rgb = spark.createDataFrame([("a", 255, 255, 255)] * 6 + [("a", 255, 0, 0)] * 4, "file string, r int, g int, b int")
    assert tuple(sources.colors(rgb).first())[1:] == (0.6, 2, 0.6)


def test_poster_files(spark, tmp_path):
    first = posters(spark)
    sources.write_posters(first, str(tmp_path / "one"))
    first.withColumn("ord", F.lit(2)).withColumn("n_columns", F.lit(9)).limit(4).write.mode("append").parquet(str(tmp_path / "one" / "corpus=c"))
    got = sources.read_posters(spark, {"mine": str(tmp_path / "one" / "corpus=c"), "gone": str(tmp_path / "gone")})
    assert got.count() == 4 and {(r["corpus"], r["n_columns"]) for r in got.collect()} == {("mine", 9)}
    assert sources.read_posters(spark, {"gone": str(tmp_path / "gone")}).count() == 0


def test_rules_are_read_back(spark, tmp_path):
    rules = judging.derive(metrics.observe(posters(spark)))
    sources.write_rules(rules, str(tmp_path / "rules"))
    got = sources.read_rules(spark, {"c": str(tmp_path / "rules" / "corpus=c"), "gone": str(tmp_path / "gone")})
    columns = sorted(rules.columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, rules.select(*columns).collect()))


def test_rules_are_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert sources.current_rules(spark, path).count() == 0
    rules = judging.derive(metrics.observe(posters(spark)))
    shown = lambda frame: sorted(map(str, frame.select(*sorted(rules.columns)).collect()))
    first, second = rules.where("metric < 'g'"), rules.where("metric >= 'g'")
    sources.replace_rules(first, path)
    before = shown(first)
    assert shown(sources.current_rules(spark, path)) == before and before
    broken = second.withColumn("metric", F.when(F.length("metric") > 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("metric")))
    with pytest.raises(Exception, match="stopped"):
        sources.replace_rules(broken, path)
    assert shown(sources.current_rules(spark, path)) == before
    reader = sources.current_rules(spark, path)
    sources.replace_rules(second, path)
    assert shown(reader) == before and shown(sources.current_rules(spark, path)) == shown(second) != before
    sources.replace_rules(rules.limit(0), path)
    assert sources.current_rules(spark, path).count() == 0


def test_boxes(spark):
    quad = lambda x, y, w, dy: [(float(a), float(b)) for a, b in ((x, y), (x + w, y + dy), (x + w, y + dy + 9), (x, y + 9))]
    rows = [("a", 500, 500, quad(0, 10, 100, 5)), ("a", 500, 500, quad(20, 50, 200, 10)), ("a", 500, 500, quad(20, 50, 10, 10)), ("b", 90, 90, quad(3, 3, 85, 0))]
    boxes = spark.createDataFrame(rows, "img string, w int, h int, quad array<struct<x:double,y:double>>")
    assert {r["img"]: tuple(r)[1:] for r in sources.union_box(boxes).collect()} == {"a": (0, 4, 226, 75), "b": (0, 0, 90, 18)}
    got = {r["img"]: round(r["angle"], 2) for r in sources.skew(boxes).collect()}
    assert got == {"a": 2.86, "b": 0.0}
    seen = spark.createDataFrame([(0.003, [("person", 0.95)]), (0.001, []), (0.002, [("person", 0.1)])], "d double, o array<struct<label:string,score:double>>")
    assert [r[0] for r in seen.select(sources.photo_verdict(F.col("d"), F.col("o"))).collect()] == ["yes", "no", "unknown"]


def test_stream(spark, tmp_path):
    into, seen = str(tmp_path / "obs"), str(tmp_path / "in")
    posters(spark).write.parquet(seen)
    for more in (False, True):
        if more:
            posters(spark).withColumn("file", F.concat("file", F.lit("2"))).write.mode("append").parquet(seen)
        ingest.follow(spark, seen, into, str(tmp_path / "state")).awaitTermination(120)
        n = metrics.observe(posters(spark)).count() * (1 + more)
        assert spark.read.parquet(into).count() == n
    assert ingest.rules(spark, into).where("metric = 'n_blocks'").first()["n"] == 4


def test_records_that_fail_stop_no_others(spark, tmp_path):
    at = tmp_path / "posters.jsonl"
    at.write_text('{"file": "a", "ord": 1, "angle": 2.0}\n{"file": "b", "ord": \n{"ord": 3}\n{"file": "a", "ord": 4, "angle": 5.0}\n')
    good, failed = sources.checked_posters(spark, {"mine": str(at), "gone": str(tmp_path / "gone")})
    assert [(r["corpus"], r["file"], r["angle"]) for r in good.collect()] == [("mine", "a", 5.0)]
    assert sorted((r["corpus"], r["step"], r["reason"]) for r in failed.collect()) == [("mine", "record", "no name"), ("mine", "record", "not a record")]
    good, failed = sources.checked_posters(spark, {"gone": str(tmp_path / "gone")})
    assert good.count() == 0 and failed.count() == 0
