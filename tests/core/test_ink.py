"""Ink and lines against plain versions and hand-made pictures."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import ink, lines
from tallystone.sources import posters as sources
from tests.core.test_operators import posters

INK = "img int, y int, x int"


def pixels(spark, pictures):
    """pictures: {img: rows of text with # for ink}"""
    return spark.createDataFrame([(i, y, x) for i, rows in pictures.items() for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"], INK)


def plain_components(points, diagonal):
    left, found = set(points), []
    while left:
        stack, own = [left.pop()], []
        while stack:
            y, x = stack.pop()
            own.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or a == 0 or b == 0} & left
            left -= near
            stack += near
        ys, xs = zip(*own)
        found.append((len(own), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(found)


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(spark, diagonal):
    rng = random.Random(5)
    points = {i: {(rng.randrange(30), rng.randrange(200)) for _ in range(2200)} for i in range(2)}
    frame = spark.createDataFrame([(i, y, x) for i, p in points.items() for y, x in p] + [(0, *next(iter(points[0])))], INK)
    got: dict = {}
    for r in ink.components(frame, ["img"], diagonal).collect():
        got.setdefault(r["img"], []).append((r["area"], r["x1"], r["y1"], r["x2"], r["y2"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_components(v, diagonal) for k, v in points.items()}
    assert ink.components(spark.createDataFrame([], INK), ["img"]).count() == 0


def test_size_classes(spark):
    frame = pixels(spark, {1: ["#.#.#...#", "#.#.#...#", "........#", "........#", "........#", "........#", "........#"], 2: ["#.#"]})
    found = ink.strata(ink.components(frame, ["img"]), ["img"])
    assert sorted((r["img"], r["y2"] - r["y1"], r["body"], r["tall"]) for r in found.collect()) == [(1, 2, 2.0, False)] * 3 + [(1, 7, 2.0, True)] + [(2, 1, 0.0, False)] * 2
    shape = {r["img"]: tuple(r)[1:] for r in ink.shape(ink.components(frame, ["img"]), ["img"], F.lit(2)).collect()}
    assert shape == {1: (13, 4, 0.538, 0.846, 1.0)}
    assert ink.closed(pixels(spark, {1: ["....", ".#.#", "....", "...."]}), ["img"]).count() == 3


def test_border(spark):
    axis = lambda values: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, at long, value double")
    ends = lambda values: tuple(ink.trimmed(axis(values), ["k"]).first())[1:]
    assert ends([0.9, 1.0, 0.3, 0.0, 0.2, 0.5, 0.0]) == (3, 7)
    assert ends([0.5, 0.0, 0.1, 0.2, 0.3, 0.4, 0.9]) == (0, 3)
    assert ends([0.0] * 4) == (0, 4) and ends([1.0] * 3) == (3, 0)
    frame = pixels(spark, {1: ["#...", "#...", "....", "...#"]})
    boxes = spark.createDataFrame([(1, 0, 0, 4, 4)], "img int, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in ink.dark_edges(frame, boxes, ["img"]).collect()] == [(1, "left", 0.5)]


def test_line_measures(spark):
    rows = [0, 1, 1, 6, 8, 7, 8, 2, 1]
    profile = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rows)] + [("b", i, 0.0) for i in range(3)] + [("c", 4, 5.0), ("c", 5, 6.0)], "line string, at long, value double")
    nz = np.array([v for v in rows if v > 0])
    level = 0.5 * np.median(nz[nz >= np.median(nz)])
    assert {r["line"]: r["base"] for r in lines.baselines(profile, ["line"]).collect()} == {"a": int(np.flatnonzero(np.array(rows) >= level)[-1]) + 1, "b": None, "c": 6}
    parts = spark.createDataFrame([("a", 1, 2), ("a", 1, 7), ("a", 3, 9), ("c", 4, 6)], "line string, y1 int, y2 int")
    got = {r["line"]: tuple(r)[1:] for r in lines.marks(profile, parts, ["line"]).collect()}
    assert got == {"a": (3, 1, 1, 1, "ascender"), "b": (0, None, None, 0, "none"), "c": (4, None, None, 0, "x_only")}
    under = spark.createDataFrame([("a", 8, 11), ("a", 9, 10), ("b", 8, 9)], "line string, y1 int, y2 int")
    assert {r["line"]: r["desc"] for r in lines.descenders(under, ["line"]).collect()} == {"a": 11, "b": None}
    rows = [([10.0, 24.0, 41.0, 55.0], 15.0), ([10.0, 24.0], 14.0), ([0.0, 10.0, 20.0], 14.0), ([0.0, 10.0, 20.0], None)]
    grid = [r["g"] for r in spark.createDataFrame(rows, "b array<double>, lead double").select(lines.on_grid(F.col("b"), F.col("lead")).alias("g")).collect()]
    assert grid[0]["fitted"] == [10.0, 25.0, 40.0, 55.0] and (grid[0]["lead"], grid[0]["residual"]) == (15.0, 0.5)
    assert [(g["fitted"], g["lead"]) for g in grid[1:]] == [(b, None) for b, _ in rows[1:]]


def plain_blocks(ls):
    """Numbers of blocks, line by line, from the rules as they are stated."""
    if not ls:
        return []
    usual = np.median(np.diff([s[0] for s in ls])) if len(ls) > 1 else 0
    numbers, own = [0], [ls[0][3]]
    for i in range(1, len(ls)):
        (b0, l0, r0, _), (b1, l1, r1, x1) = ls[i - 1], ls[i]
        ref = np.median(own)
        odd = [abs(ref - x) > 2 and abs(ref - x) > 0.25 * min(ref, x) for x in [x1, *[s[3] for s in ls[i + 1 : i + 2]]]]
        axis = abs(l0 - l1) <= 2 or abs(r0 - r1) <= 2 or abs(l0 + r0 - l1 - r1) <= 4
        new = b1 - b0 > 1.5 * usual or not axis or (len(odd) == 2 and all(odd))
        numbers.append(numbers[-1] + new)
        own = [x1] if new else [*own, x1]
    return numbers


def test_blocks(spark):
    rng = random.Random(6)
    columns = [[]]
    for _ in range(60):
        base, column = 0.0, []
        size = 10.0
        for _ in range(rng.randint(1, 14)):
            base += rng.choice([14, 14, 14, 15, 30])
            size = rng.choice([size, size, 10.0, 16.0, 30.0])
            left = float(rng.choice([0, 0, 0, 1, 9]))
            column.append((base, left, left + rng.choice([50, 50, 80, 33]), size))
        columns.append(column)
    frame = spark.createDataFrame(list(enumerate(columns)), "k int, s array<struct<base:double,xs:double,xe:double,xh:double>>")
    got = {r["k"]: r["n"] for r in frame.select("k", lines.block_numbers(F.col("s")).alias("n")).collect()}
    assert got == {k: plain_blocks(c) for k, c in enumerate(columns)}
    rows = spark.createDataFrame([(1, 0, 10, 5, 50, 8), (1, 14, 24, 5, 60, 9), (1, 60, 70, 5, 60, 8)], "k int, top int, base int, xs int, xe int, xh int")
    assert sorted(tuple(r)[1:] for r in lines.blocks(rows, ["k"]).collect()) == [(0, 2, 5, 0, 60, 24, 10.0, 8.5), (1, 1, 5, 60, 60, 70, 10.0, 8.0)]


def test_alignment(spark):
    rows = [([1.0, 2.0, 1.0], [50.0, 90.0, 20.0]), ([1.0, 40.0], [90.0, 90.0]), ([0.0, 20.0], [100.0, 80.0]), ([0.0, 50.0], [100.0, 300.0]), ([1.0], [2.0]), ([3.0, 3.0], [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>").select(lines.alignment(F.col("a"), F.col("b")).alias("x"))
    got = [r["x"] for r in frame.collect()]
    assert [g["align"] for g in got] == ["left", "right", "center", "none", None, "left"]
    assert got[0]["left"] == round(float(np.std(rows[0][0])), 2)


def test_color_records(spark):
    rows = [("a", 200, 100, 0)] * 3 + [("a", 0, 0, 0)] * 2 + [("b", 255, 255, 255)]
    got = {r["file"]: r["color"] for r in sources.color_records(spark.createDataFrame(rows, "file string, r int, g int, b int")).collect()}
    assert (got["a"]["saturation"], got["a"]["value"], got["a"]["n_colors"]) == (1.0, round(200 / 255, 4), 2)
    assert (got["b"]["saturation"], got["b"]["value"], got["b"]["gray_share"]) == (0.0, 1.0, 1.0)


def test_turns_and_tallies(spark):
    back = sources.unrotated(F.lit(60.0), F.lit(50.0), F.lit(90.0), (F.lit(80.0), F.lit(100.0)), (F.lit(100.0), F.lit(80.0)))
    p = spark.range(1).select(back.alias("p")).first()["p"]
    assert (p["x"], p["y"]) == pytest.approx((30.0, 60.0))
    seen = posters(spark).withColumn("photo", F.when(F.col("file") == "a", F.from_json(F.lit('{"verdict": "yes", "objects": [{"label": "cat", "score": 0.9}, {"label": "dog", "score": 0.9}, {"label": "cat", "score": 0.8}]}'), "depth_grad double, objects array<struct<label:string,score:double>>, verdict string, note string")))
    assert tuple(sources.tallies(seen).first()) == ("c", 4, 1, 1, 1, 0, 0)
    assert [(r["label"], r["n"]) for r in sources.seen_objects(seen).collect()] == [("cat", 2), ("dog", 1)]
