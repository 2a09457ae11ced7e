"""Angles, turned pictures, smaller pictures and palettes against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.operators import palette, turning
from tallystone.plans import catalog, sql
from tallystone.sources import posters as sources

GRAY = "img int, y int, x int, gray double"
COLOR = "img int, y int, x int, r int, g int, b int"
ONE = 1 << 16


def turn(angle):
    return round(math.cos(math.radians(angle)) * ONE), round(math.sin(math.radians(angle)) * ONE)


def plain_sharpest(points, w, h, reach=90.0, step=0.5):
    best = None
    for k in range(round(2 * reach / step) + 1):
        c, s = turn(k * step - reach)
        high = -(-(abs(s) * w + abs(c) * h) // ONE)
        rows = np.zeros(2 * high + 2)
        for y, x in points:
            rows[((c * (2 * y + 1 - h) - s * (2 * x + 1 - w) + high * ONE) >> 17) + high // 2] += 1
        score = high * int((rows * rows).sum())
        if best is None or score > best[0]:
            best = (score, k * step - reach, len(points))
    return best[1], math.sqrt(best[0] / best[2] ** 2 - 1)


def slanted(angle, w=120, h=70):
    """Lines of print that fall by an angle."""
    return {(y, x) for x in range(w) for line in range(10, h - 10, 12) for d in range(3) if 0 <= (y := line + d + round((x - w / 2) * math.tan(math.radians(angle)))) < h}


def test_sharpest_equals_a_plain_loop(spark):
    rng = random.Random(1)
    pictures = {0: (slanted(0), 120, 70), 1: (slanted(4.5), 120, 70), 2: (slanted(-7), 120, 70), 3: ({(rng.randrange(20), rng.randrange(30)) for _ in range(90)}, 30, 20), 4: ({(3, 3)}, 9, 9)}
    ink = spark.createDataFrame([(i, y, x) for i, (p, _, _) in pictures.items() for y, x in p], "img int, y int, x int")
    sizes = spark.createDataFrame([(i, w, h) for i, (_, w, h) in pictures.items()] + [(9, 5, 5)], "img int, width int, height int")
    got = {r["img"]: (r["angle"], r["sharpness"]) for r in turning.sharpest(ink, sizes, ["img"]).collect()}
    want = {i: plain_sharpest(*p) for i, p in pictures.items()}
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert [abs(got[i][0] - a) <= 0.5 for i, a in ((0, 0), (1, 4.5), (2, -7))] == [True] * 3
    quick = {r["img"]: r["angle"] for r in turning.sharpest(ink.where("img < 3"), sizes, ["img"], coarse=4).collect()}
    assert quick == {i: got[i][0] for i in range(3)}
    assert turning.sharpest(ink.limit(0), sizes, ["img"]).count() == 0


def test_sharpest_shuffles_pixels_and_not_their_projections(spark, monkeypatch):
    p, w, h = slanted(4.5), 120, 70
    ink = spark.createDataFrame([(i, y, x) for i in (0, None) for y, x in p] * 2, "img int, y int, x int")
    sizes = spark.createDataFrame([(0, w, h), (None, w, h)], "img int, width int, height int")
    for coarse in (1, 4):
        found = turning.sharpest(ink, sizes, ["img"], 20.0, coarse=coarse)
        # a row for each pixel and angle was exploded before any row of a picture was summed
        assert "explode" not in found._jdf.queryExecution().toString().lower()
        got = {tuple(r) for r in found.collect()}
        assert {(r[0], r[1]) for r in got} == {(i, plain_sharpest(p, w, h, 20.0)[0]) for i in (0, None)}
        with monkeypatch.context() as m:
            m.setattr(turning, "PICTURE", 0)
            assert {tuple(r) for r in turning.sharpest(ink, sizes, ["img"], 20.0, coarse=coarse).collect()} == got
        with monkeypatch.context() as m:
            m.setattr(turning, "_PROJECTED", 3000)
            assert {tuple(r) for r in turning.sharpest(ink, sizes, ["img"], 20.0, coarse=coarse).collect()} == got


def test_angles_of_boxes(spark):
    rows = [(1, y, x, 20.0 if (y - 40, x - 30) in print_ else 230.0) for print_ in (slanted(5),) for y in range(160) for x in range(200)]
    pixels = spark.createDataFrame(rows, GRAY)
    quad = lambda x1, y1, x2, y2: [(float(x1), float(y1)), (float(x2), float(y1)), (float(x2), float(y2)), (float(x1), float(y2))]
    boxes = spark.createDataFrame([(1, 1, quad(36, 46, 144, 104)), (1, 2, quad(36, 46, 60, 104)), (1, 3, quad(150, 158, 199, 159)), (2, 1, quad(0, 0, 90, 20))], "img int, box int, quad array<struct<x:double,y:double>>")
    held, sizes = turning.crops(pixels, boxes, ["img"])
    assert {(r["box"], r["width"], r["height"]) for r in sizes.collect()} == {(1, 120, 70), (2, 36, 70), (3, 56, 8)}
    assert held.where("box = 1 and gray < 100").count() == len(slanted(5))
    got = turning.box_angles(pixels, boxes, ["img"]).collect()
    assert [(r["box"], r["w"]) for r in got] == [(1, 108.0)] and abs(got[0]["angle"] - 5) <= 0.5


def picture(spark, img, cells, angle):
    rows = [(img, y, x, float(v)) for y, row in enumerate(cells) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, GRAY), spark.createDataFrame([(img, len(cells[0]), len(cells), float(angle))], "img int, width int, height int, angle double")


def drawn(frame):
    rows = frame.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r["gray"]
    assert not np.isnan(out).any()
    return out


@pytest.mark.parametrize("angle", [90, 180, -90, 0])
def test_quarter_turns_are_exact(spark, angle):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 256, (7, 12))
    assert (drawn(turning.turned(*picture(spark, 1, cells, angle), ["img"])) == np.rot90(cells, angle // 90)).all()


def test_turned_and_turned_back(spark):
    cells = [[100 + 80 * math.sin(x / 9) * math.cos(y / 7) for x in range(48)] for y in range(36)]
    pixels, sizes = picture(spark, 1, cells, 7.5)
    there = turning.turned(pixels, sizes, ["img"])
    wide = turning.turned_sizes(sizes, ["img"])
    back = drawn(turning.turned(there, wide.withColumn("angle", F.lit(-7.5)), ["img"]))
    top, left = (back.shape[0] - 36) // 2, (back.shape[1] - 48) // 2
    inner = back[top + 6 : top + 30, left + 6 : left + 42]
    assert np.abs(inner - np.array(cells)[6:30, 6:42]).max() < 6
    # a point of the turned picture is led back to where its pixel came from
    size = wide.collect()[0]
    c, s = turn(7.5)
    x, y = 20, 15
    spot = sources.unrotated(F.lit(x + 0.5), F.lit(y + 0.5), F.lit(7.5), (F.lit(48), F.lit(36)), (F.lit(size["width"]), F.lit(size["height"])))
    at = spark.range(1).select(spot.alias("p")).first()["p"]
    value = there.where(f"y = {y} and x = {x}").first()["gray"]
    assert abs(value - (100 + 80 * math.sin((at["x"] - 0.5) / 9) * math.cos((at["y"] - 0.5) / 7))) < 2
    far = there.where("y = 0 and x = 0").first()["gray"]
    assert far == math.floor(np.median(cells)) and there.count() == size["width"] * size["height"]


def test_reading_settles_quarter_turns(spark):
    found = spark.createDataFrame([(1, 1, 90.0, 2.0), (1, 2, 80.0, 2.0), (1, 3, 70.0, 3.0), (2, 1, 50.0, 175.0), (3, 1, 60.0, 1.0)], "img int, box int, w double, angle double")
    readings = spark.createDataFrame(
        [(1, 1, 2.0, 0.5, "abcd"), (1, 1, 92.0, 0.4, "abcde"), (1, 2, 2.0, 0.9, "ab"), (1, 2, 2.0, 0.5, "abcdef"), (1, 3, -177.0, 0.9, "abc"), (1, 3, 3.0, 0.1, "a"), (2, 1, -5.0, 0.8, "xyz"), (2, 1, 40.0, 1.0, "not a turn"), (3, 1, 1.0, None, "x")],
        "img int, box int, angle double, conf double, text string",
    )
    read = turning.read_angles(found, readings, ["img"])
    got = {(r["img"], r["box"]): (r["angle"], r["score"], r["text"]) for r in read.collect()}
    # equal scores of 2.0 go to the first turn; a box without any reading is left out
    assert got == {(1, 1): (2.0, 2.0, "abcd"), (1, 2): (2.0, 3.0, "abcdef"), (1, 3): (-177.0, 2.7, "abc"), (2, 1): (-5.0, 2.4, "xyz")}
    assert {r["img"]: (r["angle"], r["n"]) for r in turning.poster_angle(read, ["img"]).collect()} == {1: (2.0, 3), 2: (-5.0, 1)}


def test_skew_by_reading(spark):
    found = spark.createDataFrame([(i, b, 100.0 - b, a) for i, angles in {1: (3.0, 3.5, 93.0), 2: (3.0, 3.0), 3: (0.5, 0.5), 4: (-85.0, -85.0), 5: (2.0, 8.0), 6: (12.0, 12.0)}.items() for b, a in enumerate(angles)], "img int, box int, w double, angle double")
    readings = spark.createDataFrame([(1, 0, 0, 0.5, "ab"), (1, 0, 90, 0.5, "ab"), (2, 0, 90, 0.9, "abc"), (2, 1, 0, 0.2, "a"), (4, 0, 90, 0.5, "abc"), (4, 1, 0, 0.1, "a"), (4, 5, -90, 1.0, "not among the widest")], "img int, box int, turn int, conf double, text string")
    got = {r["img"]: r["angle"] for r in turning.skew_by_reading(found, readings, ["img"]).collect()}
    assert got == {1: 3.0, 2: 0.0, 3: 0.0, 4: 5.0, 5: 0.0, 6: 0.0}


def test_spread_of_exactly_two_is_not_over_two(spark):
    angles = dict(enumerate([*itertools.permutations((4.0, 2.5, 4.5, 8.5, 5.5)), (2.0, 6.0), (2.0, 6.5), (None, None), (92.0, 2.0, 6.0, 6.0, None)]))
    rows = [(i, b, 100.0 - b, a) for i, held in angles.items() for b, a in enumerate(held)]
    found = spark.createDataFrame(rows, "img int, box int, w double, angle double")
    readings = spark.createDataFrame([], "img int, box int, turn int, conf double, text string")
    got = {r["img"]: (r["angle"], r["spread"]) for r in turning.skew_by_reading(found, readings, ["img"]).collect()}
    # in some orders running sums gave a spread of 2.0000000000000004
    assert [got[i] for i in angles] == [*[(4.5, 2.0)] * 120, (4.0, 2.0), (0.0, 2.25), (0.0, None), (4.0, 2.0)]


def test_skew_query_and_its_sql_agree_at_a_spread_of_two(spark, tmp_path):
    # part keys whose angles are 3, 5, 3.5, -1 and 2, boxes from wide to narrow, in each of 120 orders
    rows = [(o, n, p, 11, 50.0 - n, "A") for o, held in enumerate(itertools.permutations((16, 20, 17, 8, 14))) for n, p in enumerate(held)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(sql.ORACLE_SQL["skew_by_reading_lines"] + " ORDER BY img").fetchall()
    assert [tuple(r) for r in catalog.skew_by_reading_lines(spark, str(tmp_path)).orderBy("img").collect()] == want
    assert {r[1:] for r in want} == {(3.0, 2.0)}


def plain_thumbnail(cells, most):
    cells = np.array(cells, dtype=object)
    h, w = cells.shape[:2]
    longest = max(w, h)
    nw, nh = (w, h) if longest <= most else (max(1, (2 * w * most + longest) // (2 * longest)), max(1, (2 * h * most + longest) // (2 * longest)))

    def shares(n, m):
        return np.array([[max(0, min((p + 1) * m, (c + 1) * n) - max(p * m, c * n)) for p in range(n)] for c in range(m)], dtype=object)

    down, across = shares(h, nh), shares(w, nw)
    assert all(sum(r) == h for r in down) and all(sum(r) == w for r in across)
    return {(y, x): tuple((2 * int(v) + h * w) // (2 * h * w) for v in np.einsum("h,w,hwc->c", down[y], across[x], cells)) for y in range(nh) for x in range(nw)}


def test_thumbnail(spark):
    rng = random.Random(8)
    pictures = {i: [[[rng.randrange(256) for _ in range(3)] for _ in range(w)] for _ in range(h)] for i, (w, h) in enumerate(((13, 7), (5, 30), (4, 4), (41, 1)))}
    pixels = spark.createDataFrame([(i, y, x, *v) for i, p in pictures.items() for y, row in enumerate(p) for x, v in enumerate(row)], COLOR)
    sizes = spark.createDataFrame([(i, len(p[0]), len(p)) for i, p in pictures.items()], "img int, width int, height int")
    for most in (5, 10):
        got: dict = {i: {} for i in pictures}
        for r in palette.thumbnail(pixels, sizes, ["img"], most).collect():
            got[r["img"]][r["y"], r["x"]] = (r["r"], r["g"], r["b"])
        assert got == {i: plain_thumbnail(p, most) for i, p in pictures.items()}
    large = palette.thumbnail_sizes(spark.createDataFrame([(1, 3000, 1999), (2, 10, 9000)], "img int, width int, height int"), ["img"]).collect()
    assert {(r["img"], r["w"], r["h"]) for r in large} == {(1, 200, 133), (2, 1, 200)}


def plain_median_cut(colors, most):
    """colors: {(r, g, b): n} -> {(r, g, b): box}"""
    box = dict.fromkeys(colors, 0)
    for new in range(1, most):
        groups: dict = {}
        for c, b in box.items():
            groups.setdefault(b, []).append(c)
        able = {b: cs for b, cs in groups.items() if len(cs) > 1}
        if not able:
            break
        b = min(able, key=lambda b: (-sum(colors[c] for c in able[b]), b))
        spans = [max(c[i] for c in able[b]) - min(c[i] for c in able[b]) for i in range(3)]
        axis = spans.index(max(spans))
        values, total = sorted({c[axis] for c in able[b]}), sum(colors[c] for c in able[b])
        at = next((v for v in values[:-1] if 2 * sum(colors[c] for c in able[b] if c[axis] <= v) >= total), values[-2])
        for c in able[b]:
            if c[axis] > at:
                box[c] = new
    return box


def test_median_cut_and_merge(spark):
    rng = random.Random(9)
    pictures = {1: {tuple(rng.randrange(0, 256, 3) for _ in range(3)): rng.randint(1, 9) for _ in range(80)}, 2: {(1, 2, 3): 5}, 3: {(0, 0, 0): 1, (0, 0, 9): 9, (0, 9, 0): 1}, 4: {(v, v, v): 1 for v in range(0, 250, 10)}}
    frame = spark.createDataFrame([(i, *c, n) for i, p in pictures.items() for c, n in p.items()], "img int, r int, g int, b int, n long")
    boxed = palette.median_cut(frame, ["img"]).cache()
    got: dict = {i: {} for i in pictures}
    for r in boxed.collect():
        got[r["img"]][r["r"], r["g"], r["b"]] = r["box"]
    assert got == {i: plain_median_cut(p, 10) for i, p in pictures.items()}
    assert max(len(set(b.values())) for b in got.values()) == 10
    shown = palette.palette(boxed, ["img"])
    rows = sorted(map(tuple, shown.select("img", "place", "r", "g", "b").collect()))
    want = []
    for i in pictures:
        leaders: list = []
        for _, place, *c in (r for r in rows if r[0] == i):
            lead = next((p for p, o in leaders if math.dist(o, c) < 26), None)
            if lead is None:
                leaders.append((place, c))
            want.append((i, place, place if lead is None else lead))
    merged = sorted(map(tuple, palette.merged(shown, ["img"]).select("img", "place", "leader").collect()))
    assert merged == want and any(p != q for _, p, q in merged)
    chain = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 2, 20, 0, 0), (1, 3, 40, 0, 0), (1, 4, 60, 0, 0), (1, 5, 26, 0, 0)], "img int, place int, r int, g int, b int")
    assert {r["place"]: r["leader"] for r in palette.merged(chain, ["img"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert palette.median_cut(frame.limit(0), ["img"], 3).count() == 0


def test_forms(spark):
    rows = [(1, y, x, *((200, 20, 20) if 4 <= x < 16 and 5 <= y < 15 else (20, 20, 200) if x >= 24 else (240 + (x + y) % 3, 240, 240))) for y in range(20) for x in range(40)]
    got = palette.forms(spark.createDataFrame(rows, COLOR), spark.createDataFrame([(1, 40, 20)], "img int, width int, height int"), ["img"]).collect()
    assert [(r["place"], r["area"], r["n_comp"], r["solidity"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 294, 1, 0.71), (2, 270, 1, 1.0), (3, 120, 1, 1.0)]  # what touches the edge loses a pixel there
