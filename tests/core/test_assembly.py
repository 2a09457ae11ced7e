"""Columns, fragments, bands, and whole pictures, against plain versions and pictures drawn here."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tallystone.functions.stages import written
from tallystone.operators import assembly, golden, ink, lines, profiles, spatial
from tallystone.sources import posters as sources
from tests.core.test_operators import posters


def plain_columns(col, gap):
    """Segments of a profile, read off the rules as they are stated."""
    full = [x for x, v in enumerate(col) if v > 0.13 * np.percentile([v for v in col if v > 0] or [0], 90)]
    if not full:
        return []
    groups = [[full[0]]]
    for x in full[1:]:
        if x - groups[-1][-1] - 1 >= gap:
            groups.append([])
        groups[-1].append(x)
    out = []
    for i, g in enumerate(groups):
        a = 0 if i == 0 and g[0] < gap else g[0]
        b = len(col) if i == len(groups) - 1 else g[-1] + 1
        inked = [x for x in range(a, b) if col[x] > 0]
        if b - a > 10:
            out.append((inked[0], inked[-1] + 1))
    return out


def test_columns(spark):
    rng = random.Random(3)
    series = {0: [0.0] * 30, 1: [1.0] + [0.0] * 5 + [9.0] * 12 + [0.0] * 8}
    for k in range(2, 40):
        out = []
        while len(out) < 90:
            out += [float(rng.choice([0, 0, 1]))] * rng.randint(1, 9) + [float(rng.randint(5, 12)) for _ in range(rng.randint(1, 25))]
        series[k] = out
    frame = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "k int, at long, value double")
    for gap in (6, 3):
        got: dict = {}
        for r in profiles.columns(frame, ["k"], gap=gap).collect():
            got.setdefault(r["k"], []).append((r["first"], r["end"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_columns(s, gap) for k, s in series.items() if plain_columns(s, gap)}


def plain_absorbed(strips, least=4):
    t = [dict(s=a, e=b, x0=c, x1=d) for a, b, c, d in strips]
    kept = []
    for i, own in enumerate(t):
        h, w = own["e"] - own["s"], own["x1"] - own["x0"]
        takers = []
        for order, j in enumerate((i + 1, i - 1)):
            if not 0 <= j < len(t):
                continue
            o = t[j]
            oh, gap = o["e"] - o["s"], o["s"] - own["e"] if j > i else own["s"] - o["e"]
            if oh > h and own["x0"] >= o["x0"] - 1 and own["x1"] <= o["x1"] + 1 and h <= 0.5 * oh and w <= 0.4 * max(o["x1"] - o["x0"], 1) and gap <= max(3, 0.6 * oh):
                takers.append((gap, order, j))
        if takers:
            o = t[min(takers)[2]]
            o["s"], o["e"] = min(o["s"], own["s"]), max(o["e"], own["e"])
        elif h >= least:
            kept.append(i)
    return [tuple(t[i][c] for c in ("s", "e", "x0", "x1")) for i in kept]


def test_fragments_are_absorbed(spark):
    rng = random.Random(4)
    cases = [[]]
    for _ in range(80):
        y, strips = 0, []
        for _ in range(rng.randint(1, 12)):
            y += rng.randint(1, 6)
            h = rng.choice([2, 3, 4, 8, 12, 20])
            x = rng.choice([0, 10, 40])
            strips.append((y, y + h, x, x + rng.choice([4, 20, 60, 90])))
            y += h
        cases.append(strips)
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, s array<struct<s:int,e:int,x0:int,x1:int>>")
    got = {r["k"]: [tuple(t) for t in r["t"]] for r in frame.select("k", lines.absorbed(F.col("s")).alias("t")).collect()}
    assert got == {k: plain_absorbed(s) for k, s in enumerate(cases)}


def test_bands_and_stretches(spark, monkeypatch):
    rng = random.Random(5)
    series = {k: [float(v + rng.random()) for v, n in [(rng.choice([0, 100, 200]), rng.randint(5, 40)) for _ in range(6)] for _ in range(n)] for k in range(6)}
    series[9] = [5.0] * 11
    frame = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "k int, at long, value double")
    want = sorted(tuple(r) for r in profiles.bands(frame, ["k"], 48.0, 6).collect())
    monkeypatch.setattr(profiles, "STRETCH", 16)
    assert sorted(tuple(r) for r in profiles.bands(frame, ["k"], 48.0, 6).collect()) == want
    for k, s in series.items():
        d = {i: abs(np.median(s[i : i + 6]) - np.median(s[i - 6 : i])) for i in range(6, len(s) - 5)}
        cuts: list = []
        for i in sorted(d, key=lambda i: (-d[i], i)):
            if d[i] >= 48 and all(abs(i - c) >= 6 for c in cuts):
                cuts.append(i)
        edges = [0, *sorted(cuts), len(s)]
        assert [(a, b) for kk, _, a, b in want if kk == k] == list(zip(edges, edges[1:]))


def picture(height=110, width=120, step=20):
    """White ground, four lines of five letters with the second one's dot above, in two columns."""
    g = np.full((height, width), 250.0)
    for i in range(4):
        y = 20 + i * step
        for column in (10, 70):
            for k in range(5):
                x = column + 8 * k
                g[y : y + 8, x : x + 5] = 10
                if k == 0:
                    g[y - 4 : y, x : x + 2] = 10
        g[y + 8 : y + 11, 10:12] = 10
    return g


def pixels(spark, pictures):
    return spark.createDataFrame([(f, y, x, float(v)) for f, g in pictures.items() for y, row in enumerate(g) for x, v in enumerate(row)], "file string, y int, x int, gray double")


def test_whole_pictures(spark):
    g = picture()
    framed = np.full((g.shape[0] + 7, g.shape[1] + 5), 5.0)
    framed[4:-3, 3:-2] = g
    frame = pixels(spark, {"plain": g, "inverse": 255 - g, "framed": framed, "empty": np.full((20, 20), 250.0)})
    blocks, counts = assembly.blocks_of(frame, ["file"])
    blocks = written(blocks)
    got = {r["file"]: r for r in assembly.records(blocks, counts, "file").collect()}
    assert set(got) == {"plain", "inverse", "framed"}
    for name, (dx, dy) in {"plain": (0, 0), "inverse": (0, 0), "framed": (3, 4)}.items():
        r = got[name]
        assert r["n_columns"] == 2 and len(r["blocks"]) == 2
        left = r["blocks"][0]
        assert (left["x1"], left["y1"], left["x2"], left["y2"], left["n"]) == (10 + dx, 16 + dy, 47 + dx, 88 + dy, 4)
        assert (left["bases"], left["caps"], left["xtops"]) == ([28 + dy + 20 * i for i in range(4)], [16 + dy + 20 * i for i in range(4)], [20 + dy + 20 * i for i in range(4)])
        assert left["lead"] == 20 and left["xh"] == 8.0 and r["region"] == [10.0 + dx, 16.0 + dy, 107.0 + dx, 88.0 + dy]
    lines_ = blocks.where("file = 'plain'").orderBy("x1").first()["lines"]
    assert [t["desc"] for t in lines_] == [31, 51, 71, 91] and all(t["shift"] == 0 and t["kind"] == "ascender" for t in lines_)
    # where the right column's block is not known, a text box leads to it
    known = spark.createDataFrame([("plain", 10, 16, 47, 88)], "file string, x1 int, y1 int, x2 int, y2 int")
    boxes = spark.createDataFrame([("plain", 70, 14, 107, 92), ("plain", 12, 20, 40, 60), ("plain", 1, 1, 2, 2)], "file string, x1 int, y1 int, x2 int, y2 int")
    got = assembly.seeded(frame.where("file = 'plain'"), boxes, known, ["file"]).collect()
    assert [(r["x1"], r["x2"], r["n"], r["lead"], r["seeded"]) for r in got] == [(70, 107, 4, 20.0, True)]


def as_image(name, g, channels=1, cut=0):
    return (name, g.shape[0], g.shape[1], channels, bytearray(np.repeat(g.astype(np.uint8), channels).tobytes())[: g.size * channels - cut])


def test_pictures_that_fail_stop_no_others(spark):
    g = picture()
    white, black = np.full((20, 20), 250.0), np.full((9, 9), 3.0)
    rows = [as_image("good", g), as_image("colour", g, 3), as_image("short", g, 1, 7), as_image("white", white), as_image("black", black), as_image("two", white, 2), as_image("twice", white), as_image("twice", g)]
    rows += [("flat", 0, 7, 1, bytearray()), ("none", 3, 3, 1, None), (None, 1, 1, 1, bytearray(b"a")), ("sizeless", None, 3, 1, bytearray(b"abc"))]
    images = spark.createDataFrame(rows, "file string, height int, width int, n_channels int, data binary")
    good, failed = sources.usable(images)
    assert sorted(r["file"] for r in good.collect()) == ["black", "colour", "good", "white"]
    holes = spark.createDataFrame([("hole", 0, 0, 5.0), ("hole", 0, 1, None)], "file string, y long, x long, gray double")
    made, failures = assembly.assemble(sources.pixels(good).select("file", "y", F.col("x").cast("long").alias("x"), "gray").unionByName(holes), failed)
    records = {r["file"]: r for r in made.collect()}
    assert set(records) == {"good", "colour"}
    assert all((r["n_columns"], len(r["blocks"]), r["region"]) == (2, 2, [10.0, 16.0, 107.0, 88.0]) for r in records.values())
    told = sorted((r["file"] or "", r["step"], r["reason"]) for r in failures.collect())
    assert [t for t in told if t[1] == "read"] == [
        ("", "read", "no name"), ("flat", "read", "no size"), ("none", "read", "no data"), ("short", "read", f"{g.size - 7} bytes where {g.size} are needed"), ("sizeless", "read", "no size"),
        ("twice", "read", "several pictures have this name"), ("twice", "read", "several pictures have this name"), ("two", "read", "channels are not 1, 3 or 4"),
    ]
    rest = {t[0]: t[1:] for t in told if t[1] != "read"}
    assert set(rest) == {"white", "black", "hole"} and rest["hole"] == ("pixels", "pixels without a place or value")
    assert all(rest[f] in assembly.STEPS for f in ("white", "black"))


def test_pictures_that_all_fail(spark):
    images = spark.createDataFrame([("none", 3, 3, 1, None), as_image("white", np.full((5, 5), 250.0))], "file string, height int, width int, n_channels int, data binary")
    for part, want in ((images, [("none", "read", "no data"), ("white", "ink", "no ink")]), (images.limit(0), [])):
        good, failed = sources.usable(part)
        made, failures = assembly.assemble(sources.pixels(good), failed)
        assert made.count() == 0 and sorted(tuple(r) for r in failures.collect()) == want


def test_boxes_that_are_looked_at(spark):
    small = spark.createDataFrame([(50, 50, 10, 10, 11, 30), (50, 50, 48, 48, 60, 60), (3, 50, 0, 0, 9, 9)], "w int, h int, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r["x1"], r["x2"], r["why"] or "") for r in spatial.measurable(small).collect()) == [(0, 3, "too_small"), (7, 14, ""), (45, 50, "")]
    assert spatial.seeds(small).count() == 1


def test_colour_classes(spark):
    rows = [("a", y, x, "red") for y in range(6) for x in range(6)] + [("a", y, x, "blue") for y in range(20, 24) for x in range(4)] + [("a", 40, 40, "one"), ("a", 50, 0, "dot")]
    sizes = spark.createDataFrame([("a", 60, 60)], "file string, width int, height int")
    got = [tuple(r) for r in ink.classes(spark.createDataFrame(rows, "file string, y int, x int, color string"), ["file"], "color", sizes).select("color", "share", "n_comp", "place").orderBy("place").collect()]
    assert got == [("red", 0.01, 1, 1), ("blue", 0.0044, 1, 2)]


def test_gradient_and_photos(spark):
    rng = np.random.default_rng(2)
    pictures = {"a": rng.random((6, 9)) * 40, "flat": np.full((4, 4), 7.0), "row": rng.random((1, 5))}
    frame = spark.createDataFrame([(f, y, x, float(v)) for f, g in pictures.items() for y, row in enumerate(g) for x, v in enumerate(row)], "file string, y int, x int, value double")
    got = {r["file"]: r["gradient"] for r in sources.gradient(frame, ["file"]).collect()}
    v = (pictures["a"] - pictures["a"].min()) / np.ptp(pictures["a"])
    gy, gx = np.gradient(v)
    assert abs(got["a"] - np.hypot(gx, gy).mean()) < 1e-12 and got["flat"] == 0
    r = (pictures["row"][0] - pictures["row"].min()) / np.ptp(pictures["row"])
    assert abs(got["row"] - np.abs(np.gradient(r)).mean()) < 1e-12
    seen = spark.createDataFrame([(0.003, [("person", 0.95)]), (0.003, [("clock", 0.95)]), (0.001, [("clock", 0.99)])], "d double, o array<struct<label:string,score:double>>")
    assert [r[0] for r in seen.select(sources.photo_verdict(F.col("d"), F.col("o"))).collect()] == ["yes", "unknown", "no"]


def plain_leaves(x, path=""):
    if isinstance(x, dict):
        return {k: v for n, y in x.items() for k, v in plain_leaves(y, f"{path}.{n}" if path else n).items()}
    if isinstance(x, list):
        return {k: v for i, y in enumerate(x) for k, v in plain_leaves(y, f"{path}[{i}]").items()}
    return {path or "value": x}


def test_flatten_deep_records(spark):
    records = [{"a": "{not json", "b": [1, {"c": [None, "x"]}, []], "d": {}}, [[1, 2], [3]], 7, {"k.1": {"l": True}}]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{bad")], "id int, json string")
    got: dict = {}
    for r in golden.flatten(rows, "id", "json").collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    assert got == {i: {k: text(v) for k, v in plain_leaves(r).items()} for i, r in enumerate(records)}


def test_regression(spark, tmp_path):
    cases = spark.createDataFrame([("a", "five blocks"), ("gone", "missing")], "file string, why string")
    old = golden.snapshot(posters(spark), cases)
    golden.bless(old, str(tmp_path / "snap"))
    kept = golden.blessed(spark, str(tmp_path / "snap"))
    assert golden.regression(kept, old, cases).count() == 0
    assert {r["name"]: r["record"] is None for r in kept.collect()} == {"a": False, "gone": True}
    moved = posters(spark).withColumn("blocks", F.transform("blocks", lambda b: b.withField("y1", b["y1"] + 1)))
    r = golden.regression(kept, golden.snapshot(moved, cases), cases, shown=2).collect()
    assert [(x["name"], x["why"], x["n_changed"], [c["path"] for c in x["changed"]]) for x in r] == [("a", "five blocks", 5, ["blocks[0].box[1]", "blocks[1].box[1]"])]
    record = json.loads(kept.where("name = 'a'").first()["record"])
    assert record["n_blocks"] == 5 and [b["box"][0] for b in record["blocks"]] == [0, 2, 9, 12, 30]


def test_measured_boxes(spark):
    """Drawn boxes whose measures are known, dark and bright, and boxes that cannot be measured."""
    g = picture()
    odd = np.full((60, 90), 250.0)
    for y, x, w in ((10, 12, 40), (31, 30, 22), (52, 20, 60)):
        odd[y : y + 6, x : x + w] = 10
    frame = pixels(spark, {"plain": g, "inverse": 255 - g, "odd": odd})
    asked = [(f, "left", 11, 17, 46, 90) for f in ("plain", "inverse")] + [("plain", "right", 70, 14, 107, 92), ("plain", "top", 10, 14, 47, 31)]
    asked += [("odd", "all", 0, 5, 90, 60), ("plain", "speck", -9, 3, 0, 50), ("plain", "blank", 50, 5, 66, 100), ("other", "lost", 0, 0, 9, 9)]
    boxes = spark.createDataFrame(asked, "file string, box string, x1 int, y1 int, x2 int, y2 int")
    got = {(r["file"], r["box"]): r.asDict() for r in assembly.measured_boxes(frame, boxes, ["file"]).collect()}
    assert set(got) == {(a[0], a[1]) for a in asked}
    assert {k: (r["why"], r["n_lines"]) for k, r in got.items() if r["why"]} == {("plain", "speck"): ("too_small", 0), ("plain", "blank"): ("no_lines", 0), ("other", "lost"): ("no_picture", 0)}
    for f in ("plain", "inverse"):
        r = got[f, "left"]
        assert (r["n_lines"], r["baselines"], r["x_tops"], r["caps"]) == (4, [28, 48, 68, 88], [20, 40, 60, 80], [16, 36, 56, 76])
        assert (r["x_heights"], r["xh_median"], r["lead"], r["lead_measured"], r["lead_over_xh"], r["grid_resid"]) == ([8.0] * 4, 8.0, 20.0, 20.0, 2.5, 0.0)
        assert (r["align"], r["align_left"], r["align_right"], r["align_center"]) == ("left", 0.0, 0.0, 0.0)
        assert (r["x_starts"], r["x_ends"], r["box_ink"]) == ([10.0] * 4, [47.0] * 4, [10, 16, 47, 88])
    assert got["plain", "right"]["x_starts"] == [70.0] * 4
    one = got["plain", "top"]
    assert (one["n_lines"], one["baselines"], one["lead"], one["lead_measured"], one["lead_over_xh"], one["align"], one["align_left"], one["grid_resid"]) == (1, [28.0], None, None, None, None, None, 0.0)
    three = got["odd", "all"]
    starts, ends = [12.0, 30.0, 20.0], [52.0, 52.0, 80.0]
    spreads = {"left": np.std(starts), "right": np.std(ends), "center": np.std([(a + b) / 2 for a, b in zip(starts, ends)])}
    assert (three["baselines"], three["x_starts"], three["x_ends"], three["align"], three["lead_measured"], three["lead_over_xh"]) == ([16, 37, 58], starts, ends, "none", 21.0, 3.5)
    assert {k: three[f"align_{k}"] for k in spreads} == {k: round(float(v), 2) for k, v in spreads.items()}
