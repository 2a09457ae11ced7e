"""Hand-computed cases and numpy cross-checks of the operators; the queries against their SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallystone.functions import ordered
from tallystone.functions.rounding import exact_round
from tallystone.operators import comparing, golden, judging, layout, metrics, profiles, spatial
from tallystone.plans import catalog
from tallystone.schemas import CONSTRAINT, FREE, INSUFFICIENT, LAYOUT, METRICS, MIXED, NO_VALUE, PLACEMENT, POSTER

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return "null" if v is None else repr(v) if isinstance(v, bool) else repr(float(v)) if isinstance(v, (int, float)) else str(v)


#: Queries that give no rows on the smallest tables are compared on larger ones.
LARGER = {"text_columns_orders": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, tiny, name):
    tiny = LARGER.get(name, tiny)
    got = catalog.QUERIES[name](spark, tiny)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert name not in LARGER or got.count() > 0
    assert sorted([plain(v) for v in r] for r in got.select(*columns).collect()) == sorted([plain(v) for v in r] for r in want.project(quoted).fetchall())


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 12


def observations(spark, groups: dict[str, list]):
    return spark.createDataFrame([("c", f"{m}{i}", i, m, v) for m, vs in groups.items() for i, v in enumerate(vs)], "corpus string, entity string, ord long, metric string, value double")


@pytest.fixture(params=["windows", "stretches"])
def either_way(request, monkeypatch):
    """Groups as windows, and as stretches of a range partitioning, as beyond GROUP_ROWS."""
    if request.param == "stretches":
        monkeypatch.setattr(ordered, "GROUP_ROWS", 0)


def test_quantiles_equal_numpy(spark, either_way):
    rng = random.Random(1)
    groups = {str(k): [round(rng.gauss(0, 9), rng.choice([0, 2, 9])) for _ in range(rng.randint(1, 400))] for k in range(12)}
    rows = observations(spark, groups | {"none": [None]})
    got = {r["metric"]: r for r in ordered.quantiles(rows, ["metric"], {"a": 0.1, "b": 0.5, "c": 0.975}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][c] for c in "abc"] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.975])))


def plain_layers(values, factor=10.0):
    v = sorted(values)
    gaps = [b - a for a, b in zip(v, v[1:])]
    wide = [g for g in gaps if g > 0]
    if len(v) < 4 or not wide:
        return [v]
    out = [[v[0]]]
    for x, g in zip(v[1:], gaps):
        if g > factor * float(np.median(wide)):
            out.append([])
        out[-1].append(x)
    return out


def test_layers(spark, either_way):
    rng = random.Random(2)
    groups = {"few": [1.0, 2.0, 900.0], "same": [5.0] * 9, "edge": [0.0, 1.0, 2.0, 3.0, 13.0], "over": [0.0, 1.0, 2.0, 3.0, 13.1], "twice": [1.0, 1.0, 2.0, 2.0, 3.0, 50.0, 50.0]}
    groups |= {f"r{k}": [rng.choice([0, 100, 5000]) + rng.randint(0, 20) for _ in range(300)] for k in range(6)}
    groups = {k: [float(x) for x in v] for k, v in groups.items()}
    found: dict = {}
    for r in judging.layers(observations(spark, groups), ["metric"]).collect():
        found.setdefault(r["metric"], {}).setdefault(r["layer"], []).extend([r["value"]] * r["n"])
    for k, v in groups.items():
        assert [sorted(found[k][i]) for i in sorted(found[k])] == plain_layers(v), k
        assert sorted(found[k]) == list(range(1, len(found[k]) + 1))


def test_derive(spark, either_way):
    groups = {
        "one": [10 + i / 10 for i in range(30)],
        "two": [10 + i / 10 for i in range(25)] + [500 + i / 10 for i in range(22)],
        "few": [float(i) for i in range(12)],
        "rest": [10 + i / 10 for i in range(25)] + [500 + i / 10 for i in range(15)] + [900 + i / 10 for i in range(9)],
        "zero": [-1.0, 1.0] * 15,
        "minus": [-10 - i / 10 for i in range(30)],
    }
    got = {r["metric"]: r for r in judging.derive(observations(spark, groups), spark.createDataFrame([("c", 60)], "corpus string, n_entities long")).collect()}
    assert (got["one"]["verdict"], got["one"]["n_layers"], got["one"]["n"], got["one"]["n_entities_all"]) == (CONSTRAINT, 0, 30, 60)
    two = got["two"]
    assert (two["n"], two["n_all"], two["n_layers"], two["is_rule"]) == (25, 47, 2, True) and two["max"] == 12.4 and two["n_entities"] == 47
    few = got["few"]
    assert (few["verdict"], few["n"], few["n_layers"], few["layers"][0]["verdict"]) == (INSUFFICIENT, 12, 1, MIXED)
    rest = got["rest"]
    assert [(p["n"], p["verdict"]) for p in rest["layers"]] == [(25, CONSTRAINT), (24, MIXED)] and rest["n"] == 25
    assert got["zero"]["cv"] == 9.9 and got["zero"]["verdict"] == FREE
    assert got["minus"]["cv"] < 0 and got["minus"]["is_rule"]
    assert judging.derive(observations(spark, {"x": []})).count() == 0


def block(x1=0, y1=0, x2=100, y2=50, n=3, xh=10.0, lead=20, bases=(30, 50, 70), caps=(16, None, 54), xtops=(20, 40, 60)):
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "n": n, "xh": xh, "lead": lead, "bases": list(bases), "caps": list(caps), "xtops": list(xtops)}


def posters(spark):
    def row(file, angle, blocks, region, n_columns=1, color=None, size=(1000, 500)):
        return {"corpus": "c", "file": file, "ord": 1, "angle": angle, "size": list(size), "region": region, "n_columns": n_columns, "color": color, "blocks": blocks}

    color = {"ground_share": 0.5, "n_colors": 3, "saturation": 0.1, "value": 0.9, "gray_share": 0.7}
    rows = [
        row("a", 0.0, [block(), block(x1=2, xh=20.0), block(x1=9, n=2), block(x1=12, lead=None), block(x1=30, caps=(None,) * 3)], [10.0, 20.0, 900.0, 400.0], color=color),
        row("b", 3.0, [block(lead=0)], [10.0, 20.0, 900.0, 400.0], 0),
        row("c", None, [], None, None),
        row("d", 0.5, None, None, 2, size=(0, 0)),
    ]
    return spark.createDataFrame(rows, POSTER)


def test_metrics(spark):
    seen: dict = {}
    for r in metrics.observe(posters(spark)).collect():
        seen.setdefault((r["entity"], r["metric"]), []).append(r["value"])
    assert seen["a", "lead_over_cap"] == [20 / 15] * 2 and seen["a", "gap_px"] == [5.0] * 2
    assert sorted(seen["a", "asc_over_xh"]) == sorted([1.4, 1.6] * 4)
    assert seen["a", "align_ratio"] == [4 / 5] and ("b", "align_ratio") not in seen
    assert [seen["a", f"margin_{s}"][0] for s in ("left", "right", "top", "bottom")] == [0.01, 0.1, 0.04, 0.2] and ("b", "margin_left") not in seen
    assert seen["a", "cap_range"] == [2.0] and seen["c", "text_area"] == [0.0] and ("d", "text_area") not in seen
    assert seen["a", "n_blocks"] == [5.0] and ("c", "n_blocks") not in seen and ("b", "n_columns") not in seen
    assert seen["a", "gray_share"] == [0.7] and ("b", "gray_share") not in seen
    assert ("b", "lead_over_cap") not in seen


def test_place(spark):
    rows = [("l", None, "a", 0.0, 0.0, 10.0, 3), ("l", None, "b", 0.0, 5.0, 24.0, 1), ("l", None, "c", 0.0, None, None, 2), ("m", 0.0, "d", 0.0, 0.0, 10.0, 1), ("n", 4.0, "e", 0.0, 0.0, 10.0, 0)]
    got = {r["id"]: r for r in layout.place(spark.createDataFrame(rows, "layout string, grid_lead double, id string, x double, y double, cap_height double, n_lines int"), 1.5).collect()}
    assert (got["a"]["grid"], got["a"]["lead"], got["a"]["baselines"]) == (15.0, 15.0, [10.0, 25.0, 40.0])
    assert got["b"]["lead"] == 30.0 and got["b"]["baselines"] == [29.0]
    assert got["c"]["lead"] is None and got["d"]["lead"] is None and got["e"]["baselines"] == []
    assert all(r["lead"] % r["grid"] == 0 and r["lead"] - h >= 1 for r, h in ((got["a"], 10), (got["b"], 24), (got["e"], 10)))


def test_check(spark):
    groups = {"lead_over_cap": [1.4 + i / 100 for i in range(25)] + [9 + i / 100 for i in range(5)], "n_blocks": [float(i % 9) for i in range(40)], "cap_range": [2 + i / 1000 for i in range(30)]}
    rules = judging.derive(observations(spark, groups))

    def lay(name, height, lines, **more):
        return {"layout": name, "layer": None, "canvas": {"w": 100.0, "h": 100.0}, "blocks": [{"id": "b", "x": 1.0, "x_width": 50.0, "cap_height": height, "lines": [{"baseline": float(v)} for v in lines]}, *more.get("blocks", [])]}

    rows = [lay("good", 10.0, [20, 35, 50]), lay("held", 10.0, [20, 110]), lay("bad", 10.0, [20, 50]), lay("tight", 10.0, [20, 30.5, 60]), lay("one", 10.0, [20]), lay("sizes", 10.0, [20, 35], blocks=[{"id": "c", "x": 1.0, "x_width": 5.0, "cap_height": 100.0, "lines": []}])]
    got: dict = {}
    for r in layout.check(spark.createDataFrame(rows, LAYOUT), rules).collect():
        got.setdefault(r["layout"], {})[r["rule"]] = (r["status"], r["value"], r["fix"])
    assert got["good"]["lead_over_cap"] == ("accepted", 1.5, None) and "overlap" not in got["good"]
    assert got["held"]["lead_over_cap"][0] == "held" and got["bad"]["lead_over_cap"] == ("violation", 3.0, 15.2)
    assert got["tight"]["regularity"] == ("violation", 19.0, None) and "lead_over_cap" not in got["one"]
    assert got["sizes"]["cap_range"] == ("violation", 10.0, 2.014) and got["good"]["n_blocks"][0] in ("in_band", "observed")
    assert {r["layout"]: (r["n_violations"], r["ok"]) for r in layout.totals(layout.check(spark.createDataFrame(rows, LAYOUT), rules)).collect()}["good"] == (0, True)


def test_check_by_corpora_and_layers(spark):
    groups = {"lead_over_cap": [1.4 + i / 100 for i in range(25)] + [9 + i / 100 for i in range(22)], "n_blocks": [5.0 + i / 100 for i in range(40)]}
    rows = observations(spark, groups).unionByName(observations(spark, {"lead_over_cap": [3 + i / 100 for i in range(30)]}).withColumn("corpus", F.lit("d")))
    rules = judging.derive(rows)

    def lay(name, corpus, layer, lines, width=50.0):
        block = {"id": "b", "x": 1.0, "x_width": width, "cap_height": 10.0, "lines": [{"baseline": float(v)} for v in lines]}
        return {"layout": name, "corpus": corpus, "layer": layer, "canvas": {"w": 100.0, "h": 100.0}, "blocks": [block] if lines else []}

    layouts = [lay("c1", "c", None, [0, 15]), lay("d1", "d", None, [0, 15]), lay("low", "c", 1, [0, 15]), lay("high", "c", 2, [0, 15]), lay("none", "c", 3, [0, 15]), lay("zero", "c", 0, [0, 15]), lay("gone", "x", None, [0, 15]), lay("empty", "c", None, []), lay("narrow", "c", None, [0, 15], None)]
    checked = layout.check(spark.createDataFrame(layouts, f"corpus string, {LAYOUT}"), rules)
    got = {(r["layout"], r["rule"]): r for r in checked.collect()}
    ratio = lambda n: (got[n, "lead_over_cap"]["status"], got[n, "lead_over_cap"]["layer"], got[n, "lead_over_cap"]["fix"])
    assert ratio("c1") == ratio("low") == ("accepted", 1, None)
    assert ratio("d1") == ("violation", None, 31.4) and ratio("high") == ("violation", None, 91.1)
    assert {k for k in got if got[k]["status"] == "error"} == {("none", "no_such_layer"), ("zero", "no_such_layer"), ("gone", "no_rules"), ("empty", "no_blocks")}
    assert got["c1", "n_blocks"]["status"] == "violation" and got["c1", "n_blocks"]["fix"] == 5.195 and ("d1", "n_blocks") not in got
    assert got["narrow", "margin_right"]["status"] == "note"
    assert {r["layout"]: r["ok"] for r in layout.totals(checked).collect()} == {"c1": False, "d1": False, "low": False, "high": False, "none": False, "zero": False, "gone": False, "empty": False, "narrow": False}
    with pytest.raises(ValueError, match="several corpora"):
        layout.check(spark.createDataFrame(layouts, f"corpus string, {LAYOUT}").drop("corpus"), rules)
    listed = [(r["layer"], r["n"]) for r in layout.layer_list(rules).where("corpus = 'c'").orderBy("layer").collect()]
    assert listed == [(1, 25), (2, 22)]


def test_place_text(spark):
    rules = judging.derive(observations(spark, {"lead_over_cap": [1.4 + i / 100 for i in range(25)] + [9 + i / 100 for i in range(5)]}))

    def ask(name, layer, grid, *blocks):
        return {"layout": name, "layer": layer, "grid_lead": grid, "blocks": [{"id": str(i), "x": 0.0, "y": y, "cap_height": h, "n_lines": n} for i, (y, h, n) in enumerate(blocks)]}

    asked = [ask("plain", None, None, (0.0, 10.0, 2), (None, 25.0, None), (0.0, None, 1)), ask("mixed", 2, None, (0.0, 10.0, 0)), ask("bad", None, 0.0, (0.0, 10.0, 1)), ask("none", 7, None, (0.0, 10.0, 1)), ask("blank", None, None, (0.0, None, 1)), ask("empty", None, None), ask("wide", None, 40.0, (0.0, 10.0, 1))]
    got = {(r["layout"], r["id"]): r for r in layout.place_text(spark.createDataFrame(asked, PLACEMENT), rules).collect()}
    one, two, three = (got["plain", i] for i in "012")
    assert (one["grid"], one["lead"], one["multiple"], one["baselines"], one["in_band"], one["notes"]) == (15.0, 15.0, 1, [10.0, 25.0], True, [])
    assert (two["lead"], two["baselines"], two["ratio"], two["notes"]) == (45.0, [25.0], 1.8, ["outside_band"]) and three["notes"] == ["no_cap_height"] and three["lead"] is None
    assert got["mixed", "0"]["notes"] == ["outside_band", "not_adopted"] and got["mixed", "0"]["baselines"] == [] and got["mixed", "0"]["lead"] == 90.0
    assert {k[0]: got[k]["error"] for k in got if got[k]["error"]} == {"bad": "bad_grid", "none": "no_such_layer", "blank": "no_cap_height", "empty": "no_blocks"}
    assert got["wide", "0"]["notes"] == ["outside_band"]


def test_style_card(spark):
    rules = judging.derive(metrics.observe(posters(spark)))
    got = {r["metric"]: r for r in comparing.style_card(rules, posters(spark)).collect()}
    assert len(got) == 20 and got["cap_ratio"]["verdict"] == "blocked" and got["n_blocks"]["verdict"] == INSUFFICIENT
    assert (got["text_area"]["n_excluded"], got["n_blocks"]["n_excluded"], got["n_blocks"]["n_entities"], got["n_blocks"]["n_posters"]) == (1, None, 2, 4)


def test_compare(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"{c}{i}", i, "m", float(v)) for c, mean in (("a", 10), ("b", 10.2), ("d", 30)) for i, v in enumerate(rng.normal(mean, 2, 200))] + [("e", "x", 0, "m", 5.0), ("a", "x", 0, "alone", 1.0)]
    frame = spark.createDataFrame(rows, "corpus string, entity string, ord long, metric string, value double")
    got = {r["metric"]: r for r in comparing.compare(frame).collect()}
    assert set(got) == {"m"} and (got["m"]["n_corpora"], got["m"]["n_pairs"], got["m"]["n_separated"]) == (4, 6, 2)
    for r in comparing.median_intervals(frame, ["corpus", "metric"]).where("metric = 'm'").collect():
        values = [x[4] for x in rows if x[0] == r["corpus"] and x[3] == "m"]
        if len(values) >= 3:
            drawn = np.median(np.random.default_rng(0).choice(values, (4000, len(values))), axis=1)
            assert (r["ci_lo"], r["ci_hi"]) == pytest.approx(np.quantile(drawn, [0.025, 0.975]), abs=0.15)
        else:
            assert r["ci_lo"] is None
    card = {r["metric"]: r for r in comparing.card(judging.judge(frame, ["metric"]), spark.createDataFrame([(m,) for m in ("m", "gone")], "metric string"), frame).collect()}
    assert card["gone"]["verdict"] == NO_VALUE and card["m"]["n_pairs"] == 6
    assert len({m for m, *_ in METRICS}) == 17


def plain_resampled(values, key, replicates, seed):
    """Medians of replicates, each value of which is repeated as the bits of its hash say."""
    counts = sorted(Counter(values).items())
    total, before, table = len(values), 0, {}
    for value, n in counts:
        middle, reach = (total - 1) / 2, 4 * total**0.5
        place = -1 if before + n - 1 < middle - reach else total if before > middle + reach else before
        had = table.get(place, (0, value))
        table[place] = (had[0] + n, value if place < 0 else had[1])
        before += n
    medians = []
    for r in range(replicates):
        weights = []
        for place, (n, value) in sorted(table.items()):
            bits = bin(int(hashlib.sha256(f"{seed}:{r}:{place}:{key}".encode()).hexdigest(), 16) | 1 << 256)[3:]
            weights.append((value, 16 * bits[:n].count("1") if n <= 256 else 8 * n + math.floor(n**0.5 * (bits.count("1") - 128))))
        drawn = [v for v, w in weights for _ in range(w)]
        if drawn:
            medians.append(float(np.median(drawn)))
    return np.quantile(medians, [0.025, 0.975])


def test_resampled_medians(spark, either_way):
    rng = random.Random(8)
    groups = {"even": [float(rng.randint(0, 40)) for _ in range(60)], "wide": [rng.random() for _ in range(401)], "heavy": [1.0] * 300 + [2.0] * 310 + [5.0] * 9, "three": [1.0, 2.0, 9.0], "two": [1.0, 4.0], "same": [3.0] * 50, None: [float(i) for i in range(30)]}
    frame = spark.createDataFrame([(k, v) for k, s in groups.items() for v in s] + [("even", None), ("gone", None)], "k string, value double")
    got = {r["k"]: r for r in comparing.resampled_intervals(frame, ["k"], 60, 3).collect()}
    assert set(got) == set(groups)
    for k, s in groups.items():
        assert (got[k]["n"], got[k]["median"]) == (len(s), pytest.approx(np.median(s), abs=1e-4))
        if len(s) < 3:
            assert got[k]["ci_lo"] is None
        else:
            assert (got[k]["ci_lo"], got[k]["ci_hi"]) == pytest.approx(plain_resampled(s, k or "", 60, 3), abs=1e-4)
    assert comparing.resampled_intervals(frame.where("false"), ["k"], 10).count() == 0


def test_resampling_agrees_with_the_closed_form(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(k, float(v)) for k in range(3) for v in rng.normal(0, 1, 3000)], "k int, value double")
    drawn, closed = ({r["k"]: r for r in f.collect()} for f in (comparing.resampled_intervals(frame, ["k"], 2000, 1), comparing.median_intervals(frame, ["k"])))
    for k, r in closed.items():
        assert (drawn[k]["ci_lo"], drawn[k]["ci_hi"]) == pytest.approx((r["ci_lo"], r["ci_hi"]), abs=0.015)
    again = {r["k"]: r for r in comparing.resampled_intervals(frame.repartition(7), ["k"], 2000, 1).collect()}
    assert again == drawn
    both = [f.select("metric", "n_pairs").collect() for f in (comparing.compare(o) for o in [frame.select(F.col("k").cast("string").alias("corpus"), F.lit("m").alias("metric"), "value")])]
    apart = comparing.compare(frame.select(F.col("k").cast("string").alias("corpus"), F.lit("m").alias("metric"), (F.col("value") + F.col("k")).alias("value")), replicates=200).first()
    assert both == [[("m", 3)]] and (apart["n_separated"], apart["separated"]) == (3, "0/1,0/2,1/2")


def test_profiles(spark):
    wave = [(1, i, float(10 + 5 * (i % 7 == 0) - (i % 7 == 3))) for i in range(140)]
    profile = spark.createDataFrame(wave, "k int, at long, value double")
    peak = profiles.first_peak(profiles.autocorrelation(profile, ["k"], 30), ["k"], 3).collect()
    assert [(r["k"], r["lag"]) for r in peak] == [(1, 7)]
    d = np.array([v for *_, v in wave])
    d -= d.mean()
    got = {r["lag"]: r["r"] for r in profiles.autocorrelation(profile, ["k"], 30).collect()}
    assert all(got[k] == pytest.approx((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(31))
    jump = spark.createDataFrame([(1, i, float(100 * (i >= 40) + 50 * (i >= 70))) for i in range(100)], "k int, at long, value double")
    found = profiles.steps(jump, ["k"], 8)
    best = found.where("step > 20").groupBy("k").agg({"step": "count"}).collect()
    assert best and {r["at"] for r in found.where("step = 100").collect()} >= {40}
    cuts = found.where("step >= 48").groupBy("k").agg(profiles.spread_out(F.collect_list(F.struct("step", "at")), 8).alias("c")).collect()
    assert cuts[0]["c"][0] in range(36, 41) and len(cuts[0]["c"]) == 2
    pixels = spark.createDataFrame([("dark", float(v)) for v in [250] * 80 + [10] * 20] + [("bright", float(v)) for v in [10] * 80 + [250] * 20], "img string, value double")
    assert {r["img"]: r["inverted"] for r in profiles.polarity(pixels, ["img"]).collect()} == {"dark": False, "bright": True}


def test_spatial(spark):
    rng = random.Random(4)
    boxes = [(rng.randrange(5), str(i), x, y, x + rng.randint(1, 90), y + rng.randint(1, 90)) for i in range(300) for x, y in [(rng.randrange(900), rng.randrange(900))]]
    rows, covers = boxes[:200], boxes[200:]
    frame = lambda r: spark.createDataFrame(r, "p int, row_id string, x1 int, y1 int, x2 int, y2 int")
    want = {b[1] for b in rows if not any(o[0] == b[0] and o[2] < b[4] and b[2] < o[4] and o[3] < b[5] and b[3] < o[5] for o in covers)}
    assert {r["row_id"] for r in spatial.uncovered_boxes(frame(rows), frame(covers), "p", 64.0).collect()} == want
    inner = [(9, "big", 0, 0, 200, 200), (9, "in", 50, 50, 90, 90), (9, "wide", 50, 50, 150, 90), (9, "out", 190, 190, 230, 230), (8, "other", 50, 50, 90, 90)]
    assert {r["row_id"] for r in spatial.without_shadows(frame(inner), "p").collect()} == {"big", "wide", "out", "other"}


def test_shadows_equal_all_pairs(spark):
    rng = random.Random(14)
    boxes = [(rng.randrange(3), i, x, y, x + w, y + h) for i in range(500) for x, y, w, h in [(rng.randrange(-50, 600), rng.randrange(-50, 600), rng.choice((0, 3, 20, 150, 400)), rng.choice((0, 5, 30, 120, 333)))]]
    boxes += [(None, 900, 0, 0, 1, 1), (1, 901, None, 0, 5, 5), (1, 902, 4, 4, 5, 5), (1, 902, 4, 4, 5, 5)]

    def shadow(b, o):
        w, h, ow, oh = b[4] - b[2], b[5] - b[3], o[4] - o[2], o[5] - o[3]
        return ow * oh > w * h and h <= 0.45 * oh and w <= 0.45 * ow and b[2] >= o[2] - 5 and b[3] >= o[3] - 5 and b[4] <= o[4] + 5 and b[5] <= o[5] + 5

    known = [b for b in boxes if None not in b]
    want = sorted(b[1] for b in boxes if None in b or not any(o[0] == b[0] and shadow(b, o) for o in known))
    frame = spark.createDataFrame(boxes, "p int, row int, x1 int, y1 int, x2 int, y2 int")
    got = spatial.without_shadows(frame, "p")
    assert sorted(r["row"] for r in got.collect()) == want and got.columns == frame.columns and len(want) < 480
    assert spatial.without_shadows(frame.limit(0), "p").count() == 0


def test_shadows_and_sweep_of_one_large_key(spark):
    """Each pair would be 10 ^ 10 of them."""
    n = 100_000
    small = spark.range(n).select(F.lit(1).alias("p"), (F.col("id") % 400 * 10).cast("int").alias("x1"), F.floor(F.col("id") / 400).cast("int").alias("k"))
    small = small.select("p", "x1", (F.col("k") * 10).alias("y1"), (F.col("x1") + 4).alias("x2"), (F.col("k") * 10 + 4).alias("y2"))
    large = spark.createDataFrame([(1, 0, 0, 2000, 2500)], "p int, x1 int, y1 int, x2 int, y2 int")
    left = spatial.without_shadows(small.unionByName(large), "p")
    # the corners from 0 to 2000 are within it, and its padding takes no more of them
    assert left.count() == n + 1 - 201 * 250
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("a"), (n - F.col("id")).cast("double").alias("b"))
    assert spatial.dominated_removed(rows, "k", ["a", "b"], 0.45).count() == n
    alike = rows.withColumn("b", F.col("a"))
    assert spatial.dominated_removed(alike, "k", ["a", "b"], 0.45).count() == sum(i > 0.45 * (n - 1) for i in range(n))


def test_dominated_equals_all_pairs(spark):
    rng = random.Random(15)
    rows = [(rng.choice((1, 2, None)), i, rng.choice((None, 0.0, float(rng.randrange(100)))), float(rng.randrange(-5, 100))) for i in range(400)]
    want = sorted(r[1] for r in rows if None in r or not any(None not in o and o[0] == r[0] and r[2] <= 0.45 * o[2] and r[3] <= 0.45 * o[3] for o in rows))
    got = spatial.dominated_removed(spark.createDataFrame(rows, "k int, row int, a double, b double"), "k", ["a", "b"], 0.45)
    assert sorted(r["row"] for r in got.collect()) == want and got.columns == ["k", "row", "a", "b"] and len(want) < 390


def test_exact_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(16)
    values = [2.675, -2.675, 0.5, 1.5, 2.5, -0.5, 1e-9, 0.125, 1.005, 1e15, 1e300, float("inf"), None]
    values += [rng.choice((rng.uniform(-1e3, 1e3), rng.randrange(-(10**7), 10**7) / 1000, round(rng.uniform(0, 99), 2) + 0.005, rng.uniform(0, 1e12))) for _ in range(100_000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = frame.select("i", *[exact_round(F.col("v"), n).alias(f"r{n}") for n in (0, 1, 2, 4)]).toPandas().sort_values("i")
    for n in (0, 1, 2, 4):
        want = [None if v is None else v if math.isinf(v) else round(v, n) for v in values]
        assert [None if w is None else g for g, w in zip(got[f"r{n}"], want, strict=True)] == want
    nan = spark.range(1).select(exact_round(F.lit(float("nan")), 2)).first()[0]
    assert math.isnan(nan)


def test_golden(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x", "d": null}}'), (2, None), (3, "{}")], "id int, json string")
    assert sorted((r["path"], r["value"]) for r in golden.flatten(rows, "id", "json").collect()) == [("a", "1"), ("b.c", "x"), ("b.d", None)]
    old, new = (spark.createDataFrame(r, "k int, value double") for r in ([(1, 1.0), (2, None), (3, 3.0)], [(1, 1.0), (3, 4.0), (4, 5.0), (5, None)]))
    assert sorted((r["k"], r["before"], r["after"]) for r in golden.diff(old, new, ["k"]).collect()) == [(3, 3.0, 4.0), (4, None, 5.0)]
