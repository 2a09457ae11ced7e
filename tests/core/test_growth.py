"""What queries shuffle and work out again, which decides how they grow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallystone.functions import graph
from tallystone.operators import golden, judging, layout, metrics, turning
from tallystone.plans import catalog
from tallystone.schemas import LAYOUT, POSTER, RULES

LINE = "img int, box int, w double, angle double"
READ = "img int, box int, turn int, angle double, conf double, text string"


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


def test_rules_shuffle_no_row_for_each_entity_and_group(spark, monkeypatch):
    rows = [("a", f"m{i % 3}", f"e{i % 7}", float(i % 11) if i % 5 else None) for i in range(200)] + [("b", "m0", "e1", 1.0), (None, None, None, 2.0), ("c", "m1", "x", None)]
    seen = spark.createDataFrame(rows, "corpus string, metric string, entity string, value double")
    found = judging.derive(seen)
    assert not re.search(r"hashpartitioning\(corpus#\d+, metric#\d+, entity#\d+", plan(found))
    got = {(r["corpus"], r["metric"]): (r["n_entities"], r["n_entities_all"]) for r in found.collect()}
    want = {}
    for c, m, e, v in rows:
        if v is not None:
            want.setdefault((c, m), set()).add(e)
    assert got == {(c, m): (len(es), len({e for d, _, e, _ in rows if d == c})) for (c, m), es in want.items()}
    monkeypatch.setattr(judging, "BITS", 2)
    assert {(r["corpus"], r["metric"]): (r["n_entities"], r["n_entities_all"]) for r in judging.derive(seen).collect()} == got


def test_readings_meet_boxes_once(spark):
    found = spark.createDataFrame([(1, 1, 50.0, 3.0), (1, 2, 60.0, 5.0), (1, 3, 70.0, None), (2, 1, 50.0, -170.0), (None, 1, 50.0, 1.0)], LINE)
    seen = spark.createDataFrame([(1, 1, 0, 3.0, 1.0, "ab"), (1, 1, 90, 93.0, 1.0, "zz"), (1, 2, 0, 4.0, 9.0, "no"), (1, 2, 180, -175.0, 1.0, "x"), (1, 3, 0, None, 1.0, "n"), (2, 1, 90, -80.0, 2.0, "abc"), (2, 1, 0, -170.0, 3.0, None), (None, 1, -90, -89.0, 1.0, "q")], READ)
    read = turning.read_angles(found, seen, ["img"])
    # each box was written four times and joined by its angle
    assert "explode" not in plan(read).lower()
    assert {(r["img"], r["box"], r["angle"], r["score"], r["text"]) for r in read.collect()} == {(1, 1, 3.0, 2.0, "ab"), (1, 2, -175.0, 1.0, "x"), (1, 3, None, 1.0, "n"), (2, 1, -80.0, 6.0, "abc"), (None, 1, -89.0, 1.0, "q")}
    told = turning.poster_angle(read, ["img"])
    # the readings were read again for each step after the first
    assert "conf" not in plan(told)
    assert {tuple(r) for r in told.where("img = 2 or img is null").collect()} == {(2, -80.0, 1), (None, -89.0, 1)}


def test_a_boxs_turns_are_one_row(spark):
    found = spark.createDataFrame([(1, 1, 50.0, 3.0), (1, 2, 60.0, 3.5), (1, 3, 40.0, 3.0), (2, 1, 9.0, 4.0)], LINE)
    seen = spark.createDataFrame([(1, 1, 90, 0.0, 1.0, "abc"), (1, 2, -90, 0.0, 1.0, "abc"), (1, 3, 0, 0.0, 99.0, "abc"), (1, 1, 0, 0.0, 1.0, None), (2, 1, 0, 0.0, 0.0, "a")], READ)
    found = turning.skew_by_reading(found, seen, ["img"])
    assert not re.search(r"Aggregate \[img#\d+, box#\d+, turn#\d+\]", plan(found))
    # turns 90 and -90 are read as well as each other, and 90 comes first: too far to turn
    assert {(r["img"], r["angle"]) for r in found.collect()} == {(1, 0.0), (2, 4.0)}


def test_records_alike_are_not_flattened(spark, monkeypatch):
    old = spark.createDataFrame([("same", '{"a":1}'), ("new", '{"a":1}'), ("twice", '{"a":1}'), ("gone", '{"a":2}'), ("none", None)], "name string, record string")
    new = spark.createDataFrame([("same", '{"a":1}'), ("new", '{"a":3,"b":4}'), ("twice", '{"a":1}'), ("twice", '{"a":5}'), ("gone", None), ("none", None)], "name string, record string")
    cases = old.select(F.col("name").alias("file"), F.lit("why").alias("why"))
    flatten, flat = golden.flatten, []

    def counted(rows, key, json):
        flat.append(rows.count())
        return flatten(rows, key, json)

    monkeypatch.setattr(golden, "flatten", counted)
    got = {r["name"]: (r["n_changed"], [tuple(c) for c in r["changed"]]) for r in golden.regression(old, new, cases).collect()}
    assert got == {"new": (2, [("a", "1", "3"), ("b", None, "4")]), "gone": (1, [("a", "2", None)]), "twice": (1, [("a", "1", "5")])}
    assert flat == [7]


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_an_array_are_sorted_once(spark):
    one = spark.createDataFrame([(1, [5.0, 1.0, 2.0, 9.0], [5.0, 1.0, None, 2.0, 9.0]), (2, [], []), (3, None, None)], "id int, v array<double>, w array<double>")
    for made, want in ((layout.gaps(F.col("w")), [[1.0, 3.0, 4.0], [], None]), (metrics.chained(F.col("v"), 2), [3, 0, None])):
        frame = one.select("id", made.alias("found"))
        assert len(re.findall("sort_array\\(", optimized(frame.where("id > 0")))) == 1
        assert [r["found"] for r in sorted(frame.collect())] == want


def test_observations_and_findings_are_worked_out_once_as_columns(spark):
    posters = spark.createDataFrame([], POSTER)
    assert "size(concat(" not in optimized(metrics.observe(posters)) and optimized(metrics.observe(posters)).count("aggregate(") == 1
    layouts = [("none", None, (0.0, 0.0), [("a", None, None, None, [])]), ("some", None, (0.0, 0.0), [("a", None, None, None, []), ("b", None, None, 10.0, [(0.0,), (15.0,), (None,)])])]
    entry = {"corpus": "c", "metric": layout.LEADING, "n": 20, "median": 1.5, "lo": 1.4, "hi": 1.6, "min": 1.4, "max": 1.6, "cv": 0.1, "verdict": "constraint", "n_all": 20, "n_layers": 0, "layers": [], "is_rule": True}
    found = layout.check(spark.createDataFrame(layouts, LAYOUT), spark.createDataFrame([entry], RULES))
    # an array of findings within an array would be worked out by functions of arrays, and again by a filter on its size
    assert "flatten(" not in optimized(found) and "size(CASE" not in optimized(found)
    assert {tuple(r) for r in found.select("layout", "block", "rule", "status", "value").collect()} == {("none", None, None, None, None), ("some", "b", layout.LEADING, "accepted", 1.5)}


def test_rules_of_records_come_from_a_row_for_each(spark):
    block = (0, 0, 10, 10, 3, 5.0, 14, [10, 24], [3, None], [5, 19])
    rows = [(c, f"{c}{i}", i, 2.5 if i % 4 == 0 else 0.0, [100, 120], [1.0, 2.0, 90.0, 100.0], i % 3, None, [block] * (i % 4), None) for c in ("a", "b") for i in range(30)]
    posters = spark.createDataFrame([*rows, rows[5], ("c", "bare", 0, 2.5, None, None, 0, None, None, None)], POSTER)
    table = metrics.measured(posters)
    # the observations were written, some twenty rows for each poster, and entities counted from them
    assert table.count() == posters.count() and [r["bits"] for r in table.where("corpus = 'c'").collect()] == [0]
    found = judging.derive_measured(table)
    assert "explode" not in plan(table.select("corpus", "entity", "bits")).lower()
    assert sorted(map(str, found.collect())) == sorted(map(str, judging.derive(metrics.observe(posters)).collect()))


def test_a_blocks_row_does_not_carry_the_rules(spark):
    block = ("x", 1.0, 5.0, 10.0, [(10.0,), (26.0,), (42.0,)])
    layouts = spark.createDataFrame([("one", None, (100.0, 120.0), [block] * 3), ("none", None, (100.0, 120.0), None)], LAYOUT)
    rules = spark.createDataFrame([("c", "lead_over_cap", 30, 1.6, 1.5, 1.7, 1.4, 1.8, 0.1, "constraint", 30, 0, [], 30, 30, True)], RULES)
    checked = layout.check(layouts, rules)
    lines = checked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [below for line, below in zip(lines, lines[1:], strict=False) if "Generate posexplode" in line]
    # the layers, adopted entry and seven others were columns of each block's row
    assert made and not any(re.search(r"\b(bands|adopted|forced|cands|of_\w+)#", line) for line in made)
    assert {(r["layout"], r["rule"], r["status"]) for r in checked.collect()} == {("one", "lead_over_cap", "accepted"), ("none", "no_blocks", "error")}


def test_a_large_star_shuffles_twice(spark):
    edges = spark.createDataFrame([(3, 1), (4, 1), (4, 3), (5, 4), (9, 7)], "a long, b long")
    # equal edges were left out twice in a round, once after each star
    assert graph._large_star(edges)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (9, 7)}


def test_items_are_dealt_before_they_are_blocks(spark, tiny):
    posters = catalog.orders_as_posters(spark, tiny)
    # a function of an array of items, or an expression within the aggregate, would not be compiled
    assert "transform(" not in optimized(posters) and re.search(r"collect_list\(b#\d+", optimized(posters))
    for frame in (posters, catalog.place_text_orders(spark, tiny)):
        made = frame._jdf.queryExecution().executedPlan().toString()
        below = [part.split("Exchange")[0] for part in made.split("Exchange hashpartitioning(l_orderkey")[1:]]
        # lists were gathered before the shuffle too
        assert below and not any("collect_list" in part for part in below)
    one = {r["ord"]: r for r in posters.collect()}
    rows = spark.read.parquet(f"{tiny}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.pmod("l_partkey", F.lit(400))).alias("x1"), F.max(F.pmod("l_suppkey", F.lit(100)) * 5 + 2 * F.col("l_quantity").cast("int")).alias("y2"))
    assert {k: (len(r["blocks"]), r["region"][0], r["region"][3]) for k, r in one.items()} == {r["l_orderkey"]: (r["n"], r["x1"], r["y2"]) for r in rows.collect()}


def test_posters_of_a_card_are_counted_from_their_table(spark, tiny):
    card = catalog.style_card_orders(spark, tiny)
    # line items were read, dealt and grouped once more for it
    assert "l_orderkey" not in plan(card)
    posters = catalog.orders_as_posters(spark, tiny).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("angle") >= 1).alias("turned"))
    assert {(r["corpus"], r["n_posters"], r["n_excluded"]) for r in card.where("metric = 'text_area'").collect()} == {tuple(r) for r in posters.collect()}


def test_ascenders_are_numbers_of_lines(spark):
    block = lambda bases, caps, xtops: (0, 0, 1, 1, 1, 1.0, None, bases, caps, xtops)
    blocks = {
        "plain": [block([10, 20, 30], [2, None, 28], [6, 16, 26]), block([10], [5], [5])],
        "uneven": [block([10, 20], [2], [6, 16, 1]), block([], [1], [2]), block([10], [8], [10])],
        "unknown": [block([10], [2], [6]), block([10], None, [6])],
        "bare": [None],
        "none": None,
    }
    posters = spark.createDataFrame([("c", name, 0, 0.0, None, None, 0, None, b, None) for name, b in blocks.items()], POSTER)
    found = posters.select("file", metrics.ascenders()["asc_over_xh"].alias("v"), metrics.leading()["gap_px"].alias("gaps"))
    # a record for each line
    assert "arrays_zip(" not in optimized(found)
    assert {r["file"]: r["v"] for r in found.collect()} == {"plain": [2.0, 1.0], "uneven": [2.0], "unknown": None, "bare": None, "none": None}
