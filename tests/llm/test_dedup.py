"""Exact, line and near dedup against SQL and all pairs."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.functions import graph
from tallystone.llm import exact_dedup, line_dedup, near_dedup, queries
from tests.llm import brute

LINE = "a line of more than forty characters, shared by some documents"


def corpus(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    for i in range(40):  # a chain of edits: neighbours are linked, the ends are not
        rows.append((20_000 + i, " ".join(base[:100] if i == 0 else base[:100][: 100 - i] + [f"x{j}" for j in range(i)])))
    for i in range(30):
        rows.append((21_000 + i, "\n".join([f"  {LINE.upper() if i % 2 else LINE}\t", f"own {i}", LINE, "", " " + LINE])))
    rows += [(22_000, None), (22_001, ""), (22_002, "\n"), (22_003, "one"), (22_004, "ONE"), (22_005, " one\n"), (22_006, "a b c d"), (22_007, "A  B c\x0bd"), (22_008, "\n".join(rng.choices(words, k=30_000)))]
    return rows


@pytest.fixture(scope="module")
def rows(spark, tiny):
    return corpus(spark, tiny)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", b"d", 1) for i, t in rows], "doc_id long, text string, key string, digest binary, n int")


def by_sql(name, rows):
    documents = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": pd.array([r[1] for r in rows], "string")})  # noqa: F841
    got = duckdb.sql(queries.ORACLE_SQL[name])
    return sorted(map(tuple, got.project(", ".join(sorted(got.columns))).fetchall()))


def by_sql_rows(name, rows):
    documents = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": pd.array([r[1] for r in rows], "string")})  # noqa: F841
    return duckdb.sql(queries.ORACLE_SQL[name]).fetchall()


def result(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_exact(spark, rows):
    rows = [*rows, *[(30_000 + i, "hot text") for i in range(400)]]
    assert result(exact_dedup.decide(frame(spark, rows))) == by_sql("op3_exact_dedup", rows)
    kept = {r["doc_id"] for r in exact_dedup.decide(frame(spark, rows)).where("kept").collect()}
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "key", "digest", "n"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(kept)


def test_exact_finds_frequent_digests(spark):
    # hot digests are in the middle of each of four partitions, single ones around them
    at = F.col("id") % 10_000
    text = F.when(at.between(3_000, 5_999), "a").when(at.between(6_000, 6_199), "b").when(at.between(7_000, 7_099), "c").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.col("id").alias("row"))
    got = {bytes(r["digest"]): (r["winner"]["doc_id"], r["group_size"]) for r in exact_dedup.frequent(rows, 0.005).collect()}
    assert {k: got[hashlib.sha256(k.encode()).digest()] for k in "abc"} == {"a": (35_999, 12_000), "b": (36_199, 800), "c": (37_099, 400)}
    assert len(got) <= 200


def test_exact_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r)[:4] for r in exact_dedup.decide(docs).collect()]
    assert sum(r[3] for r in got) == 3 and sorted(r[2] for r in got) == [2, 2, 2, 2, 3, 3, 3]
    assert {r[1] for r in got if r[0] == 2} == {3}
    assert sorted(map(str, exact_dedup.drop_copies(docs).collect())) == sorted(["Row(doc_id=None, text='a')", "Row(doc_id=1, text='b')", "Row(doc_id=3, text='')"])
    assert exact_dedup.decide(docs.limit(0)).count() == 0


def test_lines(spark, rows):
    assert result(line_dedup.report(frame(spark, rows))) == by_sql("op4_line_dedup", rows)
    assert line_dedup.report(frame(spark, rows).limit(0)).count() == 0


def test_lines_beyond_the_hot_ones(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 1)
    assert result(line_dedup.report(frame(spark, rows))) == by_sql("op4_line_dedup", rows)


@pytest.mark.parametrize("hot", [1, 1000])
def test_lines_in_several_parts(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "PART_ROWS", 3)
    assert result(line_dedup.report(frame(spark, rows))) == by_sql("op4_line_dedup", rows)


def test_one_line_in_many_rows_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART_ROWS", 100)
    docs = spark.createDataFrame([(i % 4, f"{LINE}\n{i}") for i in range(2000)] + [(10 + i % 5, f"{LINE} b\n{i}") for i in range(2000)], "doc_id long, text string")
    lost = {}
    for r in line_dedup.report(docs).collect():
        lost[r["doc_id"]] = lost.get(r["doc_id"], 0) + r["n_dropped"]
    assert lost == {**{i: 0 for i in range(4)}, **{10 + i: 400 for i in range(4)}, 14: 0}


def test_line_bitmaps_restore_texts(spark, rows):
    lost = {r["doc_id"]: r for r in line_dedup.drop_bitmaps(frame(spark, rows)).collect()}
    assert lost[21_000]["n_dropped"] == 3 and lost[21_000]["dropped"] == "0+1,2+1,4+1" and 21_029 not in lost
    left = {r["doc_id"]: r["text"] for r in line_dedup.apply(frame(spark, rows)).collect()}
    assert left[21_000] == "own 0\n" and left[21_029] == rows[-10][1] and left[22_000] is None
    assert len(left) == len(rows)


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"{LINE} number {i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, long if i == 2 else f"{LINE} number 7\n{i}") for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.report(docs).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (60_000, 1), 3: (2, 1), 4: (2, 1), 5: (2, 0)}


def test_lines_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"{LINE}\nmine"), (1, f"yours\n{LINE}"), *[(i, LINE) for i in range(2, 7)], (8, f"{LINE} b"), *[(9, f"{LINE} b\n{i}") for i in range(6)]], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_runs"]) for r in line_dedup.report(docs).collect())
    # the line of 8 and 9 is in two documents only, however many rows they have
    assert got == [(1, 2, 1, "0+1"), (1, 2, 1, "1+1"), *[(i, 1, 1, "") for i in range(2, 6)], (6, 1, 0, "0+1"), (8, 1, 0, "0+1"), *[(9, 2, 0, "0+2")] * 6]
    assert sorted(r["text"] for r in line_dedup.apply(docs).where("doc_id = 1").collect()) == ["mine", "yours"]
    hot = spark.createDataFrame([(1, LINE + str(i)) for i in range(9)] + [(i % 3, LINE) for i in range(900)], "doc_id long, text string")
    assert hot.count() == line_dedup.report(hot).where("n_dropped = 0").count()


def test_lines_null_ids(spark):
    docs = spark.createDataFrame([(None, LINE)] * 3 + [(i, LINE) for i in range(6)], "doc_id long, text string")
    got = line_dedup.report(docs).collect()
    assert len(got) == 9 and {r["doc_id"] for r in got if r["n_dropped"] == 0} == {None, 5}


def test_near(spark, rows):
    want = brute.near_components(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.similar(frame(spark, rows)).collect()}
    assert got == want
    assert want[20_000][1] == want[20_039][1] and want[22_003][1] == want[22_005][1] == 22_003
    left = {r["doc_id"] for r in near_dedup.drop_near_copies(frame(spark, rows)).collect()}
    assert left == {d for d, w in want.items() if w[2]}


def test_near_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_CHARS", 2_000)
    want = brute.near_components(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.similar(frame(spark, rows)).collect()}
    assert got == want


def test_near_at_other_similarities(spark, rows):
    text = " ".join(f"v{i}" for i in range(104))  # 100 shingles; the other text shares 90 of 110
    rows = [*rows, (40_000, text), (40_001, " ".join([*text.split()[:94], *[f"u{i}" for i in range(10)]]))]
    for percent in (80, 60):
        want = brute.near_components(rows, percent)
        got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.similar(frame(spark, rows), percent=percent).collect()}
        assert got == want and got[40_001][1] == 40_000
    assert brute.near_components(rows)[40_001][1] == 40_001
    assert near_dedup.reach(85) == (12, 23) and near_dedup.reach(80) == (15, 29)
    with pytest.raises(ValueError):
        near_dedup.reach(10)


def test_near_links_of_repeated_ids(spark):
    rng = random.Random(8)
    texts = [[" ".join(rng.choices([f"w{i}" for i in range(900)], k=80)) for _ in range(2)] for _ in range(20)]
    # ids 0-19 have two texts each; 100 + i is a copy of one of them, 200 + i a near copy of the other
    rows = [(i, t) for i, two in enumerate(texts) for t in two] + [(100 + i, a) for i, (a, _) in enumerate(texts)] + [(200 + i, f"{b} more") for i, (_, b) in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.similar(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert got == {k + i: i for k in (100, 200) for i in range(20)}
    left = near_dedup.drop_near_copies(spark.createDataFrame([*rows, (None, texts[0][0]), (None, "a b c"), (None, "a b c d e f")], "doc_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted([*map(str, [*range(20), *range(20)]), "None", "None"])


def test_near_recall_on_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute.near_components(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, linked = [sum(x[1] != i for i, x in some.items()) for some in (got, want)]
    print(f"recall of documents with a smaller partner: {found} of {linked}")
    assert got == want
    assert {r[0]: r[1:] for r in by_sql_rows("op5_near_dedup", rows)} == want


def test_near_odd_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (7, None), (None, None), (8, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.similar(docs).collect())
    assert got == [("2", 3, 2, True), ("4", 3, 2, False), ("4", 3, 2, False), ("7", 0, 7, True), ("8", 0, 8, True), ("None", 0, None, True), ("None", 3, 2, False)]
    assert near_dedup.similar(docs.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(docs).where("doc_id = 4").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, 5000)] + [(7000 + i, 7500) for i in range(400)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            above[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in above}
