"""The prefix trie, spelling variants and the n-gram join against SQL and plain versions."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.functions import ordered
from tallystone.llm import near_dedup, ngram_join, prefix_trie, queries, spelling
from tests.llm import brute

TURN = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def dialogues() -> list[tuple]:
    rng = random.Random(11)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {rng.randint(0, 1)} of {t}") for c in range(130) for t in range(rng.randint(1, 7)) if c % 40 != 20 or c == 25]
    rows += [(200, t, "user", f"long {t}") for t in range(300)]  # one dialogue with most rows, and others that leave it here and there
    rows += [(200 + i, t, "user", f"long {t}" if t < 30 * i else f"own {i} {t}") for i in range(1, 9) for t in range(30 * i + 2)]
    rows += [(300 + i, 0, "user", "hello there") for i in range(60)]
    rows += [(400, None, None, None), (400, None, "user", "b"), (400, None, "user", "a"), (400, 1, "user", ""), (400, 1, "user", ""), (401, 5, "user", "  "), (-7, 0, "user", "minus"), (-21, 0, "x", "y"), (None, 0, "user", "nobody's")]
    return rows


def nulls_first(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("stretched", [False, True])
def test_trie(spark, monkeypatch, stretched):
    rows = dialogues()
    if stretched:  # as if one conversation were beyond what a task may sort
        monkeypatch.setattr(ordered, "GROUP_ROWS", 50)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], TURN + ", depth int, key string")
    got = nulls_first(tuple(r[c] for c in NODE) for r in prefix_trie.trie(frame).collect())
    assert got == nulls_first(brute.trie_nodes(rows))


def test_trie_by_sql(spark):
    rows = dialogues()[:700]
    conversations = pd.DataFrame({c: pd.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("conv_id", "Int64"), ("turn", "Int64"), ("role", "string"), ("text", "string")))})  # noqa: F841
    told = duckdb.sql(queries.ORACLE_SQL["op11_prefix_trie"]).project(", ".join(NODE)).fetchall()
    assert nulls_first(told) == nulls_first(brute.trie_nodes(rows))


def test_trie_of_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURN)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "a")], TURN)).count() == 0
    # a block without its first conversation gives no turns, so this one is left without any
    alone = next(c for c in range(1, 20) if brute.zlib.crc32(str(c).encode()) % 4 == 1)
    got = prefix_trie.trie(spark.createDataFrame([(alone, 0, "user", "a")], TURN)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in got] == [(alone, 0, 1, 1, 0)] and got[0]["ends_sha256"] == brute.sha(str(alone))


WORD = ("word", "form", "root", "n", "n_near", "form_n")


def letters() -> list[tuple]:
    rng = random.Random(12)
    base = ["connection", "Überprüfung", "aaaaaaaa", "aaaaaaab", "aabaaaaa", "résumées", "straßenbahn", "mississippi", "missisippi", "short", "éééééééé"]
    rows = []
    for i in range(400):
        some = [rng.choice(base) for _ in range(12)]
        for j, w in enumerate(some):
            if rng.random() < 0.06:
                k = rng.randrange(len(w))
                some[j] = w[:k] + rng.choice(["", "x", "Q" + w[k]]) + w[k + 1 :]
        rows.append((i, rng.choice(["-", " ", "9", "\n"]).join(some)))
    rows += [(1000, None), (1001, ""), (1002, "12 34"), (None, "connection connection"), (1003, "y" * 30_000 + " " + "y" * 29_999), (1003, "y" * 30_000 + "_" + "y" * 29_999), (1003, "connectiom connectiom"), (1004, "connectiomm connectiomm " + "connectiom " * 20 + "connection " * 300)]
    return rows


def by_sql(name, rows, columns):
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string")})  # noqa: F841
    return nulls_first(duckdb.sql(queries.ORACLE_SQL[name]).project(", ".join(columns)).fetchall())


def test_spelling(spark):
    rows = letters()
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, word string")
    got = nulls_first(tuple(r[c] for c in WORD) for r in spelling.variants(frame).collect())
    told = {r[0]: r for r in got}
    assert got == nulls_first(brute.spelling(rows))
    assert told["connectiomm"][1:3] == ("connectiom", "connection") and told["connectiom"][1] == "connection"
    few = [r for r in rows if r[0] != 1003 or len(r[1]) < 100]
    assert nulls_first(brute.spelling(few)) == by_sql("op12_spelling", few, WORD)
    assert spelling.variants(frame.limit(0)).count() == 0 and spelling.variants(frame.where("doc_id = 1002")).count() == 0


def test_spelling_keys_are_the_distinct_deletions():
    rng = random.Random(5)
    found = ["".join(rng.choices("abÿ", k=rng.randint(1, 9))) for _ in range(300)]
    length = np.array([len(w) for w in found])
    count, keys = spelling.keys_of(found, length)
    told, at = {}, 0
    for w, n in zip(found, count, strict=True):
        own = [w, *{w[:i] + w[i + 1 :] for i in range(len(w))}]
        assert n == len(own) and len(set(keys[at : at + n])) == n
        assert told.setdefault(w, keys[at]) == keys[at]
        at += n
    # a word has the same key whichever word it comes from, and different words have different ones
    of = lambda w: set(spelling.keys_of([w], np.array([len(w)]))[1])
    for w in found[:60]:
        for i in range(len(w)):
            if len(w) > 1:
                assert spelling.keys_of([w[:i] + w[i + 1 :]], np.array([len(w) - 1]))[1][0] in of(w)


def test_spelling_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "_CHUNK", 10)
    assert list(spelling._pieces(np.array([4, 4, 4, 30, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def near_texts(spark, tiny) -> list[tuple]:
    rng = random.Random(13)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=150)
    rows += [(10_000 + i, " ".join(base[i % 3 : 140] + rng.choices(words, k=i % 12))) for i in range(90)]  # one large group of near copies
    passage = " ".join(rng.choices(words, k=25))
    rows += [(11_000 + i, " ".join(rng.choices(words, k=60)) + " " + passage) for i in range(120)]  # a passage that many share
    rows += [(12_000 + i, passage + (f" end{i % 9}" if i % 2 else "")) for i in range(40)]
    rows += [(13_000 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(40)]  # a chain of links
    rows += [(14_000, None), (14_001, ""), (14_002, " \n"), (14_003, "one"), (14_004, "ONE"), (14_005, "a b"), (14_006, "A  B"), (14_007, "a b c"), (14_008, " ".join(rng.choices(words, k=30_000)))]
    return [*rows, (14_009, rows[-1][1] + " more"), *[(14_010 + i, "of nine words there is one that is new " + "x" * i) for i in range(4)]]


def joined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, node string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame, **more).collect()}


def test_ngram_join(spark, tiny):
    rows = near_texts(spark, tiny)
    want = {d: x[:2] for d, x in brute.near_components(rows, 90, 3).items()}
    assert len({c for _, c in want.values()}) < len(rows) - 120 and want[14_009][1] == 14_008
    assert joined(spark, rows) == want
    assert [(d, *want[d]) for d in sorted(want)] == by_sql("op13_ngram_join", rows, ("doc_id", "n_shingles", "component_id"))


def test_ngram_join_in_blocks(spark, tiny, monkeypatch):
    rows = near_texts(spark, tiny)[200:]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)  # hardly any shingle is known to be frequent
    want = {d: x[:2] for d, x in brute.near_components(rows, 80, 4).items()}
    assert joined(spark, rows, width=4, percent=80, orders=2) == want


def test_ngram_join_deals_hot_shingles(spark, tiny, monkeypatch):
    rows = near_texts(spark, tiny)[200:]
    monkeypatch.setattr(ngram_join, "HOT", 20)
    seen, edges = [], ngram_join._edges
    monkeypatch.setattr(ngram_join, "_edges", lambda index, percent: seen.append(index.groupBy(F.col("spread") != 0, "token", "spread").count().collect()) or edges(index, percent))
    want = {d: x[:2] for d, x in brute.near_components(rows, 90, 3).items()}
    assert joined(spark, rows) == want
    # without it a shingle of the 90 near copies would have a task of its own
    assert {len([r for r in seen[0] if r[0] is hot]) > 0 for hot in (True, False)} == {True}
    assert max(r["count"] for r in seen[0]) < 40


def test_ngram_index_is_shuffled_once(spark, monkeypatch):
    # ten pairs that share all shingles, and a thousand sets that share one with others and need two; each was read by two tasks
    rows = [(100 * p + t, 2 * p + side, 40, 0) for p in range(10) for side in (0, 1) for t in range(4)]
    rows += [(10_000 + 4 * i + t if t else 5 + i % 50, 1000 + i, 40, 0) for i in range(1000) for t in range(4)]
    index = spark.createDataFrame([*rows, *rows], "token long, node long, n long, spread long")
    plans, kept = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    edges = {(r["a"], r["b"]) for r in ngram_join._edges(index, 90).collect()}
    assert edges == {(2 * p + 1, 2 * p) for p in range(10)}
    # it was written, and shuffled twice by shingle and three times more
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(") == 2


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "x y z"), (None, "x y z"), (None, "p q r"), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 1, 2), (None, 1, 2), (None, 1, None), (None, 0, None), (3, 0, 3)], key=str)
    assert ngram_join.join(frame.limit(0)).count() == 0


def test_prefixes_meet_under_every_order():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(60) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, 3)))) | {rng.getrandbits(60) for _ in range(rng.randint(0, 3))}
        if 100 * len(a & b) < 90 * len(a | b):
            continue
        listed = np.array(sorted(rng.sample(sorted(a), n // 2)), np.uint64)
        sides = [ngram_join.prefixes(np.array(sorted(s), np.uint64), (listed, np.arange(1, len(listed) + 1)), 90, range(4)) for s in (a, b)]
        least = ngram_join.least_common(min(len(a), len(b)), 90)
        assert all(len(set(x.tolist()) & set(y.tolist())) >= least for x, y in zip(*sides, strict=True))


def test_lossy_counting_keeps_the_frequent(monkeypatch):
    monkeypatch.setattr(ngram_join, "_WINDOW", 1000)
    counter, rng = ngram_join._Counter(), random.Random(4)
    for i in range(200):
        counter.add(np.array([7, 8 if i % 2 else 10_000 + i, *[rng.getrandbits(50) for _ in range(98)]], np.uint64))
    counter.close()
    got = dict(zip(counter.tokens.tolist(), counter.counts.tolist(), strict=True))
    assert got[7] == 200 and got[8] == 100 and len(got) < 2500


def test_only_wanted_texts_are_fetched(spark):
    texts = spark.range(0, 5000).select("id", F.concat(F.lit("text "), F.col("id") % 4000).alias("text")).withColumn("hash", F.xxhash64("text"))
    wanted = texts.where("id % 100 = 3").select("id", "hash", F.col("id").alias("row"))
    got = {r["row"]: r["text"] for r in near_dedup.fetched(texts, wanted).collect()}
    assert got == {i: f"text {i % 4000}" for i in range(3, 5000, 100)}
