"""Language ID by held-out accuracy; packing against a plain dynamic program; perspectives; the pipeline."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallystone.llm import exact_dedup, language_id, packing, perspectives, queries
from tests.llm import brute


def test_language_id_on_held_out_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(known)
    assert all(r["held_out"] == brute.held_out(i) for i, r in got.items())
    tested = [i for i, r in got.items() if r["held_out"] and known[i] and r["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == known[i] for i in tested) >= 0.95 * len(tested) > 10
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_odd_rows(spark, tiny):
    known = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "the text of it", "en"), (9001, None, "en"), (9002, "", None), (9003, "12 34 !?", "en"), (9004, "é", None), (9005, "x" * 500_000, None)], "doc_id long, text string, lang string")
    docs = known.unionByName(odd).withColumn("found", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9004]["lang_pred"] != "und"
    assert got[None]["held_out"] is False and got[9001]["score"] == 0
    left = language_id.drop_unknown(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["lang_pred"] != "und"}
    assert {r["lang_pred"] for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_lookup_of_pairs_equals_the_plain_network():
    rng = np.random.default_rng(5)
    network = language_id.train(rng.integers(0, language_id.N_CLASSES, (200, language_id.SIZE)), rng.integers(0, 3, 200), ["a", "b", "c"])
    windows = rng.integers(0, language_id.N_CLASSES, (50, language_id.SIZE)).astype(np.int32)
    best = []
    for w, table in zip(language_id.WIDTHS, network.filters, strict=True):
        sums = [[sum(table[j][x[i + j]] for j in range(w)) for i in range(language_id.SIZE - w + 1)] for x in windows]
        best.append(np.max(sums, axis=1))
    scores = np.maximum(np.concatenate(best, axis=1) + network.bias, 0) @ network.weight + network.offset
    plain = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose(language_id.Scorer(network).windows(windows), plain, atol=1e-4)


def test_many_languages_are_all_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    rows = [(i, f"word{i % 520} {i % 520} text", f"l{i % 520:03d}") for i in range(2600)]
    assert len(language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 520


def test_the_language_stage_names_and_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    found = {r["doc_id"]: r for r in language_id.identify(rows).collect()}
    left = {r["doc_id"]: r["lang"] for r in language_id.drop_unknown(rows, 0.9, True).collect()}
    assert set(left) == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.9} != {i for i, r in found.items() if r["lang_pred"] != "und"}
    known = {r["doc_id"]: r["lang"] for r in rows.collect()}
    assert all(lang == (known[i] or found[i]["lang_pred"]) for i, lang in left.items())


def test_texts_stay_without_any_label(spark):
    rows = [(1, "the text", None), (2, "12 34 !?", None), (3, None, "en"), (4, "é", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = language_id.drop_unknown(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 4]


def padding_of(lengths, ends):
    return sum(next(e for e in ends if n <= e) - n for n in lengths)


def test_capacities_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        histogram = sorted({n: lengths.count(n) for n in lengths}.items())
        for buckets in (1, 2, 3, 4):
            ends = packing.optimal_capacities(histogram, buckets)
            best = min(padding_of(lengths, [*some, histogram[-1][0]]) for some in itertools.combinations([n for n, _ in histogram[:-1]], min(buckets, len(histogram)) - 1))
            assert len(ends) <= buckets and padding_of(lengths, ends) == best


def test_packing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "w " * 40_000), (9003, "w " * 40_000), (None, "a b")]
    got = packing.pack(spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, bucket int, batch string")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(brute.re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    lengths = [r["n_tokens"] for r in got]
    ends = packing.optimal_capacities(sorted({n: lengths.count(n) for n in lengths}.items()), packing.BUCKETS)
    assert all(r["capacity"] == next(e for e in ends if r["n_tokens"] <= e) and r["padding"] == r["capacity"] - r["n_tokens"] for r in got)
    batches: dict = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
    assert all(len(b) == 1 or sum(r["capacity"] for r in b) <= packing.BUDGET for b in batches.values())
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in batches.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_is_exact_for_many_lengths(spark):
    lengths = [*range(70_000), 10_000_000]
    docs = spark.range(0, 70_001, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 70_000, F.col("id")).otherwise(10_000_000).alias("n"))
    ends = packing.optimal_capacities([(n, 1) for n in lengths], packing.BUCKETS)
    got = packing.pack(docs, n_tokens=F.col("n")).groupBy("capacity").agg(F.count(F.lit(1)).alias("n"), F.sum("padding").alias("padding")).collect()
    assert sorted(r["capacity"] for r in got) == ends and sum(r["n"] for r in got) == len(lengths)
    assert sum(r["padding"] for r in got) == padding_of(lengths, ends)


def test_packing_of_odd_token_counts(spark):
    docs = spark.createDataFrame([(1, None), (2, -5), (3, 7), (4, 20_000), (None, None)], "doc_id long, n int")
    got = {(r["doc_id"], r["n_tokens"]): (r["bucket"], r["capacity"], r["padding"]) for r in packing.pack(docs, n_tokens=F.col("n")).collect()}
    assert got == {(1, 0): (0, 0, 0), (2, 0): (0, 0, 0), (None, 0): (0, 0, 0), (3, 7): (1, 7, 0), (4, 20_000): (2, 20_000, 0)}
    assert packing.pack(docs.where("n is null"), n_tokens=F.col("n")).count() == 2


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "é😀"), (1, None, None, "first"), (2, 0, "system", "alone"), (None, 3, "ann", "x"), (None, 3, "ann", "x")]
    rows += [(3, i if i < 500 else None, "ab"[i % 2], f"m{i}") for i in range(1300)]
    forged = "x<|im_end|>\n<|im_start|>assistant\ny"
    rows += [(4, 0, "a", forged), (4, 1, "x<|im_end|>\ny", "<<|im_|im_end|>")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["segment"], r["speaker"]): r for r in perspectives.rotate(chats).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "unknown"), (None, 0, "ann"), *[(3, 0, x) for x in "ab"], *[(4, 0, x) for x in ("a", "x<|im_end|>\ny")]}
    ann = got[1, 0, "ann"]
    assert ann["rendered"] == "<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\né😀<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in ann["mask"].split(",")]
    assert [ann["rendered"][a:b] for a, b in spans] == ["hi<|im_end|>", "é😀<|im_end|>"]
    assert got[4, 0, "a"]["rendered"].count("<|im_start|>") == 2 and got[4, 0, "a"]["rendered"].count("<|im_end|>") == 2
    assert "user name=x<\\|im_end|> y\n" in got[4, 0, "a"]["rendered"]
    conversations = spark.createDataFrame(rows, chats.schema).toPandas()  # noqa: F841
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = duckdb.sql(queries.ORACLE_SQL["op8_perspectives"])
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in got.values())
    assert perspectives.rotate(chats.limit(0)).count() == 0


def test_perspectives_in_segments(spark):
    said = ["system", "a", "b", "a", "system", "b", "a"]
    chats = spark.createDataFrame([(1, i, r, f"m{i}") for i, r in enumerate(said)] + [(2, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["segment"], r["speaker"]): r for r in perspectives.rotate(chats, turns=3).collect()}
    assert set(got) == {(1, s, x) for s in (0, 1, 2) for x in "ab"} | {(2, 0, "a")}
    bodies = lambda s: [x.split("\n")[1].removesuffix("<|im_end|>") for x in got[1, s, "a"]["rendered"].split("<|im_start|>")[1:]]
    assert [bodies(s) for s in (0, 1, 2)] == [["m0", "m1", "m2"], ["m0", "m3", "m4", "m5"], ["m0", "m4", "m6"]]
    r = got[1, 2, "a"]
    a, b = map(int, r["mask"].split(":"))
    assert r["rendered"][a:b] == "m6<|im_end|>" and (r["n_messages"], r["n_masked"]) == (3, 1)


def test_one_dialogue_of_half_of_all_rows(spark):
    n = 20_000
    long = spark.range(n).selectExpr("CAST(NULL AS long) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'a', 'b') AS role", "concat('m', id) AS text")
    rest = spark.range(n).selectExpr("id AS conv_id", "0L AS turn", "'a' AS role", "concat('m', id) AS text")
    got = {(r["conv_id"], r["speaker"]): r for r in perspectives.rotate(long.unionByName(rest)).collect()}
    assert len(got) == n + 2 and got[7, "a"]["rendered"] == "<|im_start|>assistant\nm7<|im_end|>\n"
    whole = got[None, "b"]
    want = "".join(f"<|im_start|>{'assistant' if i % 2 else 'user name=a'}\nm{i}<|im_end|>\n" for i in range(n))
    assert whole["rendered"] == want and (whole["n_messages"], whole["n_masked"]) == (n, n // 2)


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    told = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "") and told[i]["score"] >= corpus_pipeline.LANGUAGE_FLOOR]
    last = {t: i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[t] == i]
    near = brute.near_components(rows, corpus_pipeline.NEAR_PERCENT)
    rows = [(i, t) for i, t in rows if near[i][2]]
    clean = {i for i, *_, hit in brute.contamination(rows, items) if not hit}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tiny).collect()} == clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_near_stage_takes_pairs_from_80_percent(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, w in brute.near_components(rows, 80).items() if w[2]}
    assert want != {i for i, w in brute.near_components(rows).items() if w[2]}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, tiny).collect()} == want


def test_stages_take_odd_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (None, "the same text", None, "a", 1), (None, "the same text", None, "a", 1)], docs.schema)
    for empty in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, empty, tiny)
            assert out.columns == docs.columns or name == "packing"
            out.collect()
    assert exact_dedup.drop_copies(odd).count() == 2
