"""Conversation prefix trie: every distinct beginning of a dialogue is a node, its subtree is summed by leaf peeling.

1. Turns are ranked within their conversation (`ordered.placed`, so a conversation of any size is no task's own work)
   and dialogues are rebuilt: each takes its first turns, none to three by a checksum of its id, from the first of its
   block of twenty.
2. A beginning of d turns is told by d and four running sums of 32 bits over digests of (place, role, text), 128 bits
   together; a node's parent is the same without its last turn. Nodes come from one aggregation.
3. Runs of only children under one smallest member are one link, so that the rounds that follow go with the branches on a
   path, not with turns; k branches on one path need k dialogues with k*k/2 turns together.
4. Leaf peeling: each link holds how many links below it are still missing. Those with none missing are finished and
   send their leaves and tokens to the parent, summed on the way; the counters fall, until the root is finished.
5. Nodes within a link take its totals less the running sum of what is above them.

Defined cases: rows with a null conversation belong to none; a null role or text is empty; ties of turn are ordered by
role and text, and repeated rows stay; the block of a negative id is rounded to zero as `%` does; an empty table gives
an empty result; other columns are ignored. Jobs run while the result is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import ordered
from tallystone.llm.common import cut, ship

BLOCK, MOST = 20, 4
_SUMS = ("s0", "s1", "s2", "s3")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(MOST))


def first_of_block(conv: Column) -> Column:
    return conv - conv % BLOCK


def _turns(chats: DataFrame) -> DataFrame:
    """(conv, place, digest, words) of each turn, places from 1."""
    empty = F.lit("")
    value = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = chats.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), value.alias("value"))
    ranked = ordered.placed(rows.groupBy("conv", "value").agg(F.count(F.lit(1)).alias("n")), ["conv"])
    role, text = F.col("value.role"), F.col("value.text")
    return ranked.select(
        "conv",
        F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("place"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def rebuilt(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words) of each turn of the rebuilt dialogues, and (conv) of all of them."""
    turns = cut(_turns(chats))
    convs = turns.groupBy("conv").agg(F.max("place").alias("own"))
    heads = turns.where(F.col("place") < MOST).withColumnRenamed("conv", "first")
    taker = convs.select("conv", first_of_block(F.col("conv")).alias("first"), shared_turns(F.col("conv")).alias("h"))
    taken = taker.where("h > 0").join(heads, "first").where("place <= h").select("conv", F.col("place").alias("depth"), "digest", "words")
    # all but short blocks give as many turns as are asked for
    short = convs.where((F.col("conv") % BLOCK == 0) & (F.col("own") < MOST - 1)).select(F.col("conv").alias("first"), F.col("own").alias("there"))
    missing = taker.select("first").distinct().join(convs.select(F.col("conv").alias("first")), "first", "left_anti").withColumn("there", F.lit(0).cast("long"))
    given = turns.select("*", first_of_block(F.col("conv")).alias("first"), shared_turns(F.col("conv")).alias("h")).where("place > h")
    given = given.join(short.unionByName(missing), "first", "left").withColumn("m", F.least("h", F.coalesce("there", "h")))
    kept = given.select("conv", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "digest", "words")
    return taken.unionByName(kept), convs.select("conv")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


_ROOT = hashlib.md5(",".join("0" * (1 + len(_SUMS))).encode()).digest()


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words): the node of each turn of each dialogue."""
    piece = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"))
    pieces = {f"p{i}": F.conv(F.substring(piece, 8 * i + 1, 8), 16, 10).cast("long") for i in range(len(_SUMS))}
    rows = turns.withColumns(pieces).select("conv", F.col("depth").alias("value"), F.lit(1).cast("long").alias("n"), "words", *pieces)
    rows = ordered.placed(rows, ["conv"], ("words", *pieces))
    for p, s in zip(pieces, _SUMS, strict=True):
        rows = ordered.running(rows, ["conv"], F.col(p), s)
    depth = F.col("value")
    before = [F.col(s) - F.col(p) for p, s in zip(pieces, _SUMS, strict=True)]
    return rows.select("conv", depth.alias("depth"), _key(depth, [F.col(s) for s in _SUMS]).alias("key"), _key(depth - 1, before).alias("parent"), "words")


def peel(links: DataFrame) -> DataFrame:
    """(link, leaves, saved) totals of the subtree below each link. links: (link, parent, waiting, leaves, saved), of
    which waiting is how many links have it as parent. One round for each level of links."""
    finished = []
    waiting = cut(links)
    while True:
        done = waiting.where("waiting = 0")
        finished.append(done.select("link", "leaves", "saved"))
        sent = done.where("parent is not null").groupBy(F.col("parent").alias("to")).agg(F.count(F.lit(1)).alias("came"), F.sum("leaves").alias("more"), F.sum("saved").alias("sum"))
        left = waiting.where("waiting > 0")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        told = left.join(sent, left["link"] == sent["to"], "left")
        more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        waiting = cut(told.select("link", "parent", (F.col("waiting") - F.coalesce("came", F.lit(0))).alias("waiting"), more("leaves", "more"), more("saved", "sum")))


def _hash_ends(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's lists in turn, from rows sorted by key and stretch; holds one list at a time."""
    key, so_far = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k != key:
                if so_far is not None:
                    out.append((key, so_far.hexdigest()))
                key, so_far = k, hashlib.sha256(ids.encode())
            else:
                so_far.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if so_far is not None:
        yield pd.DataFrame([(key, so_far.hexdigest())], columns=["key", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv). Ids are dealt by ranges and joined where they are, so only lists meet."""
    dealt = cut(cut(ends).repartitionByRange("key", "conv").withColumn("stretch", F.spark_partition_id()))
    lists = dealt.groupBy("key", "stretch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return lists.repartition("key").sortWithinPartitions("key", "stretch").mapInPandas(_hash_ends, "key binary, ends_sha256 string")


def trie(chats: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(chats.sparkSession)
    turns, convs = rebuilt(chats)
    paths = cut(_paths(turns))
    every, smallest = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    long = lambda x: F.lit(x).cast("long")
    nodes = paths.groupBy("key").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    top = convs.limit(1).select(F.lit(_ROOT).alias("key"), long(smallest).alias("conv_id"), long(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), long(every).alias("n_convs"), long(0).alias("words"))
    nodes = cut(nodes.unionByName(top))
    counted = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(counted, nodes["key"] == counted["of"], "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes)

    # every first turn has the root as its parent: its row is one, so it is written into the others
    branches = (nodes.where("depth = 0").select("n_children").first() or [0])[0]
    above = nodes.where("depth > 0").select(F.col("key").alias("of"), F.col("conv_id").alias("above"), F.col("n_children").alias("siblings"))
    deep = nodes.where("depth > 1").join(above, F.col("parent") == F.col("of")).drop("of")
    high = nodes.where("depth <= 1").withColumns({"above": F.when(F.col("depth") == 1, long(smallest)), "siblings": F.when(F.col("depth") == 1, long(branches))})
    known = deep.unionByName(high)
    starts = F.col("above").isNull() | (F.col("siblings") > 1) | (F.col("above") != F.col("conv_id"))
    known = known.select("conv_id", F.col("depth").alias("value"), F.lit(1).cast("long").alias("n"), "key", "parent", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", starts.cast("long").alias("starts"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))

    keep = ("key", "parent", "parent_conv_id", "n_convs", "n_children", "starts", "tokens")
    known = ordered.placed(known, ["conv_id"], keep)
    known = ordered.running(ordered.running(known, ["conv_id"], F.col("starts"), "link"), ["conv_id"], F.col("tokens"), "sum")
    known = cut(known.select("conv_id", F.col("value").alias("depth"), *keep, F.struct("conv_id", "link").alias("link"), (F.col("sum") - F.col("tokens")).alias("passed")))

    links = known.groupBy("link").agg(F.max_by("n_children", "depth").alias("waiting"), F.sum("tokens").alias("saved"), F.min("passed").alias("passed"))
    # the root's children are told by its link, all others by a join
    root = F.struct(long(smallest).alias("conv_id"), long(1).alias("link"))
    first = known.where("starts = 1 and depth <= 1").select("link", F.when(F.col("depth") == 1, root).alias("up"))
    others = known.where("starts = 1 and depth > 1").select("link", F.col("parent").alias("want")).join(known.where("n_children > 0 and depth > 0").select(F.col("key").alias("want"), F.col("link").alias("up")), "want").drop("want")
    ups = first.unionByName(others)
    links = cut(links.join(ups, "link").select("link", F.col("up").alias("parent"), "waiting", F.when(F.col("waiting") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved", "passed"))
    totals = peel(links.drop("passed")).join(links.select("link", F.col("passed").alias("start")), "link")

    last = paths.groupBy("conv").agg(F.max_by("key", "depth").alias("last"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("last", F.lit(_ROOT)).alias("key"), "conv")
    told = known.join(totals, "link").join(_ends(ends), "key", "left")
    return told.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("passed") + F.col("start")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
