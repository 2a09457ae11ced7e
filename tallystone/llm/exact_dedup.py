"""Exact dedup by a heavy-hitter split.

1. Every row gets the SHA-256 of its whole text; the narrow (id, digest) table is written once.
2. A Misra-Gries pass (Spark's frequent-item sketch, at most 1/support counters) names the digests
   that may cover more than ``support`` of all rows. The sketch has false positives but no misses; it
   counts 64-bit hashes of the digests, since it does not know equal binary values again.
3. The candidates are verified by an exact count with map-side combine, and those that do not cover
   more than ``support`` of the rows go. The winners, fewer than 1/support rows whatever the corpus,
   are broadcast and settle their copies on the map side.
4. All other digests, none of which holds more than ``support`` of the rows, go through an ordinary
   shuffle.

Defined cases: null text counts as empty; of equal texts the largest id stays (a null id loses to any
other, and of rows that repeat the same id exactly one stays); an empty table gives an empty result;
other columns of the input are ignored, whatever their names. Jobs run while the result is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import columns_of, cut, sha256_hex, unused, whole_text

#: Share of all rows from which on a digest is settled on the map side; 1/SUPPORT bounds the broadcast.
SUPPORT = 0.005


def decide(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = sha256_hex(whole_text() if text is None else text)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.unhex(digest).alias("digest")).withColumn("row", F.monotonically_increasing_id()))

    winners = F.broadcast(frequent(rows, support))
    copies = rows.join(winners, "digest", "inner")
    rest = rows.join(winners, "digest", "left_anti")
    tail = rest.join(_groups(rest), "digest", "inner")
    return copies.unionByName(tail).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The groups of all digests that cover more than ``support`` of the rows, and of no others."""
    n_rows = rows.count()
    hashed = rows.withColumn("hash", F.xxhash64("digest"))
    heavy = hashed.stat.freqItems(["hash"], support).select(F.explode("hash_freqItems").alias("hash"))
    return _groups(hashed.join(F.broadcast(heavy), "hash", "left_semi")).where(F.col("group_size") > support * n_rows)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one of rows that repeat both id and text.

    Only the keys of rows that go are joined with the texts, and Spark broadcasts them while they are few. Rows
    that repeat a key that stays, which ids that are unique have none of, are told apart beside."""
    key = unused(docs, "key")
    named = F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string"))
    marked = cut(decide(docs, id_col).groupBy(named.alias(key)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    keyed = docs.withColumn(key, F.concat_ws(":", sha256_hex(whole_text()), F.col(id_col).cast("string")))
    left = keyed.join(marked.select(key), key, "left_anti").select(*columns_of(docs))
    repeated = marked.where("kept").select(key)
    if repeated.isEmpty():
        return left
    return left.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates([key]).select(*columns_of(docs)))
