"""Chat formatting by perspective rotation, with built-in functions only.

For every participant of a conversation (each role but ``system``) the dialogue is rendered with that
speaker as the assistant and all others as named users; the mask lists the code points [start, end)
that the loss counts: what the speaker says, with the end mark.

A dialogue is rendered whole. So that no task gathers the messages of a long one, all messages are
range-partitioned by conversation and place, each partition's stretch of a conversation is rendered in
chunks, and only the rendered chunks are put together; a row is then as long as its dialogue. ``turns`` splits longer dialogues into rows of so many messages, each headed by the
conversation's system messages from before; it is off unless asked for.

Marks within texts and names are written ``<\\|im_...``, and line ends in names are blanks, so nobody's words
open or close a message.

Defined cases: rows with a null conversation are one conversation of their own; a null turn comes first; ties of
turn are ordered by role and text, and repeated rows stay; a null text is empty; a null role is the role
"unknown"; a conversation with system messages only has no participant and gives no row. Other columns are
ignored. Jobs run while the result is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.common import cut

#: Messages that are rendered at once.
CHUNK = 256
SYSTEM, UNNAMED = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def _header(role: Column, speaker: Column) -> Column:
    name = F.regexp_replace(_plain(role), r"[\r\n]", " ")
    named = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), named, F.lit("\n"))


def _pieces(messages: Column, speaker: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(_header(m["role"], speaker).alias("head"), F.concat(_plain(m["text"]), F.lit(CLOSE)).alias("body"), (m["role"] == speaker).alias("own")))


def _masked(pieces: Column) -> Column:
    """struct(at, mask): the rendered length, and the spans (start, end) of the speaker's own bodies."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def add(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(done["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(done["mask"]).alias("mask"))

    return F.aggregate(pieces, start, add)


def _stretches(rows: DataFrame, turns: int | None) -> DataFrame:
    """(conv_id, segment, stretch, messages): what one partition holds of one dialogue, or of one segment, in order."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = cut(rows.repartitionByRange(*order, "row").withColumn("stretch", F.spark_partition_id()))
    segment = F.lit(0).cast("long")
    if turns is not None:
        # places from the partitions' sizes, so that no task numbers a whole dialogue
        sizes = dealt.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n"))
        ahead = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        own = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text", "row")
        numbered = dealt.withColumn("place", F.row_number().over(own)).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
        dealt = numbered.withColumn("place", F.col("place") + F.col("before") - 1)
        segment = F.floor(F.col("place") / turns)
    message = F.struct("turn", "role", "text")
    return dealt.groupBy("conv_id", segment.alias("segment"), "stretch").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def rotate(chats: DataFrame, turns: int | None = None) -> DataFrame:
    """(conv_id, segment, speaker, n_messages, n_masked, rendered, mask); segment is 0 for whole dialogues."""
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    stretches = _stretches(rows, turns)
    if turns is not None:
        stretches = cut(stretches)
        said = stretches.select("conv_id", "segment", "stretch", F.filter("messages", lambda m: m["role"] == SYSTEM).alias("messages")).where(F.size("messages") > 0)
        later = stretches.groupBy("conv_id").agg(F.max("segment").alias("last")).select(F.col("conv_id").alias("c"), "last")
        heads = said.join(later, F.col("conv_id").eqNullSafe(F.col("c"))).where(F.col("last") > F.col("segment"))
        heads = heads.select("conv_id", F.explode(F.sequence(F.col("segment") + 1, "last")).alias("segment"), (F.col("stretch") - F.lit(1 << 30)).cast("int").alias("stretch"), "messages")
        stretches = stretches.unionByName(heads)
    at = F.sequence(F.lit(0), F.floor((F.size("messages") - 1) / CHUNK).cast("int"))
    chunks = stretches.select("conv_id", "segment", "stretch", "messages", F.explode(at).alias("chunk")).withColumn("messages", F.slice("messages", F.col("chunk") * CHUNK + 1, CHUNK))
    # speakers go to each stretch, so a long dialogue's chunks meet them where they are and not in one task
    places = stretches.select(F.col("conv_id").alias("__c"), F.col("stretch").alias("__s")).distinct()
    heard = places.join(speakers, F.col("__c").eqNullSafe(F.col("__conv"))).drop("__conv")
    views = chunks.join(heard, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("stretch") == F.col("__s"))).withColumn("pieces", _pieces(F.col("messages"), F.col("speaker")))
    part = views.select(
        "conv_id", "segment", "speaker", "stretch", "chunk",
        F.size("messages").cast("long").alias("n"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        _masked(F.col("pieces")).alias("m"),
    )
    found = part.groupBy("conv_id", "segment", "speaker").agg(F.array_sort(F.collect_list(F.struct("stretch", "chunk", "n", "rendered", "m"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,end:long>>>").alias("mask"))

    def shift(done: Column, p: Column) -> Column:
        moved = F.transform(p["m"]["mask"], lambda s: F.struct((s["start"] + done["at"]).alias("start"), (s["end"] + done["at"]).alias("end")))
        return F.struct((done["at"] + p["m"]["at"]).alias("at"), F.concat(done["mask"], F.array(moved)).alias("mask"))

    spans = F.flatten(F.aggregate("parts", start, shift, lambda a: a["mask"]))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    return found.withColumn("spans", spans).select(
        "conv_id",
        "segment",
        "speaker",
        total.alias("n_messages"),
        F.size("spans").cast("long").alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"),
    )
