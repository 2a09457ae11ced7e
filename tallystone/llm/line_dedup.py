"""Line dedup: lines that many documents share stay only in the document with the largest id.

1. One pass over the texts gives each row's digest, its number of lines and one 128-bit hash for each
   line's key (the stripped, ASCII-lower-cased line; null for short ones). That table is written once and
   the texts are not read again until the very end. The digest is one of a row's two names, so rows that
   repeat an id stay apart.
2. Hashes are counted with map-side combine, so a line in a third of all documents costs a row per
   map task; of the rare ones nothing more is kept. The occurrences of the others are written.
3. The occurrences are range-partitioned by hash with a secondary sort by document, largest first, and
   position. Streaming through them, a line stays if its document is the first one of its hash, or if too few
   different documents follow. A hash in more than ``PART_ROWS`` rows is dealt over as many parts as its rows fill, whatever
   its rank: its documents are counted with map-side combine, and each part is told how many there are
   and which one stays. The ``HOT`` hashes in most rows are also broadcast, so that they need no join by hash.
4. Each document's kept lines are returned as a run-length compressed bitmap: runs "first+length",
   comma-joined. No text is in there.

``apply`` gives the texts that result. Defined cases: a null or empty text is one empty line; a line counts
once for each document, and rows of equal ids are one document that may hold a line in several rows;
a row with a null id is no document: it neither counts nor loses lines; an empty table gives an empty
result; other columns are ignored. Jobs run while the result is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.common import BLANKS, ascii_lower, columns_of, cut, unused, whole_text

MIN_CHARS, MIN_DOCS = 40, 5
#: How many hashes are broadcast at most, and how many rows of one hash go in one part.
HOT, PART_ROWS = 1000, 2_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest() -> Column:
    return F.xxhash64(whole_text())


def _keys(docs: DataFrame, id_col: str, min_chars: int) -> DataFrame:
    """(doc_id, digest, keys): for each line of a document the hash of its key, null for short ones."""

    def hashed(line: Column) -> Column:
        key = F.trim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.left(F.sha2(key.cast("binary"), 256), F.lit(32)))

    text = ascii_lower(whole_text())
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _digest().alias("digest"), F.transform(_lines(text), hashed).alias("keys")).where(F.exists("keys", lambda k: k.isNotNull()))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digest, n_dropped, dropped) of every row that loses lines; dropped lists their runs."""
    keys = cut(_keys(docs, id_col, min_chars))
    # strings, which array_distinct looks up by hash, until the arrays are exploded; then half the bytes
    once = keys.select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").select(F.unhex("k").alias("h"))
    shared = cut(once.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_docs))
    hot = F.broadcast(shared.orderBy(F.desc("n_rows"), "h").limit(HOT).withColumnRenamed("n_rows", "n_hot"))
    every = keys.select("doc_id", "digest", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("doc_id", "digest", "pos", F.unhex("k").alias("h")).join(hot, "h", "left")

    is_hot = F.col("n_hot").isNotNull()
    # hot occurrences need no partner: a key of another length, which none has, deals them evenly
    own = F.when(is_hot, F.unhex(F.hex(F.xxhash64("doc_id", "digest", "pos")))).otherwise(F.col("h"))
    found = every.join(shared.select(F.col("h").alias("other"), "n_rows"), own == F.col("other"), "left").where(is_hot | F.col("other").isNotNull())
    n_parts = F.ceil(F.coalesce("n_hot", "n_rows") / PART_ROWS)
    part = F.pmod(F.xxhash64("doc_id", "digest", "pos"), n_parts)
    found = cut(found.select("doc_id", "digest", "pos", "h", n_parts.alias("n_parts"), part.alias("part")))

    order = [F.desc("doc_id"), F.asc("pos")]
    own_hash = Window.partitionBy("h")
    ranged = found.where("n_parts = 1").repartitionByRange("h").sortWithinPartitions("h", *order)
    placed = ranged.withColumns({"first": F.first("doc_id").over(own_hash.orderBy(*order)), "rank": F.dense_rank().over(own_hash.orderBy(F.desc("doc_id")))})
    placed = placed.withColumn("n_docs", F.max("rank").over(own_hash)).where((F.col("doc_id") != F.col("first")) & (F.col("n_docs") >= min_docs))
    # of a hash in several parts each part is told what all of them hold
    dealt = found.where("n_parts > 1")
    busy = dealt.groupBy("h").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"), F.max("n_parts").alias("n_parts")).where(F.col("n_docs") >= min_docs)
    told = busy.select("h", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))
    shed = dealt.join(told, ["h", "part"]).where(F.col("doc_id") != F.col("keeper"))
    dropped = placed.select("doc_id", "digest", "pos").unionByName(shed.select("doc_id", "digest", "pos")).distinct()
    by_pos = Window.partitionBy("doc_id", "digest").orderBy("pos")
    runs = (
        dropped.withColumn("run", F.col("pos") - F.row_number().over(by_pos))
        .groupBy("doc_id", "digest", "run")
        .agg(F.min("pos").alias("at"), F.count(F.lit(1)).alias("n"))
    )
    return runs.groupBy("doc_id", "digest").agg(F.sum("n").alias("n_dropped"), _joined_runs(F.array_sort(F.collect_list(F.struct("at", "n")))).alias("dropped"))


def _joined_runs(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["at"], F.lit("+"), r["n"])), ",")


def kept_runs(n_lines: Column, dropped: Column) -> Column:
    """The bitmap of kept lines, from the runs of dropped ones (null: none is)."""
    lost = F.transform(F.filter(F.split(F.coalesce(dropped, F.lit("")), ","), lambda r: r != ""), lambda r: F.split(r, r"\+").cast("array<int>"))
    begin = F.concat(F.array(F.lit(0)), F.transform(lost, lambda r: r[0] + r[1]))
    end = F.concat(F.transform(lost, lambda r: r[0]), F.array(n_lines))
    runs = F.zip_with(begin, end, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n")))
    return _joined_runs(F.filter(runs, lambda r: r["n"] > 0))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` that are left without the runs in ``dropped``, as an array."""
    runs = F.transform(F.split(dropped, ","), lambda r: F.split(r, r"\+").cast("array<int>"))
    lost = F.flatten(F.transform(runs, lambda r: F.sequence(r[0], r[0] + r[1] - 1)))
    # positions and lost positions are both sorted: array_except is a hash lookup, linear in the lines
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(text)) - 1), lost)
    # the lines are bound once: an expression inside the inner function would split the text for each of them
    picked = F.transform(F.array(_lines(text)), lambda lines: F.transform(left, lambda i: F.get(lines, i)))
    return F.when(dropped.isNull(), _lines(text)).otherwise(F.get(picked, F.lit(0)))


def _with_runs(docs: DataFrame, id_col: str, min_chars: int, min_docs: int, names: tuple[str, str, str, str]) -> DataFrame:
    """``docs`` with the runs of dropped lines under the last of four free names."""
    key, digest, n, runs = names
    bitmaps = drop_bitmaps(docs, id_col, min_chars, min_docs).toDF(key, f"{digest}o", n, runs)
    # rows that lose nothing, null ids among them, have no partner; their digests deal them evenly
    return docs.withColumn(digest, _digest()).join(bitmaps, (F.col(digest) == F.col(f"{digest}o")) & (F.col(id_col) == F.col(key)), "left")


def apply(docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the texts that are left; all other columns, and texts that lose nothing, as they were."""
    names = tuple(unused(docs, c) for c in ("__key", "__digest", "__n", "__runs"))
    runs = F.col(names[3])
    left = F.when(runs.isNull(), F.col("text")).otherwise(F.array_join(kept_lines(whole_text(), runs), "\n"))
    both = _with_runs(docs, id_col, min_chars, min_docs, names)
    return both.select(*[left.alias(n) if n == "text" else c for n, c in zip(docs.columns, columns_of(docs), strict=True)])


def report(docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 and the bitmap of kept lines."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), whole_text().alias("text"))
    both = _with_runs(narrow, "doc_id", min_chars, min_docs, ("__key", "__digest", "__n", "__runs"))
    kept = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("text"), F.col("__runs")), "\n"))
    n_lines = F.size(_lines(F.col("text")))
    return both.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("__n", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        kept_runs(n_lines, F.col("__runs")).alias("kept_runs"),
    )
