"""MinHash near-dedup by a multi-index Hamming join.

1. Each row's distinct word shingles give a signature of 64 components of 16 bits (the lowest
   bits of 64 min-hashes). Equal shingle sets are one class from here on; its first row stands
   for it, so copies cost nothing more. Rows have numbers, so ids may repeat.
2. Two sets of similarity s differ in a component with probability 1-s. Signatures within a distance
   set by ``percent`` are the join's matches: a true pair at that similarity is farther apart with a
   probability of at most ``MISS``. It is 23 components for 85 %, 29 for 80 %.
3. Pigeonhole: the 64 components are split into chunks, 12 for a distance of 23, 15 for 29. With c chunks
   a distance of at most 2c-1 leaves at most one error in some chunk, and the allowed error is
   enumerated: each chunk is indexed once for each of its components left out. So every pair within
   the distance shares at least one of 64 keys.
4. Within a bucket, signatures are compared in blocks and only a spanning forest of the matches goes
   on. The connected components of these forests are the near groups; no link leaves its group.
5. The texts of near groups, and only those, are read once more: a bitmap of fixed size of their hashes leaves out the others before
   anything is shuffled, and blocks are dealt after that. Within a group each document is
   compared on its full shingle set with those not yet reached, and each link found reaches one more:
   all links of the group are decided, and at most one row per document is returned.
6. Components over links give each row's component, named by the smallest id in it.

Buckets or groups of more than ``BLOCK`` documents are dealt as pairs of blocks, each a task of
its own, so that no group is whole in one task and no pair is left out.

Defined cases: a null or empty text, or one without words, has no shingles and no link; fewer words
than ``width`` are one shingle; rows that repeat an id are documents of their own, linked by their texts
alone; a null id names no component unless all ids in it are null; an empty table gives an empty result;
other columns are ignored. Hashes of shingles have 64 bits. Jobs run while the result is built.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.graph import components
from tallystone.functions.stages import written
from tallystone.llm import words
from tallystone.llm.common import cut, ship, unused

WIDTH, PERCENT = 5, 85
COMPONENTS = 64
#: Greatest probability that a pair at the similarity asked for is beyond the distance.
MISS = 1e-5
BLOCK = 2048
#: Most documents' characters in one block of a near group.
BLOCK_CHARS = 16_000_000
#: Bits of the bitmap of wanted texts.
BITS = 1 << 24

_U = np.uint64
_XOR = words.mix(np.arange(1, COMPONENTS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
_MUL = words.mix(_XOR + _U(1)) | _U(1)


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingles of each text, chunk by chunk: (number of the first text, arrays)."""
    for chunk in words.chunks(texts, words.NOT_BLANK):
        owner, value = words.shingles(chunk, width)
        if len(owner) and (np.diff(owner) < 0).any():
            order = np.argsort(owner, kind="stable")
            owner, value = owner[order], value[order]
        border = np.searchsorted(owner, np.arange(chunk.n_texts + 1))
        yield chunk.first, [np.unique(value[border[i] : border[i + 1]]) for i in range(chunk.n_texts)]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), COMPONENTS) uint16; no set may be empty."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    return np.stack([(np.minimum.reduceat((flat ^ x) * m, begin) & _U(0xFFFF)).astype(np.uint16) for x, m in zip(_XOR, _MUL, strict=True)], axis=1)


def _sketcher(width: int):
    @F.arrow_udf("n long, chars long, same binary, signature binary")
    def sketch(texts: pa.Array) -> pa.Array:
        n, same, signature = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
        for first, sets in _sets(texts, width):
            full = [i for i, s in enumerate(sets) if len(s)]
            for row, i in zip(_signatures([sets[i] for i in full]) if full else (), full, strict=True):
                n[first + i], same[first + i], signature[first + i] = len(sets[i]), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes()
        length = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).cast(pa.int64())
        return pa.StructArray.from_arrays([pa.array(n), length, pa.array(same, pa.binary()), pa.array(signature, pa.binary())], ["n", "chars", "same", "signature"])

    return sketch


def reach(percent: int) -> tuple[int, int]:
    """(chunks, distance): the fewest chunks, with one error each, whose distance of 2 * chunks - 1 a
    pair at a similarity of ``percent`` exceeds with a probability of at most MISS."""
    p = 1 - percent / 100
    for chunks in range(1, COMPONENTS // 2 + 1):
        if sum(math.comb(COMPONENTS, k) * p**k * (1 - p) ** (COMPONENTS - k) for k in range(2 * chunks, COMPONENTS + 1)) <= MISS:
            return chunks, 2 * chunks - 1
    raise ValueError(f"{COMPONENTS} components cannot tell a similarity of {percent} %")


def _indexer(n_chunks: int):
    chunks = np.array_split(np.arange(COMPONENTS), n_chunks)

    def index_keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each signature its 64 keys: a chunk without one of its components, hashed."""
        for batch in batches:
            if batch.empty:
                continue
            parts = np.stack([np.frombuffer(s, dtype=np.uint16) for s in batch["signature"]]).astype(_U)
            parts = words.mix((parts << _U(8)) + np.arange(COMPONENTS, dtype=_U))
            keys = []
            for chunk in chunks:
                total = parts[:, chunk].sum(axis=1, dtype=_U)
                keys += [words.mix(total - parts[:, out] + _U(out)) for out in chunk]
            yield pd.DataFrame({"key": np.stack(keys, axis=1).reshape(-1).view(np.int64), "id": np.repeat(batch["id"].to_numpy(), COMPONENTS)})

    return index_keys


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of the graph on 0..n-1; near(i, others) says which of ``others`` touch i."""
    left, found = np.arange(n), []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            reached, left = left[hit], left[~hit]
            found += [(i, int(j)) for j in reached]
            stack += reached.tolist()
    return found


def _runs(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal ``by``, from batches sorted by it; holds one run and one batch at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch[by].to_numpy()
        begin = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
        if held and tuple(held[-1][by].iloc[-1]) != tuple(keys[0]):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(begin, begin[1:], strict=False):
            if b < len(batch):
                yield pd.concat([*held, batch.iloc[a:b]]) if held else batch.iloc[a:b]
                held = []
            else:
                held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _matcher(distance: int):
    def close_signatures(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each bucket a spanning forest of the signatures within ``distance``."""
        edges: list[tuple[int, int]] = []
        for run in _runs(batches, ["key", "tile"]):
            ids, at = np.unique(run["id"].to_numpy(), return_index=True)
            if len(ids) > 1:
                rows = run["signature"].to_numpy()[at]
                table = np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(-1, COMPONENTS)
                edges += [(ids[i], ids[j]) for i, j in _forest(len(ids), lambda i, o, t=table: (t[o] != t[i]).sum(axis=1) <= distance)]
            if len(edges) > 100_000:
                yield pd.DataFrame(set(edges), columns=["a", "b"], dtype="int64")
                edges = []
        yield pd.DataFrame(list(set(edges)), columns=["a", "b"]).astype("int64")

    return close_signatures


def _linker(width: int, percent: int):
    def links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each block of a near group a spanning forest of its links, by full shingle sets."""
        edges: list[tuple[int, int]] = []
        for run in _runs(batches, ["near", "tile"]):
            run = run.drop_duplicates("id")
            ids = run["id"].to_numpy()
            sets = [s for _, some in _sets(pa.array(run["text"], pa.large_string()), width) for s in some]
            size = np.array([len(s) for s in sets])
            begin = np.concatenate([[0], np.cumsum(size)])
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(values), dtype=np.int64)

            def near(i: int, others: np.ndarray, size=size, begin=begin, flat=flat, mark=mark) -> np.ndarray:
                # a pair can only reach the similarity if its sizes do
                hit = (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (size[others] > 0)
                some = others[hit]
                if len(some):
                    mark[flat[begin[i] : begin[i + 1]]] = 1
                    at = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(size[some])])[:-1], size[some]) + np.arange(size[some].sum())
                    common = np.add.reduceat(mark[flat[at]], np.concatenate([[0], np.cumsum(size[some])])[:-1])
                    mark[flat[begin[i] : begin[i + 1]]] = 0
                    hit[hit] = 100 * common >= percent * (size[some] + size[i] - common)
                return hit

            edges += [(ids[i], ids[j]) for i, j in _forest(len(ids), near)]
            if len(edges) > 100_000:
                yield pd.DataFrame(edges, columns=["a", "b"])
                edges = []
        yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return links


def _tiled(members: DataFrame, by: str, blocks) -> DataFrame:
    """Adds ``tile``: groups of one block have tile 0; of larger ones every pair of blocks is a
    tile, and each member is in the tiles of its own block."""
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    at = lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda i: at(i)["x"] * F.col("n_blocks") + at(i)["y"])
    return members.withColumn("n_blocks", blocks.cast("long")).withColumn("tile", F.explode(F.when(F.col("n_blocks") > 1, tiles).otherwise(F.array(F.lit(0).cast("long"))))).drop("n_blocks")


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (id, hash, ...) with their texts. texts: (id, hash, text). Rows are found again by id and the text's
    hash: rows that repeat both have the same text. A bitmap of the wanted hashes, broadcast, leaves out most other texts
    before the shuffle."""
    place = F.pmod(F.col("hash"), F.lit(BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    spot = F.bitmap_bit_position(F.col("p"))
    # a bitmap's bytes hold eight positions each, the lowest bit first
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    maybe = texts.where("text is not null").withColumn("p", place).join(F.broadcast(bits), F.bitmap_bucket_number("p") == F.col("bucket"))
    maybe = maybe.where(F.getbit(byte, (spot % 8).cast("int")) == 1)
    maybe = maybe.select(F.col("id").alias("mine"), F.col("hash").alias("text_hash"), "text")
    return wanted.join(maybe, (F.col("hash") == F.col("text_hash")) & F.col("mine").eqNullSafe(F.col("id"))).drop("mine", "text_hash")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(row, id, hash, n, group, least) of each row; group is a row number, null for rows without shingles, least
    the smallest id in it, hash that of the text."""
    chunks, distance = reach(percent)
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    sketched = cut(texts.select(F.monotonically_increasing_id().alias("row"), "id", "hash", _sketcher(width)("text").alias("s")).select("row", "id", "hash", "s.*"))
    classes = sketched.where("n > 0").groupBy("same").agg(F.min("row").alias("rep"), F.min("id").alias("least"))
    reps = cut(sketched.join(classes, (sketched["same"] == classes["same"]) & (sketched["row"] == classes["rep"])).select("row", "id", "hash", "chars", "signature"))

    # by far the largest table on disk: as columns it takes less than as a checkpoint's rows
    keys = written(reps.select(F.col("row").alias("id"), "signature").mapInPandas(_indexer(chunks), "key long, id long"))
    filled = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _tiled(keys.join(filled, "key"), "key", F.ceil(F.col("n") / BLOCK)).join(reps.select(F.col("row").alias("id"), "signature"), "id")
    near = (
        members.select("key", "tile", "id", "signature")
        .repartition("key", "tile")
        .sortWithinPartitions("key", "tile")
        .mapInPandas(_matcher(distance), "a long, b long")
    )
    groups = components(near).withColumnsRenamed({"node": "row", "component": "near"}).join(reps.select("row", "id", "hash", "chars"), "row")
    groups = cut(groups)

    sizes = groups.groupBy("near").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).alias("blocks"))
    placed = _tiled(groups.select(F.col("row").alias("id"), "near").join(sizes, "near"), "near", F.col("blocks"))
    held = cut(fetched(texts, groups.select("row", "id", "hash")).select("row", "text").dropDuplicates(["row"]))
    links = (
        placed.join(held.withColumnRenamed("row", "id"), "id")
        .select("near", "tile", "id", "text")
        .repartition("near", "tile")
        .sortWithinPartitions("near", "tile")
        .mapInPandas(_linker(width, percent), "a long, b long")
    )
    linked = components(links).withColumnsRenamed({"node": "rep", "component": "group"})
    settled = classes.join(linked, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    named = settled.groupBy("group").agg(F.min("least").alias("least"))
    known = settled.select("same", "group").join(named, "group")
    return sketched.select("row", "id", "hash", "n", "same").join(known, "same", "left").drop("same")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    component = F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("least"))
    return _grouped(docs, id_col, text_col, width, percent).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its columns: of the rows with the smallest id the first. Rows that repeat
    both id and text share its fate."""
    key, mine, gone = (unused(docs, c) for c in ("__key", "__hash", "__lost"))
    found = _grouped(docs, id_col, text_col, WIDTH, percent)
    best = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("best"))
    told = found.join(best, "group", "left").groupBy("id", "hash").agg(F.max(F.coalesce(F.col("row") == F.col("best"), F.lit(True))).alias("stays"))
    lost = told.where("not stays").select(F.col("id").alias(key), F.col("hash").alias(gone))
    same = (F.col(mine) == F.col(gone)) & F.col(id_col).eqNullSafe(F.col(key))
    return docs.withColumn(mine, F.xxhash64(F.col(text_col).cast("string"))).join(lost, same, "left_anti").drop(mine)
