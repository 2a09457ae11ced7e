"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII digits, letters and all non-ASCII characters of the lower-cased text. A
window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.

A shard is what a task gets of the documents at once, up to ``SHARD_BYTES`` of text. Its words are
numbered by the benchmark's vocabulary; every run of other words is one border, and stretches shorter
than the shortest window are left out, since no window fits in. Over the rest an FM-index is built;
all windows are searched backward through its wavelet tree at once, the occurrences are located by
the sampled suffix positions, confirmed on the words themselves, and merged into removal spans.

The windows are made by Spark, which counts each once, and dealt by hash into blocks of about ``MAX_WINDOWS``.
A block is broadcast, searched for in one pass over the documents, and freed; driver and tasks never hold more
than one. A benchmark of one block, the usual case, needs no shuffle. With more blocks the documents are written
once with numbers, each pass writes the hits of its block, and the spans of all blocks are merged per document.

Defined cases: null texts have no words; items with a null id or without words have no windows;
items that repeat an id are one item; ids are of any type and compared as strings; an empty benchmark hits nothing;
other columns are passed on. Jobs run while the result is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm import words
from tallystone.llm.common import ascii_lower, columns_of, cut, ship, unused
from tallystone.llm.fm_index import FMIndex

WIDTH = 10
SHARD_BYTES = 16_000_000
MAX_WINDOWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Windows:
    """A block of windows, as numbers of words: what the tasks need."""

    def __init__(self, table: pa.Table, width: int) -> None:
        spelled, keys, begin = [], [], [0]
        for chunk in words.chunks(table["window"].combine_chunks(), words.WORD_CHAR):
            keys.append(chunk.key)
            spelled += [chunk.data[a:b].tobytes() for a, b in zip(chunk.start, chunk.end, strict=True)]
            begin += (begin[-1] + np.cumsum(chunk.per_text())).tolist()
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.vocabulary, first, number = np.unique(key, return_index=True, return_inverse=True)
        self.spelled = [spelled[i] for i in first]
        self.length = np.diff(begin)
        self.symbols = np.zeros((len(self.length), width), dtype=np.int64)
        inside = np.arange(width) < self.length[:, None]
        self.symbols[inside] = number + 1
        self.items = table["items"].combine_chunks()

    def items_of(self, some: np.ndarray) -> list[str]:
        return sorted({i for w in some for i in self.items[int(w)].as_py()})


def _shards(texts: pa.Array) -> Iterator[list[words.Words]]:
    """Chunks of whole texts, gathered to shards of about SHARD_BYTES."""
    held, size = [], 0
    for chunk in words.chunks(texts, words.WORD_CHAR):
        held.append(chunk)
        size += len(chunk.data)
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search_shard(chunks: list[words.Words], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: (text, window, first word, end word), and the words of each text."""
    shortest = int(windows.length.min())
    symbols, owner, place = [], [], []
    n_words = np.concatenate([c.per_text() for c in chunks])
    for number, c in enumerate(chunks):
        code = np.searchsorted(windows.vocabulary, c.key)
        code[code == len(windows.vocabulary)] = 0
        known = windows.vocabulary[code] == c.key
        # stretches of known words within one text
        same = np.concatenate([[False], (c.doc[1:] == c.doc[:-1]) & known[:-1]]) if len(known) else known
        opens = np.flatnonzero(known & ~same)
        closes = np.flatnonzero(known & ~np.concatenate([same[1:] & known[1:], [False]])) + 1 if len(known) else opens
        fits = closes - opens >= shortest
        opens, closes = opens[fits], closes[fits]
        if not len(opens):
            continue
        length = closes - opens
        at = np.repeat(opens - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
        ends = np.cumsum(length + 1) - 1
        text = np.zeros(int(length.sum()) + len(length), dtype=np.int64)
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        text[inner] = code[at] + 1
        word = np.zeros(len(text), dtype=np.int64)
        word[inner] = at
        symbols.append(text)
        place.append(word)
        owner.append(np.full(len(text), number))
    if not symbols:
        none = np.zeros(0, np.int64)
        return none, none, none, none, n_words
    text, place, owner = np.concatenate(symbols), np.concatenate(place), np.concatenate(owner)
    index = FMIndex(text, len(windows.vocabulary))
    low, high = index.search(windows.symbols, windows.length)
    count = high - low
    hit = np.flatnonzero(count > 0)
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count[hit])])[:-1], count[hit]) + np.arange(count[hit].sum())
    window, at = np.repeat(hit, count[hit]), index.locate(rows)
    # each word that an occurrence covers is confirmed by its bytes, once
    covered = np.unique(at[:, None] + np.arange(windows.symbols.shape[1])[None, :])
    covered = covered[covered < len(text)]
    covered = covered[text[covered] > 0]
    differs = np.zeros(len(text) + 1, dtype=np.int64)
    for number in np.unique(owner[covered]):
        c, some = chunks[number], covered[owner[covered] == number]
        differs[some] = ~_spelled(c, place[some], windows.spelled, text[some] - 1)
    wrong = np.concatenate([[0], np.cumsum(differs)])
    ok = wrong[at + windows.length[window]] == wrong[at]
    at, window = at[ok], window[ok]
    doc, first = np.zeros(len(at), np.int64), place[at]
    for number in np.unique(owner[at]):
        c, own = chunks[number], owner[at] == number
        local = c.doc[first[own]]
        doc[own] = c.first + local
        first[own] -= np.searchsorted(c.doc, local)
    return doc, window, first, first + windows.length[window], n_words


def _spelled(c: words.Words, word: np.ndarray, spelled: list[bytes], number: np.ndarray) -> np.ndarray:
    """Which words of a chunk are spelled as the words of the vocabulary they are taken for."""
    same, size = np.zeros(len(word), dtype=bool), c.end[word] - c.start[word]
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        known, at = np.unique(number[of], return_inverse=True)
        right = np.frombuffer(b"".join(spelled[k] if len(spelled[k]) == n else bytes(n) for k in known), dtype=np.uint8).reshape(-1, n)
        same[of] = (c.data[c.start[word[of]][:, None] + np.arange(n)] == right[at]).all(axis=1)
    return same


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], first[1:] > end[:-1]])
    return first[opens], end[np.concatenate([opens[1:], [True]])]


RESULT = "n_words long, spans array<struct<first long, end long>>, items array<string>"


def _finder(windows, width: int):
    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        w: Windows = windows.value
        counts, spans, items = [], [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for shard in _shards(texts):
            if len(w.length):
                doc, window, first, end, n = search_shard(shard, w)
            else:
                doc, n = np.zeros(0, np.int64), np.concatenate([c.per_text() for c in shard])
            counts.append(n)
            if len(doc):
                order = np.argsort(doc, kind="stable")
                doc, window, first, end = doc[order], window[order], first[order], end[order]
                begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                for a, b in zip(begin, [*begin[1:], len(doc)], strict=True):
                    spans[doc[a]] = [{"first": int(x), "end": int(y)} for x, y in zip(*merged(first[a:b], end[a:b]), strict=True)]
                    items[doc[a]] = w.items_of(np.unique(window[a:b]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "spans", "items"],
        )

    return find


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(window, items): each window once, its words parted by blanks, with the ids it occurs in."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    ws = items.select("item", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("ws")).where(F.size("ws") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))
    each = ws.select("item", F.explode(F.transform(at, lambda i: F.array_join(F.slice("ws", i, width), " "))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _merged(spans: Column) -> Column:
    """An array of spans in order, with those that overlap or touch made one."""

    def join(got: Column, s: Column) -> Column:
        top = F.try_element_at(got, F.lit(-1))
        both = F.array(F.struct(top["first"].alias("first"), F.greatest(top["end"], s["end"]).alias("end")))
        return F.when((F.size(got) > 0) & (s["first"] <= top["end"]), F.concat(F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0))), both)).otherwise(F.concat(got, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first:long,end:long>>"), join)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, into: str = "hits") -> DataFrame:
    """``docs`` with one more column ``into``: struct of n_words, removal spans (in words) and items."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = cut(windows_of(benchmark, item_col, item_text_col, width))
    n_blocks = max(1, -(-found.count() // MAX_WINDOWS))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n_blocks)))
    block = lambda b: context.broadcast(Windows(dealt.where(F.col("block") == b).select("window", "items").toArrow(), width))
    text = F.col(text_col).cast("string")
    if n_blocks == 1:
        return docs.withColumn(into, _finder(block(0), width)(text))

    row = unused(docs, "__row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    passes = []
    for b in range(n_blocks):
        held = block(b)
        hits = numbered.select(row, _finder(held, width)(text).alias("h")).select(row, "h.*")
        passes.append(cut(hits if b == 0 else hits.where(F.size("spans") > 0)))
        held.unpersist()
    every = reduce(DataFrame.unionByName, passes)
    per = every.groupBy(F.col(row).alias(f"{row}_")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    per = per.select(f"{row}_", F.struct("n_words", _merged(F.col("spans")).alias("spans"), "items").alias(into))
    return numbered.join(per, F.col(row) == F.col(f"{row}_")).select(*columns_of(docs), into)


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the removal spans as
    ``first:end`` numbers of words, comma-joined."""
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    listed = F.array_join(F.array_sort("hits.items"), ",")
    narrow = docs.select(F.col(names.pop("id_col", "doc_id")).alias("doc_id"), F.col(names.pop("text_col", "text")).alias("text"))
    return scan(narrow, benchmark, **names).select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_join(F.transform("hits.spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with their columns."""
    hits = unused(docs, "hits")
    return scan(docs, benchmark, into=hits).where(F.size(f"{hits}.spans") == 0).select(*columns_of(docs))
