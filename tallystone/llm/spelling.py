"""Spelling variants by a symmetric-delete join.

1. Words are the runs of letters in all texts, counted by one aggregation. Of some occurrences, told by a checksum
   of document and run, one letter is left out, so every corpus holds slips to be found.
2. Every word emits itself and its distinct single deletions as 64-bit keys, told by running sums over its letters in a
   number of steps in proportion to its length, so very long words are no special case. A key belongs to the words that
   add a letter to it, so however many documents there are, it has at most as many words as letters times places.
3. Words that share a key are joined and confirmed to be exactly one edit apart.
4. A word's form is its most frequent near word, if that is ten times as frequent; roots are reached by joining the
   table of forms with itself, which doubles the steps taken each time.

Defined cases: a null or empty text has no word; a null id counts as empty in the checksum; repeated rows count as
often as they occur; of equally frequent near words the first in code-point order is the form; an empty table gives an
empty result; other columns are ignored. Jobs run while the result is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm import words
from tallystone.llm.common import ascii_lower, cut, ship, whole_text

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One occurrence in so many loses a letter.
SLIPS = 31
#: A form is so many times as frequent as its variant.
RATIO = 10
RUN = r"[A-Za-zÀ-ÿ]+"
_CHUNK = 1 << 20


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times or more."""
    runs = F.regexp_extract_all(ascii_lower(whole_text(text_col)), F.lit(RUN), F.lit(0))
    long = F.filter(runs, lambda r: F.length(r) >= LEAST_LENGTH)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(long).alias("run"))
    check = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("check") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    told = rows.withColumn("check", check).select(F.when(F.col("check") % SLIPS == 0, short).otherwise(F.col("run")).alias("word"))
    return told.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _pieces(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of words of about ``_CHUNK`` letters together."""
    upto, first = np.cumsum(length), 0
    while first < len(length):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _CHUNK, "right")))
        yield first, last
        first = last


def keys_of(found: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many keys each word has, all keys in turn): the word itself, then its distinct single deletions."""
    letters = np.frombuffer("".join(found).encode("latin-1"), dtype=np.uint8)
    total = len(letters)
    up, down = words._power(total + 2)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:total], out=sums[1:])
    end = np.cumsum(length)
    start = end - length
    owner = np.repeat(np.arange(len(length)), length)
    # leaving out any letter of a run of equal ones gives the same word
    own = np.ones(total, dtype=bool)
    own[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    i = np.flatnonzero(own)
    s, e = start[owner[i]], end[owner[i]]
    less = (sums[i] - sums[s]) * down[s] + (sums[e] - sums[i + 1]) * down[s + 1]
    less = words.mix(less + (e - s - 1).astype(np.uint64))
    whole = words.mix((sums[end] - sums[start]) * down[start] + length.astype(np.uint64))
    count = 1 + np.bincount(owner[i], minlength=len(length))
    keys = np.empty(int(count.sum()), dtype=np.uint64)
    first = np.cumsum(count) - count
    is_whole = np.zeros(len(keys), dtype=bool)
    is_whole[first] = True
    keys[is_whole], keys[~is_whole] = whole, less
    return count, keys


def _key_lists():
    @F.arrow_udf("array<long>")
    def keys(found: pa.Array) -> pa.Array:
        length = pa.compute.utf8_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in _pieces(length):
            count, key = keys_of(found[a:b].to_pylist(), length[a:b])
            counts.append(count)
            values.append(key)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))

    return keys


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other, m): both directions of every pair of words one edit apart; m is how often the other occurs."""
    ship(vocab.sparkSession)
    keyed = cut(vocab.select(F.explode(_key_lists()("word")).alias("key"), "word", "n"))
    left, right = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("na")), keyed.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    alike = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
    pairs = alike.select("a", "b", "na", "nb").distinct()
    way = lambda x, y, m: F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(m).alias("m"))
    return pairs.select(F.explode(F.array(way("a", "b", "nb"), way("b", "a", "na"))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that is reached from (word, form), in which no word comes back."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    vocab = cut(vocabulary(docs, id_col, text_col))
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = vocab.join(best, "word", "left").withColumn("m", -F.col("best.m"))
    formed = F.col("m") >= RATIO * F.col("n")
    told = cut(told.select("word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("m")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
