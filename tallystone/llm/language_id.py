"""Language ID by a byte convolutional network.

Bytes fall into 160 classes (letters folded, each non-ASCII byte its own). Filters of widths 2, 3
and 4 slide over fixed windows of 128 bytes, each filter's maximum over the window goes through a
ReLU into a softmax. Trained here in numpy with Adam on a bounded sample of labelled rows:
``DOCS_PER_LANGUAGE`` documents of each language, ``WINDOWS_PER_DOC`` windows of each, drawn by hash from
all labelled documents. Every window of every whole text is scored; a text's prediction is the mean
of its windows' probabilities, weighted by their bytes.

For speed, neighbouring bytes are looked up as pairs: the filters are stored as sums over pairs.

The sample grows with the number of languages and with nothing else.

Defined cases: null texts and texts without any letter are ``und`` with score 0, and so is everything
if no row is labelled; rows without label are never learnt from; other columns are passed on or ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.common import columns_of, ship, unused

DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 200, 8
WIDTHS, FILTERS, SIZE = (2, 3, 4), 8, 128
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
UNKNOWN = "und"

_BYTES = np.arange(256)
_LOW = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
#: 0 blanks and controls, 1-26 letters, 27 digits, 28 other ASCII, 32.. the bytes from 0x80 on
CLASS = np.where(_BYTES >= 128, _BYTES - 96, np.where((_LOW >= 97) & (_LOW <= 122), _LOW - 96, np.where(_BYTES <= 32, 0, np.where((_BYTES >= 48) & (_BYTES <= 57), 27, 28)))).astype(np.int32)
N_CLASSES = 160


class Network(NamedTuple):
    languages: list[str]
    filters: list[np.ndarray]  # of each width: (width, N_CLASSES, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """windows: (n, SIZE) classes of bytes; labels: indexes into languages."""
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    n_features = len(WIDTHS) * FILTERS
    p += [np.zeros(n_features, np.float32), rng.normal(0, 0.3, (n_features, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            n, rows, columns = len(x), np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            best, top = [], []
            for w, table in zip(WIDTHS, p, strict=False):
                sums = sum(table[j][x[:, j : SIZE - w + 1 + j]] for j in range(w))
                top.append(sums.argmax(axis=1))
                best.append(np.take_along_axis(sums, top[-1][:, None, :], axis=1)[:, 0])
            hidden = np.maximum(np.concatenate(best, axis=1) + p[-3], 0)
            scores = _softmax(hidden @ p[-2] + p[-1])
            scores[np.arange(n), y] -= 1
            scores /= n
            back = (scores @ p[-2].T) * (hidden > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(p[k])
                for j in range(w):
                    np.add.at(g[j], (x[rows, top[k] + j], np.broadcast_to(columns, (n, FILTERS))), back[:, k * FILTERS : (k + 1) * FILTERS])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ scores, scores.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                p[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[: len(WIDTHS)], *p[len(WIDTHS) :])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Scorer:
    """The network with its filters summed up over pairs of neighbouring bytes."""

    def __init__(self, network: Network) -> None:
        self.network = network
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        two, three, four = network.filters
        self.two, self.three, self.last = pair(*two), pair(three[0], three[1]), three[2]
        self.four = pair(four[0], four[1]), pair(four[2], four[3])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of (n, SIZE) windows of classes."""
        pairs = x[:, :-1] * N_CLASSES + x[:, 1:]
        best = [self.two[pairs].max(axis=1)]
        sums = self.three[pairs[:, :-1]]
        sums += self.last[x[:, 2:]]
        best.append(sums.max(axis=1))
        sums = self.four[0][pairs[:, :-2]]
        sums += self.four[1][pairs[:, 2:]]
        best.append(sums.max(axis=1))
        hidden = np.maximum(np.concatenate(best, axis=1) + self.network.bias, 0)
        return _softmax(hidden @ self.network.weight + self.network.offset)

    def texts(self, texts: pa.Array, block: int = 4096) -> np.ndarray:
        """Mean probabilities of each whole text; zeros where it has no byte."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        n = len(texts)
        at = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        length = np.diff(at)
        count = -(-length // SIZE)
        owner = np.repeat(np.arange(n), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = at[:-1][owner] + number * SIZE
        used = np.minimum(SIZE, at[1:][owner] - begin)
        total = np.zeros((n, len(self.network.languages)))
        for a in range(0, len(owner), block):
            spot = begin[a : a + block, None] + np.arange(SIZE)
            inside = np.arange(SIZE) < used[a : a + block, None]
            x = np.where(inside, CLASS[raw[np.where(inside, spot, 0)]], 0)
            np.add.at(total, owner[a : a + block], self.windows(x) * used[a : a + block, None])
        return total / np.maximum(length, 1)[:, None]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Train on a bounded sample of the labelled rows that are not held out, of every language they name."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([], [], *[np.zeros(0)] * 3)
    # by hash, about three times the bound of each language, then the bound
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 3 * DOCS_PER_LANGUAGE / counts[lang]))])[F.col("lang")]
    order = F.xxhash64("id", F.lit(SEED))
    drawn = rows.where(F.pmod(order, F.lit(1 << 30)) < part * (1 << 30))
    spots = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC)), lambda i: F.substring("text", (F.pmod(F.xxhash64("id", i), F.greatest(F.length("text") - SIZE, F.lit(0)) + 1) + 1).cast("int"), F.lit(SIZE)))
    chosen = drawn.select("lang", order.alias("o"), "id", spots.alias("parts")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "id"))).where(F.col("n") <= DOCS_PER_LANGUAGE)
    windows, labels = [], []
    for row in chosen.orderBy("lang", "o", "id").collect():
        for text in set(row["parts"]):
            raw = np.frombuffer(text.encode()[:SIZE].ljust(SIZE), dtype=np.uint8)
            windows.append(CLASS[raw])
            labels.append(languages.index(row["lang"]))
    return train(np.array(windows), np.array(labels), languages)


def _lettered(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)


def predictor(network: Network, docs: DataFrame):
    """A column function: text -> struct(lang_pred, score)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        languages = shared.value.languages
        lettered = np.array(_lettered(texts))
        if not languages:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))], ["lang_pred", "score"])
        found = Scorer(shared.value).texts(pc.fill_null(texts, ""))
        best = found.argmax(axis=1)
        names = [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        score = np.where(lettered, np.clip(found[np.arange(len(best)), best], 0, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    network = network or learn(docs, id_col, text_col, lang_col)
    predict = predictor(network, docs)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p")).select("doc_id", "held_out", "p.*")


def drop_unknown(docs: DataFrame, floor: float = 0.0, named: bool = False) -> DataFrame:
    """The documents that are in some language, with their columns: null and letterless texts go, and texts of
    which no language gets a score of ``floor`` or more. With ``named``, rows without ``lang`` get the language that was
    found. Where no row is labelled no language is known, and every text with a letter stays as it is."""
    network, found = learn(docs), unused(docs, "found")
    if not network.languages:
        ship(docs.sparkSession)
        return docs.where(F.arrow_udf(_lettered, "boolean")(F.col("text").cast("string")))
    # told not to be repeatable, so that the filter keeps behind it and each text is scored once
    predict = predictor(network, docs).asNondeterministic()
    told = F.col(f"{found}.lang_pred")
    left = docs.withColumn(found, predict(F.col("text").cast("string"))).where((told != UNKNOWN) & (F.col(f"{found}.score") >= floor))
    return left.select(*[F.coalesce(c, told).alias(n) if named and n == "lang" else c for n, c in zip(docs.columns, columns_of(docs), strict=True)])
