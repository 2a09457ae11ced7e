"""Secret scans that link the parts of a credential.

1. Each whole text is scanned for base findings (kinds assign, access, hex), which always stay, and
   for weak candidates: identifiers (``ident``: client, account or user ids that are assigned
   something), bare keys of 32-64 letters and digits (``bare``) and ``endpoint`` addresses. Characters
   belong to one part: a weak candidate that overlaps a base finding, or a weak one listed
   before it, is the same text seen twice and goes. So does a bare key that is part of an address.
2. A text's scopes are its paragraphs, which empty lines part. Parts of one scope are joined by
   interval: two parts meet if one starts within ``REACH`` code points of the other's start and
   they don't overlap.
3. Parts that meet are complementary if one is an identifier (access, ident) and the other a secret
   (assign, hex, bare), or if one of them is an endpoint. A weak candidate is reported only where
   complementary parts co-occur: an identifier with a secret, a bare key with an identifier or an endpoint,
   an endpoint with both an identifier and a secret.
4. ``links`` names, for each secret that met one, the nearest identifier and the nearest endpoint.

The interval join is an equi-join on stretches of ``REACH`` code points. Parts that start within a reach of each other
are few, since each kind has a least length, so pairs stay in proportion to parts; only parts, never texts, are shuffled.

Defined cases: null texts count as empty and have no parts; each input row gives one row, also where
ids repeat or are null; other columns are ignored. A job runs while the result is built.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import cut, joined_spans, sha256_hex, ship

REACH = 400
KINDS = ("assign", "access", "hex", "ident", "endpoint", "bare")
BASE = KINDS[:3]
IDENTIFIERS, SECRETS, ENDPOINTS = (1, 3), (0, 2, 5), (4,)

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?:client|account|user|tenant)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", re.IGNORECASE | re.ASCII)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,64}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?")
_ADDRESS_END = re.compile(r"[\x20\t\r\n\"'<>]")
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")


def _parts(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) of base findings and of weak candidates that are no second sight of
    other characters."""
    marked = ":" in text or "=" in text
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6] if marked else []
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of hex digits that is long enough matches from its start: shorter runs cannot be inside
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    weak = [(3, m.start(), m.end()) for m in _IDENT.finditer(text)] if marked else []
    begins, ends = [], []
    if "://" in text:
        for m in _ENDPOINT.finditer(text):
            weak.append((4, m.start(), m.end()))
            close = _ADDRESS_END.search(text, m.end())
            begins.append(m.start())
            ends.append(close.start() if close else len(text))
    for m in _BARE.finditer(text):
        s, last = m.group(), bisect_left(begins, m.end()) - 1
        if last >= 0 and ends[last] > m.start():
            continue
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
            weak.append((5, m.start(), m.end()))
    if weak:
        # stretches that are taken, disjoint and in order
        taken: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda x: x[1]):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for part in weak:
            at = bisect_left(taken, (part[1], part[1]))
            if (at < len(taken) and taken[at][0] < part[2]) or (at and taken[at - 1][1] > part[1]):
                continue
            insort(taken, part[1:])
            found.append(part)
    return found


def _scan(texts: pa.Array) -> pa.Array:
    columns: tuple[list[int], ...] = ([], [], [], [])
    offsets = [0]
    for text in texts.to_pylist():
        found = _parts(text) if text else ()
        if found:
            borders = [m.start() for m in _BLANK_LINE.finditer(text)]
            at = 0
            for k, a, b in sorted(found, key=lambda x: x[1]):
                while at < len(borders) and borders[at] < a:
                    at += 1
                for column, value in zip(columns, (k, a, b, at), strict=True):
                    column.append(value)
        offsets.append(len(columns[0]))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    fields = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["rank", "start", "end", "scope"]))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, rank, start, end, scope): a row for each part, one with nulls for a text without."""
    ship(docs.sparkSession)
    scan_texts = F.arrow_udf(_scan, "array<struct<rank int, start long, end long, scope long>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("row", "doc_id", F.explode_outer(scan_texts("text")).alias("p")).select("row", "doc_id", "p.*")


def meetings(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, rank, start, end, other_rank, other_start, other_end) of parts and complementary ones in reach, from
    the view of each of the two."""
    some = found.where("rank is not null").drop("doc_id")
    cell = F.floor(F.col("start") / reach)
    a = some.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = some.select("row", "scope", cell.alias("cell"), *[F.col(c).alias(f"other_{c}") for c in ("rank", "start", "end")])
    role = lambda rank: F.when(rank.isin(*IDENTIFIERS), 0).when(rank.isin(*SECRETS), 1).otherwise(2)
    near = F.abs(F.col("start") - F.col("other_start")) <= reach
    apart = (F.col("end") <= F.col("other_start")) | (F.col("other_end") <= F.col("start"))
    met = a.join(b, ["row", "scope", "cell"]).where(near & apart & (role(F.col("rank")) != role(F.col("other_rank"))))
    return met.select("row", "rank", "start", "end", "other_rank", "other_start", "other_end")


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Adds to parts ``linked``, whether complementary parts are in reach, and the nearest identifier, secret and
    endpoint (null or structs of gap, start, end, rank). Base findings need none to stay."""
    gap = F.greatest(F.col("other_start") - F.col("end"), F.col("start") - F.col("other_end"))
    other = F.struct(gap.alias("gap"), F.col("other_start").alias("start"), F.col("other_rank").alias("rank"), F.col("other_end").alias("end"))
    nearest = lambda ranks: F.min(F.when(F.col("other_rank").isin(*ranks), other))
    met = meetings(found, reach).groupBy("row", "rank", "start", "end").agg(nearest(IDENTIFIERS).alias("identifier"), nearest(SECRETS).alias("secret"), nearest(ENDPOINTS).alias("endpoint"))
    both = found.join(met, ["row", "rank", "start", "end"], "left")
    has = lambda c: F.col(c).isNotNull()
    rank = F.col("rank")
    need = F.when(rank.isin(*SECRETS), has("identifier") | has("endpoint")).when(rank.isin(*IDENTIFIERS), has("secret")).when(rank.isin(*ENDPOINTS), has("identifier") & has("secret"))
    return both.withColumn("linked", F.coalesce(need, F.lit(False)))


def _name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), rank + 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: doc_id, counts, base_sha256, spans, the number of linked parts, and links as
    ``secret|identifier|endpoint`` spans, comma-joined."""
    # what isn't reported loses its kind but stays a row, so that its document keeps one
    kept = link(cut(parts(docs, id_col, text_col)), reach).withColumn("rank", F.when((F.col("rank") < len(BASE)) | F.col("linked"), F.col("rank")))
    span = F.when(F.col("rank").isNotNull(), F.struct("start", "rank", "end", _name(F.col("rank")).alias("kind")))
    shown = lambda p: F.coalesce(F.concat_ws(":", _name(p["rank"]), p["start"].cast("string"), p["end"].cast("string")), F.lit(""))
    told = F.concat_ws("|", shown(F.struct("rank", "start", "end")), *[F.when(F.col(c).isNotNull(), shown(F.col(c))).otherwise("") for c in ("identifier", "endpoint")])
    per_doc = kept.groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.count_if(F.col("linked")).alias("n_linked"),
        F.array_sort(F.collect_list(span)).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("linked") & F.col("rank").isin(*SECRETS), F.struct("start", "rank", told.alias("told"))))).alias("l"),
    )
    base = F.filter("s", lambda s: s["rank"] < len(BASE))
    return per_doc.select("doc_id", *[f"n_{k}" for k in BASE], sha256_hex(joined_spans(base)).alias("base_sha256"), joined_spans(F.col("s")).alias("spans"), "n_linked", F.array_join(F.transform("l", lambda x: x["told"]), ",").alias("links"))
