"""Packing into optimal length buckets.

1. One aggregation gives the histogram of token counts over all documents, each length by itself. Of
   texts of n bytes together it has fewer than sqrt(n) + 2 rows, since a token takes two bytes with its blank.
2. A dynamic program over the histogram chooses the bucket capacities that minimise padding; with
   the lower hull of lines it takes a number of steps in proportion to buckets times lengths.
3. Each document goes to the smallest bucket that holds it. Buckets are dealt by hash into parts of
   bounded size, and within each part documents, sorted by length, fill batches of
   ``budget // capacity`` documents. A document longer than the budget is a batch of its own.

A token is a run of characters that are not blank (`[^\\x20\\x09-\\x0D]+`), unless a token column is given.

Defined cases: null and empty texts have no token and go to the first bucket; a given count that is null or
negative is 0; ties are ordered by id;
repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.common import whole_text

BUCKETS, BUDGET = 16, 16384
ROWS_PER_PART = 20_000


def tokens() -> Column:
    return F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_capacities(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Capacities of at most ``buckets`` buckets with the least padding for (length, count) pairs.

    Cost of a bucket (i, j]: length_j * (N_j - N_i) - (S_j - S_i) with counts N and tokens S up to
    a length. The best i for each j is found on the lower hull of the lines x -> cost_i - N_i * x.
    Of equal costs the plan with fewer buckets wins.
    """
    lengths = [n for n, _ in histogram]
    number, total = [0], [0]
    for n, c in histogram:
        number.append(number[-1] + c)
        total.append(total[-1] + n * c)
    size = len(lengths)
    if not size:
        return []
    cost = [0, *[lengths[j - 1] * number[j] - total[j] for j in range(1, size + 1)]]
    chosen = [[0] * (size + 1)]
    best, n_best = cost[size], 1
    for k in range(2, min(buckets, size) + 1):
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), slopes falling
        new, from_ = [0] * (size + 1), [0] * (size + 1)
        head = 0
        for j in range(k, size + 1):
            i = j - 1
            line = (-number[i], cost[i] + total[i], i)
            while len(hull) - head >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, intercept, i = hull[head]
            new[j], from_[j] = slope * x + intercept + x * number[j] - total[j], i
        for j in range(1, k):
            new[j] = cost[j] if j < k - 1 else 0  # as many buckets as lengths: no padding
        chosen.append(from_)
        cost = new
        if cost[size] < best:
            best, n_best = cost[size], k
    ends, j = [], size
    for k in range(n_best, 0, -1):
        ends.append(lengths[j - 1])
        j = chosen[k - 1][j] if k > 1 else 0
    return ends[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", n_tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, capacity, batch, slot, padding."""
    given = tokens() if n_tokens is None else F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), given.alias("n_tokens"))
    table = rows.groupBy(F.col("n_tokens").alias("n")).count().orderBy("n").collect()
    capacities = optimal_capacities([(r["n"], r["count"]) for r in table], buckets)
    if not capacities:
        return rows.select("doc_id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("capacity", "long"), ("batch", "string"), ("slot", "long"), ("padding", "long"))])
    held = [sum(r["count"] for r in table if low < r["n"] <= high) for low, high in zip([-1, *capacities[:-1]], capacities, strict=True)]

    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= c, i) for i, c in enumerate(capacities)])
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    per_batch = [max(1, budget // max(c, 1)) for c in capacities]
    parts = [-(-n // max(ROWS_PER_PART, 100 * b)) or 1 for n, b in zip(held, per_batch, strict=True)]
    # null ids are dealt by their place in the input, which is the same whenever a task runs again
    dealt = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    placed = rows.withColumn("dealt", dealt).withColumn("bucket", bucket).withColumns({"capacity": of(capacities), "per_batch": of(per_batch), "part": F.pmod("dealt", of(parts))})
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id")).cast("long") - 1
    return placed.withColumn("place", place).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "capacity",
        F.concat_ws("-", "bucket", "part", F.floor(F.col("place") / F.col("per_batch"))).alias("batch"),
        F.pmod("place", "per_batch").alias("slot"),
        (F.col("capacity") - F.col("n_tokens")).alias("padding"),
    )
