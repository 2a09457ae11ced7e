"""URL filters: written rules, then association rules mined from labels.

1. A written rule (host and path) fits its host and all subdomains if the path starts with the rule's;
   the longest rule that fits decides.
2. For all other urls: FP-growth over the token sets of labelled pages, each with its label as one more
   item, finds combinations that go with bad pages. Rules that end in "bad" are pruned by support (of the
   labelled pages, and ``MIN_PAGES`` of them: one page is no pattern), by confidence, and by lift, which must be
   over 1. A page is bad if it is labelled toxic or of no quality.
3. Tokens that occur in exactly the same labelled pages are one item: whatever holds for one of them holds
   for all, and combinations of them would be mined over and over.
4. Matching is by an inverted index: each rule is listed under the tokens of its rarest item, a page looks up
   its tokens, and a hit counts if the page has a token of each item of the rule. Any hit blocks, otherwise the url
   is allowed. The index is broadcast up to ``BROADCAST_RULES`` rows; a larger one is joined.

Tokens: the scheme, each host label with its place from the right, each path segment with its digits
as one sign, the names of query fields, and "f" if there is a fragment.

Defined cases: a null url, or one without "://", has empty host and path, no rule and no token, and is
allowed; each input row gives one row, also where ids repeat or are null; pages that several labels
name are bad if one of them says so; without labels, or with fewer labelled
pages than ``min_pages``, nothing is mined; other columns are ignored. Jobs run while
the result is built.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import LOWER, UPPER, cut

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: What a single page has is no pattern.
MIN_PAGES = 2
BROADCAST_RULES = 10_000
BAD = "=bad"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def written_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; none for a null or one without "://"."""
    labels = F.reverse(F.split(host_of(url), r"\."))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i, F.lit(":"), x))
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    path = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    more = F.array_compact(F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))), F.when(url.contains("#"), "f")))
    return F.when(url.contains("://"), F.array_distinct(F.concat(host, path, query, more))).otherwise(F.array().cast("array<string>"))


def _items(seen: DataFrame, least: int) -> DataFrame:
    """(token, item, n) of the tokens in ``least`` pages or more of (row, t): item is the first of the tokens
    with the same pages, which their number and two exclusive ors of hashes tell."""
    spread = seen.select("row", F.explode("t").alias("token"))
    counted = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"x{i}") for i in range(2)]).where(F.col("n") >= least)
    return counted.groupBy("n", "x0", "x1").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.explode("tokens").alias("token"), F.col("tokens")[0].alias("item"), "n")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame | None:
    """(token, items, confidence, support) of the rules that end in BAD, a row for each token of the rarest item;
    items are arrays of tokens of which a page must have one each. None without labels, or with fewer labelled pages
    than any rule needs."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    known = pages.select(F.col("page_id").alias("doc_id"), tokens(F.col("url")).alias("t")).join(bad, "doc_id").where(F.size("t") > 0)
    known = cut(known.select(F.monotonically_increasing_id().alias("row"), "t", "bad"))
    n_pages = known.count()
    if not n_pages:
        return None
    least = math.ceil(max(min_support * n_pages, min_pages) - 1e-9)
    if least > n_pages:
        return None
    # at most the tokens of a page, times 1/min_support: the others are in too few pages
    items = F.broadcast(cut(_items(known, least)))
    spread = known.select("row", "bad", F.explode("t").alias("token")).join(items, "token", "left")
    baskets = spread.groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    baskets = cut(baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    # half a page less, so that no rounding of the share asks for one more
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_pages, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") > 1 + 1e-9))
    rules = cut(rules.select(F.monotonically_increasing_id().alias("rule"), "antecedent", "confidence", "support"))
    members = items.groupBy("item").agg(F.min("n").alias("n"), F.collect_list("token").alias("tokens"))
    listed = rules.select("rule", "confidence", "support", F.explode("antecedent").alias("item")).join(members, "item")
    whole = listed.groupBy("rule", "confidence", "support").agg(F.collect_list("tokens").alias("items"), F.min(F.struct("n", "item", "tokens"))["tokens"].alias("anchors"))
    return cut(whole.select(F.explode("anchors").alias("token"), "items", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, confidence of the best mined rule that fits."""
    mined = mine(pages, labels, min_support, min_confidence, min_pages)
    url = F.col("url")
    name, verdict = written_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    seen = seen.withColumns({"rule": name, "said": verdict})
    if mined is None or not (n_rows := mined.count()):
        found = seen.withColumn("confidence", F.lit(None).cast("double"))
    else:
        rows = seen.withColumns({"row": F.monotonically_increasing_id(), "t": tokens(url)}).drop("url")
        index = F.broadcast(mined) if n_rows <= BROADCAST_RULES else mined
        looked = rows.select("*", F.explode_outer("t").alias("token")).join(index, "token", "left")
        fits = F.forall("items", lambda i: F.arrays_overlap(i, F.col("t")))
        found = looked.groupBy("row", "page_id", "host", "path", "rule", "said").agg(F.max(F.when(fits, F.col("confidence"))).alias("confidence"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("confidence").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "confidence")
