"""Personal data by patterns, checksums and context, with built-in functions only.

1. A regular expression proposes spans. Its matches and the text between them, which split() gives,
   are cut from the text by the same engine; running sums of their lengths are the positions.
2. Validators confirm: the four parts of an address are at most 255, a card has 14 to 19 digits and
   passes Luhn, a phone number has 10 to 15 digits, an account number (``iban``, the method's own
   kind) leaves 1 modulo 97. What fails is dropped and not retried. Of an account number the pattern
   proposes every start with all that may follow; of its parts that end at a blank, the one of the
   country's length is tested or, where the country is not known, the longest that passes is taken.
3. Words within ``CONTEXT`` code points before and after a span adjust its score, whatever else matched
   there: a word of its own kind adds 0.15, a word that speaks of examples or order numbers takes 0.25
   away. Scores never drop a span.

Repetitions are possessive where nothing that follows could match inside them, so long runs need no
deep stack. Only matches are shuffled, never texts.

Defined cases: null texts count as empty; each input row gives one row, also where ids repeat or are
null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.common import joined_spans, sha256_hex, whole_text

CONTEXT = 40
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
PATTERNS = {
    # starts only where a run of its characters, or the search after a match, does
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the match is the first four characters; group 1 is what may follow
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))",
}
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What a text must contain before its matches are cut out; none of it leaves a valid span behind.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]{9}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
CERTAINTY = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
NEARBY = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|bic)\b",
}
AGAINST = r"(?i)\b(?:example|sample|test|version|order|invoice)\b"


#: So many signs a match has at least, what fails at once included.
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 4}
#: Fewer signs than that cannot be confirmed; no context is cut out for them.
LEAST = {"email": 5, "ip": 7, "card": 14, "phone": 11, "iban": 12}


def _cut(kind: str) -> Column:
    """Matches of one kind: array of (rank, number, gap before, match, context)."""
    text, pattern = F.col("text"), PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("gap"), matches.alias("match"))
    if kind == "iban":
        tails = F.arrays_zip(matches.alias("head"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("tail"))
        zipped = F.arrays_zip(between.alias("gap"), matches.alias("match"), F.transform(tails, lambda x: account(x["head"], x["tail"])).alias("whole"))
    reach = CONTEXT // SHORTEST[kind] + 1  # so many matches before or after a span lie within the context at most
    both = lambda p: F.concat(p["gap"], F.coalesce(p["match"], F.lit("")))

    def items(pairs: Column) -> Column:
        def item(x: Column, i: Column) -> Column:
            whole = x["whole"] if kind == "iban" else x["match"]
            ahead = F.transform(F.slice(pairs, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach))), lambda p: F.right(both(p), F.lit(CONTEXT)))
            before = F.right(F.concat(F.array_join(ahead, ""), F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
            behind = F.transform(F.slice(pairs, i + 2, F.lit(reach + (8 if kind == "iban" else 0))), lambda p: F.concat(F.left(p["gap"], F.lit(CONTEXT + 40)), F.coalesce(p["match"], F.lit(""))))
            # an account number reaches over what follows its first four signs
            after = F.substring(F.array_join(behind, ""), F.length(whole) - F.length(x["match"]) + 1, F.lit(CONTEXT))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("rank"),
                i.alias("number"),
                F.length(x["gap"]).alias("gap"),
                F.length(x["match"]).alias("step"),
                F.when(x["match"].isNotNull(), whole).alias("match"),
                F.when(F.length(whole) >= LEAST[kind], F.concat_ws(" ", before, after)).alias("context"),
            )

        return F.transform(pairs, item)

    # the pairs are bound once: an expression inside the inner function would cut the text for each of them
    found = F.get(F.transform(F.array(zipped), items), F.lit(0))
    none = F.array().cast("array<struct<rank:int,number:int,gap:int,step:int,match:string,context:string>>")
    return F.when(text.rlike(HINTS[kind]), F.filter(found, lambda x: x["match"].isNotNull())).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second one from the right counts double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1: four first characters last, letters as 10-35."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def account(head: Column, tail: Column) -> Column:
    """The account number that starts with ``head`` and ends at a blank or the end of ``tail``; empty if none passes."""
    text = F.concat(head, tail)
    size = F.coalesce(*[F.when(F.left(head, F.lit(2)).isin(lands.split()), F.lit(n)) for n, lands in IBAN_LENGTHS.items()])
    ends = F.filter(F.sequence(F.length(text), F.lit(12), F.lit(-1)), lambda i: F.substring(text, i + 1, F.lit(1)).isin("", " "))
    parts = F.transform(ends, lambda i: F.left(text, i))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    passing = F.filter(parts, lambda x: (F.length(plain(x)) == F.coalesce(size, F.greatest(F.length(plain(x)), F.lit(12)))) & mod97(plain(x)))
    return F.coalesce(F.try_element_at(passing, F.lit(1)), F.lit(""))


def _valid() -> Column:
    """Whether the match of a row is confirmed."""
    match, rank = F.col("match"), F.col("rank")
    digits = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    return (
        F.when(rank == 0, True)
        .when(rank == 1, small)
        .when(rank == 2, F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False))
        .when(rank == 3, F.length(digits).between(10, 15))
        .otherwise(match != "")
    )


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, rank, kind, start, end, score) of confirmed spans; a text without any has one
    row with nulls."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    cut = rows.select("row", "doc_id", F.explode_outer(F.concat(*[_cut(k) for k in KINDS])).alias("m")).select("row", "doc_id", "m.*")
    through = Window.partitionBy("row", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    near = F.coalesce(*[F.when(F.col("rank") == i, F.col("context").rlike(NEARBY[k])) for i, k in enumerate(KINDS)])
    score = pick(CERTAINTY[k] for k in KINDS) + F.when(near, 0.15).otherwise(0.0) - F.when(F.col("context").rlike(AGAINST), 0.25).otherwise(0.0)
    return (
        cut.repartition("row")
        .withColumn("start", F.sum((F.col("gap") + F.col("step")).cast("long")).over(through) - F.col("step"))
        .withColumns({"end": F.col("start") + size, "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2), "kind": pick(KINDS)})
        .withColumn("rank", F.when(_valid(), F.col("rank")))
        .select("row", "doc_id", "rank", "kind", "start", "end", "score")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts, base_sha256, spans, their scores in the same order, and the mean score (0 if none)."""
    span = F.when(F.col("rank").isNotNull(), F.struct("start", "rank", "end", "kind", "score"))
    per_doc = spans(docs, id_col, text_col).groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.array_sort(F.collect_list(span)).alias("s"),
        F.coalesce(F.round(F.avg(F.when(F.col("rank").isNotNull(), F.col("score"))), 4), F.lit(0.0)).alias("mean_score"),
    )
    base = F.filter("s", lambda s: s["rank"] < len(BASE))
    return per_doc.select("doc_id", *[f"n_{k}" for k in BASE], sha256_hex(joined_spans(base)).alias("base_sha256"), joined_spans(F.col("s")).alias("spans"), F.array_join(F.transform("s", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",").alias("scores"), "mean_score")
