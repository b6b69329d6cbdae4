"""Scalar functions on names, ratings, amounts and dates, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: wordings of instruments and their class, the first that occurs decides
INSTRUMENT_TYPES = [
    ("commercial paper", "commercial_paper"),
    ("subordinated ncd", "subordinated_debt"),
    ("perpetual bond", "perpetual_debt"),
    ("subordinated debt", "subordinated_debt"),
    ("subordinate debt", "subordinated_debt"),
    ("subordinated bond", "subordinated_debt"),
    ("subordinated liabilities", "subordinated_debt"),
    ("perpetual debt", "perpetual_debt"),
    ("bank lines", "bank_facility"),
    ("bank facilities", "bank_facility"),
    ("bank loan", "bank_facility"),
    ("market linked debenture", "mld"),
    ("equity linked debenture", "mld"),
    ("debt securities", "debt_securities"),
    ("borrowings (other than debt securities)", "bank_facility"),
    ("debenture", "ncd"),
    ("ncd", "ncd"),
    ("fund based", "bank_facility"),
    ("fund-based", "bank_facility"),
    ("term loan", "bank_facility"),
    ("working capital demand loan", "bank_facility"),
    ("cash credit", "bank_facility"),
]
# fixed values: abbreviations that count as whole words only
INSTRUMENT_WORDS = [("cp", "commercial_paper"), ("pdis?", "perpetual_debt")]
# fixed values: the verbs of an action, in the order they are named
ACTION_WORDS = ["reaffirmed", "withdrawn", "assigned", "downgraded", "upgraded", "placed on", "revised", "confirmed", "removed"]


def normalise(x: Column) -> Column:
    """White space collapsed, lower case; empty is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit(""))


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    chain = reduce(lambda made, c: made.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
    return chain.otherwise(default)


def instrument_class(name: Column) -> Column:
    low = F.lower(name)
    cases = [(low.contains(text), F.lit(kind)) for text, kind in INSTRUMENT_TYPES]
    cases += [(low.rlike(rf"\b{word}\b"), F.lit(kind)) for word, kind in INSTRUMENT_WORDS]
    return first_match(cases, F.lit("other"))


def rating_term(name: Column, grade: Column) -> Column:
    short = (instrument_class(name) == "commercial_paper") | F.coalesce(F.trim(grade).rlike(r"^A[1-4]\+?$"), F.lit(False))
    return F.when(short, "short_term").otherwise("long_term")


def action_verbs(text: Column) -> Column:
    found = F.filter(F.array(*map(F.lit, ACTION_WORDS)), lambda v: F.lower(text).contains(v))
    return F.nullif(F.array_join(found, "; "), F.lit(""))


def is_withdrawal(action: Column) -> Column:
    return F.coalesce(F.lower(action).contains("withdrawn"), F.lit(False))


def outlook(text: Column) -> Column:
    m = F.regexp_extract(text, r"(?i)\((Stable|Negative|Positive|Developing)\)|/\s*(Stable|Negative|Positive)", 1)
    n = F.regexp_extract(text, r"(?i)\((Stable|Negative|Positive|Developing)\)|/\s*(Stable|Negative|Positive)", 2)
    return F.initcap(F.coalesce(F.nullif(m, F.lit("")), F.nullif(n, F.lit(""))))


def number(text: Column) -> Column:
    """Amounts with commas; brackets or a leading minus make them negative; no number is null."""
    plain = F.regexp_replace(F.trim(text), r"[,()₹\s]|Rs\.?|INR", "")
    value = plain.try_cast("decimal(38,6)")
    return F.when(F.trim(text).rlike(r"^\(.*\)$"), -value).otherwise(value)


def excerpt(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut at the last space before `most` characters, with an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(most)), r" [^ ]*$", ""), F.lit("…")))


def statement_date(text: Column) -> Column:
    formats = ["dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "dd/MM/yy"]
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])


def signature(narration: Column) -> Column:
    """The first four words of two or more letters that name no channel."""
    words = F.filter(F.regexp_extract_all(F.upper(narration), F.lit(r"[A-Z]{2,}"), F.lit(0)), lambda w: ~w.isin("UPI", "IMPS", "NEFT"))
    return F.array_join(F.slice(words, 1, 4), " ")


def text_fragment(url: Column, quote: Column) -> Column:
    """A link to the quoted words: all of them up to eight, else the first and the last four; an old fragment is dropped."""
    words = F.filter(F.split(F.trim(F.regexp_replace(quote, r"(?U)\s+", " ")), " "), lambda w: w != "")
    ends = F.array(F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)), " "))
    parts = F.when(F.size(words) <= 8, F.array(F.array_join(words, " "))).otherwise(ends)
    coded = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.url_encode(p), r"\+", "%20"), "-", "%2D"))
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#:~:text="), F.array_join(coded, ","))


def display_name(name: Column) -> Column:
    """Groups of words that are said twice running are said once."""
    return F.regexp_replace(name, r"(?i)\b(\w+(?:[ -]\w+)*)(?:\s+\1\b)+", "$1")


def money(text: Column) -> Column:
    """An amount with exactly two decimals; a minus or Dr makes it negative; all else is null."""
    shape = r"^(-?)([\d,]+\.\d{2})\s*(?i:(dr|cr)\.?)?$"
    value = F.regexp_replace(F.regexp_extract(F.trim(text), shape, 2), ",", "").try_cast("decimal(20,2)")
    negative = (F.regexp_extract(F.trim(text), shape, 1) == "-") | (F.lower(F.regexp_extract(F.trim(text), shape, 3)) == "dr")
    return F.when(negative, -value).otherwise(value)


def fiscal_end(token: Column) -> Column:
    """The last day of a fiscal year that ends in March, or of its quarter: FY24, Q2FY25."""
    shape = r"^(?:Q([1-4]))?\s*FY\s*(\d{2})$"
    quarter, year = (F.regexp_extract(F.upper(F.trim(token)), shape, g).try_cast("int") for g in (1, 2))
    months = 3 * (4 - F.coalesce(quarter, F.lit(4)))
    return F.last_day(F.add_months(F.make_date(2000 + year, F.lit(3), F.lit(1)), -months))


def masked_account(number: Column) -> Column:
    digits = F.regexp_replace(number, r"\D", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("XX"), F.right(digits, F.lit(4))))
