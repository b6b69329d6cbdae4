"""Reading printed ratings, dates, amounts, names and places of text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text

# fixed values: how three agencies print a grade
GRADE = (
    r"(?:PP-MLD)?\[ICRA\]\s*(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?|BB[+-]?|B[+-]?|C|D)"
    r"|CARE\s+(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?)"
    r"|BWR\s+(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?)"
)
# fixed values: how a watch and its end are printed
WATCH = r"(?i)Rating\s+Watch\s+with\s+(Negative|Positive|Developing)\s+Implications|\((RWN|RWP|RWD)\)"
WATCH_ENDED = r"(?i)removed\s+from\s+(?:the\s+)?rating\s+watch"
HISTORY_WATCH_ENDED = r"(?i)removed\s+(?:from\s+)?Rating\s+Watch"
# fixed values: what a narrow column does to a grade, and outlooks printed without their usual brackets
SPACED_MODIFIER = r"(?<=[A-D])\s+([+-])(?=\s|/|$)"
SPLIT_GRADE = r"(\]|\bCARE\s|\bBWR\s)(([A-D])\3{0,2})\s+(\3{1,2})(?=[+-]?(?:[\s(;/]|$))"
OPEN_OUTLOOK = r"\((Stable|Negative|Positive|Developing)\b(?!\s+Implications)"
SEMICOLON_OUTLOOK = r";\s*(Stable|Negative|Positive|Developing)\b(?!\s+Implications)"
# fixed values: a fourth agency's rating, with its qualifiers, view and action; rated amounts and footnote markers
FULL_RATING = (
    r"(?i)Crisil\s+(PPMLD\s+)?(A[1-4]\+?|AAA|AA|A|BBB|BB|B|C|D)([+-])?(\s+r\b)?\s*"
    r"(?:/\s*(Stable|Negative|Positive|Watch\s+(?:Developing|Negative|Positive)))?(?:\s*\(([^)]*)\))?"
)
RATED_AMOUNT = r"(?i)Rs\.?\s*([\d,]+(?:\.\d+)?)\s*Crore"
CHANGED_AMOUNT = r"(?i)\((?:Reduced|Enhanced|Increased)\s+from\s+Rs\.?\s*[\d,.]+\s*Crore\)"
MARKER = r"(\*\*|[&^#*%])"
# fixed values: quarter suffixes of keys, and the section of a report that a key belongs to
QUARTER_SUFFIX = r"\|\d{4}Q\d$"
SECTIONS = {
    "liquidity_assessment": "liquidity",
    "liquidity_detail": "liquidity",
    "rating_grade": "rating",
    "rating_outlook": "rating",
    "rating_watch": "rating",
    "rating_sensitivity": "sensitivities",
}
# fixed values: what an instrument class is called where the printed name is generic; publishers by their own spelling
CLASS_NAMES = {
    "ncd": "debentures",
    "subordinated_debt": "subordinated debt",
    "perpetual_debt": "perpetual debt",
    "bank_facility": "bank facilities",
    "mld": "market-linked debentures",
    "commercial_paper": "commercial paper",
    "debt_securities": "debt securities",
}
PUBLISHERS = {"CRISIL": "Crisil"}
# fixed values: the order in which verbs are told
VERBS = ["downgraded", "upgraded", "reaffirmed", "assigned", "placed on", "revised", "removed", "withdrawn"]

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _group(x: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null if it takes no part."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


# --- ratings


def grade(x: Column) -> Column:
    return F.coalesce(*[_group(x, GRADE, g) for g in (1, 2, 3)])


def watch(x: Column) -> Column:
    """The watch that a text places a rating on, not one that it ends."""
    short = F.upper(_group(x, WATCH, 2))
    kind = F.coalesce(F.initcap(_group(x, WATCH, 1)), F.when(short == "RWN", "Negative").when(short == "RWP", "Positive").when(short == "RWD", "Developing"))
    return F.when(~x.rlike(WATCH_ENDED) & kind.isNotNull(), F.concat(F.lit("Watch with "), kind, F.lit(" Implications")))


def history_rating(x: Column) -> Column:
    """Grade, outlook, watch and withdrawal of one cell of a rating history, with what a narrow column breaks put together."""
    compact = F.regexp_replace(F.regexp_replace(x, SPACED_MODIFIER, "$1"), SPLIT_GRADE, "$1$2$4")
    seen = F.when(~x.rlike(HISTORY_WATCH_ENDED), watch(compact))
    plain = text.outlook(compact)
    loose = F.when(seen.isNull(), F.initcap(F.coalesce(_group(compact, OPEN_OUTLOOK, 1), _group(compact, SEMICOLON_OUTLOOK, 1))))
    return F.struct(grade(compact).alias("grade"), F.coalesce(plain, loose).alias("outlook"), seen.alias("watch"), F.lower(x).contains("withdrawn").alias("withdrawn"))


def full_rating(x: Column) -> Column:
    """Grade, outlook, watch, action, withdrawal and qualifiers of a rating that is printed in one line."""
    line = flat(x)
    part = lambda g: _group(line, FULL_RATING, g)
    gone = F.lower(line) == "withdrawn"
    view = part(5)
    on_watch = F.lower(view).startswith("watch")
    action = F.when(gone, "withdrawn").otherwise(F.coalesce(text.action_verbs(part(6)), F.lower(F.trim(part(6)))))
    marks = F.array_compact(F.array(F.when(part(1).isNotNull(), "ppmld"), F.when(part(4).isNotNull(), "legacy_r")))
    return F.struct(
        F.when(~gone, F.concat(F.upper(part(2)), F.coalesce(part(3), F.lit("")))).alias("grade"),
        F.when(~gone & ~on_watch, F.initcap(view)).alias("outlook"),
        F.when(~gone & on_watch, F.concat(F.lit("Watch with "), F.initcap(F.regexp_extract(view, r"(\S+)$", 1)), F.lit(" Implications"))).alias("watch"),
        action.alias("action"),
        F.coalesce(action.contains("withdrawn"), F.lit(False)).alias("withdrawn"),
        F.when(gone, F.array().cast("array<string>")).otherwise(marks).alias("qualifiers"),
    )


def instrument_cell(x: Column) -> Column:
    """Name, footnote markers and rated amount (in crore) of an instrument's cell."""
    line = flat(x)
    name = line
    for pattern in (CHANGED_AMOUNT, RATED_AMOUNT, r"(?i)\bAggregating\b", MARKER):
        name = F.regexp_replace(name, pattern, "")
    marks = F.regexp_extract_all(F.regexp_replace(line, r"\([^)]*\)", ""), F.lit(MARKER), F.lit(1))
    amount = F.regexp_replace(F.regexp_extract(line, RATED_AMOUNT, 1), ",", "").try_cast("decimal(20,2)")
    return F.struct(flat(name).alias("name"), marks.alias("markers"), amount.alias("amount"))


# --- dates


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _read(x: Column, *forms: tuple[str, str]) -> Column:
    """The date that the first fitting form gives as year/month/day; a month may be named, years of two digits from 69 on are of the last century."""

    def day_of(parts: Column) -> Column:
        year, month, day = (F.get(parts, F.lit(k)) for k in range(3))
        at = F.instr(F.lit(_MONTHS), F.lower(F.left(month, F.lit(3))))
        number = F.when(month.rlike("^[0-9]"), month).otherwise(F.floor((at + 2) / 3).cast("string"))
        whole = F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)
        return F.try_to_date(F.concat_ws("-", whole, number, day), "yyyy-M-d")

    told = _bound(x, lambda v: F.coalesce(*[F.when(v.rlike(p), F.regexp_replace(v, p, t)) for p, t in forms]))
    return _bound(F.split(told, "/"), day_of)


def month_day_cell(x: Column) -> Column:
    """Mon-DD-YYYY."""
    return _read(F.trim(x), (rf"^({_SHORT})-(\d{{2}})-(\d{{4}})$", "$3/$1/$2"))


def published_date(x: Column) -> Column:
    """The first "Month D, YYYY" of a text, else its first "D Mon YYYY"."""
    long, short = rf"\b({_LONG})\s+(\d{{1,2}}),\s+(\d{{4}})\b", rf"\b(\d{{1,2}})\s+({_SHORT})[a-z]*\s+(\d{{4}})\b"
    said = F.coalesce(_group(x, long, 0), _group(x, short, 0))
    return _read(said, (f"^{long}$", "$3/$1/$2"), (f"^{short}$", "$3/$2/$1"))


def quarter_key(d: Column) -> Column:
    return F.coalesce(F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")), F.lit("unknown"))


def statement_date(x: Column) -> Column:
    """A date as statements print it, in one of thirteen forms; years from 1990 to 2100."""
    found = _read(
        F.rtrim(F.trim(x), F.lit(",")),
        (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", "$4/$3/$1"),
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3/$2/$1"),
        (rf"(?i)^(\d{{1,2}})([ -])({_SHORT})\2(\d{{4}}|\d{{2}})$", "$4/$3/$1"),
        (rf"(?i)^(\d{{1,2}})/({_SHORT})/(\d{{4}})$", "$3/$2/$1"),
        (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1/$2/$3"),
        (rf"(?i)^({_LONG}|{_SHORT}) (\d{{1,2}}), (\d{{4}})$", "$3/$1/$2"),
    )
    return _bound(found, lambda d: F.when(F.year(d).between(1990, 2100), d))


def any_date(x: Column) -> Column:
    """A statement date, one with the month's whole name, or a month alone, which is its first day."""
    other = _read(
        flat(x),
        (rf"(?i)^(\d{{1,2}})([ -])({_LONG})\2(\d{{4}})$", "$4/$3/$1"),
        (rf"(?i)^({_LONG}) (\d{{1,2}}), (\d{{4}})$", "$3/$1/$2"),
        (rf"(?i)^(\d{{1,2}}) ({_SHORT}), (\d{{4}})$", "$3/$2/$1"),
        (rf"(?i)^({_LONG}|{_SHORT})[ -](\d{{4}})$", "$2/$1/1"),
        (r"^(\d{1,2})/(\d{4})$", "$2/$1/1"),
        (rf"(?i)^({_LONG}), (\d{{4}})$", "$2/$1/1"),
        (rf"(?i)^({_SHORT})['-](\d{{2}})$", "$2/$1/1"),
    )
    return F.coalesce(statement_date(flat(x)), other)


def annexure_date(x: Column) -> Column:
    """30-Jun-28, also where the cell breaks it over lines."""
    return _read(F.regexp_replace(x, r"(?U)\s+", ""), (rf"(?i)^(\d{{1,2}})-({_SHORT})-(\d{{2}})$", "$3/$2/$1"))


def history_date(x: Column) -> Column:
    """30-10-25."""
    return _read(F.trim(x), (r"^(\d{1,2})-(\d{1,2})-(\d{2})$", "$3/$2/$1"))


def period_date(x: Column) -> Column:
    """December 31, 2025, or Mar 31, 2025/ FY25."""
    return _read(F.trim(F.split(x, "/")[0]), (rf"(?i)^({_LONG}|{_SHORT}) (\d{{1,2}}), (\d{{4}})$", "$3/$1/$2"))


# --- amounts


def amount(x: Column) -> Column:
    """Digits with commas and perhaps a minus; anything else is null."""
    t = F.trim(x)
    return F.when(t.rlike(r"^-?[\d,]+(?:\.\d+)?$"), F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(38,6)"))


def amount_text(x: Column) -> Column:
    """An amount with a currency; brackets or a leading minus make it negative."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?i)rs\.?|inr|₹|/-", ""), r"\s", "")
    value = F.regexp_replace(F.regexp_replace(t, r"^[()-]+|[()-]+$", ""), ",", "").try_cast("decimal(38,6)")
    return F.when(t.startswith("-") | (t.startswith("(") & t.endswith(")")), -value).otherwise(value)


def bracket_number(x: Column) -> Column:
    """A number whose brackets make it negative, with all its decimals."""
    t = F.regexp_replace(F.trim(x), ",", "")
    value = F.regexp_replace(t, r"^[()]+|[()]+$", "").try_cast("decimal(38,6)")
    return F.when(t.startswith("(") & t.endswith(")"), -value).otherwise(value)


# --- places of text


def collapsed(x: Column) -> Column:
    """The text with each run of white space as one space (view), and for each of its characters the place it came from (places)."""
    letters = F.filter(F.split(x, ""), lambda c: c != "")
    blank = F.transform(letters, lambda c: c.rlike(r"(?U)^\s$"))
    marked = F.transform(blank, lambda b, i: F.struct(i.alias("i"), (b & F.coalesce(F.get(blank, i - 1), F.lit(False))).alias("drop")))
    return F.struct(F.regexp_replace(x, r"(?U)\s+", " ").alias("view"), F.transform(F.filter(marked, lambda m: ~m["drop"]), lambda m: m["i"]).alias("places"))


def anchored(x: Column, start: Column, stop: Column) -> Column:
    """The span without the white space at its ends: start, stop and text."""
    raw = F.substring(x, start + 1, stop - start)
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    kept = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    begin = start + left
    return F.struct(begin.cast("int").alias("start"), (begin + F.length(kept)).cast("int").alias("stop"), kept.alias("said"))


# --- names and sentences


def readable(x: Column) -> Column:
    """ISO dates as "15 Sep 2025" and publishers as they write themselves, in sentences of our own."""
    out = x
    for k in range(12):
        name = _SHORT.split("|")[k]
        out = F.regexp_replace(out, rf"\b(\d{{4}})-{k + 1:02d}-(\d{{2}})\b", f"$2 {name} $1")
    for stored, printed in PUBLISHERS.items():
        out = F.regexp_replace(out, rf"\b{stored}\b", printed)
    return out


def named_instrument(name: Column, kind: Column) -> Column:
    """The printed name, repeated words once; a generic one with what its class is called."""
    shown = text.display_name(flat(name))
    classes = F.create_map(*[F.lit(v) for pair in CLASS_NAMES.items() for v in pair])
    label = F.try_element_at(classes, kind)
    return F.when(shown.rlike(r"(?i)^(long|short)[ -]term instruments?$") & label.isNotNull(), F.concat(shown, F.lit(" ("), label, F.lit(")"))).otherwise(shown)


def action_sentence(action: Column, rating: Column, outlook: Column, watched: Column, previous: Column) -> Column:
    """A stored list of verbs as a sentence, in the order of VERBS."""
    verbs = F.filter(F.transform(F.split(F.coalesce(action, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")
    has = lambda v: F.array_contains(verbs, v)
    graded = has("downgraded") | has("upgraded")
    moved = lambda v: F.concat(F.lit(f"{v} to "), F.coalesce(rating, F.lit("None")), F.coalesce(F.concat(F.lit(" from "), previous), F.lit("")))
    revised = F.when(watched.isNotNull(), F.concat(F.lit("watch revised to "), F.regexp_replace(F.lower(watched), r"^watch with ", ""))).otherwise(
        F.coalesce(F.concat(F.lit("outlook revised to "), outlook), F.lit("revised"))
    )
    told = {
        "downgraded": moved("downgraded"),
        "upgraded": moved("upgraded"),
        "reaffirmed": F.coalesce(F.concat(F.lit("reaffirmed at "), rating), F.lit("reaffirmed")),
        "assigned": F.when(~graded, F.coalesce(F.concat(F.lit("assigned "), rating), F.lit("assigned"))),
        "placed on": F.coalesce(F.concat(F.lit("placed on "), F.lower(watched)), F.lit("placed on")),
        "revised": revised,
        "removed": F.lit("removed from watch"),
        "withdrawn": F.lit("withdrawn"),
    }
    parts = [F.when(has(v), told[v]) for v in VERBS] + [F.when(graded & has("assigned"), F.concat(outlook, F.lit(" outlook assigned")))]
    said = F.array_compact(F.array(*parts))
    with_outlook = outlook.isNotNull() & ~graded & ~F.exists(said, lambda p: p.contains("outlook")) & ~has("withdrawn")
    tail = F.when(with_outlook, F.concat(F.lit("/"), outlook)).otherwise(F.lit(""))
    first = F.concat(F.get(said, F.lit(0)), tail)
    rest = F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0)))
    rated = F.concat(F.lit("rated "), rating, F.coalesce(F.concat(F.lit("/"), outlook), F.lit("")))
    return F.when(F.size(said) == 0, F.coalesce(rated, F.lit("no action stated"))).otherwise(F.array_join(F.concat(F.array(first), rest), ", "))


def diff_key(key: Column) -> Column:
    return F.regexp_replace(key, QUARTER_SUFFIX, "")


def section(key: Column) -> Column:
    head = F.split(key, r"\|")[0]
    names = F.create_map(*[F.lit(v) for pair in SECTIONS.items() for v in pair])
    return F.when(head == "rationale", F.get(F.split(key, r"\|"), F.lit(2))).otherwise(F.coalesce(F.try_element_at(names, head), head))


def window_text(start: Column, end: Column) -> Column:
    return F.concat(F.lit("from "), start.cast("string"), F.coalesce(F.concat(F.lit(" to "), end.cast("string")), F.lit(" (still in force)")))


def charset(content_type: Column) -> Column:
    return F.coalesce(F.lower(_group(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)), F.lit("utf-8"))


def capped(policy: Column, x: Column) -> Column:
    """A text as its publisher lets it be shown: a short excerpt under quote_and_link, else whole."""
    return F.when(policy == "quote_and_link", text.excerpt(x)).otherwise(x)


def placeholder(x: Column) -> Column:
    """The first word that stands for "not known", which no reader may see as a fact."""
    # fixed values: such words, in the order in which they are looked for
    words = ["unknown", "null", "none", "undefined", "nan"]
    said = F.transform(F.split(F.lower(x), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:()\[\]"']+|[.,;:()\[\]"']+$""", ""))
    return F.get(F.array_intersect(F.array(*map(F.lit, words)), said), F.lit(0))
