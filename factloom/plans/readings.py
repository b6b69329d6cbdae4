"""Registered queries of the readers of printed ratings, dates, amounts and pages, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import reading, text
from factloom.operators import extractors
from factloom.operators import pages as page_ops
from factloom.plans.catalog import ORACLES, QUERIES, query
from factloom.sources import driver_tables as src

__all__ = ["ORACLES", "QUERIES"]


def _pick(key: str, values: list[str | None]) -> str:
    """A CASE of literals that both engines read."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else src.literal(v)}" for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


RATINGS = [
    "[ICRA]AA+ (Stable); reaffirmed", "PP-MLD[ICRA]AA (Negative)", "CARE AA; Stable (28-Sep-23)", "BWR AA + /Stable", "[ICRA]A1+ withdrawn", "MLD[ICRA]A A (Stable)", "CARE A A- ; Negative",
    "[ICRA]AA (Stable", "Rating Watch with Negative Implications on BWR AA", "Reaffirmed and removed from rating Watch with Negative Implications", "[ICRA]AA- (RWD)", "Crisil AA+/Stable (Reaffirmed)",
    "Crisil PPMLD AA r/Watch Negative (Placed on watch)", "Withdrawn", "Crisil A1+ (Assigned)", "nothing rated here", None, "Rs.500 Crore Non Convertible Debentures Aggregating & (Reduced from Rs. 700 Crore)", "Long Term Bank Facilities ** Rs 1,250.50 crore #",
]
DATES = [
    "Mar-05-2024", "Feb-30-2024", "Published on March 5,  2024 and 6 April 2024", "dated 7 Sept 2023", "05/03/24", "5-3-2024", "05.03.2024", "05-Mar-2024", "5-mar-71", "05 Mar 95", "05/Mar/2024", "2024-03-05", "March 5, 2024", "Mar 5, 2024,",
    "5 March 2024", "05-March-2024", "5 Mar, 2024", "March 2024", "Mar-2024", "03/2024", "March, 2024", "Mar'24", "Mar-24", "30-Jun-28", "30-10-25", "Mar 31, 2025/ FY25", "31/02/2024", "soon", None, "13-Apr-\n24",
]
AMOUNTS = ["1,234.50", "-12", "NA", "N.A.", "-", "(1.25)", "Rs. 1,200/-", "INR (300)", "₹ 5,00,000.75", "-Rs 40", "12.5Cr", " 7 ", "", None, "1,2,3", "(abc)"]
SPANS = ["  two  words ", "a\n\n b\tc", "plain", "", None, "\n x", "tail  \n"]
SAID = ["seen 2025-09-15 by CRISIL", "from 2024-01-02 to 2024-12-31", "ISO 2024-1-2 stays", "", None, "value is unknown.", "(None) given", "nan nothing null", "CRISILX 1999-05-01x"]
KEYS = ["rating_grade|ncd|long_term|2024Q3", "rationale|CRISIL|strengths|2025Q1", "liquidity_detail|ICRA", "total_borrowings|consolidated", "rating_sensitivity|x|2024Q13"]
_N = "o_orderkey"
PHRASES = f"SELECT o_orderkey AS row_id, {_pick(_N, RATINGS)} AS rating, {_pick(_N, DATES)} AS day, {_pick(_N, AMOUNTS)} AS amount, {_pick(_N, SPANS)} AS span, {_pick(_N, SAID)} AS said, {_pick(_N, KEYS)} AS key, {_pick(_N, ['text/html; charset=UTF-8', 'text/html', None])} AS content_type FROM {{orders}}"
_P = src.duck(PHRASES)


def _phrases(spark, sf_dir):
    return src.view(spark, sf_dir, PHRASES)


def _part(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def _cap(x: str) -> str:
    return f"upper(left({x}, 1)) || lower(substr({x}, 2))"


_GRADE = r"(?:PP-MLD)?\[ICRA\]\s*(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?|BB[+-]?|B[+-]?|C|D)|CARE\s+(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?)|BWR\s+(A[1-4]\+?|A{1,3}\+?-?|BBB[+-]?)"
_WATCH = r"(?i)Rating\s+Watch\s+with\s+(Negative|Positive|Developing)\s+Implications|\((RWN|RWP|RWD)\)"
_OUTLOOK = r"(?i)\((Stable|Negative|Positive|Developing)\)|/\s*(Stable|Negative|Positive)"


def _grade_of(x: str) -> str:
    return f"coalesce({', '.join(_part(x, _GRADE, g) for g in (1, 2, 3))})"


def _watch_of(x: str) -> str:
    kind = f"coalesce({_cap(_part(x, _WATCH, 1))}, CASE upper({_part(x, _WATCH, 2)}) WHEN 'RWN' THEN 'Negative' WHEN 'RWP' THEN 'Positive' WHEN 'RWD' THEN 'Developing' END)"
    return f"CASE WHEN NOT regexp_matches({x}, '(?i)removed\\s+from\\s+(?:the\\s+)?rating\\s+watch') THEN 'Watch with ' || {kind} || ' Implications' END"


_SPLIT = "regexp_replace(rating, '([A-D])\\s+([+-])(\\s|/|$)', '\\1\\2\\3', 'g')"
for _letter in "ABCD":
    _SPLIT = f"regexp_replace({_SPLIT}, '(\\]|\\bCARE\\s|\\bBWR\\s)({_letter}{{1,3}})\\s+({_letter}{{1,2}})([+-]?(?:[\\s(;/]|$))', '\\1\\2\\3\\4', 'g')"


@query(f"""
WITH p AS (SELECT row_id, rating, {_SPLIT} AS c FROM ({_P})),
q AS (SELECT *, {_watch_of('c')} AS w, coalesce({_cap(_part('c', _OUTLOOK, 1))}, {_cap(_part('c', _OUTLOOK, 2))}) AS o FROM p),
r AS (SELECT *, CASE WHEN regexp_matches(rating, '(?i)removed\\s+(?:from\\s+)?Rating\\s+Watch') THEN NULL ELSE w END AS seen FROM q)
SELECT row_id, {_grade_of('rating')} AS grade, {_watch_of('rating')} AS watch, {_grade_of('c')} AS history_grade, seen AS history_watch, contains(lower(rating), 'withdrawn') AS withdrawn,
       coalesce(o, CASE WHEN seen IS NULL AND NOT regexp_matches(c, 'Implications') THEN coalesce({_part('c', r'\((Stable|Negative|Positive|Developing)\b', 1)}, {_part('c', r';\s*(Stable|Negative|Positive|Developing)\b', 1)}) END) AS history_outlook
FROM r""")
def rating_readings(spark, sf_dir):
    x = F.col("rating")
    rows = _phrases(spark, sf_dir).withColumn("h", reading.history_rating(x))
    return rows.select("row_id", reading.grade(x).alias("grade"), reading.watch(x).alias("watch"), F.col("h.grade").alias("history_grade"), F.col("h.watch").alias("history_watch"), "h.withdrawn", F.col("h.outlook").alias("history_outlook"))


_FULL = r"(?i)Crisil\s+(PPMLD\s+)?(A[1-4]\+?|AAA|AA|A|BBB|BB|B|C|D)([+-])?(\s+r\b)?\s*(?:/\s*(Stable|Negative|Positive|Watch\s+(?:Developing|Negative|Positive)))?(?:\s*\(([^)]*)\))?"
_VERBS = "list_filter(['reaffirmed', 'withdrawn', 'assigned', 'downgraded', 'upgraded', 'placed on', 'revised', 'confirmed', 'removed'], lambda v: contains(lower(act), v))"


@query(f"""
WITH p AS (SELECT row_id, trim(regexp_replace(rating, '\\s+', ' ', 'g')) AS x FROM ({_P})),
q AS (SELECT *, lower(x) = 'withdrawn' AS gone, {_part('x', _FULL, 5)} AS view, {_part('x', _FULL, 6)} AS act FROM p),
r AS (SELECT *, CASE WHEN gone THEN 'withdrawn' WHEN act IS NULL THEN NULL WHEN len({_VERBS}) > 0 THEN array_to_string({_VERBS}, '; ') ELSE lower(trim(act)) END AS action FROM q)
SELECT row_id, CASE WHEN NOT gone THEN upper({_part('x', _FULL, 2)}) || coalesce({_part('x', _FULL, 3)}, '') END AS grade, CASE WHEN NOT gone AND NOT starts_with(lower(view), 'watch') THEN {_cap('view')} END AS outlook,
       CASE WHEN NOT gone AND starts_with(lower(view), 'watch') THEN 'Watch with ' || {_cap("split_part(view, ' ', 2)")} || ' Implications' END AS watch, action, coalesce(contains(action, 'withdrawn'), false) AS withdrawn,
       CASE WHEN x IS NOT NULL THEN concat_ws(',', CASE WHEN NOT gone AND {_part('x', _FULL, 1)} IS NOT NULL THEN 'ppmld' END, CASE WHEN NOT gone AND {_part('x', _FULL, 4)} IS NOT NULL THEN 'legacy_r' END) END AS qualifiers
FROM r""")
def full_rating_readings(spark, sf_dir):
    rows = _phrases(spark, sf_dir).select("row_id", "rating", reading.full_rating(F.col("rating")).alias("r")).select("row_id", "rating", "r.*")
    return rows.withColumn("qualifiers", F.when(F.col("rating").isNotNull(), F.array_join("qualifiers", ","))).drop("rating")


_CLEAN = "rating"
for _p in (r"(?i)\((?:Reduced|Enhanced|Increased)\s+from\s+Rs\.?\s*[\d,.]+\s*Crore\)", r"(?i)Rs\.?\s*([\d,]+(?:\.\d+)?)\s*Crore", r"(?i)\bAggregating\b", r"(\*\*|[&^#*%])"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"


@query(f"""
SELECT row_id, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) AS name, array_to_string(regexp_extract_all(regexp_replace(rating, '\\([^)]*\\)', '', 'g'), '\\*\\*|[&^#*%]'), ' ') AS markers,
       TRY_CAST(replace(regexp_extract(rating, '(?i)Rs\\.?\\s*([\\d,]+(?:\\.\\d+)?)\\s*Crore', 1), ',', '') AS DOUBLE) AS amount FROM ({_P})""")
def instrument_cells(spark, sf_dir):
    rows = _phrases(spark, sf_dir).select("row_id", reading.instrument_cell(F.col("rating")).alias("c"))
    return rows.select("row_id", "c.name", F.array_join("c.markers", " ").alias("markers"), F.col("c.amount").cast("double").alias("amount"))


def _try(x: str, shape: str, form: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{shape}') THEN CAST(try_strptime({x}, '{form}') AS DATE) END"


_M = "(January|February|March|April|May|June|July|August|September|October|November|December)"
_M3 = "(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_FORMS = [
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "%d/%m/%y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "%d-%m-%y"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"),
    (rf"^\d{{1,2}}-{_M3}-\d{{4}}$", "%d-%b-%Y"), (rf"^\d{{1,2}}-{_M3}-\d{{2}}$", "%d-%b-%y"), (rf"^\d{{1,2}} {_M3} \d{{4}}$", "%d %b %Y"), (rf"^\d{{1,2}} {_M3} \d{{2}}$", "%d %b %y"), (rf"^\d{{1,2}}/{_M3}/\d{{4}}$", "%d/%b/%Y"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (rf"^{_M} \d{{1,2}}, \d{{4}}$", "%B %d, %Y"), (rf"^{_M3} \d{{1,2}}, \d{{4}}$", "%b %d, %Y"),
]
_MORE = [
    (rf"^\d{{1,2}} {_M} \d{{4}}$", "%d %B %Y"), (rf"^\d{{1,2}}-{_M}-\d{{4}}$", "%d-%B-%Y"), (rf"^{_M} \d{{1,2}}, \d{{4}}$", "%B %d, %Y"), (rf"^\d{{1,2}} {_M3}, \d{{4}}$", "%d %b, %Y"), (rf"^{_M} \d{{4}}$", "%B %Y"), (rf"^{_M3} \d{{4}}$", "%b %Y"),
    (rf"^{_M}-\d{{4}}$", "%B-%Y"), (rf"^{_M3}-\d{{4}}$", "%b-%Y"), (r"^\d{1,2}/\d{4}$", "%m/%Y"), (rf"^{_M}, \d{{4}}$", "%B, %Y"), (rf"^{_M3}''\d{{2}}$", "%b''%y"), (rf"^{_M3}-\d{{2}}$", "%b-%y"),
]


def _stated(x: str) -> str:
    found = f"coalesce({', '.join(_try(x, *f) for f in _FORMS)})"
    return f"CASE WHEN year({found}) BETWEEN 1990 AND 2100 THEN {found} END"


@query(f"""
WITH p AS (SELECT row_id, day, rtrim(trim(day), ',') AS t, trim(regexp_replace(day, '\\s+', ' ', 'g')) AS f FROM ({_P})),
q AS (SELECT *, rtrim(f, ',') AS ft FROM p)
SELECT row_id, {_try('day', r'^[A-Z][a-z]{2}-\d{2}-\d{4}$', '%b-%d-%Y')} AS cell,
       CASE WHEN regexp_matches(day, '{_M}\\s+\\d+,\\s+\\d{{4}}') THEN CAST(try_strptime(regexp_replace(regexp_extract(day, '{_M}\\s+\\d{{1,2}},\\s+\\d{{4}}'), '\\s+', ' ', 'g'), '%B %d, %Y') AS DATE)
            ELSE CAST(try_strptime(regexp_extract(day, '\\b(\\d{{1,2}})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+(\\d{{4}})\\b', 1) || ' ' || regexp_extract(day, '\\b(\\d{{1,2}})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+(\\d{{4}})\\b', 2)
                      || ' ' || regexp_extract(day, '\\b(\\d{{1,2}})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+(\\d{{4}})\\b', 3), '%d %b %Y') AS DATE) END AS published,
       {_stated('t')} AS stated, coalesce({_stated('ft')}, {', '.join(_try('f', *m) for m in _MORE)}) AS any_date,
       {_try("regexp_replace(day, '\\s', '', 'g')", rf'^\d{{1,2}}-{_M3}-\d{{2}}$', '%d-%b-%y')} AS annexure, {_try('day', r'^\d{1,2}-\d{1,2}-\d{2}$', '%d-%m-%y')} AS listed,
       coalesce({_try("trim(split_part(day, '/', 1))", rf'^{_M} \d{{1,2}}, \d{{4}}$', '%B %d, %Y')}, {_try("trim(split_part(day, '/', 1))", rf'^{_M3} \d{{1,2}}, \d{{4}}$', '%b %d, %Y')}) AS period,
       coalesce(year({_stated('t')}) || 'Q' || quarter({_stated('t')}), 'unknown') AS quarter
FROM q""", dates=("cell", "published", "stated", "any_date", "annexure", "listed", "period"))
def date_readings(spark, sf_dir):
    x = F.col("day")
    read = {"cell": reading.month_day_cell, "published": reading.published_date, "stated": reading.statement_date, "any_date": reading.any_date, "annexure": reading.annexure_date, "listed": reading.history_date, "period": reading.period_date}
    return _phrases(spark, sf_dir).select("row_id", *[f(x).alias(n) for n, f in read.items()], reading.quarter_key(reading.statement_date(x)).alias("quarter"))


_BARE = "regexp_replace(regexp_replace(amount, 'rs\\.?|inr|₹|/-', '', 'gi'), '\\s', '', 'g')"


@query(f"""
WITH p AS (SELECT row_id, amount, trim(amount) AS t, {_BARE} AS b FROM ({_P}))
SELECT row_id, CASE WHEN regexp_full_match(t, '-?[\\d,]+(?:\\.\\d+)?') THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) END AS plain,
       CASE WHEN starts_with(b, '-') OR (starts_with(b, '(') AND ends_with(b, ')')) THEN -1 ELSE 1 END * TRY_CAST(replace(trim(b, '()-'), ',', '') AS DOUBLE) AS priced,
       CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN -1 ELSE 1 END * TRY_CAST(replace(trim(t, '()'), ',', '') AS DOUBLE) AS bracketed FROM p""")
def amount_readings(spark, sf_dir):
    x = F.col("amount")
    return _phrases(spark, sf_dir).select("row_id", *[f(x).cast("double").alias(n) for n, f in {"plain": reading.amount, "priced": reading.amount_text, "bracketed": reading.bracket_number}.items()])


@query(f"""
WITH p AS (SELECT row_id, span, least(1, length(span)) AS a, length(span) AS b FROM ({_P}))
SELECT row_id, regexp_replace(span, '\\s+', ' ', 'g') AS view, array_to_string(list_filter(range(0, length(span)), lambda i: NOT (regexp_matches(substr(span, i + 1, 1), '\\s') AND i > 0 AND regexp_matches(substr(span, i, 1), '\\s'))), ',') AS places,
       CAST(a + length(substr(span, a + 1)) - length(ltrim(substr(span, a + 1), ' ' || chr(10) || chr(9))) AS INT) AS start, trim(substr(span, a + 1), ' ' || chr(10) || chr(9)) AS said FROM p""")
def anchored_spans(spark, sf_dir):
    rows = _phrases(spark, sf_dir).select("row_id", reading.collapsed(F.col("span")).alias("c"), reading.anchored(F.col("span"), F.least(F.lit(1), F.length("span")), F.length("span")).alias("a"))
    return rows.select("row_id", "c.view", F.array_join("c.places", ",").alias("places"), "a.start", "a.said")


_SHOWN = "said"
for _k, _m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1):
    _SHOWN = f"regexp_replace({_SHOWN}, '\\b(\\d{{4}})-{_k:02d}-(\\d{{2}})\\b', '\\2 {_m} \\1', 'g')"


@query(f"""
WITH p AS (SELECT *, list_transform(string_split(regexp_replace(lower(said), '\\s+', ' ', 'g'), ' '), lambda w: trim(w, '.,;:()[]"' || chr(39))) AS words FROM ({_P}))
SELECT row_id, regexp_replace({_SHOWN}, '\\bCRISIL\\b', 'Crisil', 'g') AS shown, list_filter(['unknown', 'null', 'none', 'undefined', 'nan'], lambda w: list_contains(words, w))[1] AS placeholder, regexp_replace(key, '\\|\\d{{4}}Q\\d$', '') AS diff_key,
       CASE split_part(key, '|', 1) WHEN 'rationale' THEN split_part(key, '|', 3) WHEN 'rating_grade' THEN 'rating' WHEN 'liquidity_detail' THEN 'liquidity' WHEN 'rating_sensitivity' THEN 'sensitivities' ELSE split_part(key, '|', 1) END AS section,
       coalesce(lower(nullif(regexp_extract(content_type, '(?i)charset\\s*=\\s*([\\w.:-]+)', 1), '')), 'utf-8') AS charset FROM p""")
def sentence_readings(spark, sf_dir):
    rows = _phrases(spark, sf_dir)
    return rows.select(
        "row_id", reading.readable(F.col("said")).alias("shown"), reading.placeholder(F.col("said")).alias("placeholder"), reading.diff_key(F.col("key")).alias("diff_key"), reading.section(F.col("key")).alias("section"), reading.charset(F.col("content_type")).alias("charset")
    )


# --- pages

SHEETS = (
    "SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 0 THEN "
    + src.literal("the standalone balance sheet is given below, as the note says\n")
    + " || repeat('prose ', CAST(900 + o_orderkey % 50 AS INT)) || "
    + src.literal("\n \n")
    + " ELSE '' END || CASE o_orderkey % 2 WHEN 0 THEN 'Consolidated' ELSE 'STANDALONE' END || "
    + src.literal(" Balance  Sheet\n(")
    + " || CASE o_orderkey % 9 WHEN 0 THEN 'nothing' WHEN 1 THEN '₹ in Lakhs' WHEN 2 THEN 'in trillions' WHEN 3 THEN 'Rs. in millions' ELSE '` in Crores' END || "
    + src.literal(")\nAs at\nMarch 31, 2024\nAs at\nMarch 31, 2023\nDebt securities\n14\n1,200.50\n")
    + " || CAST(o_orderkey % 997 AS VARCHAR(20)) || "
    + src.literal(".25\nBorrowings (other than debt securities)\n")
    + " || CAST(o_orderkey % 89 AS VARCHAR(20)) || "
    + src.literal(".10\n20.00\n")
    + " || CASE WHEN o_orderkey % 13 = 0 THEN 'Other liabilities' ELSE 'Subordinated liabilities' END || "
    + src.literal("\n16.1\n3,000.00\n2,999.99\n")
    + " AS text FROM {orders} UNION ALL SELECT -o_orderkey, 'notes to the accounts' FROM {orders}"
)
_SH = src.duck(SHEETS)
_FACTOR = "CASE scale WHEN 'crore' THEN 10000 WHEN 'lakh' THEN 100 WHEN 'million' THEN 1000 END"


@query(f"""
WITH p AS (SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'consolidated' ELSE 'standalone' END AS basis, regexp_replace(lower(nullif(regexp_extract(split_part(text, '  Sheet', 2), '(?i)\\(\\s*[`₹]?\\s*(?:Rs\\.?|INR|₹|`)?\\s*in\\s+([A-Za-z]+)\\s*\\)', 1), '')), 's$', '') AS scale, text,
                  list_transform(regexp_extract_all(text, '[\\d,]+\\.\\d\\d'), lambda x: CAST(replace(replace(x, ',', ''), '.', '') AS BIGINT)) AS n FROM ({_SH}) WHERE text <> 'notes to the accounts'),
q AS (SELECT *, {_FACTOR} AS f, CASE WHEN scale IS NULL THEN 'no unit declared' WHEN f IS NULL THEN 'unknown unit ' || scale WHEN NOT contains(text, 'Subordinated') THEN 'rows not found: Subordinated liabilities' END AS problem FROM p),
c AS (SELECT page_id, basis, problem, f, unnest(CASE WHEN problem IS NULL THEN [1, 2, 3, 4, 5, 6] ELSE [0] END) AS k, n FROM q),
d AS (SELECT *, CASE WHEN k > 0 THEN n[k] * f END AS scaled FROM c),
e AS (SELECT page_id, basis, problem, k, CAST(CASE WHEN scaled % 10000 * 2 > 10000 OR (scaled % 10000 * 2 = 10000 AND scaled // 10000 % 2 = 1) THEN scaled // 10000 + 1 ELSE scaled // 10000 END AS BIGINT) AS cents FROM d)
SELECT page_id, basis, problem, CASE WHEN k = 0 THEN NULL WHEN k % 2 = 1 THEN '2024-03-31' ELSE '2023-03-31' END AS as_of, CASE WHEN k = 0 THEN NULL WHEN k < 3 THEN 'Debt securities' WHEN k < 5 THEN 'Borrowings (other than debt securities)' ELSE 'Subordinated liabilities' END AS item, cents FROM e
UNION ALL SELECT page_id, basis, problem, CASE WHEN k % 2 = 1 THEN '2024-03-31' ELSE '2023-03-31' END, 'total', CAST(sum(cents) AS BIGINT) FROM e WHERE k > 0 GROUP BY page_id, basis, problem, k % 2""")
def balance_sheet_facts(spark, sf_dir):
    rows = extractors.balance_sheets(src.view(spark, sf_dir, SHEETS), "page_id")
    return rows.select("page_id", "basis", "problem", F.col("as_of").cast("string").alias("as_of"), "item", (F.col("amount") * 100).cast("long").alias("cents"))


CERTIFICATES = (
    "SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN "
    + src.literal("GST REG-06\nRegistration Number : 27ABCDE1234F1Z5\nConstitution of Business: Sole  Proprietorship\nDate of Liability 01/07/2017\nPeriod of Validity From : 3-Aug-2018\n")
    + " WHEN 1 THEN "
    + src.literal("Udyam Registration Certificate UDYAM-MH-12-0001234\nType of Enterprise: Micro\nDate of Udyam Registration : 31/02/2021\nDate of Commencement of Production / Business Operation : 05.04.")
    + " || CAST(2000 + c_custkey % 20 AS VARCHAR(20)) ELSE 'plain page' END AS text FROM {customer}"
)


@query(f"""
WITH p AS (SELECT page_id, c % 3 AS kind, 2000 + c % 20 AS y FROM (SELECT page_id, page_id AS c FROM ({src.duck(CERTIFICATES)})))
SELECT page_id, 'registration_number' AS field, '27ABCDE1234F1Z5' AS value, NULL AS day FROM p WHERE kind = 0 UNION ALL SELECT page_id, 'constitution', 'Sole Proprietorship', NULL FROM p WHERE kind = 0
UNION ALL SELECT page_id, 'liability_date', NULL, '2017-07-01' FROM p WHERE kind = 0 UNION ALL SELECT page_id, 'validity_from', NULL, '2018-08-03' FROM p WHERE kind = 0
UNION ALL SELECT page_id, 'registration_number', 'UDYAM-MH-12-0001234', NULL FROM p WHERE kind = 1 UNION ALL SELECT page_id, 'enterprise_type', 'Micro', NULL FROM p WHERE kind = 1
UNION ALL SELECT page_id, 'commencement_date', NULL, y || '-04-05' FROM p WHERE kind = 1""")
def registration_facts(spark, sf_dir):
    pages = src.view(spark, sf_dir, CERTIFICATES)
    gst = extractors.labelled(pages.where(F.col("text").contains("GST")), "page_id", extractors.GST)
    udyam = extractors.labelled(pages.where(F.col("text").contains("Udyam")), "page_id", extractors.UDYAM)
    return gst.unionByName(udyam).withColumn("day", F.col("day").cast("string"))


KIND_WORDS = [
    "Aadhaar of a person", "form gst reg-06", "Registration certificate", "GSTIN", "Udyam Registration", "certificate", "Computation of Total  Income", "Balance sheet", "profit & loss", "Form 26AS", "ITR-V", "Form No. 16", "section 203",
    "gross total income", "CIBIL", "credit score, date opened", "Repayment schedule", "EMI", "electricity", "consumer bill", "trade licence", "Pay slip", "net pay, earnings", "deductions", "sanction", "overdraft", "nothing", "", "Elector", "soap",
]
KIND_PAGES = (
    f"SELECT o_orderkey AS document_id, concat({_pick(_N, KIND_WORDS)}, ' ', {_pick(f'CAST(floor({_N} / 30) AS BIGINT)', KIND_WORDS)}, CASE WHEN o_orderkey % 7 = 0 THEN repeat(' filler', 300) ELSE '' END) AS text, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'My Stmt.pdf' WHEN 1 THEN 'CIBIL.pdf' WHEN 2 THEN NULL ELSE 'x.pdf' END AS filename, CAST(1 + o_orderkey % 2 AS INT) AS n_pages, o_orderkey % 31 = 0 AS has_table FROM {orders}"
)


def _says(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(f"""
WITH p AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, lower(coalesce(filename, '')) AS f FROM ({src.duck(KIND_PAGES)})),
q AS (SELECT *, CASE WHEN contains(f, 'stmt') THEN 'bank_statement' WHEN contains(f, 'cibil') THEN 'credit_report' ELSE 'other' END AS by_name,
             length(t) < 1500 AS short, {_says('form no. 16')} AND {_says('section 203')} AS sixteen FROM p)
SELECT document_id, CASE WHEN t = '' THEN by_name
  WHEN short AND {_says('aadhaar', 'elector')} THEN 'kyc' WHEN {_says('gst reg-06')} OR {_says('registration certificate')} AND {_says('gstin')} THEN 'gst_certificate' WHEN {_says('udyam registration')} AND {_says('certificate')} THEN 'udyam_certificate'
  WHEN {_says('computation of total income')} THEN 'itr_computation' WHEN {_says('balance sheet')} AND {_says('profit & loss')} THEN 'financials' WHEN {_says('form 26as')} THEN 'tax_statement' WHEN {_says('itr-v')} THEN 'itr_ack'
  WHEN sixteen AND {_says('gross total income')} THEN 'form16_part_b' WHEN sixteen THEN 'form16_part_a' WHEN {_says('cibil')} AND {_says('credit score')} AND {_says('date opened')} AND n_pages = 2 THEN 'credit_report' WHEN has_table THEN 'bank_statement'
  WHEN {_says('repayment schedule')} AND {_says('emi', 'soa', 'principal')} THEN 'loan_soa' WHEN {_says('electricity')} AND {_says('bill')} OR {_says('trade licence')} THEN 'business_proof'
  WHEN {_says('pay slip')} OR {_says('net pay, earnings')} AND {_says('deduction')} THEN 'salary_slip' WHEN {_says('sanction')} AND {_says('overdraft')} THEN 'od_sanction' WHEN {_says('sanction')} THEN 'loan_sanction' ELSE by_name END AS kind
FROM q""")
def document_kinds(spark, sf_dir):
    rows = src.view(spark, sf_dir, KIND_PAGES, ("orders", "o_orderkey", 200_000))
    return rows.select("document_id", extractors.document_kind(F.col("text"), F.col("filename"), F.col("n_pages"), F.col("has_table")).alias("kind"))


FIGURES = (
    "SELECT o_orderkey AS row_id, CASE o_orderkey % 8 WHEN 0 THEN 'NCD Series ' WHEN 1 THEN 'Subordinated NCD ' WHEN 2 THEN 'CP programme ' WHEN 3 THEN 'Cash credit ' WHEN 4 THEN 'Perpetual Bonds ' WHEN 5 THEN 'Tier II PDI ' WHEN 6 THEN 'Commercial Paper ' ELSE NULL END AS name, "
    "CASE o_orderkey % 3 WHEN 0 THEN 'A1+' WHEN 1 THEN ' A4 ' ELSE 'AA+' END AS grade, CASE o_orderkey % 5 WHEN 0 THEN 'Reaffirmed and Withdrawn' WHEN 1 THEN 'Placed on watch; upgraded' WHEN 2 THEN 'noted' WHEN 3 THEN NULL ELSE 'ASSIGNED' END AS said, "
    "CASE o_orderkey % 4 WHEN 0 THEN concat('Rs. ', CAST(o_orderkey AS VARCHAR(20)), '.505/-') WHEN 1 THEN concat('(', CAST(o_orderkey AS VARCHAR(20)), ',000)') WHEN 2 THEN 'n/a' ELSE NULL END AS quote, o_orderkey AS amount FROM {orders}"
)


@query(f"""
WITH p AS (SELECT *, lower(name) AS n FROM ({src.duck(FIGURES)})),
q AS (SELECT *, CASE WHEN contains(n, 'commercial paper') THEN 'commercial_paper' WHEN contains(n, 'subordinated ncd') THEN 'subordinated_debt' WHEN contains(n, 'perpetual bond') THEN 'perpetual_debt' WHEN contains(n, 'ncd') THEN 'ncd' WHEN contains(n, 'cash credit') THEN 'bank_facility'
                 WHEN starts_with(n, 'cp ') THEN 'commercial_paper' WHEN contains(n, ' pdi ') THEN 'perpetual_debt' ELSE 'other' END AS class FROM p)
SELECT row_id, class, CASE WHEN class = 'commercial_paper' OR trim(grade) IN ('A1+', 'A4') THEN 'short_term' ELSE 'long_term' END AS term,
       nullif(array_to_string(list_filter(['reaffirmed', 'withdrawn', 'assigned', 'upgraded', 'placed on'], lambda v: contains(lower(said), v)), '; '), '') AS verbs,
       CASE row_id % 4 WHEN 0 THEN false WHEN 1 THEN row_id * 1000 = amount WHEN 2 THEN false END AS named
FROM q""")
def figure_readings(spark, sf_dir):
    rows = src.view(spark, sf_dir, FIGURES)
    named = F.when(F.col("quote").isNotNull(), page_ops.amount_in(F.col("quote"), F.col("amount")))
    return rows.select("row_id", text.instrument_class(F.col("name")).alias("class"), text.rating_term(F.col("name"), F.col("grade")).alias("term"), text.action_verbs(F.col("said")).alias("verbs"), named.alias("named"))
