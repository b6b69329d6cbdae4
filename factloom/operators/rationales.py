"""Rating rationales in HTML: tables known by their shape, read into claims with the text units that state them.

Input: units (document_id, unit_no, node_path, tag, text) as pages.html_units gives
them, every step of a path numbered among its like-named siblings. A table is
recognised by what its rows look like, never by its place on the page, and a row
that cannot be read is reported, not dropped. Everything is grouping by
(document, table, row) and joins inside a document.

Defined results: a document without a kind of table gives no rows of that kind;
of two cells at one place (two bodies of a table) the later counts; null and
empty cells read as empty text; dates, amounts and units that do not read leave
the row out of the claims and into `unreadable` where its kind requires them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading, text

# fixed values: shapes of the tables, footnote markers, what they mean, units of indicators, headings
CELL = r"^(.*/table\[\d+\])/(?:tbody\[\d+\]/)?tr\[(\d+)\]/td\[(\d+)\]$"
RATED = r"(?i)Crisil\s+(?:PPMLD\s+)?(?:A[1-4]\+?|AAA|AA|A|BBB|BB|B|C|D)"
MARKER, FOOTNOTE = r"(\*\*|[&^#*%])", r"(\*\*|[&^#*%])\s*([A-Za-z][^&^#*%]*)"
QUALIFIERS = [("secured and subordinated", "interchangeable_subordinated"), ("secured", "secured"), ("retail", "retail"), ("not yet issued", "not_yet_issued"), ("short-term bank loan", "interchangeable_short_term")]
UNITS = {"rs crore": "INR_CRORE", "%": "PERCENT", "times": "TIMES"}
LENDER_HEAD = ["Facility", "Amount (Rs.Crore)", "Name of Lender"]
ADJUSTED = r"(?i)Key financial indicators.*\((consolidated|standalone);[^)]*adjusted"
OUTLOOK, LIQUIDITY = r"(?i)^Outlook:?\s+(Stable|Negative|Positive|Developing)$", r"(?i)^Liquidity:?\s+(Superior|Strong|Adequate|Stretched|Poor)$"
DRIVERS = {"Key Rating Drivers - Strengths": "strengths", "Key Rating Drivers - Weaknesses": "weaknesses"}
FACTORS = {"Upward factors:": "positive", "Downward factors:": "negative"}
UPDATED = r"This RR was updated on ([A-Z][a-z]+ \d{1,2}, \d{4})"
# fixed values: units after a table in which its footnotes stand, units from the top in which the date stands, the length of a narrative, of a headline, and where that is looked for
NOTES, TOP, NARRATIVE, HEADLINE, NEAR = 8, 40, 60, 200, 3

# fixed values: one bit for each thing that a rationale must give, by what is said without it, and one for the document itself
GIVEN = {"no rating-action table": 1, "no instrument annexure": 2, "no rating history entries": 4, "no outlook": 8}
DOCUMENT = 16

DOC, TABLE, ROW = ["document_id"], ["document_id", "table_path"], ["document_id", "table_path", "row_no"]


def placed(units: DataFrame, counted: bool = False) -> DataFrame:
    """units with at (their number from 1) and said (white space collapsed). counted: each document's unit_no are 0, 1, 2 and so on, as html_units gives them, so that none has to be sorted or shuffled."""
    at = F.col("unit_no") + 1 if counted else F.row_number().over(Window.partitionBy(*DOC).orderBy("unit_no"))
    return units.select(*DOC, at.alias("at"), "node_path", F.coalesce(reading.flat(F.col("text")), F.lit("")).alias("said"))


def grid_rows(units: DataFrame) -> DataFrame:
    """One row a table row: cells (col, said, at) from the left, and the first row's number and cells (head). units: placed."""
    # the path's last two steps, cut off one after the other: cheaper than a pattern over the whole path for each part
    path = F.col("node_path")
    column, row = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    number = lambda step: F.regexp_extract(step, r"(\d+)", 1).cast("int")
    table = F.regexp_replace(F.left(path, F.length(path) - F.length(column) - F.length(row) - 2), r"/tbody\[\d+\]$", "")
    cells = units.where(path.endswith("]") & column.startswith("td[")).where(path.rlike(CELL)).select(*DOC, table.alias("table_path"), number(row).alias("row_no"), number(column).alias("col"), "said", "at")
    # of the cells at one place the last counts: they are gathered once and sorted by column and place
    rows = cells.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("col", "at", "said"))).alias("c"))
    last = F.filter("c", lambda x, i: ~F.coalesce(F.get("c", i + 1)["col"] == x["col"], F.lit(False)))
    rows = rows.select(*ROW, F.transform(last, lambda x: F.struct(x["col"].alias("col"), x["said"].alias("said"), x["at"].alias("at"))).alias("cells"))
    whole = Window.partitionBy(*TABLE)
    return rows.withColumn("head", F.min(F.struct("row_no", "cells")).over(whole))


def cell(k: int, cells: str = "cells") -> Column:
    return F.try_element_at(F.filter(F.col(cells), lambda c: c["col"] == k), F.lit(1))


def said(k: int, cells: str = "cells") -> Column:
    return F.coalesce(cell(k, cells)["said"], F.lit(""))


def _has(*columns: int) -> Column:
    return reduce(Column.__and__, [cell(k).isNotNull() for k in columns])


def shapes(rows: DataFrame) -> DataFrame:
    """rows with what kinds of table theirs is: is_action, is_bank, is_annexure, is_history, is_indicators, is_lenders."""
    whole = Window.partitionBy(*TABLE)
    every = lambda c: F.min(c.cast("int")).over(whole) == 1
    some = lambda c: F.max(c.cast("int")).over(whole) == 1
    # what the first cells say is looked up once
    told = rows.withColumns({"__1": said(1), "__2": said(2), "__3": said(3), "__top": F.transform("head.cells", lambda c: c["said"]), "__columns": F.transform("cells", lambda c: c["col"])})
    one, top = F.col("__1"), F.col("__top")
    # two columns and an amount on every row, a rating on some: one rating that does not read must not hide the table
    action = every((F.col("__columns") == F.array(F.lit(1), F.lit(2))) & F.lower(one).contains("crore")) & some(F.col("__2").rlike(RATED))
    bank = some(one.startswith("Total Bank Loan Facilities")) & some(one.startswith("Long Term Rating") | one.startswith("Short Term Rating"))
    annexure = (F.size(top) >= 8) & (F.get(top, F.lit(0)) == "ISIN") & F.get(top, F.lit(1)).startswith("Name of instrument")
    history = some((one == "Instrument") & F.col("__3").startswith("Outstanding"))
    indicators = F.lower(F.regexp_replace(F.get(top, F.lit(0)), " ", "")).startswith("ason/forthe")
    lenders = F.slice(top, 1, 3) == F.array(*map(F.lit, LENDER_HEAD))
    named = {"is_action": action, "is_bank": bank, "is_annexure": annexure, "is_history": history, "is_indicators": indicators, "is_lenders": lenders}
    return told.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in named.items()}).drop("__1", "__2", "__3", "__top", "__columns")


def footnotes(units: DataFrame, rows: DataFrame) -> DataFrame:
    """What each marker means under each table (meanings: marker to text): the first run of lines that begin with markers, near after it."""
    steps = F.split("node_path", "/")
    prefixes = F.filter(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")), lambda p: p.rlike(r"/table\[\d+\]$"))
    ends = units.where(F.col("node_path").contains("/table[")).select(*DOC, F.explode(prefixes).alias("table_path"), "at").groupBy(*TABLE).agg(F.max("at").alias("end"))
    wanted = rows.where("is_action OR is_annexure").select(*TABLE).distinct().join(ends, TABLE)
    after = wanted.select(*TABLE, F.posexplode(F.sequence(F.col("end") + 1, F.col("end") + NOTES)).alias("k", "at")).join(units, [*DOC, "at"])
    order = Window.partitionBy(*TABLE).orderBy("at")
    is_note = F.col("said").rlike("^" + MARKER)
    marked = after.withColumn("note", is_note.cast("int")).withColumn("seen", F.max("note").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    broken = F.max(((F.col("seen") == 1) & (F.col("note") == 0)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = marked.withColumn("broken", broken).where("note = 1 AND broken = 0")
    told = F.arrays_zip(F.regexp_extract_all("said", F.lit(FOOTNOTE), F.lit(1)).alias("m"), F.regexp_extract_all("said", F.lit(FOOTNOTE), F.lit(2)).alias("t"))
    each = lines.select(*TABLE, "at", F.posexplode(told).alias("pos", "x"))
    last = each.groupBy(*TABLE, F.col("x.m").alias("marker")).agg(F.max_by(F.trim("x.t"), F.struct("at", "pos")).alias("meaning"))
    return last.groupBy(*TABLE).agg(F.map_from_entries(F.collect_list(F.struct("marker", "meaning"))).alias("meanings"))


def qualifiers(markers: Column, meanings: Column) -> Column:
    """What the markers of a name say, in their order."""

    def one(marker: Column) -> Column:
        meaning = F.lower(F.coalesce(F.try_element_at(meanings, marker), F.lit("")))
        told = F.lit(None).cast("string")
        for words, name in reversed(QUALIFIERS):
            fits = F.regexp_replace(meaning, r"^[ .]+|[ .]+$", "") == words if name == "secured" else meaning.contains(words)
            told = F.when(fits, name).otherwise(told)
        return told

    return F.array_compact(F.transform(markers, one))


_MARKERS = lambda c: F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))


def _bare(name: Column) -> Column:
    return reading.flat(F.regexp_replace(name, MARKER, ""))


def _ratings(rows: DataFrame, name: Column, amount: Column, rating: Column, marks: Column, note: Column, place: Column, evidence: Column) -> DataFrame:
    """Ratings of rows: name, amount, rating_text, what it reads as, qualifiers, place (the row's cell), and readable."""
    read = rows.select(*DOC, name.alias("instrument"), amount.cast("decimal(20,4)").alias("amount"), rating.alias("rating_text"), marks.alias("marks"), note.alias("note"), place.alias("place"), evidence.alias("evidence")).withColumn("r", reading.full_rating(F.col("rating_text")))
    withdrawn = F.col("r.withdrawn") | (F.lower("rating_text") == "withdrawn")
    kind, term = text.instrument_class(F.col("instrument")), text.rating_term(F.col("instrument"), F.col("r.grade"))
    return read.select(
        *DOC, "instrument", kind.alias("instrument_class"), term.alias("term"), "amount", "rating_text", F.col("r.grade").alias("grade"), F.col("r.outlook").alias("outlook"), F.col("r.watch").alias("watch"),
        F.coalesce("r.action", F.when(withdrawn, "withdrawn")).alias("action"), withdrawn.alias("withdrawn"), F.concat(F.col("r.qualifiers"), F.col("marks")).alias("qualifiers"), "note", "place", "evidence", (F.col("r.grade").isNotNull() | withdrawn).alias("readable"),
    )


def ratings(units: DataFrame, rows: DataFrame) -> DataFrame:
    """The ratings of bank facilities, of action tables, of withdrawn instruments, and of subordinated ones of the annexure (part). units: placed; rows: shapes."""
    notes = footnotes(units, rows)
    none = F.array().cast("array<string>")
    whole = Window.partitionBy(*TABLE)
    bank = rows.where("is_bank").withColumn("total", F.min(F.when(said(1).startswith("Total Bank Loan"), F.struct("row_no", "cells"))).over(whole)).withColumn("rated", F.min(F.when(said(1).endswith("Rating"), F.struct("row_no", "cells"))).over(whole))
    bank = bank.where("row_no = total.row_no AND rated IS NOT NULL").select(*ROW, F.col("total.cells").alias("cells"), F.col("rated.cells").alias("rated"))
    of_bank = _ratings(bank, F.lit("Bank Loan Facilities"), reading.instrument_cell(said(2))["amount"], said(2, "rated"), none, F.lit(""), cell(1)["at"], F.array(cell(1)["at"], cell(2)["at"], cell(2, "rated")["at"])).withColumn("part", F.lit("bank"))

    acted = rows.where("is_action").join(notes, TABLE, "left").withColumn("c", reading.instrument_cell(said(1)))
    of_action = _ratings(acted, F.col("c.name"), F.col("c.amount"), said(2), qualifiers(F.col("c.markers"), F.col("meanings")), F.lit(""), cell(1)["at"], F.array(cell(1)["at"], cell(2)["at"])).withColumn("part", F.lit("action"))

    listed = annexure_rows(rows).where("complete").join(notes, TABLE, "left")
    due = F.coalesce(reading.annexure_date(said(5)).cast("string"), said(5))
    note = F.when(F.col("withdrawn_table"), F.concat(F.lit("|"), said(1), F.lit("|withdrawn"))).otherwise(F.concat(F.lit("|"), said(1), F.lit("|"), due))
    of_list = listed.where(F.col("withdrawn_table") | ((text.instrument_class(_bare(said(2))) == "subordinated_debt") & reading.bracket_number(said(6)).isNotNull()))
    of_list = _ratings(of_list, _bare(said(2)), F.lit(None), said(8), qualifiers(_MARKERS(said(2)), F.col("meanings")), note, cell(2)["at"], F.array(cell(1)["at"], cell(2)["at"], cell(8)["at"])).withColumn("part", F.lit("annexure"))
    return of_bank.unionByName(of_action).unionByName(of_list)


def annexure_rows(rows: DataFrame) -> DataFrame:
    """The rows under an annexure's head: complete (has the cells that are read), withdrawn_table (all of the table's ratings are withdrawals)."""
    body = rows.where("is_annexure AND row_no > head.row_no").withColumn("complete", _has(1, 2, 5, 6, 8))
    gone = F.min(F.when(cell(8).isNotNull(), said(8) == "Withdrawn").otherwise(F.lit(True)).cast("int")).over(Window.partitionBy(*TABLE)) == 1
    return body.withColumn("withdrawn_table", gone)


def instruments(rows: DataFrame) -> DataFrame:
    """The instruments of the annexures: isin, instrument, class, coupon, maturity (null if open), due (as printed), amount, rating_text, place, evidence, readable."""
    listed = annexure_rows(rows).where("complete AND NOT withdrawn_table")
    coupon = F.when(cell(4).isNotNull(), said(4)).otherwise("NA")
    kind = text.instrument_class(_bare(said(2)))
    return listed.select(*DOC, said(1).alias("isin"), _bare(said(2)).alias("instrument"), kind.alias("instrument_class"), coupon.alias("coupon"), reading.annexure_date(said(5)).alias("maturity_date"), said(5).alias("due"), reading.bracket_number(said(6)).alias("amount"), said(8).alias("rating_text"), cell(2)["at"].alias("place"), F.array(*[cell(k)["at"] for k in (1, 2, 5, 6, 8)]).alias("evidence"), reading.bracket_number(said(6)).isNotNull().alias("readable"))


def history(rows: DataFrame, published: DataFrame) -> DataFrame:
    """The dated pairs of rating histories, without the document's own date: instrument (carried down its group), class, term, action_date, rating_text and what it reads as. published: document_id, published."""
    down = Window.partitionBy(*TABLE).orderBy("row_no")
    is_head = said(1) == "Instrument"
    headed = rows.where("is_history").withColumn("top", F.min(F.when(is_head, F.struct("row_no", "cells"))).over(Window.partitionBy(*TABLE)))
    body = headed.where("row_no > top.row_no").withColumn("group", F.last(F.when(said(1) != "", cell(1)), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    dates = F.transform(F.filter("top.cells", lambda c: c["said"] == "Date"), lambda c: c["col"])
    pairs = body.where("group IS NOT NULL").select(*ROW, "group", "cells", F.explode(dates).alias("col"))
    at = lambda k: F.try_element_at(F.filter("cells", lambda c: c["col"] == k), F.lit(1))
    read = pairs.select(*DOC, "group", at(F.col("col")).alias("d"), at(F.col("col") + 1).alias("x")).where("d IS NOT NULL AND x IS NOT NULL").withColumn("action_date", reading.history_date(F.col("d.said")))
    kept = read.join(published, DOC, "left").where("action_date IS NOT NULL AND x.said NOT IN ('', '--') AND (published IS NULL OR action_date <> published)").withColumn("r", reading.full_rating(F.col("x.said")))
    withdrawn = F.col("r.withdrawn") | (F.lower("x.said") == "withdrawn")
    name = F.col("group.said")
    return kept.select(*DOC, name.alias("instrument"), text.instrument_class(name).alias("instrument_class"), text.rating_term(name, F.col("r.grade")).alias("term"), "action_date", F.col("x.said").alias("rating_text"), F.col("r.grade").alias("grade"), F.col("r.outlook").alias("outlook"), F.col("r.watch").alias("watch"), withdrawn.alias("withdrawn"), F.array("group.at", "d.at", "x.at").alias("evidence"), (F.col("r.grade").isNotNull() | withdrawn).alias("readable"))


def indicators(units: DataFrame, rows: DataFrame) -> DataFrame:
    """Adjusted indicators: scope, metric, slug, as_of, value, unit, evidence. A table without a heading that says so gives one row with a null metric."""
    head = rows.where("is_indicators").groupBy(*TABLE).agg(F.min("head").alias("head"))
    first = head.withColumn("first", F.get("head.cells", F.lit(0))["at"])
    said_so = units.where(F.col("said").rlike(ADJUSTED)).select(*DOC, F.col("at").alias("heading"), F.lower(F.regexp_extract("said", ADJUSTED, 1)).alias("scope"))
    scoped = first.join(said_so, DOC, "left").where("heading IS NULL OR heading < first").groupBy(*TABLE).agg(F.max(F.struct("heading", "scope")).alias("h"))
    headed = rows.where("is_indicators").join(scoped, TABLE, "left")
    lacking = headed.where("h.heading IS NULL").select(*TABLE).distinct()
    unit = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    body = headed.where("h.heading IS NOT NULL AND row_no > head.row_no").where(_has(1, 2)).withColumn("unit", F.try_element_at(unit, F.lower(said(2))))
    values = body.select(*DOC, "h", said(1).alias("metric"), "unit", cell(1)["at"].alias("a1"), cell(2)["at"].alias("a2"), F.explode(F.filter("head.cells", lambda c: c["col"] >= 3)).alias("top"), "cells")
    value = F.try_element_at(F.filter("cells", lambda c: c["col"] == F.col("top.col")), F.lit(1))
    read = values.withColumn("as_of", reading.period_date(F.col("top.said"))).withColumn("v", value).withColumn("value", reading.bracket_number(F.col("v.said"))).where("as_of IS NOT NULL AND value IS NOT NULL AND unit IS NOT NULL")
    slug = F.regexp_replace(F.regexp_replace(F.lower("metric"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    told = read.select(*DOC, F.col("h.scope").alias("scope"), "metric", slug.alias("slug"), "as_of", "value", "unit", F.array("a1", "a2", "top.at", "v.at", "h.heading").alias("evidence"))
    return told.unionByName(lacking.select(*DOC), allowMissingColumns=True)


def lenders(rows: DataFrame) -> DataFrame:
    """Facilities by lender: facility, lender, amount, evidence."""
    body = rows.where("is_lenders AND row_no > head.row_no").where(_has(1, 2, 3)).withColumn("amount", reading.bracket_number(said(2))).where("amount IS NOT NULL")
    shown = F.transform(F.filter("cells", lambda c: c["col"] <= 4), lambda c: c["at"])
    return body.select(*DOC, _bare(said(1)).alias("facility"), said(3).alias("lender"), "amount", shown.alias("evidence"))


def prose(units: DataFrame) -> DataFrame:
    """What the text around the tables says (part, key, value, evidence): outlook, liquidity and its narrative, drivers, rating factors, and the date of an update."""
    first = lambda pattern, part: units.where(F.col("said").rlike(pattern)).groupBy(*DOC).agg(F.min(F.struct("at", "said")).alias("u")).select(*DOC, F.lit(part).alias("part"), F.lit("").alias("key"), F.initcap(F.regexp_extract("u.said", pattern, 1)).alias("value"), F.array("u.at").alias("evidence"))
    outlook, liquidity = first(OUTLOOK, "outlook"), first(LIQUIDITY, "liquidity")
    near = liquidity.select(*DOC, F.explode(F.sequence(F.get("evidence", F.lit(0)) + 1, F.get("evidence", F.lit(0)) + NEAR)).alias("at")).join(units, [*DOC, "at"]).where(F.length("said") > NARRATIVE)
    narrative = near.groupBy(*DOC).agg(F.min(F.struct("at", "said")).alias("u")).select(*DOC, F.lit("liquidity_detail").alias("part"), F.lit("").alias("key"), F.col("u.said").alias("value"), F.array("u.at").alias("evidence"))

    headings = F.create_map(*[F.lit(v) for pair in (DRIVERS | FACTORS).items() for v in pair])
    marked = units.withColumn("heading", F.try_element_at(headings, F.col("said")))
    opened = marked.where("heading IS NOT NULL").select(*DOC, F.col("at").alias("from"), "heading", F.col("said").isin(list(FACTORS)).alias("factors"), F.regexp_replace("node_path", "/[^/]*$", "").alias("container"))
    # a container's units follow each other, so all of it that comes after the heading belongs to the heading
    under = opened.join(marked.drop("heading"), DOC).where(F.col("node_path").startswith(F.col("container")) & (F.col("at") > F.col("from")))
    headline = (F.length("said") < HEADLINE) & ~F.col("said").endswith(".")
    drivers = under.where(~F.col("factors") & headline).select(*DOC, F.lit("driver").alias("part"), F.col("heading").alias("key"), F.col("said").alias("value"), F.array("at").alias("evidence"))
    until = Window.partitionBy(*DOC, "from").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    listed = under.where("factors").withColumn("over", F.max(F.col("said").endswith("factors:").cast("int")).over(until)).where("over = 0").where(F.col("node_path").contains("/li"))
    bullets = listed.groupBy(*DOC, "from", "heading").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("b"))
    factors = bullets.select(*DOC, F.lit("factors").alias("part"), F.col("heading").alias("key"), F.array_join(F.transform("b", lambda x: x["said"]), " ").alias("value"), F.transform("b", lambda x: x["at"]).alias("evidence"))

    depth = F.size(F.split("node_path", "/"))
    updated = units.where(F.col("said").rlike(UPDATED)).groupBy(*DOC).agg(F.max(F.struct(depth.alias("depth"), (-F.col("at")).alias("back"), "said")).alias("u"))
    day = reading.period_date(F.regexp_extract("u.said", UPDATED, 1))
    stated = updated.select(*DOC, F.lit("updated_on").alias("part"), F.lit("").alias("key"), day.cast("string").alias("value"), F.array(-F.col("u.back")).alias("evidence")).where("value IS NOT NULL")
    return reduce(DataFrame.unionByName, [outlook, liquidity, narrative, drivers, factors, stated])


def published(units: DataFrame) -> DataFrame:
    """document_id, published: the first date that one of a document's first units states."""
    # a year is looked for first: that is cheap, and most units state none
    stated = units.where((F.col("at") <= TOP) & F.col("said").rlike(r"\d{4}")).withColumn("day", reading.published_date(F.col("said"))).where("day IS NOT NULL")
    return stated.groupBy(*DOC).agg(F.min_by("day", "at").alias("published"))


def coverage(documents: DataFrame, rows: DataFrame, rated: DataFrame, listed: DataFrame, dated: DataFrame, measured: DataFrame, told: DataFrame) -> DataFrame:
    """document_id, status, missing: what a rationale must give and does not, and every row that was found but could not be read."""
    # every part is looked through once, for what it gives and for its rows that were not read
    told_of = lambda found, gives, *unread: found.select(*DOC, gives.cast("int").alias("gives"), F.array_compact(F.array(*unread)).cast("array<string>").alias("unread"))
    place, nothing = F.col("place").cast("string"), F.lit(0)
    lines = annexure_rows(rows)
    of_line = (F.col("complete") & ~F.col("withdrawn_table")).cast("int") * GIVEN["no instrument annexure"]
    parts = [
        told_of(documents.select(*DOC).distinct(), F.lit(DOCUMENT)),
        told_of(rows.where("is_action").select(*DOC).distinct(), F.lit(GIVEN["no rating-action table"])),
        told_of(lines, of_line, F.when(~F.col("complete"), F.concat(F.lit("unreadable annexure row "), F.col("row_no").cast("string")))),
        told_of(rated.where("NOT readable"), nothing, F.when(F.col("part") != "annexure", F.concat(F.lit("no rating in the row of unit "), place)), F.concat_ws(" ", F.lit("unreadable rating of"), "instrument")),
        told_of(listed.where("NOT readable"), nothing, F.concat(F.lit("no instrument in the row of unit "), place)),
        told_of(dated, F.col("readable").cast("int") * GIVEN["no rating history entries"], F.when(~F.col("readable"), F.concat_ws(" ", F.lit("unreadable history of"), "instrument", F.col("action_date").cast("string")))),
        told_of(measured.where("metric IS NULL"), nothing, F.lit("indicators without an adjusted heading")),
        told_of(told.where("part = 'outlook'").select(*DOC).distinct(), F.lit(GIVEN["no outlook"])),
    ]
    whole = reduce(DataFrame.unionByName, parts).groupBy(*DOC).agg(F.bit_or("gives").alias("gives"), F.flatten(F.collect_list(F.when(F.size("unread") > 0, F.col("unread")))).alias("unread"))
    lacks = F.array_compact(F.array(*[F.when(F.col("gives").bitwiseAND(bit) == 0, name) for name, bit in GIVEN.items()]))
    out = whole.where(F.col("gives").bitwiseAND(DOCUMENT) > 0).select(*DOC, F.array_sort(F.concat(lacks, "unread")).alias("missing"))
    return out.select(*DOC, F.when(F.size("missing") == 0, "complete").otherwise("incomplete").alias("status"), "missing")
