"""Tables without lines: rows around their one tenure cell, entries that carry their own dates, totals found by running sums, a debt row under its periods.

Input of the first: words (document_id, page_no, word_no, line_no, text, start,
stop, x0, y0, x1, y1), line_no being the line of the page's text; of the second
the lines of `histories.table_lines`; of the last pages (document_id, page_no,
text). A cell's place follows from its page alone, an entry's from its document.

Defined results: pages without the heading, or without each of its columns, give
no rows; of cells as near to two rows or columns the first counts; a date that is
none counts as missing; rows that cannot be read are given and say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading, text
from factloom.operators.histories import DOCUMENT, _day, _matches
from factloom.operators.layout import PAGE, joined

# fixed values: where the table begins and ends, its heads, and cells of its body
BEGINS, ENDS = "Particulars:", ("*Please", "refer")
LABEL_HEAD, TENURE_HEAD, BEFORE_HEAD, NOW_HEAD = r"^Instruments?$", "Tenure", "Previous", "Present"
TENURE, HEAD_DATE, RATING_CELL, TOTALS = r"^(Long Term|Short Term)$", r"^\([^()]*\d{4}\)$", r"^BWR\s+[A-D]", r"^(Total|Rupees)"
FOOTNOTES = r"\s*[*^#]+\s*$"
# fixed values, in points: between words of one cell, over the first row, over the total
CELL_GAP, OVER_ROW, OVER_TOTAL = 6.0, 12.0, 3.0

# fixed values: cells of a history whose entries carry dates, its column heads and what is no part of a name
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
ENTRY_DATE = rf"\(?(\d{{1,2}})\s*({MONTH})\s*(\d{{4}})\)?|\((\d{{2}})\.(\d{{2}})\.(\d{{4}})\)"
COLUMN_HEAD = rf"^(?:20\d\d|Rating|\((?:\d{{1,2}}\s*)?{MONTH}\s*\d{{4}}\)?|\(\d{{1,2}}\s*{MONTH}|\d{{4}}\))$"
AMOUNT_HEAD, AMOUNT_CELL, NO_NAME = r"^(?:Amount|Type Amount)", r"^[\d,]+\.\d{2}$", r"^(?:\d{1,2}|(?:Long|Short)(?: Term)?|Term)$"
ENTRY_BEGINS = "BWR|Withdrawn"
# fixed values, in points: around the amounts' head, between columns, between heads and the first row; and in crores how near a total is
AROUND, BESIDE, COLUMN_GAP, UNDER_HEAD, TOTAL_NEAR = 10.0, 5.0, 25.0, 30.0, "0.02"

# fixed values: the row of total debt, the row of its periods, and the heading that states their basis
DEBT_HEADING = r"Key Financial Performance - IIFL Finance Ltd\.\s*\((Consolidated|Standalone)\)"
PERIODS = r"\n(FY\d{2}(?:\n(?:FY\d{2}|Q\dFY\d{2}))+)(?=\n|\z)"
DEBT_ROW = r"\nTotal Debt\nRs\.in Crores\n([\d,]+(?:\n[\d,]+){0,5})"


def cells(words: DataFrame, gap: float = CELL_GAP) -> DataFrame:
    """Words of one line of text with at most `gap` between them as one cell: text, start, stop, x0, x1, y (of its first word)."""
    order = Window.partitionBy(*PAGE).orderBy("start", "word_no")
    near = (F.lag("line_no").over(order) == F.col("line_no")) & (F.col("x0") - F.lag("x1").over(order) <= gap)
    numbered = words.withColumn("cell_no", F.sum(F.when(near, 0).otherwise(1)).over(order))
    word = F.struct("start", "word_no", "text", "stop", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    made = numbered.groupBy(*PAGE, "cell_no").agg(F.array_sort(F.collect_list(word)).alias("w"))
    first, last = F.col("w")[0], F.try_element_at("w", F.lit(-1))
    return made.select(*PAGE, "cell_no", joined("w").alias("text"), first["start"].alias("start"), last["stop"].alias("stop"), first["x0"].alias("x0"), last["x1"].alias("x1"), first["y"].alias("y"))


def _nearest(places: Column, x: Column) -> Column:
    """The number, from 1, of the place nearest to x; of equally near ones the first."""
    return F.array_min(F.transform(places, lambda p, i: F.struct(F.abs(p - x).alias("far"), (i + 1).alias("n"))))["n"]


def _in_table(words: DataFrame) -> DataFrame:
    """The words from the heading to the note under the table."""
    page = Window.partitionBy(*PAGE)
    used = words.where("trim(text) <> '' AND start IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    begins = F.min(F.when(F.col("text").contains(BEGINS), F.col("start") + F.instr("text", BEGINS) - 1)).over(page)
    after = F.lead("text").over(page.orderBy("start", "word_no"))
    opened = used.withColumn("__after", after).withColumn("__from", begins).where("start >= __from")
    ends = F.min(F.when(F.col("text").endswith(ENDS[0]) & F.col("__after").startswith(ENDS[1]), F.col("start"))).over(page)
    return opened.withColumn("__to", ends).where("__to IS NULL OR start < __to").drop("__after", "__from", "__to")


def rated_particulars(words: DataFrame) -> DataFrame:
    """One row a rated instrument: document_id, page_no, row_no, label, amount, rating_text, previous_text, grade, outlook, watch, action, readable, and the places (start, stop) of label, amount and rating.

    Columns are the heads' middles. A row is built around its tenure cell: every other cell joins the row whose tenure cell
    is nearest in height, a rating with all the lines under its first.
    """
    page = Window.partitionBy(*PAGE)
    found = cells(_in_table(words)).withColumn("middle", (F.col("x0") + F.col("x1")) / 2).withColumn("is_tenure", _matches("text", TENURE))
    place = F.struct("start", "middle", "y")
    one = lambda hit: F.min(F.when(hit, place)).over(page)
    two = lambda said: F.array_sort(F.collect_list(F.when(F.col("text") == said, place)).over(page))
    headed = found.withColumns({"label": one(_matches("text", LABEL_HEAD)), "tenure": one(F.col("text") == TENURE_HEAD), "before": two(BEFORE_HEAD), "now": two(NOW_HEAD), "top": F.min(F.when(F.col("is_tenure"), F.col("y"))).over(page) - OVER_ROW, "bottom": F.min(F.when(_matches("text", TOTALS), F.col("y"))).over(page) - OVER_TOTAL})
    headed = headed.where("label IS NOT NULL AND tenure IS NOT NULL AND size(before) = 2 AND size(now) = 2 AND top IS NOT NULL")
    dated = F.max(F.when(_matches("text", HEAD_DATE) & (F.col("y") < F.col("top")), F.col("y"))).over(page)
    order = ["label", "before_amount", "amount", "tenure", "before_rating", "rating"]
    heads = F.array(F.col("label"), F.col("before")[0], F.col("now")[0], F.col("tenure"), F.col("before")[1], F.col("now")[1])
    body = headed.withColumn("head_y", F.greatest(F.array_max(F.transform(heads, lambda h: h["y"])), dated)).withColumn("heads", F.transform(heads, lambda h: h["middle"]))
    body = body.where("y > head_y AND (bottom IS NULL OR y < bottom)")
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_tenure"), F.struct("start", "y"))).over(page)), lambda t: t["y"])
    body = body.withColumn("rows", rows).where("NOT is_tenure AND size(rows) > 0").withColumn("column", F.element_at(F.array(*map(F.lit, order)), _nearest(F.col("heads"), F.col("middle"))))
    body = body.where((F.col("column") != "label") | (F.col("x0") <= F.col("heads")[1]))
    down = Window.partitionBy(*PAGE, "column").orderBy("y", "x0", "start")
    opens = (_matches("text", RATING_CELL) | (F.col("text") == "-")).cast("int")
    blocks = body.withColumn("block", F.sum(opens).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    height = F.when(F.col("column").isin("rating", "before_rating"), F.first("y").over(Window.partitionBy(*PAGE, "column", "block").orderBy("y", "x0", "start"))).otherwise(F.col("y"))
    placed = blocks.withColumn("row_no", _nearest(F.col("rows"), height))
    of = lambda c, hit=F.lit(True): F.array_sort(F.collect_list(F.when((F.col("column") == c) & hit, F.struct("y", "x0", "start", "stop", "text"))))
    told = F.col("text") != "-"
    read = placed.groupBy(*PAGE, "row_no").agg(of("label").alias("l"), of("amount").alias("a"), of("rating", told).alias("r"), of("before_rating", told).alias("b")).where("size(l) > 0 AND size(a) > 0 AND size(r) > 0")
    amount = F.try_element_at("a", F.lit(-1))
    spans = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    named = read.select(*PAGE, "row_no", F.trim(F.regexp_replace(joined("l"), FOOTNOTES, "")).alias("label"), reading.amount(amount["text"]).alias("amount"), joined("r").alias("rating_text"), F.nullif(joined("b"), F.lit("")).alias("previous_text"), spans("l").alias("label_spans"), F.struct(amount["start"].alias("start"), amount["stop"].alias("stop")).alias("amount_span"), spans("r").alias("rating_spans"))
    said = F.col("rating_text")
    action = F.coalesce(text.action_verbs(said), F.when(F.lower(said).contains("assignment"), "assigned"))
    return named.withColumns({"grade": reading.grade(said), "outlook": text.outlook(said), "watch": reading.watch(said), "action": action}).withColumn("readable", F.col("grade").isNotNull() & F.col("amount").isNotNull())


def before_total(amounts: DataFrame, order: list[str], value: str = "value", near: str = TOTAL_NEAR) -> DataFrame:
    """amounts with is_total and is_row: the first amount after others that is their sum, but for less than `near`, is a document's total; rows are those before it. A null value counts as nothing and is no total."""
    down = Window.partitionBy(*DOCUMENT).orderBy(*order)
    before = F.sum(F.coalesce(F.col(value), F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, -1))
    hit = F.coalesce(F.abs(F.col(value) - before) < F.lit(near).cast("decimal(10,2)"), F.lit(False))
    so_far = F.sum(F.col("__hit").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    told = amounts.withColumn("__hit", hit).withColumn("__hits", so_far)
    first = (F.row_number().over(Window.partitionBy(*DOCUMENT, "__hits").orderBy(*order)) == 1) & (F.col("__hits") == 1)
    return told.withColumn("is_total", first).withColumn("is_row", F.col("__hits") == 0).drop("__hit", "__hits")


def _entry_day(said: Column) -> Column:
    part = lambda g: F.nullif(F.regexp_extract(said, ENTRY_DATE, g), F.lit(""))
    return F.coalesce(_day(part(3), part(2), part(1)), F.try_to_date(F.concat_ws("-", part(6), part(5), part(4)), "yyyy-MM-dd"))


def _starts(middles: Column) -> Column:
    """The columns' middles: a head's own, where the column before lies at least COLUMN_GAP to its left."""

    def add(made: Column, x: Column) -> Column:
        return F.when((F.size(made) > 0) & (x - F.try_element_at(made, F.lit(-1)) < COLUMN_GAP), made).otherwise(F.concat(made, F.array(x)))

    return F.aggregate(middles, F.array().cast("array<double>"), add)


def dated_entries(table: DataFrame) -> DataFrame:
    """Entries of a history whose cells carry their own dates; columns as of `histories.entries`, and status: read, undated (a withdrawal under a year alone) or unreadable.

    table: lines of `histories.table_lines`. A row has one amount, and a total at the end is known by its sum. A name line
    belongs to the next amount, a cell to the last; the first column after the amounts is the document's own action and is
    left out. A column's cells of a row are read downwards and cut where a rating begins; its date is the last in it, else the column's.
    """
    whole, down = Window.partitionBy(*DOCUMENT), Window.partitionBy(*DOCUMENT).orderBy("at")
    head = F.min(F.when(_matches("text", AMOUNT_HEAD), F.struct("at", "x0", "x1"))).over(whole)
    lines = table.withColumn("head", head).where("head IS NOT NULL")
    near = (F.col("x0") > F.col("head.x0") - AROUND) & (F.col("x0") < F.col("head.x1") + AROUND)
    sized = lines.where(_matches("text", AMOUNT_CELL) & near).withColumn("value", reading.amount(F.col("text")))
    counted = before_total(sized, ["at"]).select(*DOCUMENT, "at", "is_row", "is_total")
    marked = lines.join(counted, [*DOCUMENT, "at"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_row", "is_total")})
    marked = marked.withColumn("row1", F.min(F.when(F.col("is_row"), F.struct("at", "page_no", "y"))).over(whole)).withColumn("total_at", F.min(F.when(F.col("is_total"), F.col("at"))).over(whole)).where("row1 IS NOT NULL")
    over = (F.col("page_no") < F.col("row1.page_no")) | ((F.col("page_no") == F.col("row1.page_no")) & (F.col("y") < F.col("row1.y") - UNDER_HEAD))
    marked = marked.withColumn("is_head", (F.col("x0") > F.col("head.x1") - BESIDE) & over & _matches("text", COLUMN_HEAD))
    heads = F.array_sort(F.collect_list(F.when(F.col("is_head"), F.struct("middle", "y", "at", "text"))).over(whole))
    marked = marked.withColumn("heads", heads).where("size(heads) > 0").withColumn("starts", _starts(F.transform("heads", lambda h: h["middle"])))
    head_end = F.greatest(F.array_max(F.transform("heads", lambda h: h["at"])), F.col("head.at"))
    marked = marked.withColumn("row_no", F.sum(F.col("is_row").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    body = marked.where(~F.col("is_row") & ~F.col("is_head") & (F.col("at") != F.col("head.at")) & (F.col("at") > head_end) & (F.col("total_at").isNull() | (F.col("at") < F.col("total_at"))))

    line = F.struct("page_no", "y", "at", "text")
    labels = body.where((F.col("x0") < F.col("head.x0") - BESIDE) & ~_matches("text", NO_NAME)).groupBy(*DOCUMENT, (F.col("row_no") + 1).alias("row_no")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined("l"), r"^\d{1,2}\s+", ""), r"\s+(?:Long|Short)(?:\s+Term)?\b", ""), r"\s*[*^#]+", "")
    labels = labels.select(*DOCUMENT, "row_no", F.trim(name).alias("name"), F.transform("l", lambda x: x["at"]).alias("label_at"))

    cell = body.where((F.col("x0") > F.col("head.x1") - BESIDE) & (F.col("row_no") > 0)).withColumn("column_no", _nearest(F.col("starts"), F.col("middle"))).where("column_no > 1")
    start, after = F.get("starts", F.col("column_no") - 1), F.get("starts", F.col("column_no"))
    own = F.array_sort(F.transform(F.filter("heads", lambda h: (h["middle"] >= start) & (after.isNull() | (h["middle"] < after))), lambda h: F.struct(h["y"].alias("y"), h["at"].alias("at"), h["text"].alias("text"))))
    # a column's own date needs a day and a month in letters; a year alone dates nothing
    cell = cell.withColumn("own", own)
    stacks = cell.groupBy(*DOCUMENT, "row_no", "column_no").agg(F.array_sort(F.collect_list(line)).alias("c"), F.first("own").alias("own"))
    stated = F.regexp_extract(joined("own"), ENTRY_DATE, 0)
    column_day = F.when(F.regexp_extract(stated, ENTRY_DATE, 1) != "", _entry_day(stated))
    stacks = stacks.withColumn("column_day", column_day).withColumn("pieces", F.split(joined("c"), f"(?={ENTRY_BEGINS})"))
    length = lambda parts, n, sep: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, p: s + F.length(p) + sep)
    texts = F.transform("c", lambda x: x["text"])
    placed = stacks.withColumn("c", F.transform("c", lambda x, i: F.struct(x["at"].alias("at"), length(texts, i, 1).alias("from"), (length(texts, i, 1) + F.length(x["text"])).alias("to"))))
    pieces = placed.select(*DOCUMENT, "row_no", "column_no", "c", "own", "column_day", "pieces", F.posexplode("pieces").alias("k", "piece")).where(F.col("piece").rlike(f"^(?:{ENTRY_BEGINS})"))
    first = length(F.col("pieces"), F.col("k"), 0)
    pieces = pieces.withColumn("from", first).withColumn("to", first + F.length("piece"))
    used = F.transform(F.filter("c", lambda x: (x["to"] > F.col("from")) & (x["from"] < F.col("to"))), lambda x: x["at"])
    last = F.try_element_at(F.regexp_extract_all("piece", F.lit(ENTRY_DATE), F.lit(0)), F.lit(-1))
    dated = pieces.withColumn("stated", last).withColumn("rating_at", used).withColumn("h", reading.history_rating(F.col("piece")))
    dated = dated.withColumn("action_date", F.when(F.col("stated").isNotNull(), _entry_day(F.col("stated"))).otherwise(F.col("column_day")))
    says = F.col("h.grade").isNotNull() | F.col("h.withdrawn")
    status = F.when(F.col("action_date").isNull() & F.col("h.withdrawn") & F.col("h.grade").isNull(), "undated").when(F.col("action_date").isNull() | ~says, "unreadable").otherwise("read")
    date_at = F.when(F.col("stated").isNull(), F.transform("own", lambda h: h["at"])).otherwise(F.array().cast("array<int>"))
    told = dated.withColumn("status", status).withColumn("date_at", date_at).join(labels, [*DOCUMENT, "row_no"], "left")
    return told.select(*DOCUMENT, "row_no", F.coalesce("name", F.lit("")).alias("name"), "action_date", F.trim("piece").alias("rating_text"), "h.grade", "h.outlook", "h.watch", "h.withdrawn", (F.col("status") == "read").alias("readable"), "status", F.coalesce("label_at", F.array().cast("array<int>")).alias("label_at"), "date_at", "rating_at")


def _period_end(said: Column) -> Column:
    """The last day of a financial year that ends in March (FY24), or of its quarter (Q1FY25)."""
    year, quarter = F.regexp_extract(said, r"FY(\d{2})$", 1).try_cast("int") + 2000, F.coalesce(F.regexp_extract(said, r"^Q([1-4])", 1).try_cast("int"), F.when(said.startswith("FY"), 4))
    ends = F.array(*[F.lit(m) for m in ("06-30", "09-30", "12-31", "03-31")])
    return F.try_to_date(F.concat_ws("-", F.when(quarter < 4, year - 1).otherwise(year).cast("string"), F.get(ends, quarter - 1)), "yyyy-MM-dd")


def total_debt(pages: DataFrame) -> DataFrame:
    """document_id, page_no, basis, period, as_of, amount, start, stop: the amounts of the debt row under the periods after the heading, as many as have a period.

    A period that is no year or quarter, or an amount that is none, gives no row.
    """
    whole = F.regexp_substr("text", F.lit(DEBT_HEADING))
    offset = F.instr("text", whole) - 1 + F.length(whole)
    found = pages.where(F.col("text").rlike(DEBT_HEADING)).withColumn("__at", offset).withColumn("__after", F.substring(F.col("text"), F.col("__at") + 1, F.length("text")))
    row = F.regexp_extract("__after", DEBT_ROW, 1)
    lead = F.regexp_substr("__after", F.lit(DEBT_ROW))
    first = F.col("__at") + F.instr("__after", lead) - 1 + F.length(lead) - F.length(row)
    parts = found.select(*DOCUMENT, "page_no", F.lower(F.regexp_extract("text", DEBT_HEADING, 1)).alias("basis"), F.split(F.regexp_extract("__after", PERIODS, 1), "\n").alias("periods"), F.split(row, "\n").alias("values"), first.alias("first"))
    each = parts.select("*", F.posexplode("values").alias("k", "value"))
    start = F.col("first") + F.aggregate(F.slice("values", 1, F.col("k")), F.lit(0), lambda s, v: s + F.length(v) + 1)
    told = each.withColumn("period", F.get("periods", F.col("k"))).withColumns({"as_of": _period_end(F.col("period")), "amount": reading.amount(F.col("value")), "start": start})
    return told.where("as_of IS NOT NULL AND amount IS NOT NULL").select(*DOCUMENT, "page_no", "basis", "period", "as_of", "amount", "start", (F.col("start") + F.length("value")).alias("stop"))
