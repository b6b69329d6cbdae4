"""Rating histories read from the lines of a page: tables that go on over pages, rows by serial or type cell, dates in cells or in column heads.

Input: lines (document_id, page_no, line_no, text, start, stop, x0, x1, y):
line_no orders a page's lines as its text does, start and stop are places in
that text, y is the line's top. All steps are windows over a document's table;
what depends on what came before (which row an orphan name belongs to, where a
date's rating ends) is counted, not looped.

Defined results: documents without the heading give no rows; lines with a null
place or blank text are left out; dated cells that state neither a grade nor a
withdrawal are given with `readable` false, never dropped; repeated lines are
read twice, as printed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading, text

# fixed values: heads of the name and type columns, of the serial column, cells of the type column
NAME_HEAD, TYPE_HEAD = r"^(Instrument|Name of the)\b", r"^Type$"
SERIAL_HEADS = ["Sr.", "No.", "Sr. No."]
TYPE_CELL = r"^(Long|Short|Long[- ]term|Short[- ]term|term|Term|LT|ST)$"
SERIAL, STRAY, EMPTY = r"^\d{1,2}$", r"^\d{1,3}$", r"^-$"
# fixed values: dates of column heads and of cells, by the lines that they are broken into
HEAD_DMY, HEAD_MDY, HEAD_MONTH, HEAD_DAY_YEAR = r"^(\d{1,2}) ([A-Z][a-z]{2,8}) (\d{4})$", r"^([A-Z][a-z]{2,8}) (\d{1,2}),(?: (\d{4}))?$", r"^([A-Z][a-z]{2,8})$", r"^(\d{1,2}), (\d{4})$"
CELL_MONTH, CELL_DAY, CELL_DAY_MONTH, YEAR = r"^([A-Z][a-z]{2})-?$", r"^(\d{1,2})[-,]?$", r"^(\d{1,2})-([A-Za-z]{3})-$", r"^(\d{4})$"
# fixed values, in points: a column's edge, and how far a cell's middle may lie from its head's
SLACK, REACH = 3.0, 45.0

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
DOCUMENT = ["document_id"]


def _matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(pattern), F.lit(False))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date by the first three letters of its month; null where there is none."""
    at = F.instr(F.lit(_MONTHS), F.lower(F.left(month, F.lit(3))))
    number = F.when((at > 0) & ((at - 1) % 3 == 0), ((at + 2) / 3).cast("int"))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def table_lines(lines: DataFrame, head: str, ends: list[str], furniture: str | None = None) -> DataFrame:
    """The lines of each document's table: part (head or body), at (their order), middle.

    The table begins under the first line that holds `head`, and ends over the first line, on that page or a later one,
    that holds one of `ends` (begins with it, where that starts with a line feed; is it, where it ends with one too) and lies under the heading, by its place
    on the page and not in the text. A later page's repeated head, and a page number over it, are left out.
    """
    used = lines.where("trim(text) <> '' AND x0 IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL").withColumn("text", F.trim("text"))
    if furniture:
        used = used.where(~F.col("text").rlike(furniture))
    used = used.withColumn("middle", (F.col("x0") + F.col("x1")) / 2)
    # windows over the document and its pages: nothing is joined, so the lines are made and looked through once
    whole, paged = Window.partitionBy(*DOCUMENT), Window.partitionBy(*DOCUMENT, "page_no")
    top = F.min(F.when(F.col("text").contains(head), F.struct("page_no", "line_no", "y"))).over(whole)
    open_pages = used.withColumn("top", top).where("page_no >= top.page_no").withColumn("top_y", F.when(F.col("page_no") == F.col("top.page_no"), F.col("top.y")))
    under = open_pages.where("top_y IS NULL OR y > top_y")
    # of each end its first line in the text that lies under the heading
    found = []
    for end in ends:
        said = end.strip("\n")
        hit = (F.col("text") == said) if end.startswith("\n") and end.endswith("\n") else F.col("text").startswith(said) if end.startswith("\n") else F.col("text").contains(said)
        found.append(F.min(F.when(hit, F.struct("line_no", "y"))).over(paged)["y"])
    stopped = under.withColumn("bottom", F.least(*found, F.lit(float("inf"))))
    stopped = stopped.withColumn("last_page", F.min(F.when(F.col("bottom") < float("inf"), F.col("page_no"))).over(whole))
    inside = stopped.where("(last_page IS NULL OR page_no <= last_page) AND y < bottom")
    inside = inside.withColumn("first_page", F.col("page_no") == F.col("top.page_no"))

    # on the first page the head ends at the first line of the name column after the type head
    first = lambda c: F.when(F.col("first_page"), c)
    marked = inside.withColumn("kind_at", F.min(first(F.when(_matches("text", TYPE_HEAD), F.struct("line_no", "middle", "x0")))).over(whole))
    named = F.when(_matches("text", NAME_HEAD) & (F.col("line_no") <= F.col("kind_at.line_no")), F.struct("line_no", "middle"))
    marked = marked.withColumn("name_at", F.min(first(named)).over(whole))
    edge = F.when(F.col("name_at").isNotNull(), (F.col("name_at.middle") + F.col("kind_at.middle")) / 2).otherwise(F.col("kind_at.x0"))
    starts = (F.col("middle") < edge) & ~_matches("text", NAME_HEAD) & ~F.col("text").isin(SERIAL_HEADS) & (F.col("line_no") > F.col("kind_at.line_no"))
    cut = F.when(F.max("kind_at").over(whole).isNull(), F.lit(-1)).otherwise(F.coalesce(F.min(first(F.when(starts, F.col("line_no")))).over(whole), F.lit(2**31 - 1)))
    split = marked.withColumn("cut", cut).withColumn("in_head", F.col("first_page") & (F.col("line_no") < F.col("cut")))
    seen = split.withColumn("heads", F.collect_set(F.when(F.col("in_head"), F.col("text"))).over(whole))
    again = F.array_contains("heads", F.col("text")) | _matches("text", STRAY)
    down = Window.partitionBy(*DOCUMENT, "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max((~again).cast("int")).over(down)
    kept = seen.withColumn("opened", opened).where("first_page OR opened = 1")
    order = Window.partitionBy(*DOCUMENT).orderBy("page_no", "line_no")
    return kept.select(*DOCUMENT, F.when(F.col("in_head"), "head").otherwise("body").alias("part"), F.row_number().over(order).alias("at"), "page_no", "line_no", "text", "start", "stop", "x0", "x1", "y", "middle")


def rows_of(table: DataFrame) -> DataFrame:
    """The body's lines with row_no, and role: label or cell. Lines that belong to no row are left out."""
    whole = Window.partitionBy(*DOCUMENT)
    is_head = F.col("part") == "head"
    kind = F.min(F.when(is_head & _matches("text", TYPE_HEAD), F.struct("at", "middle", "x0"))).over(whole)
    name = F.min(F.when(is_head & _matches("text", NAME_HEAD), F.struct("at", "middle"))).over(whole)
    placed = table.withColumn("kind", kind).withColumn("name", name).withColumn("left", F.min(F.when(~is_head, F.col("x0"))).over(whole))
    edge = F.when(F.col("kind").isNull(), F.col("left") + SLACK).when(F.col("name").isNull(), F.col("kind.x0")).otherwise((F.col("name.middle") + F.col("kind.middle")) / 2)
    body = placed.withColumn("in_band", F.col("middle") < edge).where("part = 'body'")
    serial = F.col("in_band") & _matches("text", SERIAL)
    numbered = body.withColumn("serial", serial).withColumn("by_serial", F.max(serial.cast("int")).over(whole) == 1)
    stray = _matches("text", STRAY)

    down = Window.partitionBy(*DOCUMENT).orderBy("at")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    # a document's rows are told by their serials or by their types: both are counted in one pass, its own way counts
    numbered = numbered.withColumn("serial_no", F.sum(F.col("serial").cast("int")).over(so_far))
    of_serial = F.when((F.col("serial_no") > 0) & ~F.col("serial") & (F.col("in_band") | ~stray), F.col("serial_no"))

    near = F.coalesce(F.abs(F.col("middle") - F.col("kind.middle")) <= REACH / 2, F.lit(False))
    typed = numbered.withColumn("is_type", ~F.col("in_band") & _matches("text", TYPE_CELL) & near)
    opens = F.col("is_type") & ~F.coalesce(F.lag("is_type").over(down), F.lit(False))
    typed = typed.withColumn("opens", opens).withColumn("row_no", F.sum(opens.cast("int")).over(so_far))
    # runs of name lines, and what follows each: a type cell (its row's name), a cell (an orphan name), or nothing
    changes = F.coalesce((F.col("in_band") != F.lag("in_band").over(down)).cast("int"), F.lit(1))
    typed = typed.withColumn("changes", changes).withColumn("run", F.sum("changes").over(so_far)).withColumn("before_type", F.lead("is_type").over(down))
    after = F.last("before_type").over(Window.partitionBy(*DOCUMENT, "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    typed = typed.withColumn("followed_by", F.when(F.col("in_band"), F.when(after.isNull(), "end").when(after, "type").otherwise("cell")))
    starts_run = F.col("in_band") & (F.col("changes") == 1)
    # rows that open without a name wait for one; an orphan takes the last that waits
    unnamed = F.col("opens") & ~F.coalesce(F.lag("in_band").over(down), F.lit(False))
    orphan = starts_run & F.col("followed_by").isin("cell", "end")
    step = F.when(unnamed, 1).when(orphan, -1).otherwise(0)
    waiting = typed.withColumn("step", step).withColumn("sum", F.sum("step").over(so_far))
    waiting = waiting.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    before = F.coalesce(F.lag("depth").over(down), F.lit(0))
    waiting = waiting.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).when(F.col("step") == -1, before))
    pushed = F.last(F.when(F.col("step") == 1, F.col("row_no")), ignorenulls=True).over(Window.partitionBy(*DOCUMENT, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    owner = F.when((F.col("step") == -1) & (F.col("level") > 0), pushed)
    # without a waiting row a name inside the table goes to the row before it, one at its end to none
    owner = F.coalesce(owner, F.when((F.col("step") == -1) & (F.col("followed_by") == "cell") & (F.col("row_no") > 0), F.col("row_no")))
    waiting = waiting.withColumn("owner", F.max(owner).over(Window.partitionBy(*DOCUMENT, "run")))
    row = F.when(~F.col("in_band"), F.when((F.col("row_no") > 0) & (F.col("is_type") | ~stray), F.col("row_no"))).when(F.col("followed_by") == "type", F.col("row_no") + 1).otherwise(F.col("owner"))
    placed = waiting.withColumn("row_no", F.when(F.col("by_serial"), of_serial).otherwise(row)).where("row_no IS NOT NULL").withColumn("role", F.when(F.col("in_band"), "label").otherwise("cell"))
    return placed.select(*DOCUMENT, "row_no", "role", "at", "page_no", "text", "start", "stop", "x0", "x1", "middle")


def head_dates(table: DataFrame) -> DataFrame:
    """The dates that column heads state: column_no, day, middle, and the lines (at) that state it."""
    down = Window.partitionBy(*DOCUMENT).orderBy("at")
    heads = table.where("part = 'head'").select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in ("text", "x0", "x1", "at")])
    t, n = F.col("text"), F.col("next_text")
    dmy = _day(_part(t, HEAD_DMY, 3), _part(t, HEAD_DMY, 2), _part(t, HEAD_DMY, 1))
    month_first = _day(_part(n, HEAD_DAY_YEAR, 2), _part(t, HEAD_MONTH, 1), _part(n, HEAD_DAY_YEAR, 1))
    mdy = _day(F.coalesce(_part(t, HEAD_MDY, 3), _part(n, YEAR, 1)), _part(t, HEAD_MDY, 1), _part(t, HEAD_MDY, 2))
    two_lines = F.when(_matches("text", HEAD_DMY), False).when(_matches("text", HEAD_MONTH) & _matches(n, HEAD_DAY_YEAR), True).when(_matches("text", HEAD_MDY), _part(t, HEAD_MDY, 3).isNull())
    day = F.when(_matches("text", HEAD_DMY), dmy).when(_matches("text", HEAD_MONTH), month_first).when(_matches("text", HEAD_MDY), mdy)
    told = heads.withColumn("day", day).withColumn("two", two_lines).where("day IS NOT NULL")
    x0, x1 = F.when(F.col("two"), F.least("x0", "next_x0")).otherwise(F.col("x0")), F.when(F.col("two"), F.greatest("x1", "next_x1")).otherwise(F.col("x1"))
    stated = F.when(F.col("two"), F.array("at", "next_at")).otherwise(F.array("at"))
    return told.select(*DOCUMENT, F.row_number().over(down).alias("column_no"), "day", ((x0 + x1) / 2).alias("middle"), stated.alias("date_at"))


def entries(table: DataFrame) -> DataFrame:
    """One row a dated cell: document_id, row_no, name, action_date, rating_text, grade, outlook, watch, withdrawn, readable, and the lines (at) of its name, date and rating.

    A date inside the cells is followed by its rating, up to the next date or an empty cell; other cells belong to the date
    of the column head whose middle is nearest, within reach.
    """
    lined = rows_of(table)
    label = F.collect_list(F.when(F.col("role") == "label", F.struct("at", "text"))).over(Window.partitionBy(*DOCUMENT, "row_no"))
    lined = lined.withColumn("l", label)
    down = Window.partitionBy(*DOCUMENT, "row_no").orderBy("at")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    cells = lined.where("role = 'cell'").select("*", F.lead("text", 1).over(down).alias("t1"), F.lead("text", 2).over(down).alias("t2"))
    t, t1, t2 = F.col("text"), F.col("t1"), F.col("t2")
    two = _day(_part(t1, YEAR, 1), _part(t, CELL_DAY_MONTH, 2), _part(t, CELL_DAY_MONTH, 1))
    three = _day(_part(t2, YEAR, 1), _part(t, CELL_MONTH, 1), _part(t1, CELL_DAY, 1))
    dated = cells.withColumn("two", two).withColumn("three", F.when(F.col("two").isNull(), three)).withColumn("day", F.coalesce("two", "three"))
    length = F.when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3)
    dated = dated.withColumn("length", length).withColumn("entry", F.count("day").over(so_far))
    inside = Window.partitionBy(*DOCUMENT, "row_no", "entry").orderBy("at")
    dated = dated.withColumn("k", F.row_number().over(inside)).withColumn("own_day", F.first("day").over(inside)).withColumn("own_length", F.first("length").over(inside))
    is_date = (F.col("entry") > 0) & (F.col("k") <= F.col("own_length"))
    ended = F.max(F.when(~is_date, _matches("text", EMPTY).cast("int")).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)) == 1
    parted = dated.withColumn("use", F.when(is_date, "date").when((F.col("entry") > 0) & ~ended, "rating"))
    columns = head_dates(table).groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.struct("column_no", "day", "middle", "date_at"))).alias("columns"))
    near = F.array_min(F.transform("columns", lambda c: F.struct(F.abs(c["middle"] - F.col("middle")).alias("far"), c["column_no"].alias("column_no"), c["day"].alias("day"), c["date_at"].alias("date_at"))))
    near = F.when(F.col("use").isNull() & ~_matches("text", EMPTY), near)
    used = parted.join(columns, DOCUMENT, "left").withColumn("near", near).where(F.col("use").isNotNull() | (F.col("near.far") <= REACH))
    used = used.withColumn("dated", F.col("use").isNotNull()).withColumn("entry", F.when(F.col("dated"), F.col("entry").cast("int")).otherwise(F.col("near.column_no")))
    of = lambda use: F.array_sort(F.collect_list(F.when(F.coalesce("use", F.lit("rating")) == use, F.struct("at", "text"))))
    day = F.when(F.col("dated"), F.col("own_day")).otherwise(F.col("near.day"))
    both = used.groupBy(*DOCUMENT, "row_no", "dated", "entry").agg(F.first(day).alias("action_date"), of("date").alias("d"), of("rating").alias("r"), F.first("near.date_at").alias("head_at"), F.first("l").alias("l"))
    both = both.withColumn("date_at", F.when(F.col("dated"), F.transform("d", lambda x: x["at"])).otherwise(F.col("head_at"))).withColumn("l", F.array_sort("l"))
    both = both.withColumn("name", F.array_join(F.transform("l", lambda x: x["text"]), " ")).withColumn("label_at", F.transform("l", lambda x: x["at"]))
    said = both.withColumn("rating_text", F.array_join(F.transform("r", lambda x: x["text"]), " ")).withColumn("rating_at", F.transform("r", lambda x: x["at"]))
    read = said.withColumn("h", reading.history_rating(F.col("rating_text"))).withColumn("readable", F.col("h.grade").isNotNull() | F.col("h.withdrawn"))
    return read.where(F.col("readable") | (F.size("rating_at") > 0)).select(*DOCUMENT, "row_no", "name", "action_date", "rating_text", "h.grade", "h.outlook", "h.watch", "h.withdrawn", "readable", "label_at", "date_at", "rating_at")


def history_claims(read: DataFrame, own_dates: DataFrame) -> DataFrame:
    """The readable entries as claims, but for the document's own action. own_dates: document_id, own_date, agency."""
    claims = read.where("readable").join(own_dates, DOCUMENT, "left").where("own_date IS NULL OR action_date <> own_date")
    kind, term = text.instrument_class(F.col("name")), text.rating_term(F.col("name"), F.col("grade"))
    keyed = claims.withColumn("instrument_class", kind).withColumn("term", term)
    key = F.concat_ws("|", F.lit("rating_history"), "agency", "instrument_class", "term", F.col("action_date").cast("string"), F.lower("name"))
    value = F.when(F.col("rating_text") != "", F.col("rating_text")).otherwise("Withdrawn")
    return keyed.withColumn("fact_key", key).withColumn("value_text", value)


def anchors(read: DataFrame, table: DataFrame) -> DataFrame:
    """Evidence of each entry: a row for each run of lines that follow each other on one page (document_id, row_no, action_date, part, run_no, page_no, start, stop)."""
    parts = reduce(DataFrame.unionByName, [read.select(*DOCUMENT, "row_no", "action_date", "rating_text", F.lit(p).alias("part"), F.posexplode(f"{p}_at").alias("pos", "at")) for p in ("label", "date", "rating")])
    placed = parts.join(table.select(*DOCUMENT, "at", "page_no", "start", "stop"), [*DOCUMENT, "at"])
    entry = [*DOCUMENT, "row_no", "action_date", "rating_text", "part"]
    order = Window.partitionBy(*entry).orderBy("pos")
    follows = (F.lag("page_no").over(order) == F.col("page_no")) & (F.lag("stop").over(order) + 1 == F.col("start"))
    runs = placed.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run_no", F.sum("new").over(order))
    return runs.groupBy(*entry, "run_no", "page_no").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("rating_text")


def history_coverage(documents: DataFrame, claims: DataFrame, read: DataFrame) -> DataFrame:
    """document_id, status, missing: a document without entries, or with dated cells that could not be read, is incomplete."""
    n = claims.groupBy(*DOCUMENT).agg(F.count("*").alias("n"))
    broken = read.where("NOT readable").groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "name", F.col("action_date").cast("string"), "rating_text"))).alias("cells"))
    told = documents.select(*DOCUMENT).distinct().join(n, DOCUMENT, "left").join(broken, DOCUMENT, "left")
    missing = F.concat(F.when(F.col("n").isNull(), F.array(F.lit("no rating-history entries"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("cells", lambda c: F.concat(F.lit("unreadable cell: "), c)), F.array().cast("array<string>")))
    return told.select(*DOCUMENT, F.when(F.size(missing) == 0, "complete").otherwise("incomplete").alias("status"), missing.alias("missing"))
