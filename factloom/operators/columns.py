"""Tables whose first column is left-aligned at the table's edge: rows by their labels, and generic names told by the one instrument of their size.

Input: the table's lines (document_id, page_no, line_no, text, start, stop, x0), as
histories takes them. Rows never leave a page.

Defined results: blank lines and lines without a place are left out; cells before
the first label belong to none; a row's amount, rating and action are null where
they are not printed; a name that two instruments could be is not told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading, text

# fixed values: heads of columns, amounts, ratings and what may follow inside a rating's cell, sizes of instruments
HEAD_CELL, AMOUNT_CELL = r"^(Facilities/Instruments|Amount \(₹|crore\)|Rating\d?|Rating Action)$", r"^(?:[\d,]+\.\d{2}|-)$"
RATING_CELL, RATING_GOES_ON = r"^(?:CARE\s+[A-D]|-$)", r"^(?:\((?:RWN|RWP|RWD)\)|(?:Stable|Negative|Positive|Developing)\)?)$"
SIZE_CELL = r"^[\d,]+\.\d{2}$"
# fixed value, in points: how far a label may lie from the table's edge
SLACK = 3.0

PAGE = ["document_id", "page_no"]


def label_groups(lines: DataFrame) -> DataFrame:
    """The lines of each row: group_no (from 1 in each page), role (label or cell), k (the cell's number in its row)."""
    edge = F.min("x0").over(Window.partitionBy(*PAGE))
    placed = lines.withColumn("text", F.trim("text")).where("text <> ''").withColumn("edge", edge).where(~F.col("text").rlike(HEAD_CELL))
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    is_label = F.coalesce(F.abs(F.col("x0") - F.col("edge")) <= SLACK, F.lit(False))
    marked = placed.withColumn("is_label", is_label)
    opens = F.col("is_label") & ~F.coalesce(F.lag("is_label").over(down), F.lit(False))
    grouped = marked.withColumn("opens", opens.cast("int")).withColumn("group_no", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0))).where("group_no > 0")
    k = F.row_number().over(Window.partitionBy(*PAGE, "group_no", "is_label").orderBy("line_no"))
    return grouped.select(*PAGE, "group_no", F.when(F.col("is_label"), "label").otherwise("cell").alias("role"), k.alias("k"), "line_no", "text", "start", "stop")


def _collected(groups: DataFrame, part: str) -> DataFrame:
    """Each row's lines by `part`, as text and place: <part>, <part>_start, <part>_stop."""
    each = groups.where(F.col(part).isNotNull()).groupBy(*PAGE, "group_no", part).agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "start", "stop"))).alias("l"))
    return each.select(*PAGE, "group_no", F.col(part).alias("name"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("said"), F.col("l")[0]["start"].alias("start"), F.try_element_at("l", F.lit(-1))["stop"].alias("stop"))


def rated_rows(lines: DataFrame) -> DataFrame:
    """One row a table row: label, amount, rating_text, action_text, each with its place. The cells stand in the order amount, rating, action."""
    groups = label_groups(lines)
    row = Window.partitionBy(*PAGE, "group_no", "role").orderBy("k")
    has_amount = F.max(F.when((F.col("role") == "cell") & (F.col("k") == 1) & F.col("text").rlike(AMOUNT_CELL), 1).otherwise(0)).over(Window.partitionBy(*PAGE, "group_no"))
    told = groups.withColumn("has_amount", has_amount).withColumn("at", F.when(F.col("role") == "cell", F.col("k") - F.col("has_amount")))
    begins = F.max(F.when((F.col("at") == 1) & F.col("text").rlike(RATING_CELL), 1).otherwise(0)).over(Window.partitionBy(*PAGE, "group_no"))
    told = told.withColumn("begins", begins).withColumn("ends", F.when((F.col("at") > 1) & ~F.col("text").rlike(RATING_GOES_ON), 1).otherwise(0))
    told = told.withColumn("ended", F.max("ends").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("role") == "label", "label").when(F.col("at") == 0, "amount").when((F.col("begins") == 1) & (F.col("ended") == 0), "rating").otherwise("action")
    parts = _collected(told.withColumn("part", part), "part")
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    places = [of(n, c).alias(f"{n}_{c}") for n in ("label", "amount", "rating", "action") for c in ("start", "stop")]
    rows = parts.groupBy(*PAGE, "group_no").agg(of("label", "said").alias("label"), of("amount", "said").alias("amount_text"), of("rating", "said").alias("rating_text"), of("action", "said").alias("action_text"), *places)
    return rows.withColumn("amount", reading.amount(F.col("amount_text"))).drop("amount_text")


def sized_names(lines: DataFrame) -> DataFrame:
    """The rows of an annexure that have exactly one size: name, size, instrument_class, and the places of both."""
    groups = label_groups(lines)
    sizes = groups.where(F.col("role") == "cell").where(F.col("text").rlike(SIZE_CELL)).groupBy(*PAGE, "group_no").agg(F.count("*").alias("n"), F.min("text").alias("size_text"), F.min("start").alias("size_start"), F.max("stop").alias("size_stop")).where("n = 1")
    names = _collected(groups.withColumn("part", F.when(F.col("role") == "label", "label")), "part").select(*PAGE, "group_no", F.col("said").alias("name"), F.col("start").alias("name_start"), F.col("stop").alias("name_stop"))
    both = sizes.join(names, [*PAGE, "group_no"])
    return both.select(*PAGE, "name", reading.amount(F.col("size_text")).alias("size"), text.instrument_class(F.col("name")).alias("instrument_class"), "name_start", "name_stop", "size_start", "size_stop")


def told_by_size(rows: DataFrame, annexure: DataFrame) -> DataFrame:
    """rows with told_name and told_class: of the one instrument in the document's annexure that has the row's amount and a class.

    A row without an amount (a withdrawal) is told by the one instrument listed at nought whose class no other row of the
    table names. Rows that name a class themselves are not looked up. Two instruments that fit tell nothing.
    """
    own = rows.withColumn("instrument_class", text.instrument_class(F.col("label")))
    generic = own.where("instrument_class = 'other'")
    known = annexure.where("instrument_class <> 'other'").select("document_id", F.col("name").alias("told_name"), "size", F.col("instrument_class").alias("told_class"))
    taken = own.where("instrument_class <> 'other'").select(*PAGE, F.col("instrument_class").alias("told_class")).distinct()
    key = [*PAGE, "group_no"]
    by_amount = generic.where("amount IS NOT NULL").join(known, (generic.document_id == known.document_id) & (generic.amount == known.size)).select(*[generic[c] for c in key], "told_name", "told_class")
    nought = known.where("size = 0")
    withdrawn = generic.where("amount IS NULL").select(*key).join(nought.select("document_id", "told_name", "told_class"), "document_id").join(taken, [*PAGE, "told_class"], "left_anti").select(*key, "told_name", "told_class")
    single = by_amount.unionByName(withdrawn).groupBy(*key).agg(F.count("*").alias("n"), F.min("told_name").alias("told_name"), F.min("told_class").alias("told_class")).where("n = 1").drop("n")
    return own.join(single, key, "left")
