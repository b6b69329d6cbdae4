"""Tables that a page's text gives line by line: a summary of rated amounts, where a pair of amounts is followed by its rating, and a list of instruments by ISIN.

Input: lines (document_id, at, text, start, stop): at orders the lines of one
text, blank lines may be left out. Which lines belong together follows from
what stands before them; that state is counted by windows over a document (how
many ratings have begun or ended so far), and where rows of unlike length must not overlap
by a fold over a document's few candidates.

Defined results: blank and null lines are left out; a pair without a rating, and
a rating without a label before it, give no row; the last rating of a text that
does not end is taken to the text's end; amounts of "-" are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading

# fixed values: cells of the summary: amounts, where a rating begins and how it ends, heads of columns; and how many lines a label has at most
AMOUNT_CELL, RATING_BEGINS = r"^(?:[\d,]+\.\d{2}|-)$", r"(PP-MLD)?\[ICRA\]"
RATING_ENDS = r"(Stable|Negative|Positive|Implications|reaffirmed|withdrawn|assigned|outstanding|confirmed)$"
HEAD_CELL = r"^(Instrument\*?|Previous rated|Current rated|Previous Rated|Current Rated|amount|Amount|\(Rs\. crore\)|Rating [Aa]ction|Rating Outstanding|Rating outstanding)$"
LABEL_LINES = 6
# fixed values: cells of the list: identifiers, and the cells after a name (issuance, coupon, maturity, amount)
ISIN_CELL, AFTER_NAME = r"^(INE[A-Z0-9]{9}|Not placed|NA)$", 4

DOC = ["document_id"]


def _is(pattern: str, c: Column | str = "text") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(pattern), F.lit(False))


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines that say something, numbered from 1."""
    kept = lines.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).where("text <> ''")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*DOC).orderBy("at")))


def block(lines: DataFrame, heads: list[str], ends: list[str]) -> DataFrame:
    """The lines after the first that holds the first of `heads` that any does, up to the first after it that holds one of `ends`."""
    whole = Window.partitionBy(*DOC)
    first = F.coalesce(*[F.min(F.when(F.col("text").contains(h), F.col("at"))).over(whole) for h in heads])
    opened = lines.withColumn("__from", first).where("at > __from")
    stop = F.least(*[F.min(F.when(F.col("text").contains(e), F.col("at"))).over(whole) for e in ends], F.lit(2**62))
    return opened.withColumn("__to", stop).where("at < __to").drop("__from", "__to")


def rated_amounts(lines: DataFrame) -> DataFrame:
    """One row a rated instrument: label, previous and current amount, rating_text, and the places of each (label_start .. rating_stop)."""
    down = Window.partitionBy(*DOC).orderBy("n")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    near = _numbered(lines).withColumn("t1", F.lead("text", 1).over(down)).withColumn("t2", F.lead("text", 2).over(down))
    pair = _is(AMOUNT_CELL) & _is(AMOUNT_CELL, "t1")
    # a rating that wraps goes on in lower case; a label begins with a capital or a digit
    closes = ~_is(r"^\p{Ll}", "t1") & ~F.col("text").endswith(",") & _is(RATING_ENDS)
    marked = near.withColumn("pair", pair).withColumn("opens", pair & _is(RATING_BEGINS, "t2")).withColumn("closes", closes.cast("int"))
    # amounts close nothing, so pairs between two closes are inside the rating that the first of them opened
    stretch = marked.withColumn("stretch", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    opened = stretch.withColumn("first", F.min(F.when(F.col("opens"), F.col("n"))).over(Window.partitionBy(*DOC, "stretch")))
    taken = F.coalesce(F.col("n") >= F.col("first"), F.lit(False))
    counted = opened.withColumn("taken", taken).withColumn("begins", (F.col("n") == F.col("first")).cast("int")).withColumn("row_no", F.coalesce(F.sum("begins").over(so_far), F.lit(0)))
    role = F.when(F.col("taken"), F.when(F.col("n") == F.col("first"), "previous").when(F.col("n") == F.col("first") + 1, "current").otherwise("rating")).when(~F.col("pair") & ~_is(HEAD_CELL), "label")
    told = counted.withColumn("role", role).where("role IS NOT NULL").withColumn("row_no", F.when(F.col("taken"), F.col("row_no")).otherwise(F.col("row_no") + 1))
    of = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("n", "text", "start", "stop"))))
    rows = told.groupBy(*DOC, "row_no").agg(*[of(r).alias(r) for r in ("label", "previous", "current", "rating")]).where("size(previous) = 1 AND size(label) > 0")
    rows = rows.withColumn("label", F.slice("label", F.greatest(F.size("label") - LABEL_LINES + 1, F.lit(1)), F.lit(LABEL_LINES)))
    said = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    places = [x for c in ("label", "current", "rating") for x in (F.col(c)[0]["start"].alias(f"{c}_start"), F.try_element_at(c, F.lit(-1))["stop"].alias(f"{c}_stop"))]
    return rows.select(*DOC, "row_no", said("label").alias("label"), reading.amount(F.col("previous")[0]["text"]).alias("previous_amount"), reading.amount(F.col("current")[0]["text"]).alias("current_amount"), said("rating").alias("rating_text"), *places)


def listed_instruments(lines: DataFrame) -> DataFrame:
    """One row an instrument: isin, name, issuance, coupon, maturity_date, amount, and the places of its name, maturity, amount and row.

    A row is an identifier, the lines of a name, and four cells; the name ends before a date, NA or an identifier. A row
    whose fourth cell is no amount is left out, and the search goes on behind the cell that ended its name.
    """
    down = Window.partitionBy(*DOC).orderBy("n")
    after = down.rowsBetween(1, Window.unboundedFollowing)
    numbered = _numbered(lines).withColumn("day", reading.month_day_cell(F.col("text"))).withColumn("isin", _is(ISIN_CELL))
    ended = numbered.withColumn("stop_at", F.first(F.when(F.col("day").isNotNull() | F.col("isin"), F.col("n")), ignorenulls=True).over(after)).withColumn("total", F.count("*").over(Window.partitionBy(*DOC)))
    found = ended.where("isin AND stop_at > n + 1 AND stop_at + 3 <= total").select(*DOC, F.col("n").alias("i"), F.col("stop_at").alias("j"))
    cells = numbered.select(*DOC, "n", "text", "start", "stop", "day")
    fourth = found.withColumn("n", F.col("j") + 3).join(cells.select(*DOC, "n", "text"), [*DOC, "n"]).select(*DOC, "i", "j", reading.amount(F.col("text")).isNotNull().alias("ok"))

    def take(state: Column, c: Column) -> Column:
        kind = "struct<next:int,taken:array<struct<i:int,j:int>>>"
        behind = F.struct((c["j"] + F.when(c["ok"], AFTER_NAME).otherwise(1)).alias("next"), F.when(c["ok"], F.concat(state["taken"], F.array(F.struct(c["i"].alias("i"), c["j"].alias("j"))))).otherwise(state["taken"]).alias("taken")).cast(kind)
        return F.when(c["i"] < state["next"], state).otherwise(behind)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,j:int>>").alias("taken"))
    kept = fourth.groupBy(*DOC).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("i", "j", "ok"))), start, take)["taken"].alias("taken"))
    rows = kept.select(*DOC, F.explode("taken").alias("r")).select(*DOC, "r.i", "r.j", F.explode(F.sequence("r.i", F.col("r.j") + AFTER_NAME - 1)).alias("n")).join(cells, [*DOC, "n"])
    cell = lambda k, c: F.max(F.when(F.col("n") == F.col("j") + k, F.col(c)))
    name = F.array_sort(F.collect_list(F.when((F.col("n") > F.col("i")) & (F.col("n") < F.col("j")), F.struct("n", "text", "start", "stop"))))
    read = rows.groupBy(*DOC, "i").agg(
        F.max(F.when(F.col("n") == F.col("i"), F.col("text"))).alias("isin"), name.alias("name"), cell(0, "day").alias("issuance"), cell(1, "text").alias("coupon"), cell(2, "day").alias("maturity_date"), cell(3, "text").alias("amount"),
        cell(2, "start").alias("maturity_start"), cell(2, "stop").alias("maturity_stop"), cell(3, "start").alias("amount_start"), cell(3, "stop").alias("amount_stop"), F.min("start").alias("row_start"), F.max("stop").alias("row_stop"),
    )
    said = F.array_join(F.transform("name", lambda x: x["text"]), " ")
    return read.select(*DOC, F.col("i").alias("row_no"), "isin", said.alias("name"), "issuance", "coupon", "maturity_date", reading.amount(F.col("amount")).alias("amount"), F.col("name")[0]["start"].alias("name_start"), F.try_element_at("name", F.lit(-1))["stop"].alias("name_stop"), "maturity_start", "maturity_stop", "amount_start", "amount_stop", "row_start", "row_stop")
