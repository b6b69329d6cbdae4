"""Printed pages of the test tables' rows: the word boxes that a reader of statements gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a letter takes, and the pages' heights of a header, of what follows it, and of the summary.
LETTER, TOP, LEADING, SUMMARY = 3.75, 120.0, 16.0, 700.0
#: Words of a narration's first line.
FIRST_LINE = 3
PLAIN = {"date": 28.0, "narration": 70.0, "ref": 232.0, "value": 318.0, "debit": 418.0, "credit": 488.0, "balance": 568.0}


def _word(text: Column | str, x: Column | float, y: Column | float, right: bool = False) -> Column:
    said = F.lit(text) if isinstance(text, str) else text
    width = F.length(said) * LETTER
    left = (F.lit(x) if isinstance(x, float) else x) - (width if right else F.lit(0.0))
    top = F.lit(y) if isinstance(y, float) else y
    return F.struct(said.alias("text"), left.cast("double").alias("x0"), top.cast("double").alias("y0"), (left + width).cast("double").alias("x1"), (top + 8).cast("double").alias("y1"))


def _run(words: Column, x: float, y: Column) -> Column:
    """Words one after another from x on."""
    before = lambda i: F.when(i > 0, (F.length(F.array_join(F.slice(words, 1, i), " ")) + 1) * LETTER).otherwise(0.0)
    return F.transform(words, lambda w, i: _word(w, F.lit(x) + before(i), y))


def _head(said: list[tuple[str, float, float, bool]]) -> Column:
    out = []
    for phrase, x, y, right in said:
        at = x - len(phrase) * LETTER if right else x
        for word in phrase.split(" "):
            out.append(_word(word, at, y))
            at += (len(word) + 1) * LETTER
    return F.array(*out)


def _cents(c: str) -> Column:
    return F.format_number((F.col(c) / 100).cast("decimal(20,2)"), 2)


def statement_words(rows: DataFrame) -> DataFrame:
    """Word boxes of statements. rows: document_id, n, page_no, stacked, day, narration, ref, debit, credit, unmarked, balance (in cents; 0 and null are not printed)."""
    by_page = Window.partitionBy("document_id", "page_no")
    page, document = by_page.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("document_id")
    said = F.split("narration", " ")
    spaced = rows.withColumn("said", said).withColumn("height", F.lit(LEADING) + F.when(F.size("said") > FIRST_LINE, 10.0).otherwise(0.0)).withColumn("y", TOP + F.sum("height").over(page) - F.col("height") + LEADING)
    # a page's head and foot, and a document's summary, are printed with the first row of their page
    spaced = spaced.withColumn("first", F.row_number().over(by_page.orderBy("n")) == 1).withColumn("any_stacked", F.max("stacked").over(by_page))
    plainly = lambda c: F.when(~F.col("stacked"), c)
    counts = {"debits": F.sum(plainly(F.col("debit"))), "credits": F.sum(plainly(F.col("credit"))), "n_debits": F.count(plainly(F.when(F.col("debit") > 0, 1))), "n_credits": F.count(plainly(F.when(F.col("credit") > 0, 1))), "last": F.max(plainly(F.col("page_no")))}
    spaced = spaced.select("*", *[c.over(document).alias(k) for k, c in counts.items()]).withColumn("opening", F.lit(5000000)).withColumn("closing", F.col("opening") + F.col("credits") - F.col("debits"))
    y = F.col("y")
    narration = F.concat(_run(F.slice("said", 1, FIRST_LINE), PLAIN["narration"], y), _run(F.slice("said", FIRST_LINE + 1, 99), PLAIN["narration"], y + 10))
    amount = lambda c, x: _word(F.col(c), x, y, right=True)
    plain = F.array(_word(F.col("dmy"), PLAIN["date"], y), _word(F.col("ref"), PLAIN["ref"], y), _word(F.col("dmy"), PLAIN["value"], y), amount("taken", PLAIN["debit"]), amount("given", PLAIN["credit"]), amount("overdrawn", PLAIN["balance"]))
    stacked = F.array(_word(F.col("named"), 10.0, y), amount("either", 440.0), _word(F.col("marker"), 450.0, y), amount("own", 568.0))
    # what a row prints is written out before it is placed: a box asks for its text several times
    either, absolute = F.col("debit") + F.col("credit"), F.format_number((F.abs("balance") / 100).cast("decimal(20,2)"), 2)
    spaced = spaced.withColumns(
        {
            "dmy": F.date_format("day", "dd/MM/yy"), "named": F.date_format("day", "dd-MMM-yyyy"), "absolute": absolute, "taken": F.when(F.col("debit") > 0, _cents("debit")), "given": F.when(F.col("credit") > 0, _cents("credit")),
            "either": F.when(either > 0, F.format_number((either / 100).cast("decimal(20,2)"), 2)), "marker": F.when(~F.col("unmarked") & (either > 0), F.when(F.col("debit") > 0, "Dr.").otherwise("Cr")),
        }
    )
    spaced = spaced.withColumn("overdrawn", F.concat("absolute", F.when(F.col("balance") < 0, "Dr").otherwise(""))).withColumn("own", F.concat("absolute", F.when(F.col("balance") < 0, "DR").otherwise("CR")))
    words = F.concat(narration, F.when(F.col("stacked"), stacked).otherwise(plain))
    printed = F.filter(words, lambda w: w["text"].isNotNull() & w["x0"].isNotNull())

    one = [("Date", PLAIN["date"], TOP, False), ("Narration", PLAIN["narration"], TOP, False), ("Chq./Ref.No.", PLAIN["ref"], TOP, False), ("Value Dt", PLAIN["value"], TOP, False), ("Withdrawal Amt.", PLAIN["debit"], TOP, True), ("Deposit Amt.", PLAIN["credit"], TOP, True), ("Closing Balance", PLAIN["balance"], TOP, True)]
    two = [("Transaction", 10.0, TOP - 10, False), ("Date", 10.0, TOP, False), ("Transaction", 70.0, TOP - 10, False), ("Remarks", 70.0, TOP, False), ("Amount", 440.0, TOP - 10, True), ("(INR)", 440.0, TOP, True), ("Balance", 568.0, TOP - 10, True), ("(INR)", 568.0, TOP, True)]
    footer = F.array(_word("Page", 28.0, 815.0), _word("No", 50.0, 815.0), _word(F.col("page_no").cast("string"), 66.0, 815.0))
    heads = F.concat(F.when(F.col("any_stacked"), _head(two)).otherwise(_head(one)), footer)

    at = {"opening": ("Opening Balance", 40.0), "n_debits": ("Dr Count", 130.0), "n_credits": ("Cr Count", 200.0), "debits": ("Debits", 280.0), "credits": ("Credits", 370.0), "closing": ("Closing Bal", 470.0)}
    shown = {c: F.col(c).cast("string") if c.startswith("n_") else F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.format_number((F.abs(c) / 100).cast("decimal(20,2)"), 2)) for c in at}
    figures = F.array(*[_word(shown[c], x, SUMMARY + 14) for c, (_, x) in at.items()])
    ends = F.concat(_head([("STATEMENT SUMMARY", 28.0, SUMMARY - 14, False), *[(label, x, SUMMARY, False) for label, x in at.values()]]), figures)

    every = F.when(~F.col("first"), printed).when(F.col("page_no") == F.col("last"), F.concat(printed, heads, ends)).otherwise(F.concat(printed, heads))
    every = spaced.select("document_id", "page_no", every.alias("words")).select("document_id", "page_no", F.explode("words").alias("w")).select("document_id", "page_no", "w.*")
    order = Window.partitionBy("document_id", "page_no").orderBy("y0", "x0", "text")
    return every.withColumn("word_no", F.row_number().over(order).cast("long")).select("document_id", "page_no", "word_no", "text", "x0", "y0", "x1", "y1")


def history_lines(cells: DataFrame) -> DataFrame:
    """Lines of rating histories on two pages. cells: document_id, row_no, k (its column), layout (0: dates in the cells, 1: in the column heads, 2: there and with serial numbers), orphan (the second row's name follows the page break), day, name, said."""
    line = lambda said, middle: F.struct((F.lit(said) if isinstance(said, str) else said).alias("text"), F.lit(float(middle)).alias("middle"))
    none = F.array().cast("array<struct<text:string,middle:double>>")
    rows = cells.groupBy("document_id", "row_no", "layout", "orphan", "name").agg(F.array_sort(F.collect_list(F.struct("k", "day", "said"))).alias("cells"))
    label = F.transform(F.split("name", " "), lambda w: F.struct(w.alias("text"), F.lit(70.0).alias("middle")))
    kind = F.array(line("Long", 150), line("term", 150), line("500.00", 200))
    at = lambda c: (F.lit(150.0) + c["k"] * 100).cast("double")
    dated = lambda c: F.when(c["said"] == "-", F.array(F.struct(c["said"].alias("text"), at(c).alias("middle")))).otherwise(
        F.array(*[F.struct(t.alias("text"), at(c).alias("middle")) for t in (F.concat(F.date_format(c["day"], "MMM"), F.lit("-")), F.concat(F.date_format(c["day"], "d"), F.lit("-")), F.date_format(c["day"], "yyyy"), c["said"])])
    )
    plain = lambda c: F.array(F.struct(c["said"].alias("text"), at(c).alias("middle")))
    part = lambda a, n: F.flatten(F.transform(F.slice("cells", a, n), lambda c: F.when(F.col("layout") == 0, dated(c)).otherwise(plain(c))))
    serial = F.when(F.col("layout") == 2, F.array(F.struct(F.col("row_no").cast("string").alias("text"), F.lit(30.0).alias("middle")))).otherwise(none)
    split, broken = F.col("orphan") & (F.col("row_no") == 2), (F.col("layout") == 2) & (F.col("row_no") == 2)
    here = F.when(split, F.concat(kind, part(1, 1))).otherwise(F.concat(serial, label, kind, F.when(broken, part(1, 2)).otherwise(part(1, 3))))
    # a numbered row's last cell stands first on the next page: a serial number there would be taken for the page's
    later = F.when(split, F.concat(label, part(2, 2))).when(broken, part(3, 1)).otherwise(none)
    day = lambda k, form: F.date_format(F.get("cells", F.lit(k))["day"], form)
    stated = F.array(*[F.struct(t.alias("text"), F.lit(m).alias("middle")) for t, m in ((day(0, "MMM dd, yyyy"), 250.0), (day(1, "MMM dd,"), 350.0), (day(1, "yyyy"), 350.0), (day(2, "d MMMM yyyy"), 450.0))])
    words = F.array(*[line(w, m) for w, m in (("Date", 240), ("Rating", 260), ("Date", 340), ("Rating", 360))])
    head = F.concat(F.array(line("Instrument", 70), line("Type", 150)), F.when(F.col("layout") == 0, words).otherwise(stated))
    first = F.concat(F.array(line("Complexity level of what follows", 200), line("Rating history for past three years", 200)), head)
    again = F.concat(F.array(line("7", 300)), head)
    last = F.array(line("Complexity level", 100), line("[ICRA]D", 250))
    # what stands around the rows is printed with the first of them
    block = lambda page, number, l: F.struct((F.lit(page) if isinstance(page, int) else page).alias("page_no"), (F.lit(number) if isinstance(number, int) else number).alias("block"), l.alias("l"))  # noqa: E731, E741
    own = F.array(block(F.when(F.col("row_no") < 3, 1).otherwise(2), F.col("row_no"), here), block(2, F.col("row_no"), later))
    around = F.array(block(1, 0, first), block(2, 0, again), block(2, 9, last))
    blocks = rows.select("document_id", F.when(F.col("row_no") == 1, F.concat(own, around)).otherwise(own).alias("blocks")).select("document_id", F.explode("blocks").alias("b"))
    body = blocks.select("document_id", F.col("b.page_no").alias("page_no"), F.col("b.block").alias("block"), F.posexplode("b.l").alias("pos", "w"))

    order = Window.partitionBy("document_id", "page_no").orderBy("block", "pos")
    every = body.select("document_id", "page_no", "block", "pos", "w.text", "w.middle").withColumn("line_no", F.row_number().over(order))
    width = F.length("text") * 4.0
    stop = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return every.select("document_id", "page_no", "line_no", "text", (stop - F.length("text")).cast("int").alias("start"), stop.cast("int").alias("stop"), (F.col("middle") - width / 2).alias("x0"), (F.col("middle") + width / 2).alias("x1"), (F.col("line_no") * 12.0).alias("y"))


#: Ratings of an action table's first row, by the document's v.
ACTED = ["Crisil AA/Stable (Reaffirmed)", "Crisil PPMLD AA r /Negative (Downgraded)", "Rating to be confirmed", "Withdrawn", "Crisil AA-/Watch Developing (Placed on watch)"]


def rationale_pages(rows: DataFrame) -> DataFrame:
    """HTML of rating rationales (document_id, html). rows: document_id, published, amount, v, day1, day2, day3, gap, assets."""
    acted = F.element_at(F.array(*map(F.lit, ACTED)), F.col("v") + 1)
    day = lambda c: F.date_format(c, "dd-MM-yy")
    number = lambda c: F.format_number(c, 0)

    def table(*lines: list) -> Column:
        cells = lambda line: F.concat(*[F.concat(F.lit("<td> "), F.lit(c) if isinstance(c, str) else c, F.lit("</td>")) for c in line])
        return F.concat(F.lit("<table><tbody>"), *[F.concat(F.lit("<tr>"), cells(line), F.lit("</tr>")) for line in lines], F.lit("</tbody></table>"))

    crore = lambda n: F.concat(F.lit("Rs."), number(n), F.lit(" Crore"))
    parts = [
        "<html><body><p>", F.date_format("published", "MMMM d, yyyy"), "</p>",
        table(["Total Bank Loan Facilities Rated", crore(F.col("amount"))], ["Long Term Rating", "Crisil AA/Stable (Reaffirmed)"]),
        table([F.concat(crore(F.col("amount") + 1), F.lit(" Non Convertible Debentures&amp;**")), acted], ["Rs.8500 Crore  Commercial Paper (Reduced from Rs.9000 Crore)", "Crisil A1+ (Reaffirmed)"]),
        "<p>some words</p><p>&amp; For retail bond issuance ** Secured.</p><p>plain</p><p>&amp; not a note any more</p>",
        table(
            ["ISIN", "Name of instrument", "Date of allotment", "Coupon", "Maturity date", "Issue size", "Complexity", "Rating"],
            [F.concat(F.lit("INE"), F.col("document_id").cast("string")), "NCD&amp;", "1-Jan-20", "9.5", "30-Jun-28", F.when(F.col("gap") == 0, "NA").otherwise(number(F.col("amount") + 2)), "Simple", "Crisil AA/Stable"],
            ["NA", "Subordinated NCD#", "1-Jan-20", "NA", "7-365 days", "50.25", "Simple", "Crisil AA/Stable"],
        ), "<p># Interchangeable between secured and subordinated debt</p>",
        table(["", "Current", "2025"], ["Instrument", "Type", "Outstanding Amount", "Rating", "Date", "Rating", "Date", "Rating"], ["Fund Based Facilities", "LT", "1", "x", day("day1"), "Crisil AA/Stable", day("day2"), F.when(F.col("gap") == 1, "unclear").otherwise("Withdrawn")], ["", "ST", "2", "x", day("day3"), "Crisil A1+", "--", "--"]),
        F.when(F.col("gap") == 2, "<p>Key financial indicators</p>").otherwise("<p>Key financial indicators (consolidated; Crisil Ratings-adjusted numbers)</p>"),
        table(["As on/for the year ended", "Unit", "December 31, 2025", "Mar 31, 2025/ FY25"], ["Total assets", "Rs crore", number(F.col("assets")), "NA"], ["Gearing", "Times", "(1.2)", "3.45"], ["Odd", "kg", "1", "2"]),
        table(["Facility", "Amount (Rs.Crore)", "Name of Lender"], ["Term Loan&amp;", number(F.col("amount")), "State Bank of India"], ["Proposed", "NA", "none"]),
        "<p>Outlook:  Stable</p><p>Liquidity: Strong</p><p>short</p><p>", F.lit("The company keeps liquid funds that cover its debt of the next quarter."), "</p>",
        "<div><p>Key Rating Drivers - Strengths</p><p>Comfortable capital</p><p>A body that explains it.</p></div><div><p>Upward factors:</p><ul><li>more</li><li>profit</li></ul><p>Downward factors:</p><ul><li>less</li></ul></div>",
        "<div><p>This RR was updated on May 22, 2026</p></div></body></html>",
    ]
    return rows.select("document_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"))


def rated_lines(rows: DataFrame, listed: bool) -> DataFrame:
    """Lines (document_id, at, text, start, stop) of a summary of rated amounts, or of a list of instruments. rows: document_id, row_no, v, previous, current, isin, issued, matures."""
    two = lambda c: F.concat(F.format_number(c, 0), F.lit(".00"))
    day = lambda c: F.date_format(c, "MMM-dd-yyyy")
    none = F.array().cast("array<string>")
    v = F.col("v")
    summary = F.concat(
        F.when(v == 1, F.array(F.lit("Non-convertible"), F.lit("debentures"))).when(v == 2, F.array(F.lit("Previous rated"), F.lit("Commercial paper"))).otherwise(F.array(F.lit("Bank lines"))),
        F.array(F.when(v == 3, "-").otherwise(two("previous")), two("current")),
        F.when(v == 0, F.array(F.lit("not rated, assigned"))).when(v == 1, F.array(F.lit("[ICRA]AA (Stable); reaffirmed,"), F.lit("removed from watch"), F.lit("and withdrawn"))).when(v == 2, F.array(F.lit("[ICRA]A1+; reaffirmed"))).otherwise(F.array(F.lit("[ICRA]AA"), F.lit("(Stable); outlook"), F.lit("Negative"))),
    )
    listing = F.concat(
        F.array(F.when(v == 1, "Not placed").otherwise(F.col("isin"))), F.when(v == 2, none).otherwise(F.array(F.lit("NCD"), F.lit("Series II"))),
        F.array(F.when(v == 1, "NA").otherwise(day("issued")), F.lit("9.50%"), day("matures"), F.when(v == 3, "250 each").otherwise(two("current"))),
    )
    each = rows.select("document_id", F.struct("row_no").alias("r"), F.posexplode(listing if listed else summary).alias("pos", "text"))
    order = Window.partitionBy("document_id").orderBy("r.row_no", "pos")
    stop = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return each.select("document_id", F.row_number().over(order).alias("at"), "text", (stop - F.length("text")).cast("int").alias("start"), stop.cast("int").alias("stop"))


def label_lines(rows: DataFrame, annexure: bool) -> DataFrame:
    """Lines of a table whose labels stand at its left edge, on one page, or of its annexure of sizes. rows: document_id, row_no, v, size."""
    line = lambda said, x: F.struct((F.lit(said) if isinstance(said, str) else said).alias("text"), F.lit(float(x)).alias("x0"))
    size = F.concat(F.col("size").cast("string"), F.lit(".00"))
    v = F.col("v")
    if annexure:
        cells = F.array(line(F.when(v == 4, "Subordinated debt").when(v == 3, "Perpetual bonds").otherwise("plain paper"), 20), line("INE000A01234", 80), line(F.when(v == 3, "0.00").otherwise(size), 200))
    else:
        label = F.when(v == 0, F.array(line("Long Term Bank", 10), line("Facilities", 11))).otherwise(F.array(line("Long Term Instruments", 10)))
        rating = F.when(v == 1, F.array(line("CARE AA;", 300), line("Stable", 300))).when(v == 3, F.array(line("-", 300))).otherwise(F.array(line("CARE A", 300)))
        cells = F.concat(label, F.array(line(F.when(v == 3, "-").otherwise(size), 200)), rating, F.array(line("Reaffirmed", 400), line("as before", 400)))
    each = rows.select("document_id", "row_no", F.posexplode(cells).alias("pos", "c"))
    order = Window.partitionBy("document_id").orderBy("row_no", "pos")
    stop = F.sum(F.length("c.text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return each.select("document_id", F.lit(1).alias("page_no"), F.row_number().over(order).alias("line_no"), F.col("c.text").alias("text"), (stop - F.length("c.text")).cast("int").alias("start"), stop.cast("int").alias("stop"), F.col("c.x0").alias("x0"))


def _cell(text: Column | str, x: float, y: Column | float) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x"), (F.lit(y) if isinstance(y, float) else y).cast("double").alias("y"))


def _rated(v: Column, y: Column) -> Column:
    """The lines of text of a rated row (its cells each), by the row's v: labels and ratings that wrap, an empty rating."""
    said = {0: (["NCDs Public", "Issue **"], ["BWR AA+", "Reaffirmed and", "removed Rating Watch", "with Negative", "Implications"]), 1: (["Commercial Paper"], ["BWR A1+ Reaffirmed"]), 2: (["Bank Loan"], ["-"]), 3: (["Secured NCD"], ["BWR A", "Assignment"])}
    out = None
    for k, (label, rating) in said.items():
        tenure = "Short Term" if k == 1 else "Long Term"
        first = F.array(_cell(label[0], 20.0, y), _cell(F.format_number(F.col("amount") + 7, 2), 100.0, y + 2), _cell(F.format_number("amount", 2), 170.0, y + 2), _cell(tenure, 250.0, y + 2), _cell("-" if k == 1 else "BWR AA", 320.0, y - 2), _cell(rating[0], 420.0, y - 4))
        more = [F.array(_cell(t, 20.0, y + 8)) for t in label[1:]] + [F.array(_cell(t, 420.0, y + 6 + 10 * n)) for n, t in enumerate(rating[1:])]
        lines = F.array(first, *more)
        out = F.when(v == k, lines) if out is None else out.when(v == k, lines)
    return out


def particulars_words(rows: DataFrame) -> DataFrame:
    """Words of tables without lines. rows: document_id, row_no, v, amount, undated (a head without the previous rating's date)."""
    y = (100 + F.col("row_no") * 60).cast("double")
    body = rows.select("document_id", F.col("row_no").alias("block"), F.posexplode(_rated(F.col("v"), y)).alias("line", "cells"))
    over = [[_cell("Particulars:", 10.0, 50.0)], [_cell("Instruments", 20.0, 60.0), _cell("Amount (Rs Crs)", 120.0, 60.0), _cell("Tenure", 250.0, 60.0), _cell("Rating", 340.0, 60.0)], [_cell("Previous", 100.0, 70.0), _cell("Present", 170.0, 70.0), _cell("Previous", 320.0, 70.0), _cell("Present", 420.0, 70.0)]]
    under = [[_cell("Total", 20.0, 350.0), _cell("9.00", 170.0, 350.0)], [_cell("*Please refer below", 10.0, 370.0)], [_cell("NCDs", 20.0, 380.0), _cell("9.00", 170.0, 380.0), _cell("Long Term", 250.0, 380.0), _cell("BWR B", 420.0, 380.0)]]
    pages = rows.groupBy("document_id").agg(F.max("undated").alias("undated"))
    fixed = lambda parts: F.array(*[F.array(*p) for p in parts])
    heads = F.when(F.col("undated"), fixed(over)).otherwise(fixed([*over, [_cell("(30th Sept 2024)", 310.0, 80.0)]]))
    around = pages.select("document_id", F.explode(F.array(F.struct(F.lit(0).alias("block"), heads.alias("lines")), F.struct(F.lit(99).alias("block"), fixed(under).alias("lines")))).alias("b"))
    around = around.select("document_id", F.col("b.block").alias("block"), F.posexplode("b.lines").alias("line", "cells"))
    cells = body.unionByName(around).select("document_id", (F.col("block") * 100 + F.col("line")).alias("line_no"), F.posexplode("cells").alias("pos", "c"))
    words = cells.select("document_id", "line_no", "pos", "c.x", "c.y", F.split("c.text", " ").alias("said")).select("*", F.posexplode("said").alias("k", "text"))
    left = F.col("x") + F.aggregate(F.slice("said", 1, F.col("k")), F.lit(0.0), lambda s, w: s + (F.length(w) + 1) * LETTER)
    order = Window.partitionBy("document_id").orderBy("line_no", "pos", "k")
    stop = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    set_ = words.withColumns({"x0": left, "word_no": F.row_number().over(order), "stop": stop.cast("int")})
    return set_.select("document_id", F.lit(1).alias("page_no"), "word_no", "line_no", "text", (F.col("stop") - F.length("text")).alias("start"), "stop", "x0", (F.col("y") - 4).alias("y0"), (F.col("x0") + F.length("text") * LETTER).alias("x1"), (F.col("y") + 4).alias("y1"))


def dated_lines(rows: DataFrame) -> DataFrame:
    """Lines of histories whose cells carry their dates. rows: document_id, row_no, name, amount, day, earlier, totalled, undated, unreadable; the third row stands on a second page."""
    y = (100 + F.col("row_no") * 40).cast("double")
    none = F.array().cast("array<struct<text:string,x:double,y:double>>")
    number = F.concat(F.col("amount").cast("string"), F.lit(".00"))
    later = F.when(F.col("undated"), F.array(_cell("Withdrawn", 385.0, y))).otherwise(F.array(_cell("BWR AA", 390.0, y - 5), _cell("(Stable)", 390.0, y + 5), _cell(F.date_format("day", "d MMM"), 390.0, y + 15), _cell(F.date_format("day", "yyyy"), 395.0, y + 25)))
    first = F.array(_cell(F.concat(F.lit("BWR A+ ("), F.date_format("earlier", "dd.MM.yyyy"), F.lit(")")), 470.0, y))
    cells = F.concat(F.array(_cell(F.col("name"), 30.0, y), _cell(number, 120.0, y + 4), _cell("BWR AA+", 190.0, y), _cell("Stable", 200.0, y + 10), _cell("BWR AA+", 290.0, y)), later, first, F.when(F.col("unreadable"), F.array(_cell("BWR said", 490.0, y + 10), _cell("3 May 2023", 490.0, y + 20))).otherwise(none))
    body = rows.select("document_id", F.when(F.col("row_no") < 3, 1).otherwise(2).alias("page_no"), F.col("row_no").alias("block"), F.posexplode(cells).alias("pos", "c"))
    heads = F.array(*[_cell(t, x, h) for t, x, h in (("Rating History", 10.0, 10.0), ("Sl", 5.0, 30.0), ("Instruments", 30.0, 30.0), ("Amount", 120.0, 30.0), ("Rating", 200.0, 30.0), ("(15 Sept", 290.0, 30.0), ("2025)", 300.0, 40.0), ("2024", 400.0, 30.0), ("2023", 500.0, 30.0))])
    ends = rows.groupBy("document_id").agg(F.sum("amount").alias("total"), F.max("totalled").alias("totalled"))
    total = F.when(F.col("totalled"), F.array(_cell("Total", 30.0, 300.0), _cell(F.concat(F.col("total").cast("string"), F.lit(".00")), 120.0, 300.0), _cell("BWR D", 290.0, 300.0))).otherwise(none)
    around = ends.select("document_id", F.explode(F.array(F.struct(F.lit(1).alias("page_no"), F.lit(0).alias("block"), heads.alias("l")), F.struct(F.lit(2).alias("page_no"), F.lit(9).alias("block"), F.concat(total, F.array(_cell("The end", 10.0, 340.0))).alias("l")))).alias("b"))
    around = around.select("document_id", "b.page_no", "b.block", F.posexplode("b.l").alias("pos", "c"))
    order = Window.partitionBy("document_id", "page_no").orderBy("block", "pos")
    every = body.unionByName(around).select("document_id", "page_no", "block", "pos", "c.text", "c.x", "c.y")
    stop = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    set_ = every.withColumns({"line_no": F.row_number().over(order), "stop": stop.cast("int")})
    return set_.select("document_id", "page_no", "line_no", "text", (F.col("stop") - F.length("text")).alias("start"), "stop", F.col("x").alias("x0"), (F.col("x") + F.length("text") * LETTER).alias("x1"), "y")
