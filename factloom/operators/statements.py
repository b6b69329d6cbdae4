"""Account statements read from word boxes: header columns, transaction rows, the printed summary, and the checks of both.

Input: words (document_id, page_no, word_no, text, x0, y0, x1, y1) of the
statements' pages, and perhaps their drawn lines. Every page finds its own
header; a line with a date opens a row, lines without one carry it on, and a
footer, a wide gap or the next header ends it. All of it is windows over pages
and expressions over lines, so statements are read where their pages lie.

Defined results: pages without a header give no rows, documents without one are
named by `unread`; empty words are left out; nulls in a box leave the word out;
repeated boxes are read twice, as printed twice; rows whose amounts cannot be
told are listed as issues, never guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import reading
from factloom.operators.layout import PAGE, joined, lines_of, named_runs, page_lines, phrases, stacked, visual_lines

# fixed values: header phrases of a statement's columns
HEADERS = {
    "date": ["date", "txn date", "tran date", "transaction date", "post date"],
    "value_date": ["value dt", "value date"],
    "narration": ["narration", "description", "particulars", "remarks", "details", "transaction details"],
    "ref": ["chq./ref.no.", "chq/ref no", "chq./ref.no", "ref no", "cheque no", "chq no", "reference", "chq / ref no.", "ref no./cheque no."],
    "debit": ["withdrawal amt.", "withdrawal", "withdrawals", "debit", "debits", "dr amount", "withdrawal amt"],
    "credit": ["deposit amt.", "deposit", "deposits", "credit", "credits", "cr amount", "deposit amt"],
    "amount": ["amount", "amount (inr)", "transaction amount"],
    "balance": ["closing balance", "balance", "balance (inr)", "running balance"],
}
# fixed values: phrases that end the table on a page
STOPS = ["statement summary", "opening balance", "page no", "this is a computer generated", "generated on", "end of statement", "contents of this statement", "registered office", "*closing balance includes", "state account branch"]
# fixed values: words by which a stacked header's column is told, the first that fits decides (each: any of these, or for value_date both)
STACKED = [
    ("narration", ["remark", "narration", "description", "particular", "details"]),
    ("debit", ["withdraw", "debit"]),
    ("credit", ["deposit", "credit"]),
    ("balance", ["balance"]),
    ("ref", ["chq", "cheque", "ref"]),
    ("date", ["date"]),
    ("amount", ["amount"]),
]
SERIAL = ["sno", "slno", "srno", "#"]
# fixed values: an amount has two decimals; a marker may follow it or stand alone
AMOUNT = r"^(-?)([\d,]*\d\.\d{2})(Dr|Cr|DR|CR)?$"
MARKERS = ["dr", "cr", "dr.", "cr."]
# fixed values: labels of the printed summary
SUMMARY = {
    "opening_balance": ["opening balance"],
    "closing_balance": ["closing bal", "closing balance"],
    "total_debits": ["debits", "total debits", "total withdrawals"],
    "total_credits": ["credits", "total credits", "total deposits"],
    "debit_count": ["dr count"],
    "credit_count": ["cr count"],
}
SUMMARY_VALUE = r"^-?[\d,]+(?:\.\d{2})?(?:Dr|Cr)?$"
# fixed values, in points: heights that share a line, the gap inside a phrase, the way down a stacked header and from a row to what carries it on,
# how far left of the first amount column amounts begin, how far text may lie left of its column, and how far a summary's value may lie from its label
LINE, PHRASE_GAP, STACK_GAP, ROW_GAP, AMOUNT_SLACK, TEXT_SLACK, INSIDE, LABEL_REACH = 2.5, 6.0, 14.0, 40.0, 12.0, 4.0, 2.0, 80.0
# fixed values: lines that divide a table: at least so many
LEAST_RULES = 3

_COLUMN = "array<struct<kind:string,x0:double,x1:double>>"
_AMOUNTS = ("debit", "credit", "balance", "amount")
_NAMES = {name: kind for kind, names in HEADERS.items() for name in names}
_MONEY = "decimal(20,2)"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _complete(columns: Column) -> Column:
    """columns, if they make a statement's table; else null."""

    def told(columns: Column) -> Column:
        has = lambda k: F.exists(columns, lambda c: c["kind"] == k)
        return F.when(has("date") & has("balance") & ((has("debit") & has("credit")) | has("amount")), columns)

    return _once(columns, told)


def _merged(columns: Column) -> Column:
    """Neighbouring columns of one kind as one."""

    def add(made: Column, c: Column) -> Column:
        last = F.try_element_at(made, F.lit(-1))
        wider = F.struct(last["kind"].alias("kind"), last["x0"].alias("x0"), c["x1"].alias("x1"))
        return F.when(last["kind"] == c["kind"], F.concat(F.slice(made, 1, F.size(made) - 1), F.array(wider))).otherwise(F.concat(made, F.array(c)))

    return F.aggregate(columns, F.array().cast(_COLUMN), add)


def _stacked_kind(said: Column) -> Column:
    low = F.lower(said)
    value = low.contains("value") & (low.contains("dt") | low.contains("date"))
    told = F.when(value, "value_date")
    for kind, words in STACKED:
        told = told.when(reduce(Column.__or__, [low.contains(w) for w in words]), kind)
    return told.when(F.regexp_replace(low, "[. ]", "").isin(SERIAL), "serial")


def _stacked_columns(lines: list[Column]) -> Column:
    found = stacked(F.concat(*[phrases(words, PHRASE_GAP) for words in lines]))
    named = F.transform(found, lambda s: F.struct(_stacked_kind(s["text"]).alias("kind"), s["x0"].alias("x0"), s["x1"].alias("x1")))
    return _complete(F.filter(named, lambda c: c["kind"].isNotNull()))


def with_headers(lines: DataFrame) -> DataFrame:
    """lines with `columns` where a header begins, and `n_header`, how many lines it takes."""
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    # every header names both a date and a balance, in the lines that it takes: the words of other lines are not carried along
    near = lines.withColumn("__said", F.lower("text"))
    for k in (1, 2):
        near = near.withColumn(f"__said{k}", F.lead("__said", k).over(down)).withColumn(f"__y{k}", F.lead("line_y", k).over(down))

    def may(k: int) -> Column:
        names = lambda word: reduce(Column.__or__, [F.coalesce(F.col(c).contains(word), F.lit(False)) for c in ("__said", "__said1", "__said2")[:k]])
        return names("date") & names("balance")

    near = near.withColumns({f"__may{k}": may(k) for k in (1, 2, 3)}).drop("__said", "__said1", "__said2")
    asked = F.coalesce(F.lag("__may3", 1).over(down), F.lit(False)) | F.coalesce(F.lag("__may3", 2).over(down), F.lit(False))
    near = near.withColumn("__asked", F.when(asked, F.col("words")))
    for k in (1, 2):
        near = near.withColumn(f"__w{k}", F.lead("__asked", k).over(down))
    single = _complete(_merged(named_runs(F.col("words"), _NAMES, 3)))
    close1, close2 = F.col("__y1") - F.col("line_y") <= STACK_GAP, F.col("__y2") - F.col("__y1") <= STACK_GAP
    two = F.when(close1, _stacked_columns([F.col("words"), F.col("__w1")]))
    three = F.when(close1 & close2, _stacked_columns([F.col("words"), F.col("__w1"), F.col("__w2")]))
    named = near.withColumn("__one", F.when(F.col("__may1"), single)).withColumn("__two", F.when(F.col("__may2") & F.col("__one").isNull(), two))
    named = named.withColumn("__three", F.when(F.col("__may3") & F.col("__one").isNull() & F.col("__two").isNull(), three))
    size = F.when(F.col("__one").isNotNull(), 1).when(F.col("__two").isNotNull(), 2).when(F.col("__three").isNotNull(), 3)
    named = named.withColumn("__n", size).withColumn("columns", F.coalesce("__one", "__two", "__three"))
    # a header takes its lines: one that would begin inside another is none
    mine = F.collect_list(F.when(F.col("__n").isNotNull(), F.struct("line_no", F.col("__n").alias("n")))).over(Window.partitionBy(*PAGE))

    def take(taken: Column, h: Column) -> Column:
        last = F.try_element_at(taken, F.lit(-1))
        return F.when(h["line_no"] < last["line_no"] + last["n"], taken).otherwise(F.concat(taken, F.array(h)))

    named = named.withColumn("__mine", mine)
    kept = F.when(F.size("__mine") < 2, F.col("__mine")).otherwise(F.aggregate(F.array_sort("__mine"), F.array().cast("array<struct<line_no:int,n:int>>"), take))
    named = named.withColumn("__kept", kept)
    own = F.try_element_at(F.filter("__kept", lambda h: h["line_no"] == F.col("line_no")), F.lit(1))
    inside = F.exists("__kept", lambda h: (F.col("line_no") > h["line_no"]) & (F.col("line_no") < h["line_no"] + h["n"]))
    named = named.withColumn("n_header", own["n"]).withColumn("in_header", inside | own.isNotNull()).withColumn("columns", F.when(own.isNotNull(), F.col("columns")))
    return named.drop("__w1", "__w2", "__y1", "__y2", "__may1", "__may2", "__may3", "__asked", "__mine", "__one", "__two", "__three", "__n", "__kept")


def _ruled(words: DataFrame, rules: DataFrame) -> DataFrame:
    """words with zone and line_y where drawn lines make the rows: each band between two of them under the header is one line.

    rules: document_id, page_no, direction (h or v), position.
    """
    drawn = rules.groupBy(*PAGE).agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "h", F.col("position").cast("double")))).alias("__h"), F.array_sort(F.collect_set(F.when(F.col("direction") == "v", F.col("position").cast("double")))).alias("__v")
    )
    headed = with_headers(lines_of(visual_lines(words, LINE))).where("n_header IS NOT NULL")
    first = headed.groupBy(*PAGE).agg(F.min(F.struct("line_no", "n_header")).alias("h"))
    lined = visual_lines(words, LINE).join(first, PAGE, "left").join(drawn, PAGE, "left")
    in_head = F.col("line_no").between(F.col("h.line_no"), F.col("h.line_no") + F.col("h.n_header") - 1)
    bottom = F.max(F.when(in_head, F.col("y1"))).over(Window.partitionBy(*PAGE))
    lined = lined.withColumn("__bottom", bottom).withColumn("__below", F.filter("__h", lambda y: y > F.col("__bottom")))
    banded = F.coalesce(F.size("__below") >= LEAST_RULES, F.lit(False))
    under = F.col("line_no") > F.col("h.line_no") + F.col("h.n_header") - 1
    above = F.array_max(F.filter("__below", lambda y: y < F.col("yc")))
    on_rule = F.array_contains("__below", F.col("yc"))
    last = F.array_max("__below")
    zone = F.when(~banded | ~under, 0).when(F.col("yc") > last, 2).when(above.isNotNull() & ~on_rule, 1)
    return lined.withColumn("banded", banded).withColumn("zone", zone).withColumn("band", F.when(F.col("zone") == 1, above)).where("zone IS NOT NULL").select(*words.columns, "zone", "band", "banded", F.col("__v").alias("verticals"))


def _placed_words(words: DataFrame, rules: DataFrame | None) -> DataFrame:
    """The words with their lines: as they lie, or by the bands that drawn lines make."""
    if rules is None:
        return visual_lines(words, LINE).withColumn("banded", F.lit(False)).withColumn("verticals", F.lit(None).cast("array<double>"))
    zoned = _ruled(words, rules)
    free = visual_lines(zoned.where("zone <> 1"), LINE, ("zone",)).drop("line_no")
    bands = zoned.where("zone = 1").withColumn("yc", (F.col("y0") + F.col("y1")) / 2).withColumn("line_y", F.col("band")).withColumn("row_at", F.rint("yc"))
    both = free.unionByName(bands, allowMissingColumns=True)
    # in a band a word wrapped above or below still belongs to the row: by rounded height, then from the left
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("zone", "line_y"))
    return both.withColumn("line_no", number).drop("zone", "band")


def _held(columns: Column, money: Column) -> Column:
    """What the words of a table ask of its columns: the columns, those of amounts (money), where the first of these begins, and for text where each column begins and what it is called there."""
    lefts = F.transform(columns, lambda c: F.when(c["kind"].isin(*_AMOUNTS), "overflow").otherwise(c["kind"]))
    return F.struct(columns.alias("columns"), money.alias("money"), F.array_min(F.transform(money, lambda c: c["x0"])).alias("first"), F.transform(columns, lambda c: c["x0"] - TEXT_SLACK).alias("edges"), lefts.alias("lefts"))


def _assigned(w: Column, held: Column, snapped: Column) -> Column:
    """The kind of column that a word stands in; columns follow each other from the left."""
    middle = (w["x0"] + w["x1"]) / 2
    near = F.array_min(F.transform(held["money"], lambda c, i: F.struct(F.least(F.abs(w["x1"] - c["x1"]), F.abs(middle - (c["x0"] + c["x1"]) / 2)).alias("d"), i.alias("i"), c["kind"].alias("kind"))))
    boxed = F.try_element_at(F.filter(held["columns"], lambda c: ~c["kind"].isin(*_AMOUNTS) & middle.between(c["x0"] - INSIDE, c["x1"] + INSIDE)), F.lit(1))
    return (
        F.when((w["x1"] >= held["first"] - AMOUNT_SLACK) & w["text"].rlike(AMOUNT), near["kind"])
        .when((w["x0"] >= held["first"] - AMOUNT_SLACK) & F.lower(w["text"]).isin(MARKERS), "marker")
        .when(snapped & boxed.isNotNull(), boxed["kind"])
        .otherwise(F.element_at(held["lefts"], F.greatest(F.size(F.filter(held["edges"], lambda e: e <= w["x0"])), F.lit(1))))
    )


def _money(w: Column) -> Column:
    """amount and marker (Dr, Cr or -) of a printed amount; null otherwise."""
    value = F.regexp_replace(F.regexp_extract(w, AMOUNT, 2), ",", "").try_cast(_MONEY)
    marker = F.when(F.regexp_extract(w, AMOUNT, 1) == "-", "-").otherwise(F.initcap(F.nullif(F.regexp_extract(w, AMOUNT, 3), F.lit(""))))
    return F.when(w.rlike(AMOUNT), F.struct(value.alias("amount"), marker.alias("marker")))


def _used(words: DataFrame) -> DataFrame:
    return words.where("text <> '' AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL")


def table_lines(words: DataFrame, rules: DataFrame | None = None, summed: bool = False) -> DataFrame:
    """The lines of each page's tables: segment (a header and what follows), txn (0 before the first date), said date, and cells (kind, text, word_no). summed: with what its document's summary states (stated), read from the same lines."""
    used = _used(words)
    if rules is None:
        lines = page_lines(used, LINE)
        marked = with_headers(_with_stated(lines) if summed else lines)
        banded, snapped = F.lit(False), F.lit(False)
    else:
        placed = _placed_words(used, rules)
        marks = placed.groupBy(*PAGE).agg(F.bool_or("banded").alias("banded"), F.first("verticals", ignorenulls=True).alias("verticals"))
        lines = lines_of(placed)
        marked = with_headers(_with_stated(lines) if summed else lines).join(marks, PAGE)
        banded, snapped = F.col("banded"), F.coalesce(F.size("verticals") >= LEAST_RULES, F.lit(False))
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)

    def snap(c: Column) -> Column:
        middle = (c["x0"] + c["x1"]) / 2
        left, right = F.array_max(F.filter("verticals", lambda v: v <= middle)), F.array_min(F.filter("verticals", lambda v: v >= middle))
        both = left.isNotNull() & right.isNotNull()
        return F.struct(c["kind"].alias("kind"), F.when(both, left).otherwise(c["x0"]).alias("x0"), F.when(both, right).otherwise(c["x1"]).alias("x1"))

    own = F.when(snapped, F.transform("columns", snap)).otherwise(F.col("columns")) if rules is not None else F.col("columns")
    # what the words of a table ask of its columns is worked out at its header
    headed = marked.withColumn("snapped", snapped).withColumn("columns", own).withColumn("__money", F.filter("columns", lambda c: c["kind"].isin(*_AMOUNTS)))
    held = F.when(F.col("columns").isNotNull(), _held(F.col("columns"), F.col("__money")))
    carried = headed.withColumn("held", held).withColumn("held", F.last("held", ignorenulls=True).over(so_far)).withColumn("segment", F.count("n_header").over(so_far))
    body = carried.where("held IS NOT NULL AND NOT in_header")
    cells = body.withColumn("cells", F.transform("words", lambda w: F.struct(_assigned(w, F.col("held"), F.col("snapped") if rules is not None else snapped).alias("kind"), w["text"].alias("text"), w["word_no"].alias("word_no"))))
    of = lambda kind: F.array_join(F.transform(F.filter("cells", lambda c: c["kind"] == kind), lambda c: c["text"]), " ")
    dated = cells.withColumn("__said", of("date")).withColumn("day", F.when(F.col("__said") != "", reading.statement_date(F.col("__said")))).withColumn("__value", of("value_date"))
    dated = dated.withColumn("value_day", F.when(F.col("__value") == F.col("__said"), F.col("day")).when(F.col("__value") != "", reading.statement_date(F.col("__value"))))
    low = F.lower("text")
    stop = reduce(Column.__or__, [low.contains(s) for s in STOPS])
    inside = Window.partitionBy(*PAGE, "segment").orderBy("line_no")
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    # a stop counts as no row of its own; in a banded table a row without a date carries nothing on
    stepped = dated.withColumn("banded", banded).withColumn("__stop", stop).withColumn("__open", F.when(~F.col("__stop") & F.col("day").isNotNull(), 1).otherwise(0)).withColumn("txn", F.sum("__open").over(until))
    gap = ~F.col("banded") & F.col("day").isNull() & (F.col("txn") > 0) & (F.coalesce(F.lag("txn").over(inside), F.lit(0)) > 0) & (F.col("line_y") - F.lag("line_y").over(inside) > ROW_GAP)
    ended = stepped.withColumn("__end", (F.col("__stop") | gap).cast("int")).withColumn("__ended", F.max("__end").over(until))
    kept = ended.where("__ended = 0 AND txn > 0 AND NOT (banded AND day IS NULL)")
    return kept.select(*PAGE, "segment", "txn", "line_no", "day", "value_day", "cells", *(["stated"] if summed else []))


def statement_rows(words: DataFrame, rules: DataFrame | None = None, summed: bool = False) -> DataFrame:
    """One row a printed transaction: document_id, seq, page_no, txn_date, value_date, narration, ref, debit, credit, balance, word_nos, evidence_text, issue.

    seq numbers the rows that were read; one that was not has a null seq and says why in `issue`. summed: with what the
    document's summary states (stated: field, value), so that the pages need not be read a second time for it.
    """
    lines = table_lines(words, rules, summed)
    # a line's last marker, and its cells with the overflowing ones last; a row's lines then follow each other
    markers = F.filter("cells", lambda c: c["kind"] == "marker")
    marker = F.regexp_replace(F.initcap(F.try_element_at(markers, F.lit(-1))["text"]), r"\.$", "")
    ordered = F.when(F.exists("cells", lambda c: c["kind"] == "overflow"), F.concat(F.filter("cells", lambda c: c["kind"] != "overflow"), F.filter("cells", lambda c: c["kind"] == "overflow"))).otherwise(F.col("cells"))
    told = lines.withColumn("line", F.struct("line_no", "day", "value_day", marker.alias("marker"), ordered.alias("cells")))
    grouped = told.groupBy(*PAGE, "segment", "txn").agg(F.array_sort(F.collect_list("line")).alias("lines"), *([F.first("stated").alias("stated")] if summed else []))
    marked = lambda x: F.transform(F.filter(x["cells"], lambda c: c["kind"].isin(*_AMOUNTS)), lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text"), x["marker"].alias("marker")))
    each = grouped.withColumn("all", F.flatten(F.transform("lines", lambda x: x["cells"]))).withColumn("money", F.flatten(F.transform("lines", marked)))
    of = lambda kind: F.filter("money", lambda c: c["kind"] == kind)
    parts = each.withColumns({k: of(k) for k in _AMOUNTS})
    only = lambda c: F.when(F.size(c) == 1, _money(F.get(c, F.lit(0))["text"])["amount"])
    said = lambda *kinds: F.array_join(F.transform(F.filter("all", lambda c: c["kind"].isin(*kinds)), lambda c: c["text"]), " ")
    told = parts.withColumn("marker", F.try_element_at(F.filter("amount", lambda c: c["marker"].isNotNull()), F.lit(-1))["marker"])
    last = F.try_element_at("balance", F.lit(-1))
    told = told.withColumn("last", F.struct(_money(last["text"]).alias("money"), last["marker"].alias("marker")))
    has_amount = F.size("amount") > 0
    unmarked = has_amount & ~F.coalesce(F.col("marker").isin("Dr", "Cr"), F.lit(False))
    debit = F.when(has_amount & (F.col("marker") == "Dr"), only("amount")).otherwise(only("debit"))
    credit = F.when(has_amount & (F.col("marker") == "Cr"), only("amount")).otherwise(only("credit"))
    taken = F.coalesce(F.col("last.money.marker"), F.col("last.marker")).isin("Dr", "-")
    placed = F.array_sort(F.transform("all", lambda c: F.struct(c["word_no"].alias("word_no"), c["text"].alias("text"))))
    read = told.select(
        *PAGE, "segment", "txn", F.array_max(F.transform("lines", lambda x: x["day"])).alias("txn_date"), F.get(F.filter(F.transform("lines", lambda x: x["value_day"]), lambda d: d.isNotNull()), F.lit(0)).alias("value_date"),
        F.trim(said("narration", "overflow")).alias("narration"), F.nullif(said("ref"), F.lit("")).alias("ref"),
        debit.alias("debit"), credit.alias("credit"), F.when(taken, -F.col("last.money.amount")).otherwise(F.col("last.money.amount")).alias("balance"),
        F.transform(placed, lambda w: w["word_no"]).alias("word_nos"), joined(placed).alias("evidence_text"), unmarked.alias("unmarked"), *(["stated"] if summed else []),
    )
    neither = F.col("debit").isNull() & F.col("credit").isNull()
    issue = F.when(F.col("unmarked"), "an amount without a Dr/Cr marker; not read").when(neither, "no withdrawal or deposit amount; not read").when(F.col("debit").isNotNull() & F.col("credit").isNotNull(), "both a withdrawal and a deposit; kept")
    told = read.withColumn("issue", issue).withColumn("__read", ~F.col("unmarked") & ~neither)
    order = Window.partitionBy("document_id").orderBy("page_no", "segment", "txn").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("__read"), F.sum(F.col("__read").cast("int")).over(order)).cast("long")
    kept = ["document_id", "seq", "page_no", "txn_date", "value_date", "narration", "ref", "debit", "credit", "balance", "word_nos", "evidence_text", "issue"]
    return told.withColumn("seq", number).select(*kept, *(["stated"] if summed else []))


def unread(words: DataFrame) -> DataFrame:
    """document_id of the documents that no page of shows a statement's header."""
    headed = with_headers(page_lines(_used(words), LINE)).where("n_header IS NOT NULL")
    return words.select("document_id").distinct().join(headed.select("document_id").distinct(), "document_id", "left_anti")


def _stated(words: Column, values: Column) -> Column:
    """What a line of labels states by the values under it: field and value, of a field that is named twice the first."""
    names = {name: field for field, names in SUMMARY.items() for name in names}
    labels = F.transform(named_runs(words, names, 2), lambda r: F.struct(r["kind"].alias("field"), ((r["x0"] + r["x1"]) / 2).alias("xc")))

    def told(label: Column) -> Column:
        near = F.array_min(F.transform(values, lambda w, i: F.struct(F.abs((w["x0"] + w["x1"]) / 2 - label["xc"]).alias("d"), i.alias("i"), w["text"].alias("text"))))
        return F.struct(label["field"].alias("field"), near.alias("near"))

    def value(t: Column) -> Column:
        said, money = t["near"]["text"], _money(t["near"]["text"])
        whole = F.when(F.regexp_replace(said, ",", "").rlike(r"^\d+$"), F.regexp_replace(said, ",", "").try_cast(_MONEY))
        return F.struct(t["field"].alias("field"), F.when(t["field"].endswith("_count"), whole).when(money["marker"].isin("Dr", "-"), -money["amount"]).otherwise(money["amount"]).alias("value"))

    def read(labels: Column) -> Column:
        first = F.filter(labels, lambda r, i: ~F.exists(F.slice(labels, 1, i), lambda q: q["field"] == r["field"]))
        near = F.filter(F.transform(first, told), lambda t: t["near"]["d"] <= LABEL_REACH)
        return F.when((F.size(labels) >= 2) & (F.size(values) > 0), F.filter(F.transform(near, value), lambda t: t["value"].isNotNull()))

    return _once(labels, read)


def _summaries(lines: DataFrame) -> DataFrame:
    """lines with __told: where a line of labels has values under it, its page, number and what it states."""
    down = Window.partitionBy(*PAGE).orderBy("line_no")
    low = F.lower("text")
    labelled = low.contains("opening") & low.contains("closing")
    following = lines.withColumn("__next", F.lead("words").over(down))
    under = following.withColumn("__values", F.when(labelled & F.col("__next").isNotNull(), F.filter("__next", lambda w: w["text"].rlike(SUMMARY_VALUE)))).drop("__next")
    stated = under.withColumn("__stated", F.when(F.size("__values") > 0, _stated(F.col("words"), F.col("__values"))))
    return stated.withColumn("__told", F.when(F.col("__stated").isNotNull(), F.struct("page_no", "line_no", F.col("__stated").alias("stated")))).drop("__values", "__stated")


def _with_stated(lines: DataFrame) -> DataFrame:
    """lines with what their document's summary states, null without one."""
    first = F.min("__told").over(Window.partitionBy("document_id"))
    return _summaries(lines).withColumn("stated", first["stated"]).drop("__told")


def statement_summary(words: DataFrame) -> DataFrame:
    """The summary that a statement prints (document_id, field, value): of its first line of labels that has values under it."""
    first = _summaries(page_lines(_used(words), LINE)).where("__told IS NOT NULL").groupBy("document_id").agg(F.min("__told").alias("s"))
    return first.select("document_id", F.explode("s.stated").alias("f")).select("document_id", "f.field", "f.value")


def statement_checks(rows: DataFrame, summary: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """One row a document with rows: its totals, opening and closing with their basis, the balance identity, breaks of the running balance, and issues.

    summary: statement_summary; without it the rows carry what theirs states (`summed`). periods: document_id, period_start, period_end.
    """
    zero = F.lit(0).cast(_MONEY)
    read = rows.where("seq IS NOT NULL").withColumn("__d", F.coalesce("debit", zero)).withColumn("__c", F.coalesce("credit", zero))
    order = Window.partitionBy("document_id").orderBy("seq")
    if summary is None:
        stated = lambda f: F.get(F.filter("stated", lambda s: s["field"] == f), F.lit(0))["value"]
        known = read.withColumns({f"stated_{f}": stated(f) for f in SUMMARY})
    else:
        known = read.join(summary.groupBy("document_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"stated_{f}") for f in SUMMARY]), "document_id", "left")
    first = F.first(F.when(F.col("seq") == 1, F.col("balance") - F.col("__c") + F.col("__d"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("__first", first).withColumn("opening_balance", F.coalesce("stated_opening_balance", "__first"))
    before = F.coalesce(F.last("balance", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("opening_balance"))
    broken = F.col("balance").isNotNull() & (F.abs(before + F.col("__c") - F.col("__d") - F.col("balance")) >= 0.01)
    known = known.withColumn("__broken", F.coalesce(broken, F.lit(False)))
    if periods is not None:
        known = known.join(periods.select("document_id", "period_start", "period_end"), "document_id", "left").withColumn("__outside", F.coalesce(~F.col("txn_date").between(F.col("period_start"), F.col("period_end")), F.lit(False)))
    else:
        known = known.withColumn("__outside", F.lit(False))
    told = known.groupBy("document_id").agg(
        F.count("*").alias("n_rows"), F.sum("__d").cast(_MONEY).alias("total_debits"), F.sum("__c").cast(_MONEY).alias("total_credits"), F.count(F.when(F.col("debit") > 0, 1)).alias("debit_count"), F.count(F.when(F.col("credit") > 0, 1)).alias("credit_count"),
        F.min_by("txn_date", "seq").alias("first_date"), F.max_by("txn_date", "seq").alias("last_date"), F.max("opening_balance").alias("opening_balance"), F.max("stated_opening_balance").isNotNull().alias("opening_stated"),
        F.max_by("balance", "seq").alias("__last"), F.count("balance").alias("running_rows"), F.count(F.when(F.col("__broken"), 1)).alias("n_breaks"), F.count(F.when(F.col("__outside"), 1)).alias("n_outside"),
        *[F.max(f"stated_{f}").alias(f"stated_{f}") for f in SUMMARY if f != "opening_balance"],
    )
    told = told.withColumn("closing_balance", F.coalesce("stated_closing_balance", "__last")).withColumn("closing_stated", F.col("stated_closing_balance").isNotNull())
    difference = (F.col("closing_balance") - (F.col("opening_balance") + F.col("total_credits") - F.col("total_debits"))).cast(_MONEY)
    told = told.withColumn("difference", difference).withColumn("reconciled", F.abs("difference") < 0.01)
    issues = [F.when(F.col("difference").isNull(), "opening or closing balance not found")]
    for f in ("total_debits", "total_credits", "debit_count", "credit_count"):
        issues.append(F.when(F.col(f"stated_{f}") != F.col(f), F.lit(f"stated {f.replace('_', ' ')} differ from the rows read")))
    issues += [F.when(~F.col("reconciled"), "the balance identity fails"), F.when(F.col("n_breaks") > 0, "the running balance breaks"), F.when(F.col("n_outside") > 0, "rows dated outside the stated period")]
    kept = ["document_id", "n_rows", "total_debits", "total_credits", "debit_count", "credit_count", "first_date", "last_date", "opening_balance", "opening_stated", "closing_balance", "closing_stated", "difference", "reconciled", "running_rows", "n_breaks", "n_outside"]
    return told.select(*kept, F.array_compact(F.array(*issues)).alias("issues"))
