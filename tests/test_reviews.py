"""Fixtures of page reading, tax returns, findings, debt tables and text functions."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evidence, pages, review
from factloom.plans import reviews

HTML = "<body><h1>Title</h1><table><tr><th>A<th>B</tr><tr><td> a&nbsp;1\r\n\t</td><td><p>in</p>b</td></tr></table><p>one<p>two <b>bold</b><br>end<p>  </p></body>"
WORD = "page_id long, block int, line int, word_no int, word string, x0 double, y0 double, x1 double, y1 double"


def test_units_of_html():
    got = [(path.rsplit("/", 1)[1], told) for path, _, told in pages.units_of(HTML)]
    assert got == [("h1[1]", "Title"), ("th[1]", "A"), ("th[2]", "B"), ("td[1]", " a\xa01\r\n\t"), ("td[2]", "inb"), ("p[1]", "in"), ("p[1]", "one"), ("p[2]", "two boldend")]
    assert pages.units_of(None) == pages.units_of("") == []


def test_table_cells(spark):
    frame = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>no table")], "page_id long, html string")
    got = pages.table_cells(pages.html_units(frame, "page_id", "html"), "page_id").where("table_path <> ''").collect()
    assert sorted((r.row_no, r.col_no, r.text) for r in got) == [(1, 1, "A"), (1, 2, "B"), (2, 1, "a 1"), (2, 2, "inb")]


def test_words_make_the_text_and_spans_make_rectangles(spark):
    rows = [(1, 0, 1, 0, "later", 10.0, 10.0, 20.0, 18.0), (1, 0, 0, 0, "Total", 0.0, 0.0, 10.0, 8.0), (1, 0, 0, 1, "sum", 11.0, 1.0, 30.0, 8.0), (1, 0, 0, 2, "", 31.0, 0.0, 32.0, 8.0)]
    words = spark.createDataFrame(rows, WORD)
    assert pages.page_texts(words).first().text == "Total sum\nlater"
    spans = spark.createDataFrame([(1, 1, 6, 12), (1, 2, 0, 9), (1, 3, 99, 100)], "page_id long, span_id int, start int, stop int")
    got = {r.span_id: ([tuple(x) for x in r.lines], tuple(r.bounds)) for r in pages.span_rects(words, spans).collect()}
    assert got == {1: ([(11.0, 1.0, 30.0, 8.0), (10.0, 10.0, 20.0, 18.0)], (10.0, 1.0, 30.0, 18.0)), 2: ([(0.0, 0.0, 30.0, 8.0)], (0.0, 0.0, 30.0, 8.0))}


@pytest.mark.parametrize(("whole", "quote", "want"), [("a  Total\nSum x", "total sum", [(3, 12)]), ("aaa", "AA", [(0, 2), (1, 3)]), ("x", "x", []), (None, "ab", []), ("ab", None, []), ("a.b acb", "a.b", [(0, 3)])])
def test_quotes(spark, whole, quote, want):
    row = spark.createDataFrame([(whole, quote)], "w string, q string").select(pages.quote_spans("w", "q").alias("s")).first()
    assert [tuple(s) for s in row.s] == want


@pytest.mark.parametrize(("told", "amount", "want"), [("(` in Crores)", "12.345678", ("declared", "12.345678")), ("(Rs. in lakhs) (₹ in million)", "5.25", ("declared", "0.52")), ("(in trillions)", "1", ("unknown_scale", None)), ("none", "1", ("undeclared", None)), (None, "1", ("undeclared", None))])
def test_stated_scales(spark, told, amount, want):
    row = pages.in_crores(spark.createDataFrame([(told, Decimal(amount))], "text string, amount decimal(24,6)")).first()
    assert (row.status, row.crores) == (want[0], want[1] and Decimal(want[1]))


@pytest.mark.parametrize(("quote", "value", "want"), [("Rs 1,234.50 paid", 1234.5, True), ("(99)", -99.0, True), ("12", 13.0, False), ("no", 1.0, False), (",", 1.0, False)])
def test_amounts_in_quotes(spark, quote, value, want):
    assert spark.createDataFrame([(quote, value)], "q string, v double").select(pages.amount_in(F.col("q"), F.col("v")).alias("x")).first().x is want


def test_tax_returns(spark):
    raws = ['{"ITR":{"ITR2":{"Form_ITR2":{"AssessmentYear":"2024"},"ScheduleS":{"TotalGrossSalary":5,"Salaries":[{"NameOfEmployer":"X"}]},"PartB-TI":{"TotalIncome":"?"}}}}', '{"insights":1}', "[]", "oops", None, '{"ITR":{"F":{}},"AckNo":"9"}']
    files = spark.createDataFrame(list(enumerate(raws)), "document_id long, raw string")
    got = {r.document_id: (r.json_type, r.form, r.acknowledged) for r in review.tax_returns(files).collect()}
    assert got == {0: ("return", "ITR2", False), 1: ("prefill", None, None), 2: ("unknown", None, None), 3: ("invalid", None, None), 4: ("invalid", None, None), 5: ("return", "F", True)}
    facts = {r.field: (r.value_text, r.value) for r in review.tax_facts(files).collect()}
    assert facts == {"gross_salary": ("5", Decimal(5)), "employer": ("X", None), "total_income": ("?", None), "assessment_year": ("AY 2024-25", None)}


def test_acknowledgements_settle_only_what_they_can(spark):
    rows = [(1, "returns", "7", "discrepancy", False, True), (1, "returns", "7", "discrepancy", False, True), (1, "obligation", "b:1", "confirm", True, False), (2, "gap", "x", "missing", False, True)]
    findings = spark.createDataFrame(rows, "case_id long, rule string, item string, kind string, blocking boolean, by_ack boolean")
    acks = spark.createDataFrame([(1, 1, "returns", "7"), (2, 1, "obligation", "b:1"), (3, 1, "gap", "x")], "ack_id long, case_id long, rule string, item string")
    done = review.settled(findings, acks)
    assert sorted((r.case_id, r.rule, r.resolved) for r in done.collect()) == [(1, "obligation", False), (1, "returns", True), (2, "gap", False)]
    totals = spark.createDataFrame([(1, 500), (3, 1)], "case_id long, total_included long")
    got = {r.case_id: (r.n_missing, r.n_discrepancy, r.n_confirm, r.n_blocking, r.n_resolved, r.total_included, r.state) for r in review.headline(done, totals).collect()}
    assert got == {1: (0, 0, 1, 1, 1, 500, "provisional"), 2: (1, 0, 0, 0, 0, 0, "computed"), 3: (0, 0, 0, 0, 0, 1, "computed")}


def test_debt_table(spark):
    rows = [("Br", 1, 50000), ("Br", 1, 50000), ("Co", 1, 50005), ("Ic", 2, 100), ("Ic", 2, 120)]
    totals = spark.createDataFrame([(i, 1, "c", b, s, i, a) for i, (s, b, a) in enumerate(rows)], "claim_id long, issuer_id long, basis string, as_of long, source_name string, published long, amount long")
    got = {r.as_of: (r.n_sources, r.low, r.changed_within, r.agreement) for r in evidence.debt_table(totals).collect()}
    assert got == {1: (2, 50000, False, "2 sources agree within 5"), 2: (1, 120, True, "single source")}


def test_debt_table_of_one_claim_stated_twice(spark):
    rows = [(7, 1, "c", 1, "Br", 5, a) for a in (50000, 50040)]
    for given in (rows, rows[::-1]):
        totals = spark.createDataFrame(given, "claim_id long, issuer_id long, basis string, as_of long, source_name string, published long, amount long").coalesce(1)
        assert [(r.low, r.changed_within) for r in evidence.debt_table(totals).collect()] == [(50040, True)]


def test_debt_table_keeps_the_first_row_of_equal_claims(spark, tmp_path):
    # one claim, stated twice alike in publication: the twin keeps the row that stands first in the table, the larger or not
    for first, second in ((10.0, 40.0), (40.0, 10.0)):
        lines = spark.createDataFrame([(507, 1, 1, 1, q, datetime(1995, 3, 2)) for q in (first, second)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp")
        lines.coalesce(1).write.parquet(f"{tmp_path}/{first}/lineitem.parquet")
        assert [r.low for r in reviews.QUERIES["debt_table"](spark, f"{tmp_path}/{first}").collect()] == [100000 + int(first)]


def test_debt_table_goes_by_the_number_that_is_given(spark):
    # the twin's number: a claim that is 200,000,000 later outweighs a month
    totals = spark.createDataFrame([(300000001, 1, "c", 1, "s", 199502, 10), (100000001, 1, "c", 1, "s", 199503, 40)], "claim_id long, issuer_id long, basis string, as_of long, source_name string, published long, amount long")
    got = [evidence.debt_table(totals, *n).first().low for n in ((), (F.col("published") * 100000000 + F.col("claim_id"),))]
    assert got == [40, 10]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.money, "1,234.50 Dr", Decimal("-1234.50")), (text.money, "-5.00", Decimal("-5.00")), (text.money, "7.5", None), (text.money, None, None), (text.money, "12.00 CR", Decimal("12.00")),
        (text.fiscal_end, "FY24", date(2024, 3, 31)), (text.fiscal_end, "Q2FY25", date(2024, 9, 30)), (text.fiscal_end, "2024", None),
        (text.masked_account, "12-345678", "XX5678"), (text.masked_account, "12", None), (text.display_name, "Perpetual Debt Perpetual Debt Instrument", "Perpetual Debt Instrument"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(f(F.col("x")).alias("y")).first().y == want


def test_text_fragments(spark):
    rows = spark.createDataFrame([("a-b c",), ("1 2 3 4 5 6 7 8 9",)], "q string").select(text.text_fragment(F.lit("http://h/p#x"), F.col("q")).alias("l")).collect()
    assert [r.l for r in rows] == ["http://h/p#:~:text=a%2Db%20c", "http://h/p#:~:text=1%202%203%204,6%207%208%209"]
