"""Rationales in HTML: tables known by shape, footnotes of their own table, group labels carried down, and what coverage tells."""

import random
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from factloom.operators import pages, rationales
from factloom.plans import printings


def table(*rows, body=""):
    lines = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
    return f"<table>{'<tbody>' if body else ''}{lines}{'</tbody>' if body else ''}</table>"


ANNEX = ["ISIN", "Name of instrument", "Allotted", "Coupon", "Maturity", "Issue size", "Level", "Rating"]
WHOLE = (
    "<body><p>January 27, 2026</p>"
    + table(["Rs.4,666.31 Crore Non Convertible Debentures&amp;", "Crisil AA/Stable (Reaffirmed)"], ["Rs.300 Crore Perpetual Bonds", "Crisil AA-/Stable (Reaffirmed)"], body="y")
    + "<p>&amp; Interchangeable between secured and subordinated debt</p>"
    + table(ANNEX, ["INE1", "Subordinated NCD&amp;#", "-", "9", "30-Jun-28", "12.5", "Simple", "Crisil AA/Stable"], ["INE1", "NCD", "-", "9", "7-365 days", "(1.5)", "Simple", "Crisil AA/Stable"])
    + "<p>&amp; For retail bond issuance # Interchangeable between secured and subordinated debt</p>"
    + table(ANNEX, ["INE9", "NCD", "-", "9", "30-Jun-28", "1", "Simple", "Withdrawn"])
    + table(["Instrument", "Type", "Outstanding", "Rating", "Date", "Rating", "Date", "Rating"], ["Commercial Paper", "ST", "5", "x", "27-01-26", "Crisil A1+", "30-10-25", "Crisil A1+"], ["", "", "", "", "06-01-23", "Withdrawn", "--", "--"])
    + "<p>Outlook: stable</p></body>"
)


def read(spark, *html):
    units = rationales.placed(pages.html_units(spark.createDataFrame(list(enumerate(html)), "document_id long, html string"), "document_id", "html"))
    return units, rationales.shapes(rationales.grid_rows(units))


def cover(units, rows):
    return rationales.coverage(units, rows, rationales.ratings(units, rows), rationales.instruments(rows), rationales.history(rows, rationales.published(units)), rationales.indicators(units, rows), rationales.prose(units))


@pytest.fixture(scope="module")
def whole(spark):
    return read(spark, WHOLE)


def test_a_symbol_means_what_its_own_table_says(whole):
    rated = rationales.ratings(*whole).collect()
    assert {(r.part, r.instrument, r.amount, r.grade, tuple(r.qualifiers)) for r in rated} == {
        ("action", "Non Convertible Debentures", D("4666.31"), "AA", ("interchangeable_subordinated",)),
        ("action", "Perpetual Bonds", D(300), "AA-", ()),
        ("annexure", "Subordinated NCD", None, "AA", ("retail", "interchangeable_subordinated")),
        ("annexure", "NCD", None, None, ()),
    }
    assert {r.note: r.action for r in rated if r.part == "annexure"} == {"|INE1|2028-06-30": None, "|INE9|withdrawn": "withdrawn"}
    units = {u.at: u.said for u in whole[0].collect()}
    (row,) = [r for r in rated if r.instrument == "Perpetual Bonds"]
    assert [units[k] for k in row.evidence] == ["Rs.300 Crore Perpetual Bonds", "Crisil AA-/Stable (Reaffirmed)"]


def test_every_listed_instrument_is_read_and_open_ends_are_no_date(whole):
    listed = rationales.instruments(whole[1]).collect()
    assert [(r.isin, r.maturity_date, r.amount) for r in sorted(listed, key=lambda r: -r.amount)] == [("INE1", date(2028, 6, 30), D("12.5")), ("INE1", None, D("-1.5"))]


def test_a_group_label_is_carried_down_and_the_own_date_left_out(whole):
    dated = rationales.history(whole[1], rationales.published(whole[0])).collect()
    assert sorted((r.instrument, r.action_date, r.withdrawn) for r in dated) == [("Commercial Paper", date(2023, 1, 6), True), ("Commercial Paper", date(2025, 10, 30), False)]
    assert {r.term for r in dated} == {"short_term"}


def test_a_rationale_says_what_it_lacks(spark):
    unread = WHOLE.replace("Crisil AA-/Stable (Reaffirmed)", "Rating to be confirmed")
    cut = WHOLE[: WHOLE.index("<table><tr><td>Instrument")] + "</body>"
    short = WHOLE.replace("<td>INE9</td><td>NCD</td>", "<td></td><td>NCD</td>").replace("<td>Simple</td><td>Withdrawn</td>", "")
    units, rows = read(spark, WHOLE, unread, cut, short, "<p>nothing</p>")
    got = {r.document_id: (r.status, r.missing) for r in cover(units, rows).collect()}
    assert got[0] == ("complete", [])
    assert got[1][0] == "incomplete" and any(m.startswith("no rating in the row of unit") for m in got[1][1])
    assert got[2][1] == ["no outlook", "no rating history entries"] and got[3][1] == ["unreadable annexure row 2"]
    assert got[4][1] == ["no instrument annexure", "no outlook", "no rating history entries", "no rating-action table"]


def test_indicators_need_a_heading_that_says_adjusted(spark):
    grid = table(["As on / for the year ended", "Unit", "December 31, 2025", "Mar 31, 2025/ FY25", "soon"], ["Total assets", "Rs crore", "81,342", "NA", "5"], ["Return on assets", "%", "(1.2)", "2.75", "-"], ["Odd", "kg", "1", "2", "3"])
    headed = "<p>Key financial indicators (standalone; Crisil-adjusted)</p>" + grid
    units, rows = read(spark, headed, "<p>Key financial indicators</p>" + grid, grid + "<p>Key financial indicators (standalone; adjusted)</p>")
    got = rationales.indicators(units, rows).collect()
    assert sorted((r.scope, r.slug, str(r.as_of), r.value, r.unit) for r in got if r.metric) == [("standalone", "return_on_assets", "2025-03-31", D("2.75"), "PERCENT"), ("standalone", "return_on_assets", "2025-12-31", D("-1.2"), "PERCENT"), ("standalone", "total_assets", "2025-12-31", D(81342), "INR_CRORE")]
    assert sorted(r.document_id for r in got if r.metric is None) == [1, 2]


def test_nested_tables_second_bodies_and_empty_documents(spark):
    nested = "<table><tr><td>" + table(["Facility", "Amount (Rs.Crore)", "Name of Lender"], ["Loan", "5", "A Bank"]) + "</td></tr></table>"
    twice = "<table><tbody><tr><td>Facility</td><td>Amount (Rs.Crore)</td><td>Name of Lender</td></tr></tbody><tbody><tr><td>later</td></tr></tbody></table>"
    units, rows = read(spark, nested, twice, "", None)
    assert [tuple(r)[:4] for r in rationales.lenders(rows).collect()] == [(0, "Loan", "A Bank", D(5))]
    assert rows.where("document_id = 1").select(F.col("cells")[0]["said"]).first()[0] == "later"
    assert rationales.grid_rows(units.where("false")).count() == 0


def test_what_is_written_for_readers_is_dealt_by_its_size_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(printings, "CUSTOMERS", 10)
    sf_dir = "/root/testdata/sf0.001"
    units = printings._units(spark, sf_dir)
    assert printings._tasks(spark, sf_dir, "customer", 10) == 15
    # by the size of its files this table would be broadcast, whole and from the driver
    plan = units.groupBy("document_id").count().join(units, "document_id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("html", ['<p class="a">x &amp; y<br>z</p>', "<p a=b>x</p><p>y", "a < b <p>c</p>", "<script><p>no</p></script><p>yes</p>", "<!-- <p>no</p> --><P>yes</P>", "<p>&lt;p&gt;</p ><td>q", '</p x="1"><p\n>r</p>', "<title><p>t</p></title>", ""])
def test_tags_are_cut_as_the_parser_cuts_them(html):
    reader = pages._Units()
    reader.feed(html)
    reader.close()
    whole = "".join(reader.text)
    told = [(path, tag, whole[start : len(whole) if end is None else end]) for path, tag, start, end in reader.ranges]
    assert pages.units_of(html) == [t for t in told if t[2].strip()]


def test_elements_that_hold_only_text_are_read_as_the_parser_reads_them():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<td>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "<li>", "</li>", "<ul>", "</ul>", "<br>", "</br>", "<div>", "</div>", "a", "&amp;", '<P class="x">', "<dt>", "<dd>", "</dd>", " ", "<p></p>", "<td>b</td>", "<th>c</th>", "<title>"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        reader = pages._Units()
        reader.feed(html)
        reader.close()
        whole = "".join(reader.text)
        assert pages.units_of(html) == [(path, tag, whole[start : len(whole) if end is None else end]) for path, tag, start, end in reader.ranges if whole[start : len(whole) if end is None else end].strip()]


def test_coverage_looks_through_each_part_once_and_units_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(printings, "CUSTOMERS", 10)
    sf_dir = "/root/testdata/sf0.001"
    plan = printings.rationale_coverage(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 18 and "LeftAnti" not in plan
    units = printings._units(spark, sf_dir)
    # a bucket is one file at most, written by the task that printed and read its documents
    assert 10 < len(units.inputFiles()) <= 15
    assert units.groupBy("document_id").agg(F.min("at").alias("a"), (F.max("at") - F.count("*")).alias("b")).where("a <> 1 OR b <> 0").count() == 0
