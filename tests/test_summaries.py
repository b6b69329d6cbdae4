"""Tables read line by line, against a plain loop over the lines."""

import random
import re
from datetime import date, datetime

import pytest

from factloom.operators import summaries as s
from factloom.plans import printings

LINES = "document_id long, at int, text string, start int, stop int"


def frame(spark, documents):
    rows = []
    for k, lines in enumerate(documents):
        place = 0
        for n, line in enumerate(lines):
            rows.append((k, n, line, place, place + len(line or "")))
            place += len(line or "") + 1
    return spark.createDataFrame(rows, LINES).repartition(5)


def plain_rated(lines):
    out, label, i = [], [], 0
    lines = [x.strip() for x in lines if x and x.strip()]
    is_amount = lambda k: k < len(lines) and bool(re.match(s.AMOUNT_CELL, lines[k]))
    while i < len(lines):
        if is_amount(i) and is_amount(i + 1):
            if not (i + 2 < len(lines) and re.search(s.RATING_BEGINS, lines[i + 2])):
                i += 1
                continue
            j = i + 2
            while True:
                j += 1
                following = lines[j] if j < len(lines) else ""
                if j >= len(lines) or (not following[:1].islower() and not lines[j - 1].endswith(",") and re.search(s.RATING_ENDS, lines[j - 1])):
                    break
            if label:
                out.append((" ".join(label[-6:]), lines[i], lines[i + 1], " ".join(lines[i + 2 : j])))
                label = []
            i = j
            continue
        if not re.match(s.HEAD_CELL, lines[i]):
            label.append(lines[i])
        i += 1
    return out


def plain_listed(lines):
    day = lambda x: datetime.strptime(x, "%b-%d-%Y").date() if re.match(r"^[A-Z][a-z]{2}-\d{2}-\d{4}$", x) else None
    amount = lambda x: bool(re.match(r"^-?[\d,]+(\.\d+)?$", x))
    lines = [x.strip() for x in lines if x and x.strip()]
    out, i = [], 0
    while i < len(lines):
        j = i + 1
        if re.match(s.ISIN_CELL, lines[i]):
            while j < len(lines) and not (day(lines[j]) or re.match(s.ISIN_CELL, lines[j])):
                j += 1
            if j > i + 1 and j + 3 < len(lines):
                if amount(lines[j + 3]):
                    out.append((lines[i], " ".join(lines[i + 1 : j]), day(lines[j]), lines[j + 1], day(lines[j + 2]), lines[j + 3]))
                    i = j + 4
                else:
                    i = j + 1
                continue
        i += 1
    return out


def test_rated_amounts_match_a_plain_loop(spark):
    rng = random.Random(3)
    pool = ["Non-convertible", "debentures", "Long-term", "1,000.00", "500.25", "-", "20.00", "[ICRA]AA (Stable); reaffirmed", "[ICRA]A1+; ", "PP-MLD[ICRA]AA,", "removed from", "(Stable)", "withdrawn", "assigned", "Instrument*", "Previous rated", "Total", "and Negative", "is reaffirmed", "Rating Action"]
    documents = [[rng.choice(pool) for _ in range(rng.randint(0, 40))] for _ in range(1500)]
    documents += [["NCD", "10.00", "20.00", "[ICRA]AA (Stable); reaffirmed", " ", None, "CP", "-", "5.00", "[ICRA]A1+; reaffirmed,", "then withdrawn", "Last", "1.00", "2.00", "[ICRA]A never ends"]] + [[str(k) + "th line" for k in range(9)] + ["1.00", "2.00", "[ICRA]D assigned"]]
    got = s.rated_amounts(frame(spark, documents)).orderBy("document_id", "row_no").collect()
    number = lambda x: None if x == "-" else float(x.replace(",", ""))
    want = [(k, label, number(a), number(b), rating) for k, lines in enumerate(documents) for label, a, b, rating in plain_rated(lines)]
    assert [(r.document_id, r.label, r.previous_amount and float(r.previous_amount), r.current_amount and float(r.current_amount), r.rating_text) for r in got] == want and len(want) > 60
    text = {k: "\n".join(x or "" for x in lines) for k, lines in enumerate(documents)}
    assert all(text[r.document_id][r.rating_start : r.rating_stop].split() == r.rating_text.split() for r in got)


def test_listed_instruments_match_a_plain_loop(spark):
    rng = random.Random(5)
    pool = ["INE000A07AB1", "INE111B08CD2", "NA", "Not placed", "NCD", "Series II", "Mar-05-2024", "Jun-30-2028", "9.50%", "250.00", "1,000", "Rated"]
    documents = [[rng.choice(pool) for _ in range(rng.randint(0, 60))] for _ in range(900)]
    documents += [["INE000A07AB1", "NCD", "Mar-05-2024", "NA", "NA", "25.00", "INE111B08CD2", "Sub", "debt", "NA", "9%", "Jun-30-2028", "1,250.50"], ["INE000A07AB1", "NCD", "Mar-05-2024", "9%"]]
    got = s.listed_instruments(frame(spark, documents)).orderBy("document_id", "row_no").collect()
    want = [(k, *row[:5], float(row[5].replace(",", ""))) for k, lines in enumerate(documents) for row in plain_listed(lines)]
    assert [(r.document_id, r.isin, r.name, r.issuance, r.coupon, r.maturity_date, float(r.amount)) for r in got] == want and len(want) > 60
    assert want[-1][5] == date(2028, 6, 30)


def test_blocks_by_their_heads_and_ends(spark):
    documents = [["x", "Summary of ratings", "a", "b", "*Note", "c"], ["Old head", "a", "Summary of ratings", "b"], ["none"], ["Old head", "z", "*Note"]]
    got = s.block(frame(spark, documents), ["Summary of ratings", "Old head"], ["*Note", "end"]).orderBy("document_id", "at").collect()
    assert [(r.document_id, r.text) for r in got] == [(0, "a"), (0, "b"), (1, "b"), (3, "z")]
    empty = frame(spark, documents).where("false")
    assert s.rated_amounts(empty).count() == 0 and s.listed_instruments(empty).count() == 0


@pytest.mark.parametrize("name", ["rated_amount_lines", "listed_instrument_lines", "printed_statement_rows"])
def test_pages_are_dealt_by_the_rows_of_their_table(spark, monkeypatch, name):
    monkeypatch.setattr(printings, "ORDERS", 100)
    plan = printings.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(document_id#\d+L?, 15\), REPARTITION_BY_NUM", plan)


def test_label_rows_are_read_once_and_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(printings, "ORDERS", 100)
    plan = printings.QUERIES["label_column_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 15 out of 15" in plan and "x0" not in plan


@pytest.mark.parametrize("name", ["rated_amount_lines", "listed_instrument_lines", "printed_statement_rows"])
def test_rows_are_numbered_where_their_table_is_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(printings, "ORDERS", 100)
    # a shuffle of the view's own, for its numbers, gives each task a part that grows with the table
    plan = printings.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_custkey" not in plan
