"""Statements from word boxes: a synthetic case of two overlapping statements, other layouts, drawn lines, and what cannot be read."""

import calendar
from datetime import date
from decimal import Decimal as D

import pytest
from boxes import WORDS, Pages
from pyspark.sql import functions as F

from factloom.operators import layout, ledger, statements

AT = {"date": 28, "narration": 70, "ref": 232, "value": 318, "debit": 418, "credit": 488, "balance": 568}


def money(v):
    whole, cents = f"{abs(v):.2f}".split(".")
    head, tail = whole[:-3], whole[-3:]
    groups = []
    while head:
        groups.insert(0, head[-2:])
        head = head[:-2]
    return ("-" if v < 0 else "") + ",".join([*groups, tail]) + "." + cents


def case_rows():
    """Nine transactions a month for four months, with the running balance."""
    balance, out = D("145210.50"), []
    for month, salary, interest in ((6, "102750", "1512.33"), (7, "102750", "1488.90"), (8, "107750", "1530.12"), (9, "104250", "1497.41")):
        debits = [(2, "UPI-FRESHMART STORES-freshmart@okbank-UPI", "2345"), (5, "ACH D- BAJAJ FINANCE LTD-P400ZZ5678", "18450"), (7, "NACH DR ICICI BANK LTD AUTO LOAN UMRN ICIC70009876", "12300"), (10, "ACH D- TATA CAPITAL LTD-OD INTEREST", interest)]
        debits += [(12, "ACH D- KREDITBEE-KB778899", "4999"), (15, "CC 000412XXXXXX9012 AUTOPAY SI-TAD", "15000"), (20, "IMPS-RAMESH KUMAR-SBIN0001234-HOUSE RENT", "25000"), (25, "UPI-SWIGGY-swiggy@axisbank-UPI", "640")]
        rows = [(date(2026, month, d), n, D(v), None) for d, n, v in debits] + [(date(2026, month, calendar.monthrange(2026, month)[1]), "NEFT CR-CITI0000002-NORTHWIND ANALYTICS-SALARY", None, D(salary))]
        for day, said, debit, credit in rows:
            balance += (credit or 0) - (debit or 0)
            out.append((day, said, f"REF{day:%m%d}", debit, credit, balance))
    return out


def wrapped(text, width=34):
    lines = [""]
    for word in text.split(" "):
        lines = [*lines[:-1], f"{lines[-1]} {word}".strip()] if len(lines[-1]) + 1 + len(word) <= width else [*lines, word]
    return [x for x in lines if x]


def header(p, y):
    for at, said in (("date", "Date"), ("narration", "Narration"), ("ref", "Chq./Ref.No."), ("value", "Value Dt")):
        p.left(AT[at], y, said)
    for at, said in (("debit", "Withdrawal Amt."), ("credit", "Deposit Amt."), ("balance", "Closing Balance")):
        p.right(AT[at], y, said)


def statement(document_id, rows, opening, a_page=14):
    p = Pages(document_id)
    for start in range(0, len(rows), a_page):
        p.page().left(28, 30, "SYNTHETIC - NOT A REAL DOCUMENT")
        if not start:
            p.left(28, 94, f"Statement From : {rows[0][0]:%d/%m/%Y} To : {rows[-1][0]:%d/%m/%Y}")
        y = 60 if start else 120
        header(p, y)
        for day, said, ref, debit, credit, balance in rows[start : start + a_page]:
            y += 16
            for k, part in enumerate(wrapped(said)):
                y += 10 * bool(k)
                if not k:
                    p.left(AT["date"], y, f"{day:%d/%m/%y}")
                    p.left(AT["ref"], y, ref)
                    p.left(AT["value"], y, f"{day:%d/%m/%y}")
                    for at, v in (("debit", debit), ("credit", credit), ("balance", balance)):
                        if v is not None:
                            p.right(AT[at], y, money(v))
                p.left(AT["narration"], y, part)
        p.left(28, 815, f"Page No .: {p.page_no}")
    p.left(28, 640, "STATEMENT SUMMARY :-")
    debits, credits = [r[3] for r in rows if r[3]], [r[4] for r in rows if r[4]]
    for said, x, v in (("Opening Balance", 80, money(opening)), ("Dr Count", 170, str(len(debits))), ("Cr Count", 240, str(len(credits))), ("Debits", 320, money(sum(debits))), ("Credits", 410, money(sum(credits))), ("Closing Bal", 510, money(rows[-1][5]))):
        p.middle(x, 656, said)
        p.middle(x, 670, v)
    return p.words


@pytest.fixture(scope="module")
def case(spark):
    rows = case_rows()
    early, late = [r for r in rows if r[0].month <= 8], [r for r in rows if r[0].month >= 8]
    words = statement(1, early, D("145210.50")) + statement(2, late, rows[17][5]) + [(3, 1, 0, "Date", 0.0, 0.0, 9.0, 9.0), (3, 1, 1, "", 10.0, 0.0, 19.0, 9.0), (3, 1, 2, "Balance", None, 0.0, 19.0, 9.0)]
    return rows, spark.createDataFrame(words, WORDS).repartition(7)


def test_two_overlapping_statements_are_read_whole(case):
    rows, words = case
    got = statements.statement_rows(words).orderBy("document_id", "seq").collect()
    want = [(k, i + 1, *r) for k, some in ((1, [r for r in rows if r[0].month <= 8]), (2, [r for r in rows if r[0].month >= 8])) for i, r in enumerate(some)]
    assert [(r.document_id, r.seq, r.txn_date, r.narration, r.ref, r.debit, r.credit, r.balance) for r in got] == want
    assert all(r.value_date == r.txn_date and r.issue is None for r in got) and {r.page_no for r in got} == {1, 2}
    assert [r.document_id for r in statements.unread(words).collect()] == [3]
    place = {(w.document_id, w.word_no): w.text for w in words.collect()}
    assert all(r.evidence_text == " ".join(place[r.document_id, n] for n in r.word_nos) for r in got)


def test_what_two_statements_share_counts_once(case):
    rows, words = case
    read = statements.statement_rows(words).withColumns({"txn_id": F.col("document_id") * 1000 + F.col("seq"), "account_key": F.lit(1)})
    marked = ledger.mark_duplicates(read).select("duplicate").collect()
    assert (sum(not r.duplicate for r in marked), sum(r.duplicate for r in marked)) == (36, 9)


def test_the_printed_summary_and_the_checks(case, spark):
    rows, words = case
    summary = statements.statement_summary(words)
    told = {(r.document_id, r.field): r.value for r in summary.collect()}
    assert told[1, "opening_balance"] == D("145210.50") and told[2, "debit_count"] == 16 and told[2, "credit_count"] == 2 and told[2, "closing_balance"] == rows[-1][5]
    periods = spark.createDataFrame([(1, date(2026, 6, 1), date(2026, 8, 31)), (2, date(2026, 8, 3), date(2026, 9, 30))], "document_id long, period_start date, period_end date")
    one, two = statements.statement_checks(statements.statement_rows(words), summary, periods).orderBy("document_id").collect()
    assert one.n_rows == 27 and one.reconciled and one.n_breaks == 0 and one.issues == [] and one.opening_stated and one.running_rows == 27
    assert two.n_rows == 18 and two.difference == 0 and two.n_outside == 1 and two.issues == ["rows dated outside the stated period"]
    # without the summary the first balance gives the opening; a lost row breaks the chain and the totals
    lost = statements.statement_rows(words).where("NOT (document_id = 1 AND seq = 5)")
    broken = statements.statement_checks(lost, summary).where("document_id = 1").first()
    assert broken.n_breaks == 1 and not broken.reconciled and "stated debit count differ from the rows read" in broken.issues
    bare = statements.statement_checks(statements.statement_rows(words), summary.where("false")).where("document_id = 1").first()
    assert bare.opening_balance == D("145210.50") and not bare.opening_stated and bare.reconciled


def test_other_layouts_and_rows_that_cannot_be_told(spark):
    p = Pages(5)
    p.page()
    # one amount column with markers; stacked over two lines
    for x, up, down in ((28, "Transaction", "Date"), (120, "Transaction", "Remarks"), (400, "Amount", "(INR)"), (520, "Balance", "(INR)")):
        p.left(x, 50, up)
        p.left(x, 60, down)
    rows = [("01-Jan-2024", "opening entry", "1,000.00", "Cr", "1,000.00"), ("02-Jan-2024", "paid out", "250.50", "Dr.", "749.50"), ("03-Jan-2024", "unclear", "10.00", None, "739.50"), ("04-Jan-2024", "overdrawn", "1,000.00", "DR", "250.50Dr")]
    y = 64
    for day, said, amount, marker, balance in rows:
        y += 14
        p.left(28, y, day)
        p.left(120, y, said)
        p.right(430, y, amount)
        if marker:
            p.left(440, y, marker)
        p.right(550, y, balance)
    p.left(28, y + 60, "words far below")
    p.left(28, y + 90, "09-Jan-2024")  # the table has ended
    p.right(430, y + 90, "7.00")
    p.page()
    header(p, 40)
    p.left(28, 50, "stray line")  # before the first date: no row
    p.left(28, 60, "05/01/2024")
    p.right(AT["debit"], 60, "5.00")
    p.right(AT["credit"], 60, "6.00")
    p.left(28, 70, "06/01/2024")
    p.left(70, 70, "nothing here 12.00")
    p.left(28, 80, "07/01/2024")
    p.right(AT["debit"], 80, "5.00")
    p.right(AT["debit"], 86, "6.00")
    p.right(AT["balance"], 80, "-9.00")
    p.left(28, 96, "This is a computer generated statement")
    p.left(28, 106, "08/01/2024")
    p.right(AT["debit"], 106, "5.00")
    got = statements.statement_rows(spark.createDataFrame(p.words, WORDS)).orderBy("page_no", "txn_date").collect()
    assert [(r.txn_date.day, r.seq, r.debit, r.credit, r.balance, (r.issue or "").split(";")[0]) for r in got] == [
        (1, 1, None, D(1000), D(1000), ""),
        (2, 2, D("250.50"), None, D("-749.50"), ""),  # a marker that stands alone is the balance's too
        (3, None, None, None, D("739.50"), "an amount without a Dr/Cr marker"),
        (4, 3, D(1000), None, D("-250.50"), ""),
        (5, 4, D(5), D(6), None, "both a withdrawal and a deposit"),
        (6, None, None, None, None, "no withdrawal or deposit amount"),
        (7, None, None, None, D("-9.00"), "no withdrawal or deposit amount"),
    ]
    assert got[1].narration == "paid out" and got[5].narration == "nothing here 12.00"


def test_drawn_lines_make_rows_and_columns(spark):
    p = Pages(6)
    p.page()
    header(p, 40)
    # the remark is wrapped above and below its date, which lies in the middle of its band
    for k, (day, above, below, v, balance) in enumerate([("01/02/2024", "CARD BILL", "AUTOPAY", "20.00", "80.00"), ("02/02/2024", "CASH", "AT COUNTER", "30.00", "50.00"), (None, "brought", "forward", None, "50.00")]):
        y = 70 + 40 * k
        p.left(75, y - 10, above)
        p.left(75, y + 10, below)
        if day:
            p.left(30, y, day)
        if v:
            p.right(AT["debit"] - 30, y, v)
        p.right(AT["balance"], y, balance)
    p.left(28, 300, "after the table")
    rules = [(6, 1, "h", float(y)) for y in (50, 90, 130, 170)] + [(6, 1, "v", float(x)) for x in (25, 68, 230, 310, 350, 420, 490, 575)]
    words, drawn = spark.createDataFrame(p.words, WORDS), spark.createDataFrame(rules, "document_id long, page_no int, direction string, position double")
    got = statements.statement_rows(words, drawn).orderBy("seq").collect()
    assert [(r.txn_date.day, r.narration, r.debit, r.balance) for r in got] == [(1, "CARD BILL AUTOPAY", D(20), D(80)), (2, "CASH AT COUNTER", D(30), D(50))]


def test_lines_follow_their_first_word(spark):
    """Heights that chain by small steps are cut where they leave the line's first word by more than the tolerance."""
    rows = [(1, 1, k, f"w{k}", float(50 - k), 2.0 * k, 55.0 - k, 2.0 * k + 4) for k in range(6)] + [(1, 2, 9, "other", 0.0, 0.0, 1.0, 1.0)]
    got = layout.lines_of(layout.visual_lines(spark.createDataFrame(rows, WORDS), 2.5)).orderBy("page_no", "line_no").collect()
    assert [(r.page_no, r.line_no, r.text) for r in got] == [(1, 1, "w1 w0"), (1, 2, "w3 w2"), (1, 3, "w5 w4"), (2, 1, "other")]


def test_page_lines_are_the_lines_of_visual_lines(spark):
    rows = [(1, 1, k, f"w{k}", float(50 - k), 2.0 * k, 55.0 - k, 2.0 * k + 4) for k in range(6)] + [(1, 2, 9, "other", 0.0, 0.0, 1.0, 1.0), (1, 2, 9, "other", 0.0, 0.0, 1.0, 1.0), (1, 2, 8, "low", 0.0, 9.0, 1.0, 11.0)]
    words = spark.createDataFrame(rows, WORDS)
    want, got = layout.lines_of(layout.visual_lines(words, 2.5)), layout.page_lines(words, 2.5)
    told = lambda df: sorted((r.page_no, r.line_no, r.line_y, r.text, [w.word_no for w in r.words]) for r in df.collect())
    assert told(got) == told(want) and len(told(got)) == 5


def test_the_summary_comes_with_the_rows(case):
    """What the rows carry gives the same checks as the summary read apart, without a second look at the pages."""
    words = case[1]
    rows = statements.statement_rows(words, summed=True)
    apart = statements.statement_checks(statements.statement_rows(words), statements.statement_summary(words))
    assert sorted(statements.statement_checks(rows).collect()) == sorted(apart.collect())
    plan = statements.statement_checks(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_spans_must_read_as_their_evidence(spark):
    rows = [("abc def ghi", [(0, 3), (8, 11)], "abc ghi"), ("abc", [(0, 4)], "abc"), ("abc", [(2, 2)], ""), ("abc", [(0, 2)], "abc"), ("abc", [], ""), (None, [(0, 1)], "a")]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,stop:int>>, said string")
    assert [r[0] for r in df.select(layout.spans_read(F.col("text"), F.col("spans"), F.col("said"))).collect()] == [True, False, False, False, False, False]


def test_empty_tables_of_words(spark):
    nothing = spark.createDataFrame([], WORDS)
    assert statements.statement_rows(nothing).count() == 0 and statements.statement_summary(nothing).count() == 0 and statements.unread(nothing).count() == 0
