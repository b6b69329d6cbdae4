"""Fixtures of the case assessment, the document views and the stream."""

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.operators import banking, credit, evidence
from factloom.plans import readings, registers, reviews  # noqa: F401  (all add to one catalogue)
from factloom.streaming import activity

LINE = "tradeline_id long, case_id long, lender string, account_type string, ownership string, status string, status_verified boolean, date_closed date, date_closed_verified boolean, account_number string, emi long, emi_status string"
SERIES = "series_id long, case_id long, category string, narrations string, refs string, amount long, recurring boolean, fixed_amount boolean"
DECISION = "decision_id long, tradeline_id long, series_id long, status string"
TREATMENT = "treatment_id long, source string, key_id long, include boolean, amount long"


def line(key, lender="HDFC BANK", kind="Personal Loan", own="Individual", status="Active", verified=True, number="XX1234", emi=1000, emi_status="reported"):
    return key, 1, lender, kind, own, status, verified, None, False, number, emi, emi_status


def matched(spark, lines, series, decisions=()):
    found = credit.matches(spark.createDataFrame(lines, LINE), spark.createDataFrame(series, SERIES), spark.createDataFrame(list(decisions), DECISION))
    return {(r.tradeline_id, r.series_id): r for r in found.collect()}


def test_tokens_drop_generic_words_and_add_aliases(spark):
    got = spark.createDataFrame([("AMEX Card",), (None,), ("The Bank of India",), ("hdfc HDFC ltd",)], "x string").select(F.array_sort(banking.tokens(F.col("x"))).alias("t")).collect()
    assert [r.t for r in got] == [["AMERICAN", "AMEX"], [], [], ["HDFC"]]


@pytest.mark.parametrize(
    ("narration", "credit_", "want"),
    [("salary", 5, "salary"), ("NEFT ACME", 5, "salary"), ("gift", 5, "other"), ("INT. DR", 0, "od_interest"), ("CARD AUTOPAY", 0, "card_payment"), ("CARD", 0, "other"), ("HDFC x", 0, "loan_repayment"), ("ICICI x", 0, "other"), (None, 0, "other")],
)
def test_categories(spark, narration, credit_, want):
    rows = spark.createDataFrame([(1, narration, credit_)], "account_key long, narration string, credit long")
    parties = spark.createDataFrame([(1, "ACME LTD", "HDFC ICICI", "ICICI BANK")], "account_key long, employer string, lenders string, own_bank string")
    assert banking.categorise(rows, parties).first().category == want


def test_counterparties(spark):
    names = {"UPI/SHREE TRADERS/ok@bank": "SHREE TRADERS", "NEFT-ICIC0000123-KUMAR STEEL WORKS PVT": "KUMAR STEEL WORKS", "12345/99": None, "": None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", banking.counterparty(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names


def test_two_strong_claims_contest_a_series(spark):
    got = matched(spark, [line(1), line(2, number="XX9"), line(3, lender="OTHER")], [(7, 1, "loan_repayment", "HDFC EMI", "", 1000, True, True)])
    assert {k[0]: (r.strength, r.status) for k, r in got.items()} == {1: ("contested", "ambiguous"), 2: ("contested", "ambiguous"), 3: ("weak", "ambiguous")}
    assert got[1, 7].signals == "amount,lender,monthly"


def test_amount_alone_needs_recurrence_and_decisions_override(spark):
    once, twice = (7, 1, "loan_repayment", "EMI", "", 1004, False, True), (8, 1, "loan_repayment", "EMI", "", 1005, True, True)
    got = matched(spark, [line(1, lender=None)], [once, twice], [(1, 1, 8, "rejected"), (2, 1, 8, "confirmed")])
    assert {k: r.status for k, r in got.items()} == {(1, 8): "confirmed"}


def test_obligation_ladder(spark):
    lines = [line(1), line(2, status="Written-off"), line(3, kind="OD x"), line(4, kind="Credit Card"), line(5, own="Guarantor"), line(6, emi=None, emi_status="unverified"), line(7, status="Closed", verified=False, emi=0)]
    series = [(90, 1, "loan_repayment", "EMI UNKNOWN", "", 77, True, True)]
    treatments = [(1, "bureau", 5, True, 10), (2, "bureau", 5, False, 20), (3, "bureau", 4, True, 30)]
    frames = spark.createDataFrame(lines, LINE), spark.createDataFrame(series, SERIES)
    found = credit.matches(*frames, spark.createDataFrame([], DECISION))
    rows = credit.obligations(*frames, found, spark.createDataFrame(treatments, TREATMENT))
    got = {(r.source, r.key_id): (r.basis, r.included, r.amount) for r in rows.collect()}
    assert got == {
        ("bureau", 1): ("emi", True, 1000), ("bureau", 2): ("closed", False, None), ("bureau", 3): ("overdraft", False, None), ("bureau", 4): ("analyst", True, 30),
        ("bureau", 5): ("analyst", False, None), ("bureau", 6): ("unverified", False, None), ("bureau", 7): ("missing", False, None), ("bank", 90): ("bank_only", False, None),
    }
    assert tuple(credit.obligation_totals(rows).first()) == (1, 1030, 4)


def test_salary_of_the_first_days_pays_the_month_before(spark):
    slips = spark.createDataFrame([(1, 1, "2024-01", 100), (1, 2, "2024-02", 100), (1, 3, "2025-01", 5), (1, 4, "2024-03", None)], "account_key long, document_id long, month string, net long")
    credits = spark.createDataFrame([(1, date(2024, 2, 10), 100), (1, date(2024, 2, 28), 130), (1, date(2024, 6, 11), 1)], "account_key long, txn_date date, credit long")
    statements = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 6, 30))], "account_key long, period_start date, period_end date")
    got = {r.month: r.finding for r in credit.salary_comparison(slips, credits, statements).collect()}
    assert got == {"2024-01": "equal", "2024-02": "above", "2024-03": "net_unverified", "2024-06": "no_slip", "2025-01": "not_covered"}


def test_anchors(spark):
    anchors = [(1, 0, 4, "some"), (1, 0, 4, ""), (1, 4, 4, "x"), (1, 0, 99, "x"), (1, 0, 4, "else"), (2, 0, 1, "x")]
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    got = evidence.verify_anchors(spark.createDataFrame(anchors, "doc_id long, char_start int, char_end int, evidence_text string"), docs)
    assert sorted(r.verdict for r in got.collect()) == sorted(["verified", "empty", "range", "beyond_text", "other_text", "beyond_text"])


def test_a_drained_stream_resumes_and_drops_what_is_too_late(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(list(rows), "ts timestamp, kind string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema("ts timestamp, kind string, v long").parquet(str(tmp_path / "in"))
        rows = activity.drain(activity.windowed(stream, "ts", ["kind"], "v"), ["start", "kind"], str(tmp_path / "out"))
        return {(str(r.start)[:10], r.kind): (r.n, r.total) for r in rows.collect()}

    arrive((datetime(2024, 1, 1, 5), "a", 1), (datetime(2024, 1, 9), "a", 2))
    assert drain() == {("2024-01-01", "a"): (1, 1), ("2024-01-09", "a"): (1, 2)}
    arrive((datetime(2024, 1, 1, 6), "a", 50), (datetime(2024, 1, 9, 3), "a", 4), (datetime(2024, 1, 8), "b", 8))
    assert drain() == {("2024-01-01", "a"): (1, 1), ("2024-01-09", "a"): (2, 6), ("2024-01-08", "b"): (1, 8)}


@pytest.mark.parametrize("name", [n for n in reviews.QUERIES if n in reviews.ORACLES])
def test_queries_equal_their_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = entry.queries()[name](spark, sf)
    told = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(found.collect()) == plain(told)
