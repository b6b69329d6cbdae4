"""Underwriting and writes on small fixtures: the rules' edges, nulls, repeats and empty tables."""

import datetime as dt
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from factloom.operators import underwriting, writes


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def test_usable_and_states(spark):
    held = spark.createDataFrame([(1, 5, "reported"), (2, 5, "unverified"), (3, None, "reported"), (4, None, None), (5, 7, "analyst")], "id int, v int, s string")
    got = held.select("id", underwriting.usable(F.col("v"), F.col("s")), underwriting.field_state(F.col("v"), F.col("s")))
    assert rows(got) == [(1, 5, "reported"), (2, None, "unverified"), (3, None, "reported blank"), (4, None, "not reported"), (5, 7, "reported")]


@pytest.fixture()
def eligible(spark):
    def run(recorded, suggested=(), totals=()):
        a = underwriting.assumptions(spark.createDataFrame(recorded, "assumption_id long, case_id long, key string, value decimal(12,2)"))
        s = spark.createDataFrame(list(suggested), "case_id long, income double")
        t = spark.createDataFrame(list(totals), "case_id long, total_included long, n_unresolved long")
        return {r.case_id: r for r in underwriting.case_eligibility(a, s, t).collect()}

    return run


def terms(case, first, income=None):
    named = [("foir_max_pct", 50), ("annual_rate_pct", 0), ("tenure_months", 10)] + ([("eligible_income", income)] if income is not None else [])
    return [(first + i, case, k, D(v)) for i, (k, v) in enumerate(named)]


def test_eligibility_is_provisional_while_points_are_open(eligible):
    got = eligible(terms(1, 0, 1000) + terms(2, 10) + terms(3, 20, 1000) + terms(4, 30) + terms(5, 40, 0), [(1, 9999.0), (2, 2000.0)], [(3, 100, 2)])
    assert (got[1].status, got[1].capacity, got[1].principal, got[1].income_origin) == ("computed", 500.0, 5000.0, "analyst")
    assert (got[2].status, got[2].capacity, got[2].income_origin) == ("provisional", 1000.0, "suggested")
    assert (got[3].status, got[3].capacity, got[3].present_ratio) == ("provisional", 400.0, 10.0)
    assert (got[4].status, got[4].capacity) == ("needs_input", None)
    assert got[5].status == "invalid"


def test_newest_assumption_counts_even_when_cleared(eligible):
    got = eligible(terms(1, 0, 1000) + [(9, 1, "eligible_income", None), (10, 1, "no_such_key", D(5))], [(1, 2000.0)])
    assert (got[1].status, got[1].income_origin) == ("needs_input", "analyst")
    assert eligible([]) == {}


def test_slips_and_account_of_a_salaried_case(spark):
    slips = spark.createDataFrame([(1, "2024-01"), (1, "2023-11"), (1, "2023-11"), (1, None), (2, None)], "case_id long, month string")
    assert rows(underwriting.salaried_slips(slips)) == [(1, 2, "2023-12")]
    day = dt.date
    held = spark.createDataFrame(
        [(1, 7, day(2024, 1, 2), day(2024, 6, 30), 0, 9), (1, 8, day(2024, 1, 1), day(2024, 6, 30), 0, 9), (2, 9, day(2024, 1, 1), day(2024, 6, 1), 0, 1), (3, 5, day(2023, 1, 1), day(2024, 6, 1), 1, 1)],
        "case_id long, account_key long, first_day date, last_day date, n_gaps long, unique_rows long",
    )
    # 150 days before 1 June 2024 is 3 January 2024
    assert rows(underwriting.salary_account(held), "case_id", "account_key", "wanted_from", "ok") == [(1, 7, day(2024, 1, 1), False), (2, 9, day(2024, 1, 1), True), (3, 5, day(2024, 1, 1), False)]


def test_proprietor_checklist(spark):
    day = dt.date
    files = spark.createDataFrame([(1, 10, "kyc"), (1, 10, "kyc"), (1, 11, "itr_ack"), (1, 12, "itr_ack"), (2, 13, "itr_json"), (2, 14, "itr_ack"), (2, 15, None)], "case_id long, document_id long, kind string")
    statements = spark.createDataFrame([(1, "current", day(2023, 7, 4), day(2024, 6, 2)), (2, "current", day(2023, 7, 5), day(2024, 6, 2)), (2, "savings", None, day(2024, 6, 2))], "case_id long, account_type string, period_start date, period_end date")
    loans = spark.createDataFrame([(2,)], "case_id long")
    got = {(r.case_id, r.item): (r.received, r.ok) for r in underwriting.proprietor_checklist(files, statements, loans).collect()}
    assert got[1, "kyc"] == (1, True) and got[1, "itr"] == (2, False) and got[2, "itr"] == (2, True)
    assert got[1, "current_statement"] == (335, True) and not got[2, "current_statement"][1] and got[2, "savings_statement"] == (0, False)
    assert got[1, "loan_papers"] == (0, True) and got[2, "loan_papers"] == (0, False)
    assert len(got) == 18


@pytest.fixture()
def load(spark):
    documents = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, None)], "document_id long, text string")
    claims = spark.createDataFrame([(10, 1, "new"), (11, 1, "new"), (20, 2, "new"), (21, 2, "new"), (30, 3, "new"), (90, 9, "new")], "claim_id long, document_id long, version string")
    anchors = spark.createDataFrame(
        [(10, 1, 0, 3, "abc"), (11, 1, 3, 6, "def"), (20, 2, 0, 3, "abc"), (30, 3, 0, 1, "a"), (90, 9, 0, 1, "a")], "claim_id long, document_id long, char_start int, char_end int, evidence_text string"
    )
    return claims, writes.refused_documents(claims, anchors, documents)


def test_a_load_replaces_a_document_whole_or_not_at_all(spark, load):
    claims, refused = load
    assert rows(refused) == [(2, "unanchored"), (3, "beyond_text"), (9, "no_document")]
    known = spark.createDataFrame([(1, 1, "old"), (2, 2, "old"), (4, 4, "old")], "claim_id long, document_id long, version string")
    assert rows(writes.loaded(known, claims, refused)) == [(10, 1, "new"), (11, 1, "new"), (2, 2, "old"), (4, 4, "old")]
    assert rows(writes.loaded(known.limit(0), claims.limit(0), refused)) == []
    audit = writes.extraction_runs(known, claims, refused, "r1")
    assert rows(audit) == [(1, "r1", 2, 1, None), (2, "r1", 0, 0, "unanchored"), (3, "r1", 0, 0, "beyond_text"), (9, "r1", 0, 0, "no_document")]


def test_subjects_keep_their_ids(spark):
    known = spark.createDataFrame([(7, "A", "a"), (3, "B", "b")], "id long, name string, aliases string")
    found = spark.createDataFrame([("A", "x"), ("C", "c2"), ("C", "c1"), ("D", None), (None, "n")], "name string, aliases string")
    got = {r.name: (r.id, r.aliases) for r in writes.named(known, found).collect()}
    assert got["A"] == (7, "x") and got["B"] == (3, "b") and got["C"][1] == "c1" and got["D"][1] is None
    assert len({i for i, _ in got.values()}) == 4 and min(got["C"][0], got["D"][0]) > 7
    assert len(rows(writes.named(known.limit(0), found))) == 3


def test_overlays_are_checked_before_they_are_appended(spark):
    shape = "id int, case_id long, target string, target_id string, field string, value_text string, include boolean, amount double, basis string, reason string"
    asked = [
        (1, 1, "fact", "5:0:net", "net", "9", None, None, None, "typo"),
        (2, 1, "fact", "5:0:no", "no", "9", None, None, None, "typo"),
        (3, 1, "txn", "5:1", "category", "salary", None, None, None, "seen"),
        (4, 1, "txn", "5:1", "category", None, None, None, None, "seen"),
        (5, 1, "obligation", "x", "treatment", None, None, None, None, "r"),
        (6, 1, "obligation", "x", "treatment", None, True, None, "b", "r"),
        (7, 1, "obligation", "x", "treatment", None, True, 5.0, " ", "r"),
        (8, 1, "obligation", "x", "treatment", None, False, None, None, "r"),
        (9, 1, None, "x", "f", None, None, None, None, "r"),
        (10, 1, "fact", "5:0:net", "net", "9", None, None, None, None),
        (11, 1, "fact", "y" * 301, "net", "9", None, None, None, "r"),
    ]
    known = spark.createDataFrame([(1, "fact", "5:0:net", "8"), (1, "fact", "5:0:net", "8"), (1, "txn", "5:1", "other")], "case_id long, target string, target_id string, original string")
    checked = writes.checked_corrections(spark.createDataFrame(asked, shape), known)
    refusals = [None, "no such fact", None, "unknown category", "include", "amount", "basis", None, "target or reason", "target or reason", "length"]
    assert {r.id: r.refusal for r in checked.collect()} == {i + 1: why for i, why in enumerate(refusals)}
    folder = tempfile.mkdtemp(prefix="spark-") + "/overlay"
    writes.append(checked, folder)
    writes.append(checked.where("id = 1"), folder)
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == [1, 1, 3, 8]
    decided = spark.createDataFrame([(1, "m", "confirmed", "r"), (2, "m", "maybe", "r"), (3, None, "rejected", "r"), (4, "m", None, "r")], "id int, match_key string, status string, reason string")
    assert rows(writes.checked_decisions(decided), "id", "refusal") == [(1, None), (2, "status"), (3, "length"), (4, "status")]


def test_snapshot_and_coverage_stamp(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,)], "claim_id long")
    shown = spark.createDataFrame([(1, 3), (None, 3)], "a long, b long")
    assert rows(writes.reachable(claims, (shown, "a"), (shown, "b"))) == [(1,), (3,)]
    documents = spark.createDataFrame([(1, "was"), (2, "was")], "document_id long, extraction_status string")
    told = spark.createDataFrame([(1, "incomplete", 5, 4, "x")], "document_id long, status string, expected int, found int, missing string")
    assert rows(writes.stamped(documents, told), "document_id", "extraction_status", "extraction_found") == [(1, "incomplete", 4), (2, None, None)]
