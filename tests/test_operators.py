"""Fixtures of the domain operators: input rows and the results they must give."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import gaps, ledger, reconcile, timeline

ACTION = "claim_id long, issuer_id long, agency string, instrument_class string, term string, grade string, outlook string, watch string, instrument string, action string, action_date date, provenance string"


def action(claim, agency, day, what="reaffirmed", grade="AA", history=False, kind="ncd"):
    return claim, 1, agency, kind, "long_term", grade, "Stable", None, "NCD", what, date.fromisoformat(day), "history_annexure" if history else "primary_rationale"


def states(spark, *rows):
    return {r.claim_id: r for r in timeline.states(spark.createDataFrame(list(rows), ACTION)).collect()}


def test_the_next_own_action_closes(spark):
    s = states(spark, action(1, "I", "2024-03-12"), action(2, "I", "2025-09-24"), action(3, "C", "2025-01-01"))
    assert s[1].effective_to == date(2025, 9, 24) and s[1].end_basis == "primary" and s[2].effective_to is None and s[3].effective_to is None


def test_same_day_tranches_and_withdrawals(spark):
    s = states(spark, action(1, "I", "2025-09-24"), action(2, "I", "2026-02-11", "reaffirmed; withdrawn"), action(3, "I", "2026-02-11"))
    assert s[1].effective_to == date(2026, 2, 11) and s[2].effective_to == date(2026, 2, 11) and s[2].withdrawn and s[3].effective_to is None


def test_history_truncates(spark):
    s = states(spark, action(1, "I", "2024-01-01"), action(2, "I", "2024-12-01"), action(11, "I", "2024-06-01", grade="AA-", history=True))
    assert (s[1].end_basis, s[1].superseded_by, s[11].end_basis, s[2].effective_to) == ("history", 11, "primary", None)


@pytest.mark.parametrize(("rows", "want"), [([(1, "A", "2025-06-30"), (2, "B", "2025-07-02")], 1), ([(1, "A", "2024-01-01"), (3, "A", "2024-06-01"), (2, "B", "2024-06-01")], 1)])
def test_overlaps_are_half_open(spark, rows, want):
    s = timeline.states(spark.createDataFrame([action(*r) for r in rows], ACTION))
    assert timeline.concurrent(s).count() == want


def test_runs_merge_contiguous_windows(spark):
    d = date.fromisoformat
    rows = [("k", 1, d("2025-09-15"), d("2025-09-24")), ("k", 2, d("2025-09-24"), d("2026-02-11")), ("k", 3, d("2026-02-11"), None), ("g", 1, d("2024-01-01"), d("2024-06-01")), ("g", 2, d("2025-01-01"), None)]
    got = timeline.runs(spark.createDataFrame(rows, "key string, m long, start date, end date"), ["key"], ["m"]).collect()
    assert sorted((r.key, r.members, r.end is None) for r in got) == [("g", [1], False), ("g", [2], True), ("k", [1, 2, 3], True)]


def test_gaps(spark):
    rows = [action(1, "I", "2024-01-01"), action(2, "I", "2024-12-01")]
    history = [action(10, "I", "2024-01-02", history=True), action(11, "I", "2024-06-01", grade="AA-", history=True), action(12, "I", "2024-06-01", grade="AA-", history=True), action(13, "I", "2023-06-01", history=True)]
    got = gaps.find_gaps(spark.createDataFrame(history, ACTION), spark.createDataFrame(rows, ACTION)).collect()
    assert sorted((str(r.action_date), r.scope, r.n_evidence) for r in got) == [("2023-06-01", "before_corpus", 1), ("2024-06-01", "within_corpus", 2)]


@pytest.mark.parametrize(("low", "high", "unit", "want"), [(4667420, 4669900, "x", False), (100, 101, "INR_CRORE", True), (100000, 100006, "INR_CRORE", True), (100000, 100006, "PERCENT", False), (0, 5, "PERCENT", False), (-100, -100, "PERCENT", False), (-100, 50, "PERCENT", False), (-100, -90, "INR_CRORE", True)])
def test_tolerances(spark, low, high, unit, want):
    assert spark.range(1).select(reconcile.disagrees(F.lit(low), F.lit(high), F.lit(unit)).alias("x")).first().x is want


def test_state_is_kept_resolved_and_reopened(spark):
    state = spark.createDataFrame([("a", "r1", "r1", None), ("b", "r1", "r1", None), ("c", "r0", "r0", "r1")], "key string, first_seen string, last_seen string, resolved_at string")
    found = spark.createDataFrame([("a",), ("c",), ("d",), ("d",)], "key string")
    got = {tuple(r) for r in reconcile.merge_state(state, found, ["key"], "r2").collect()}
    assert got == {("a", "r1", "r2", None), ("b", "r1", "r1", "r2"), ("c", "r0", "r2", None), ("d", "r2", "r2", None)}


def test_duplicates_are_of_equal_balance_and_numbered_accounts(spark):
    d = date(2024, 1, 5)
    rows = [(1, "A", d, 1, 1, 50, 0, 950, "upi x"), (2, "A", d, 2, 1, 50, 0, 950, "UPI  X"), (3, "A", d, 2, 2, 50, 0, 900, "upi x"), (4, "A", d, 1, 2, 7, 0, None, "y"), (5, "A", d, 2, 3, 7, 0, None, "y")]
    rows += [(6, "unnumbered-doc3", d, 3, 1, 50, 0, 950, "upi x"), (7, "A", d, 2, 4, 50, 0, 950, "upi x")]
    got = ledger.mark_duplicates(spark.createDataFrame(rows, "txn_id long, account_key string, txn_date date, document_id long, seq long, debit long, credit long, balance long, narration string"))
    assert {r.txn_id for r in got.where("duplicate").collect()} == {2, 5, 7} and got.count() == 7
    unnumbered = spark.createDataFrame([(1, "doc3", d, 2, 1, 5, 0, 9, "z"), (2, "doc3", d, 3, 1, 5, 0, 9, "z")], got.drop("duplicate").schema)
    assert ledger.mark_duplicates(unnumbered).where("duplicate").count() == 0


def test_breaks_start_from_the_opening(spark):
    d = date(2024, 1, 5)
    rows = spark.createDataFrame([(1, 1, d, 1, 0, 100, 1100), (2, 1, d, 2, 50, 0, 1050), (3, 2, d, 1, 0, 5, 900), (4, 3, d, 1, 0, 5, 900)], "txn_id long, document_id long, txn_date date, seq long, debit long, credit long, balance long").withColumn("account_key", F.lit(1))
    statements = spark.createDataFrame([(1, 1000), (2, 800), (3, None)], "document_id long, opening long")
    assert [(r.txn_id, r.previous, r.off_by) for r in ledger.balance_breaks(rows, statements).collect()] == [(3, 800, -95)]


def test_covered_days_restart_after_a_gap(spark):
    d = date.fromisoformat
    kinds = "account_key long, document_id long, period_start date, period_end date, opening long"
    statements = [(1, 1, d("2024-01-01"), d("2024-01-25"), 100), (1, 2, d("2024-02-01"), d("2024-02-03"), -40), (1, 3, d("2024-02-04"), d("2024-02-05"), 999), (2, 4, d("2024-01-01"), d("2024-01-02"), None), (3, 5, d("2024-01-01"), d("2024-01-02"), 5), (1, 6, d("2024-02-10"), d("2024-02-10"), None)]
    rows = [(1, 1, d("2024-01-03"), 1, 70), (1, 1, d("2024-01-03"), 2, 60), (1, 1, d("2023-12-30"), 0, 5), (1, 2, d("2024-02-03"), 1, 10), (1, 3, d("2024-02-08"), 1, 33), (2, 4, d("2024-01-01"), 1, 7)]
    daily = ledger.covered_balances(spark.createDataFrame(rows, "account_key long, document_id long, txn_date date, seq long, balance long"), spark.createDataFrame(statements, kinds))
    got = {str(r.txn_date): r.balance for r in daily.collect()}
    want = {f"2024-01-{k:02}": 100 if k < 3 else 60 for k in range(1, 26)} | {"2024-02-01": -40, "2024-02-02": -40, "2024-02-03": 10, "2024-02-04": 10, "2024-02-05": 10, "2024-02-10": 33}
    assert got == want and {r.account_key for r in daily.collect()} == {1}
    months = ledger.balance_months(daily)
    assert sorted(tuple(r)[1:] for r in months.collect()) == [("2024-01", 25, 63.2, 60, 0), ("2024-02", 6, -2.83, -40, 2)]
    assert [r.average for r in ledger.average_balances(months).collect()] == [63.2]


def test_covered_days_are_told_last_and_their_accounts_dealt(spark, monkeypatch):
    from factloom.plans import registers

    monkeypatch.setattr(registers, "ACCOUNTS", ("customer", "c_custkey", 10))
    daily = registers._daily(spark, "/root/testdata/sf0.001")
    assert daily.rdd.getNumPartitions() == 15
    # days outnumber what they follow from many times: none is shuffled, sorted or joined
    plan = daily._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert not any(step in above for step in ("Exchange", "Sort ", "Join", "Aggregate"))


def test_an_accounts_months_are_counted_where_its_days_are(spark):
    from factloom.plans import registers

    plan = registers.average_balances(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # the customers are dealt, once for their statements and once for their rows, and nothing after
    assert plan.count("Exchange hashpartitioning") == 2


def test_rows_of_business_months_are_made_by_dealt_customers(spark):
    from factloom.plans import registers

    plan = registers.business_months(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3


@pytest.mark.parametrize("name", ["conflict_register", "open_conflicts"])
def test_a_runs_conflicts_take_one_pass_over_its_claims(spark, name):
    from factloom.plans import registers

    plan = registers.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # three runs; no row is copied for distinct counts
    assert plan.count("FileScan") == 3 and "Expand" not in plan


def test_conflicts_of_both_kinds_are_those_of_their_readers(spark):
    import random

    from factloom.operators import conflicts, reconcile

    pick, or_none = random.Random(3), lambda p, v: None if pick.random() < p else v
    keys, words, bases = ["metric|1", "metric|2", "rated_amount|3"], ["Negative", " negative  ", "Stable", " "], ["agency_adjusted", "consolidated", "consolidated"]
    rows = [(i, pick.randint(0, 60), pick.choice(keys), or_none(0.1, pick.randint(0, 2)), or_none(0.1, pick.choice(["a", "b"])), or_none(0.3, pick.choice([-1, 0, 100000, 100004, 100006, 100200])), or_none(0.1, pick.choice(["INR_CRORE", "PERCENT"])), or_none(0.3, pick.choice(bases)), or_none(0.3, pick.choice(words))) for i in range(900)]
    claims = spark.createDataFrame(rows, "claim_id long, issuer_id long, fact_key string, document_id long, source_name string, value long, unit string, basis string, value_text string")
    found = conflicts.claim_conflicts(claims).collect()
    got = {(r.issuer_id, r.fact_key, r.kind) for r in found}
    want = {(r.issuer_id, r.fact_key, "numeric_disagreement") for r in reconcile.numeric_facts(claims).where("status = 'conflict'").collect()} | {(r.issuer_id, r.fact_key, "categorical_disagreement") for r in reconcile.categorical_conflicts(claims).collect()}
    assert got == want and len(found) == len(got) > 10
    states = {"numeric_disagreement": lambda r: r[5] is not None, "categorical_disagreement": lambda r: bool((r[8] or "").strip())}
    assert all(r.members == sorted(c[0] for c in rows if (c[1], c[2]) == (r.issuer_id, r.fact_key) and states[r.kind](c)) for r in found)


def test_flags_ask_runs_and_gaps_that_are_worked_out_once(spark):
    from factloom.plans import registers

    told = registers.rating_conflict_flags(spark, "/root/testdata/sf0.001")
    plan = told._jdf.queryExecution().executedPlan().toString()
    # the orders are read for the history claims alone; the runs for their dates, their members and themselves
    assert plan.count("orders.parquet") == 1 and "Window" not in plan and sum("/runs-" in line for line in plan.splitlines()) == 3


def test_a_conflict_rests_on_history_or_lacks_an_action_in_its_time(spark):
    from factloom.operators import conflicts

    d = date.fromisoformat
    kinds = "issuer_id long, fact_key string, instrument_class string, term string, a_agency string, b_agency string, start date, ended_on date, members array<long>"
    rows = [(1, f"k{i}", "ncd", "long_term", "A", "B", d("2024-02-01"), end, members) for i, (end, members) in enumerate([(d("2024-03-01"), [1]), (d("2024-03-01"), [9]), (None, [1]), (d("2024-02-02"), [5]), (d("2024-02-02"), [6]), (d("2024-02-02"), [1])])]
    gaps_kinds = "issuer_id long, agency string, instrument_class string, term string, action_date date, scope string, changes_view boolean, evidence array<long>"
    found = [(1, "B", "ncd", "long_term", d("2024-03-01"), "within_corpus", False, [7]), (1, "A", "ncd", "long_term", d("2024-05-01"), "within_corpus", True, [5]), (1, "C", "ncd", "long_term", d("2024-02-01"), "within_corpus", True, [6]), (1, "A", "ncd", "long_term", d("2024-02-01"), "before_corpus", True, [1])]
    told = conflicts.completeness(spark.createDataFrame(rows, kinds), spark.createDataFrame([(9,)], "claim_id long"), spark.createDataFrame(found, gaps_kinds))
    got = {r.fact_key: (r.incomplete, r.material) for r in told.collect()}
    # a gap on the last day; history alone; an open end reaches a later gap; evidence of a later gap; another agency's; none
    assert got == {"k0": (True, False), "k1": (True, False), "k2": (True, True), "k3": (True, True), "k4": (False, False), "k5": (False, False)}


def test_overlapping_and_endless_statements_cover_as_told(spark):
    d = date.fromisoformat
    statements = [(1, 1, d("2024-01-05"), None, 1), (1, 2, d("2024-01-06"), d("2024-01-10"), None), (1, 3, d("2024-01-07"), d("2024-01-08"), 3), (1, 4, d("2024-01-11"), d("2024-01-09"), 4), (1, 5, d("2024-01-12"), d("2024-01-13"), 5), (2, 6, d("2024-01-01"), d("2024-01-02"), 6)]
    rows = [(1, 1, d("2024-01-05"), 1, 50), (1, 1, None, 1, 60), (1, 1, d("2024-01-11"), 1, 70), (1, 1, d("2024-01-11"), 2, None)]
    daily = ledger.covered_balances(spark.createDataFrame(rows, "account_key long, document_id long, txn_date date, seq long, balance long"), spark.createDataFrame(statements, "account_key long, document_id long, period_start date, period_end date, opening long"))
    # the first opening stands for a missing one on the first day; an opening inside covered days is not one; the 12th starts anew
    assert sorted((str(r.txn_date)[8:], r.balance) for r in daily.collect()) == [("06", 1), ("07", 1), ("08", 1), ("09", 1), ("10", 1), ("12", 5), ("13", 5)]


def test_retention_counts_each_rupee_once(spark):
    d = date(2024, 1, 10)
    rows = [(1, d, 1, 0, 10000, "ok"), (1, d, 2, 0, 10000, "ok"), (1, date(2024, 1, 11), 3, 8000, 0, "ok"), (1, d, 4, 0, 90000, "NEFT RETURN"), (1, d, 5, 0, 90000, "OWN A/C"), (1, d, 6, 0, 9999, "ok")]
    rows += [(1, date(2024, 3, 1), 7, 0, 20000, "CASH DEP"), (1, date(2024, 3, 3), 8, 15999, 0, "x"), (1, date(2024, 3, 3), 9, 0, 10000, "ok"), (1, date(2024, 3, 4), 10, 1, 0, "x"), (1, date(2024, 3, 6), 11, 9000, 0, "x")]
    got = ledger.retention(spark.createDataFrame([(*r[:3], r[2], *r[3:]) for r in rows], "account_key long, txn_date date, seq long, txn_id long, debit long, credit long, narration string")).first()
    assert (got.n_large, got.n_quick, got.large_amount, int(got.quick_amount)) == (4, 2, 50000, 20000)


def test_retention_matches_the_rule_told_plainly(spark):
    import random

    rng, rows = random.Random(6), []
    for n in range(600):
        amount = rng.choice([0, 9000, 10000, 12500, 20000, 40000])
        rows.append((n % 5, date.fromordinal(738000 + rng.randint(0, 25)), n, n, 0 if amount else rng.choice([500, 4000, 9000, 16000]), amount, "ok"))
    want = {}
    for account in range(5):
        own = sorted(r for r in rows if r[0] == account)
        left = {r[3]: r[4] * 5 for r in own}  # fifths of a unit, so that four fifths of a credit are whole
        n_large = n_quick = 0
        for _, day, _, _, _, credit, _ in own:
            if credit >= 10000:
                n_large += 1
                near = [r[3] for r in own if 0 <= (r[1] - day).days <= 2]
                need = credit * 4
                if sum(left[k] for k in near) >= need:
                    n_quick += 1
                    for k in near:
                        left[k], need = left[k] - min(left[k], need), need - min(left[k], need)
        want[account] = (n_large, n_quick)
    got = ledger.retention(spark.createDataFrame(rows, "account_key long, txn_date date, seq long, txn_id long, debit long, credit long, narration string")).collect()
    assert {r.account_key: (r.n_large, r.n_quick) for r in got} == want


@pytest.mark.parametrize(("inputs", "want"), [((100000, 20000, 50, 0, 60), ("computed", 30000.0, 1800000.0)), ((50000, 40000, 50, 10, 36), ("computed", 0.0, 0.0)), ((0, 0, 50, 10, 12), ("invalid", None, None)), ((None, 0, 50, 10, 12), ("needs_input", None, None)), ((5, 0, 150, 10, 12), ("invalid", None, None))])
def test_eligibility(spark, inputs, want):
    df = spark.createDataFrame([(1, *inputs)], "case_id long, income long, obligations long, ratio_pct long, rate_pct long, tenure long")
    assert tuple(ledger.eligibility(df).first())[1:4] == want


@pytest.mark.parametrize(("ratio", "tenure", "want"), [("0.5", "12", ("computed", 500.0, 6000.0, 0.0)), ("0", "12", ("invalid", None, None, None)), ("100", "12.5", ("invalid", None, None, None)), ("100", "1", ("computed", 100000.0, 100000.0, 0.0))])
def test_ratios_below_one_percent_are_valid_and_tenures_are_whole(spark, ratio, tenure, want):
    df = spark.sql(f"SELECT 1 AS case_id, 100000 AS income, 0 AS obligations, {ratio}BD AS ratio_pct, 0 AS rate_pct, {tenure}BD AS tenure")
    assert tuple(ledger.eligibility(df).first())[1:] == want


def test_text_functions(spark):
    names = {"Non-convertible debenture programme": "ncd", "Long Term Bank Facilities": "bank_facility", "Subordinated debt programme": "subordinated_debt", "Proposed Perpetual Debt Instrument (PDI)": "perpetual_debt", "CP": "commercial_paper", "cpx": "other"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.instrument_class(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names
    one = spark.range(1).select(
        text.normalise(F.lit(" Watch  with   Negative\nImplications ")).alias("a"),
        text.number(F.lit("(1.2)")).cast("string").alias("b"),
        text.number(F.lit("81,342")).cast("int").alias("c"),
        text.number(F.lit("NA")).alias("d"),
        text.action_verbs(F.lit("Reaffirmed; Withdrawn")).alias("e"),
        text.outlook(F.lit("[ICRA]AA (stable)")).alias("f"),
        text.statement_date(F.lit("05/03/2024")).cast("string").alias("g"),
        text.rating_term(F.lit("unfamiliar"), F.lit("A1+")).alias("h"),
    ).first()
    assert tuple(one) == ("watch with negative implications", "-1.200000", 81342, None, "reaffirmed; withdrawn", "Stable", "2024-03-05", "short_term")


def test_every_query_runs_without_the_training_data_part():
    from factloom.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and "rating_conflict_runs" in catalog.QUERIES
