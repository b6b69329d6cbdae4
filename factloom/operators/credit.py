"""Case assessment: tradelines, their matches with bank debits, obligations, salary comparison, income, vintage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.banking import tokens

#: Slips whose average is the suggested income.
RECENT_SLIPS = 3


def tradelines(rows: DataFrame) -> DataFrame:
    """Adds kind, role, closed (by verified values only), last4 and the lender's tokens."""
    kind_of, own = F.upper(F.coalesce("account_type", F.lit(""))), F.upper("ownership")
    status = F.upper(F.when(F.col("status_verified"), F.col("status")).otherwise(""))
    closed = (F.col("date_closed").isNotNull() & F.col("date_closed_verified")) | status.contains("CLOSED") | status.contains("SETTLED") | (status.contains("WRITTEN") & status.contains("OFF"))
    role = F.when(own.contains("GUARANTOR"), "guarantor").when(own.contains("JOINT"), "joint").when(own.contains("AUTHORI"), "authorized user").when(own != "", "individual")
    return rows.withColumns(
        {
            "kind": F.when(kind_of.rlike(r"OVERDRAFT|\bOD\b"), "od").when(kind_of.contains("CARD"), "card").otherwise("loan"),
            "role": role,
            "closed": F.coalesce(closed, F.lit(False)),
            "last4": F.nullif(F.right(F.regexp_replace("account_number", r"\D", ""), F.lit(4)), F.lit("")),
            "lender_tokens": tokens(F.col("lender")),
        }
    )


def matches(lines: DataFrame, series: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open tradelines and the debit series of their case that may pay them, with signals, strength and status.

    Joined on the case, so a pair never leaves it. Two strong claims on one
    series contest each other; an analyst's newest decision overrides.
    """
    open_lines = tradelines(lines).where("NOT closed").select("case_id", "tradeline_id", "kind", "account_type", "emi", "last4", "lender_tokens")
    pairs = open_lines.join(series, "case_id")
    said = F.upper("narrations")
    primary = F.col("category") == F.when(F.col("kind") == "card", "card_payment").when(F.col("kind") == "od", "od_interest").otherwise("loan_repayment")
    amount = F.coalesce(F.abs(F.col("amount") - F.col("emi")) * 200 <= F.greatest(F.lit(200), F.col("emi")), F.lit(False))
    lender = F.arrays_overlap("lender_tokens", tokens(said))
    account = F.coalesce(F.concat_ws(" ", said, "refs").contains(F.col("last4")), F.lit(False))
    flat = lambda x: F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))
    named = F.coalesce((flat(F.col("account_type")) != "") & flat(F.col("narrations")).contains(flat(F.col("account_type"))), F.lit(False))
    marked = pairs.withColumns({"__primary": primary, "__amount": amount, "__lender": lender, "__account": account, "__type": named})
    fits = marked.where("__primary OR (category = 'loan_repayment' AND (__lender OR __account))")
    told = fits.where("__lender OR __account OR __type OR (__amount AND recurring)")
    signals = F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in [("__amount", "amount"), ("__lender", "lender"), ("__account", "account"), ("__type", "type"), ("recurring", "monthly")]]))
    strong = F.col("__amount").cast("int") + F.col("__lender").cast("int") + F.col("__account").cast("int") >= 2
    rated = told.withColumns({"signals": F.array_join(signals, ","), "__strong": strong})
    rivals = F.count_if("__strong").over(Window.partitionBy("case_id", "series_id"))
    strength = F.when(~F.col("__strong"), "weak").when(rivals > 1, "contested").otherwise("strong")
    decided = decisions.groupBy("tradeline_id", "series_id").agg(F.max_by("status", "decision_id").alias("__decided"))
    rated = rated.withColumn("strength", strength).join(decided, ["tradeline_id", "series_id"], "left")
    status = F.coalesce("__decided", F.when(F.col("strength") == "strong", "proposed").otherwise("ambiguous"))
    return rated.select("case_id", "tradeline_id", "series_id", "signals", "strength", status.alias("status"))


def obligations(lines: DataFrame, series: DataFrame, found: DataFrame, treatments: DataFrame) -> DataFrame:
    """One row an obligation: whether it counts, with what amount, from where, or why it is unresolved.

    A tradeline takes its confirmed match, else its first proposed one. Loan-like
    series that no live match uses become rows of their own. The newest
    treatment by an analyst comes last.
    """
    live = found.where("status IN ('confirmed', 'proposed')")
    taken = live.groupBy("tradeline_id").agg(F.min(F.struct((F.col("status") != "confirmed").alias("later"), "series_id")).alias("m")).select("tradeline_id", F.col("m.series_id").alias("series_id"))
    observed = series.select("series_id", F.col("amount").alias("seen_amount"), "fixed_amount")
    bureau = tradelines(lines).join(taken.join(observed, "series_id", "left"), "tradeline_id", "left")
    basis = (
        F.when(F.col("closed"), "closed")
        .when(F.col("kind") == "od", "overdraft")
        .when(F.col("kind") == "card", "card")
        .when(F.col("role").isin("guarantor", "authorized user"), "role")
        .when(F.col("emi") > 0, "emi")
        .when(F.col("fixed_amount"), "observed")
        .when(F.col("emi_status") == "unverified", "unverified")
        .otherwise("missing")
    )
    amount = F.when(F.col("basis") == "emi", F.col("emi")).when(F.col("basis") == "observed", F.col("seen_amount"))
    origin = F.when(F.col("basis") == "closed", "reported").when(F.col("basis") == "emi", F.col("emi_status")).when(F.col("basis") == "observed", "inferred")
    from_bureau = bureau.withColumn("basis", basis).select("case_id", F.lit("bureau").alias("source"), F.col("tradeline_id").alias("key_id"), "basis", amount.cast("long").alias("amount"), origin.alias("origin"))
    unmatched = series.where("category = 'loan_repayment' AND recurring").join(found.where("status <> 'rejected'").select("series_id"), "series_id", "left_anti")
    from_bank = unmatched.select("case_id", F.lit("bank").alias("source"), F.col("series_id").alias("key_id"), F.lit("bank_only").alias("basis"), F.lit(None).cast("long").alias("amount"), F.lit(None).cast("string").alias("origin"))
    treated = treatments.groupBy("source", "key_id").agg(F.max_by(F.struct("include", F.col("amount").cast("long").alias("amount")), "treatment_id").alias("t"))
    rows = from_bureau.unionByName(from_bank).join(treated, ["source", "key_id"], "left")
    by_analyst = F.col("t").isNotNull()
    included = F.when(by_analyst, F.col("t.include")).otherwise(F.col("basis").isin("emi", "observed"))
    return rows.select(
        "case_id",
        "source",
        "key_id",
        F.when(by_analyst, "analyst").otherwise(F.col("basis")).alias("basis"),
        included.alias("included"),
        F.when(by_analyst, F.when(F.col("t.include"), F.col("t.amount"))).otherwise(F.col("amount")).alias("amount"),
        F.when(by_analyst, "analyst").otherwise(F.col("origin")).alias("origin"),
    )


def obligation_totals(rows: DataFrame) -> DataFrame:
    """Each case's included sum and the number of its rows that still need a decision."""
    open_row = ~F.col("included") & ~F.col("basis").isin("closed", "analyst")
    return rows.groupBy("case_id").agg(F.coalesce(F.sum(F.when(F.col("included"), F.col("amount"))), F.lit(0)).alias("total_included"), F.count_if(open_row).alias("n_unresolved"))


def salary_comparison(slips: DataFrame, credits: DataFrame, statements: DataFrame) -> DataFrame:
    """Net pay of each month beside the salary credited for it: credits up to the 10th pay the month before.

    A slip without a month takes no part; of two slips for a month the smaller document counts.
    """
    paid_for = F.when(F.dayofmonth("txn_date") <= 10, F.add_months(F.trunc("txn_date", "MM"), -1)).otherwise(F.col("txn_date"))
    banked = credits.groupBy("account_key", F.date_format(paid_for, "yyyy-MM").alias("month")).agg(F.sum("credit").alias("bank_total"))
    dated = slips.where("month IS NOT NULL").groupBy("account_key", "month").agg(F.min_by(F.struct("net"), "document_id").alias("slip"))
    months = F.explode(F.sequence(F.trunc("period_start", "MM"), F.trunc("period_end", "MM"), F.expr("INTERVAL 1 MONTH")))
    covered = statements.select("account_key", months.alias("first_day")).select("account_key", F.date_format("first_day", "yyyy-MM").alias("month"))
    before = covered.select("account_key", F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), -1), "yyyy-MM").alias("month"))
    could_show = covered.unionByName(before).distinct().withColumn("__covered", F.lit(True))
    both = dated.join(banked, ["account_key", "month"], "full_outer").join(could_show, ["account_key", "month"], "left")
    gap = F.col("bank_total") - F.col("slip.net")
    finding = (
        F.when(F.col("slip").isNull(), "no_slip")
        .when(F.col("slip.net").isNull(), "net_unverified")
        .when(F.col("bank_total").isNull(), F.when(F.col("__covered"), "no_credit").otherwise("not_covered"))
        .when(gap == 0, "equal")
        .when(gap > 0, "above")
        .otherwise("below")
    )
    return both.select("account_key", "month", F.col("slip.net").alias("slip_net"), "bank_total", gap.alias("difference"), finding.alias("finding"))


def suggested_income(slips: DataFrame) -> DataFrame:
    """Average net of the last verified slips, and their average gross for a year (an assumption)."""
    verified = slips.where("net IS NOT NULL AND gross IS NOT NULL AND month IS NOT NULL")
    newest = F.row_number().over(Window.partitionBy("account_key").orderBy(F.desc("month"), F.desc("document_id")))
    recent = verified.withColumn("__n", newest).where(F.col("__n") <= RECENT_SLIPS).groupBy("account_key").agg(F.count("*").alias("n_slips"), F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    average = F.bround(F.col("net").cast("decimal(20,6)") / F.col("n_slips"), 2).cast("double")
    annual = F.bround(F.col("gross").cast("decimal(20,6)") * 12 / F.col("n_slips"), 0).cast("long")
    return recent.select("account_key", "n_slips", average.alias("income"), annual.alias("annual_gross"))


def vintage(registrations: DataFrame, as_of: str) -> DataFrame:
    """Years since the earliest verified registration date of each case."""
    known = registrations.where("status <> 'unverified' AND value IS NOT NULL")
    first = known.groupBy("case_id").agg(F.min(F.struct("value", "field")).alias("f"))
    days = F.datediff(F.lit(as_of).cast("date"), "f.value")
    return first.select("case_id", F.col("f.value").alias("since"), F.col("f.field").alias("field"), F.bround(days.cast("decimal(10,0)") / F.lit("365.25").cast("decimal(5,2)"), 1).cast("double").alias("years"))
