"""Case underwriting: overdrafts, eligibility at the newest assumptions with what makes it provisional, and both checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import credit, ledger

# fixed values: the assumptions an eligibility needs
ASSUMPTION_KEYS = ("eligible_income", "foir_max_pct", "annual_rate_pct", "tenure_months")
# fixed values: kinds of document behind each item of a proprietorship's checklist
PROPRIETOR_KINDS = {
    "kyc": ["kyc"],
    "gst": ["gst_certificate", "business_proof"],
    "udyam": ["udyam_certificate"],
    "itr": ["itr_ack", "itr_json", "itr_computation"],
    "financials": ["financials"],
    "business_proof": ["business_proof"],
    "loan_papers": ["loan_soa", "od_sanction", "loan_sanction"],
}
COMPUTATION_KINDS = ["itr_computation", "itr_json"]
# fixed values: months of statements that each type of account should cover
COVERED_MONTHS = {"current": 12, "savings": 6}


def usable(value: Column, status: Column) -> Column:
    """A reported or an analyst's number; null where it is unverified or missing."""
    return F.when(F.coalesce(status, F.lit("")) != "unverified", value)


def field_state(value: Column, status: Column) -> Column:
    """not reported (no such field: null status), reported blank, unverified or reported."""
    return F.when(status.isNull(), "not reported").when(status == "unverified", "unverified").when(value.isNull(), "reported blank").otherwise("reported")


def overdrafts(lines: DataFrame, found: DataFrame, obligations: DataFrame, files: DataFrame) -> DataFrame:
    """Each overdraft tradeline: limit (the credit limit where no amount was sanctioned), balance, drawing power, its interest series and sanction papers.

    The series is that of the confirmed match, else of the first proposed one.
    The limit is no debt: only an obligation's own row can count.
    """
    kept = credit.tradelines(lines).where("kind = 'od'")
    limit = F.coalesce(F.nullif(usable(F.col("sanctioned_amount"), F.col("sanctioned_status")), F.lit(0)), usable(F.col("credit_limit"), F.col("limit_status")))
    first = F.min(F.struct((F.col("status") != "confirmed").alias("later"), "series_id"))
    taken = found.where("status IN ('confirmed', 'proposed')").groupBy("tradeline_id").agg(first.alias("m"))
    papers = files.where("kind = 'od_sanction'").groupBy("case_id").agg(F.count_distinct("document_id").alias("n"))
    owed = obligations.where("source = 'bureau'").select(F.col("key_id").alias("tradeline_id"), "basis", "included", F.col("amount").alias("obligation"))
    shown = kept.select(
        "case_id",
        "tradeline_id",
        "lender",
        limit.cast("long").alias("sanctioned_limit"),
        usable(F.col("current_balance"), F.col("balance_status")).cast("long").alias("outstanding"),
        usable(F.col("drawing_power"), F.col("power_status")).cast("long").alias("drawing_power"),
        field_state(F.col("drawing_power"), F.col("power_status")).alias("drawing_power_state"),
    )
    joined = shown.join(taken, "tradeline_id", "left").join(papers, "case_id", "left").join(owed, "tradeline_id", "left")
    match = F.when(F.col("m").isNotNull(), F.when(F.col("m.later"), "proposed").otherwise("confirmed"))
    return joined.select(*shown.columns, F.col("m.series_id").alias("series_id"), match.alias("match_status"), F.coalesce("n", F.lit(0)).alias("n_sanction_papers"), "basis", "included", "obligation")


def assumptions(rows: DataFrame) -> DataFrame:
    """The newest value of each known assumption of a case, and how many were recorded. rows: assumption_id, case_id, key, value, append-only."""
    known = rows.where(F.col("key").isin(*ASSUMPTION_KEYS))
    return known.groupBy("case_id", "key").agg(F.max_by("value", "assumption_id").alias("value"), F.max("assumption_id").alias("assumption_id"), F.count("*").alias("n_recorded"))


def case_eligibility(recorded: DataFrame, suggested: DataFrame, totals: DataFrame) -> DataFrame:
    """Eligibility of every case that has assumptions; computed becomes provisional while its income is only suggested or liability rows are open.

    recorded: rows of `assumptions`; suggested: case_id, income; totals: of
    `obligation_totals`. An assumption set to null stays null: the suggestion
    stands in only for one never recorded. A case without liability rows owes 0.
    """
    wide = recorded.groupBy("case_id").agg(
        F.bool_or(F.col("key") == "eligible_income").alias("by_analyst"), *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ASSUMPTION_KEYS]
    )
    joined = wide.join(suggested.select("case_id", F.col("income").alias("suggestion")), "case_id", "left").join(totals, "case_id", "left")
    money = "decimal(18,4)"
    inputs = joined.select(
        "case_id",
        F.when(F.col("by_analyst"), F.col("eligible_income").cast(money)).otherwise(F.col("suggestion").cast(money)).alias("income"),
        F.coalesce("total_included", F.lit(0)).alias("obligations"),
        F.col("foir_max_pct").alias("ratio_pct"),
        F.col("annual_rate_pct").alias("rate_pct"),
        F.col("tenure_months").alias("tenure"),
        F.when(F.col("by_analyst"), "analyst").when(F.col("suggestion").isNotNull(), "suggested").alias("income_origin"),
        F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"),
    )
    judged = ledger.eligibility(inputs.drop("income_origin", "n_unresolved")).join(inputs.select("case_id", "income_origin", "n_unresolved"), "case_id")
    open_points = (F.col("income_origin") == "suggested") | (F.col("n_unresolved") > 0)
    return judged.withColumn("status", F.when((F.col("status") == "computed") & open_points, "provisional").otherwise(F.col("status")))


def salaried_slips(slips: DataFrame) -> DataFrame:
    """The three months up to a case's newest slip that no slip covers. slips: case_id, month (yyyy-MM); slips without a month show none."""
    held = slips.where("month IS NOT NULL").groupBy("case_id").agg(F.collect_set("month").alias("months"))
    last = F.to_date(F.array_max("months"), "yyyy-MM")
    wanted = F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda n: F.date_format(F.add_months(last, n), "yyyy-MM"))
    missing = F.filter(wanted, lambda m: ~F.array_contains("months", m))
    return held.select("case_id", F.size("months").alias("n_months"), F.array_join(missing, ",").alias("missing_months"))


def salary_account(accounts: DataFrame) -> DataFrame:
    """The account of a case with most unique rows (ties to the smallest key) and whether its statements reach back far enough.

    They should begin by the first of the month that holds the day 150 days
    before the first day of the last month covered. accounts: rows of
    `ledger.accounts` with case_id.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc("unique_rows"), "account_key")
    chosen = accounts.withColumn("n", F.row_number().over(order)).where("n = 1")
    wanted = F.trunc(F.date_sub(F.trunc("last_day", "MM"), 150), "MM")
    short = F.coalesce(F.col("first_day") > wanted, F.lit(False))
    return chosen.select("case_id", "account_key", "first_day", "last_day", wanted.alias("wanted_from"), "n_gaps", (~short & (F.col("n_gaps") == 0)).alias("ok"))


def proprietor_checklist(files: DataFrame, statements: DataFrame, open_loans: DataFrame) -> DataFrame:
    """case_id, item, received (documents or days covered), ok, for every case that has files.

    statements: case_id, account_type, period_start, period_end; open_loans:
    case_id, a row for each open loan or recurring instalment. Statements may
    begin three days late. Loan papers are asked for only where a loan is open.
    """
    of_kind = lambda kinds: F.count_distinct(F.when(F.col("kind").isin(kinds), F.col("document_id")))
    counted = files.groupBy("case_id").agg(*[of_kind(k).alias(i) for i, k in PROPRIETOR_KINDS.items()], of_kind(COMPUTATION_KINDS).alias("computed"))
    periods = statements.where("period_start IS NOT NULL AND period_end IS NOT NULL").groupBy("case_id").agg(
        *[f(F.when(F.col("account_type") == t, F.col(c))).alias(f"{t}_{c}") for t in COVERED_MONTHS for f, c in ((F.min, "period_start"), (F.max, "period_end"))]
    )
    loans = open_loans.groupBy("case_id").agg(F.count("*").alias("n_open"))
    joined = counted.join(periods, "case_id", "left").join(loans, "case_id", "left")

    def item(name: str, received: Column, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("item"), received.cast("long").alias("received"), ok.alias("ok"))

    def held(name: str, ok: Column | None = None) -> Column:
        return item(name, F.col(name), F.col(name) > 0 if ok is None else ok)

    def covered(account_type: str, months: int) -> Column:
        first, last = F.col(f"{account_type}_period_start"), F.col(f"{account_type}_period_end")
        wanted = F.add_months(F.trunc(last, "MM"), 1 - months)
        return item(f"{account_type}_statement", F.coalesce(F.datediff(last, first) + 1, F.lit(0)), F.coalesce(first <= F.date_add(wanted, 3), F.lit(False)))

    rows = [
        held("kyc"),
        held("gst"),
        held("udyam"),
        held("itr", (F.col("itr") >= 2) & (F.col("computed") > 0)),
        held("financials"),
        held("business_proof"),
        *[covered(t, m) for t, m in COVERED_MONTHS.items()],
        held("loan_papers", (F.col("loan_papers") > 0) | F.col("n_open").isNull()),
    ]
    return joined.select("case_id", F.inline(F.array(*rows)))
