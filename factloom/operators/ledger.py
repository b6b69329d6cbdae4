"""Statement rows: duplicates, reconciliation, daily balances, monthly rollups, series, retention, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import banking

# fixed values: thresholds of the banking analysis
LARGE_CREDIT, QUICK_SHARE, QUICK_DAYS = 10_000, 0.8, 2
#: covered days from which a month counts in the average
FULL_MONTH = 20
ORDER = ["txn_date", "document_id", "seq"]


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """A row that an earlier document of the account already shows is a duplicate; repeats inside a document are not.

    Rows of different balance are different payments. An account without a number, keyed by its document ("...doc7"), has no duplicates.
    """
    alike = ["account_key", "txn_date", "debit", "credit", "balance", text.normalise(F.col("narration"))]
    first = F.first("document_id").over(Window.partitionBy(*alike).orderBy("document_id", "seq", "txn_id"))
    numbered = ~F.col("account_key").cast("string").endswith(F.concat(F.lit("doc"), F.col("document_id").cast("string")))
    return rows.withColumn("duplicate", numbered & (F.col("document_id") != first))


def balance_breaks(rows: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Rows whose balance does not follow from the last stated one and their own amounts.

    Without statements an account is one line of rows; with them (document_id, opening) each document is, and starts from its opening.
    """
    key, order = (["account_key"], ORDER) if statements is None else (["document_id"], ["seq"])
    line = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("balance", ignorenulls=True).over(line)
    if statements is None:
        before = rows.withColumn("previous", last)
    else:
        openings = statements.select("document_id", F.col("opening").alias("__opening"))
        before = rows.join(openings, "document_id", "left").withColumn("previous", F.coalesce(last, "__opening")).drop("__opening")
    off = F.col("previous") + F.col("credit") - F.col("debit") - F.col("balance")
    return before.withColumn("off_by", off).where("balance IS NOT NULL AND previous IS NOT NULL AND off_by <> 0")


def reconciliation(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Whether each statement's opening, credits and debits give its last stated balance."""
    sums = rows.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.sum("debit").alias("debits"), F.sum("credit").alias("credits"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("closing"))
    expected = F.col("opening") + F.col("credits") - F.col("debits")
    both = sums.join(statements.select("document_id", "opening"), "document_id").withColumn("expected", expected).withColumn("difference", F.col("closing") - F.col("expected"))
    return both.select("document_id", "n_rows", "opening", "closing", "expected", "difference", F.when(F.col("difference") == 0, "reconciles").when(F.col("difference") != 0, "differs").alias("status"))


def daily_balances(rows: DataFrame) -> DataFrame:
    """The last stated balance of every day from an account's first to its last, carried forward: for rows without statements."""
    eod = rows.where("balance IS NOT NULL").groupBy("account_key", "txn_date").agg(F.max_by("balance", "seq").alias("eod"))
    span = rows.groupBy("account_key").agg(F.explode(F.sequence(F.min("txn_date"), F.max("txn_date"))).alias("txn_date"))
    line = Window.partitionBy("account_key").orderBy("txn_date").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(eod, ["account_key", "txn_date"], "left").select("account_key", "txn_date", F.last("eod", ignorenulls=True).over(line).alias("balance"))


def covered_balances(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """The balance at the end of every day that a statement covers; after a gap it starts from the next statement's opening.

    rows: without duplicates; statements: account_key, document_id, period_start, period_end, opening. An account has
    balances if a row states one and its first statement an opening. A day's own balance outranks an opening, and one
    stated on a day that is not covered is carried on too. A statement without an end covers no day.
    """
    # an account's points: days on which a row states a balance or a statement begins; the days between two of them are told only at the end
    held = statements.where("period_start IS NOT NULL").select("account_key", F.col("period_start").alias("txn_date"), F.col("document_id").alias("opened_by"), "opening", "period_end", F.lit(True).alias("begins"))
    both = rows.where("balance IS NOT NULL").select("account_key", "txn_date", "document_id", "seq", "balance").unionByName(held, allowMissingColumns=True).where("account_key IS NOT NULL")
    points = both.groupBy("account_key", "txn_date").agg(
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("document_id", "seq"))).alias("eod"),
        F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("opened_by"))).alias("opening"),
        F.min_by(F.struct("opening"), F.when(F.col("begins"), F.struct("opened_by"))).alias("begun"),
        F.min(F.when(F.col("period_end").isNotNull(), F.col("txn_date"))).alias("ended"),
        F.max(F.when(F.col("period_end") >= F.col("txn_date"), F.col("period_end"))).alias("reach"),
    )
    account = Window.partitionBy("account_key")
    line = account.orderBy("txn_date")
    so_far, before = (line.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    known = points.select(
        "account_key",
        "txn_date",
        "eod",
        "opening",
        F.first("begun", ignorenulls=True).over(so_far)["opening"].alias("first_opening"),
        F.min("ended").over(so_far).alias("since"),
        F.max("reach").over(so_far).alias("reach"),
        F.max("reach").over(before).alias("reached"),
        F.date_sub(F.lead("txn_date").over(line), 1).alias("last"),
        (F.count("eod").over(account) > 0).alias("states"),
    )
    # covered are the days up to the furthest end so far: one that it did not reach the day before begins anew
    starts = (F.col("reach") >= F.col("txn_date")) & F.coalesce(F.datediff("txn_date", "reached") > 1, F.lit(True))
    begun = F.when(F.col("txn_date") == F.col("since"), F.coalesce("opening", "first_opening")).otherwise(F.col("opening"))
    stated = known.withColumn("stated", F.coalesce(F.when(F.col("txn_date") >= F.col("since"), F.col("eod")), F.when(starts, begun)))
    carried = stated.withColumn("balance", F.last("stated", ignorenulls=True).over(so_far))
    until = F.when(F.col("reach").isNotNull(), F.least("reach", "last"))
    told = carried.withColumn("until", until).where("states AND first_opening IS NOT NULL AND until >= txn_date")
    return told.select("account_key", F.explode(F.sequence("txn_date", "until")).alias("txn_date"), "balance")


def balance_months(daily: DataFrame) -> DataFrame:
    """Covered days, average and lowest balance and negative days of each month of covered_balances."""
    return daily.groupBy("account_key", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("days"),
        F.bround(F.sum("balance").cast("decimal(30,6)") / F.count("balance"), 2).cast("double").alias("average"),
        F.min("balance").alias("lowest"),
        F.count_if(F.col("balance") < 0).alias("negative_days"),
    )


def average_balances(months: DataFrame) -> DataFrame:
    """An account's average monthly balance: over its months of FULL_MONTH covered days or more, null without one."""
    return months.groupBy("account_key").agg(F.bround(F.avg(F.when(F.col("days") >= FULL_MONTH, F.col("average").cast("decimal(20,2)"))), 2).cast("double").alias("average"))


def monthly(rows: DataFrame) -> DataFrame:
    cash = F.upper("narration").rlike(r"\bCASH\b")
    return rows.groupBy("account_key", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(
        F.sum("credit").alias("credits"),
        F.sum("debit").alias("debits"),
        F.count_if(F.col("credit") > 0).alias("n_credits"),
        F.count_if(F.col("debit") > 0).alias("n_debits"),
        F.coalesce(F.sum(F.when(cash, F.col("credit"))), F.lit(0)).alias("cash_in"),
    )


def statement_gaps(statements: DataFrame) -> DataFrame:
    """Successive statements of an account that leave days out or cover some twice."""
    line = Window.partitionBy("account_key").orderBy("period_start", "document_id")
    after = statements.withColumn("next_start", F.lead("period_start").over(line))
    kind = F.when(F.col("next_start") > F.date_add("period_end", 1), "gap").when(F.col("next_start") <= F.col("period_end"), "overlap")
    both = after.withColumn("next_end", F.lead("period_end").over(line)).withColumn("kind", kind).where("kind IS NOT NULL")
    first = F.when(F.col("kind") == "gap", F.date_add("period_end", 1)).otherwise(F.col("next_start"))
    last = F.when(F.col("kind") == "gap", F.date_sub("next_start", 1)).otherwise(F.least("period_end", "next_end"))
    return both.select("account_key", "document_id", "period_end", "next_start", "kind", first.alias("first_day"), last.alias("last_day"))


def accounts(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Each account of the statements: its range, gaps, overlaps, unique and duplicate rows and the totals of the unique ones. rows: as mark_duplicates gives them."""
    held = statements.groupBy("account_key").agg(F.count("*").alias("n_statements"), F.min("period_start").alias("first_day"), F.max("period_end").alias("last_day"))
    broken = statement_gaps(statements).groupBy("account_key").agg(F.count_if(F.col("kind") == "gap").alias("n_gaps"), F.count_if(F.col("kind") == "overlap").alias("n_overlaps"))
    own = ~F.col("duplicate")
    moved = rows.groupBy("account_key").agg(
        F.count_if(own).alias("unique_rows"),
        F.count_if(F.col("duplicate")).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(own, F.col("credit"))), F.lit(0)).alias("total_credits"),
        F.coalesce(F.sum(F.when(own, F.col("debit"))), F.lit(0)).alias("total_debits"),
    )
    counts = ["n_gaps", "n_overlaps", "unique_rows", "duplicate_rows", "total_credits", "total_debits"]
    return held.join(broken, "account_key", "left").join(moved, "account_key", "left").fillna(0, counts)


def business_months(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """Each month of an account in one row: turnover, business credits, cash, returns with their rows, and its covered balances.

    rows: without duplicates. Business credits leave out returns and own transfers; cash deposits are business.
    """
    month = F.date_format("txn_date", "yyyy-MM").alias("month")
    of = lambda amount, *tags: F.coalesce(F.sum(F.when((F.col(amount) > 0) & F.col("tag").isin(*tags), F.col(amount))), F.lit(0))
    moved = banking.tag(rows).groupBy("account_key", month).agg(
        F.sum("credit").alias("credits"),
        F.count_if(F.col("credit") > 0).alias("n_credits"),
        F.sum("debit").alias("debits"),
        F.count_if(F.col("debit") > 0).alias("n_debits"),
        of("credit", "business", "cash_deposit").alias("business_credits"),
        of("credit", "cash_deposit").alias("cash_in"),
        of("debit", "cash_withdrawal").alias("cash_out"),
        F.array_sort(F.collect_list(F.when(F.col("tag") == "return", F.col("txn_id")))).alias("return_ids"),
    )
    both = moved.join(balance_months(daily), ["account_key", "month"], "full_outer")
    amounts = ["credits", "n_credits", "debits", "n_debits", "business_credits", "cash_in", "cash_out", "days", "negative_days"]
    return both.fillna(0, amounts).withColumn("return_ids", F.coalesce("return_ids", F.array().cast("array<long>")))


def recurring(rows: DataFrame) -> DataFrame:
    """Debits of the servicing kinds by narration signature in two months or more; typical is the upper median. Rows marked duplicate take no part."""
    serving = rows.where(F.col("category").isin("loan_repayment", "card_payment", "od_interest"))
    if "duplicate" in rows.columns:
        serving = serving.where("NOT duplicate")
    key = ["account_key", "category", "signature"]
    placed = serving.withColumn("signature", text.signature(F.col("narration")))
    line = Window.partitionBy(*key).orderBy("debit", "txn_id")
    ranked = placed.withColumns({"__place": F.row_number().over(line), "__n": F.count("*").over(Window.partitionBy(*key))})
    made = ranked.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.date_format("txn_date", "yyyy-MM")).alias("n_months"),
        F.max(F.when(F.col("__place") == F.floor(F.col("__n") / 2) + 1, F.col("debit"))).alias("typical"),
        F.min("debit").alias("low"),
        F.max("debit").alias("high"),
        F.bround(F.sum("debit").cast("decimal(30,6)") / F.count("*"), 2).cast("double").alias("average"),
    )
    fixed = (F.col("high") - F.col("low")) * 200 <= F.greatest(F.lit(200), F.col("typical"))
    return made.where((F.col("n_months") >= 2) | (F.col("category") == "od_interest")).withColumn("fixed_amount", fixed)


def top_payers(rows: DataFrame, n: int = 5) -> DataFrame:
    """The largest payers of each account with their share of its credits."""
    paid = rows.where("credit > 0").groupBy("account_key", text.signature(F.col("narration")).alias("payer")).agg(F.sum("credit").alias("credits"))
    account = Window.partitionBy("account_key")
    ranked = paid.withColumns({"total": F.sum("credits").over(account), "rank": F.row_number().over(account.orderBy(F.desc("credits"), "payer"))})
    return ranked.where(F.col("rank") <= n).select("account_key", "payer", "credits", F.floor(F.col("credits") * 1000 / F.col("total")).cast("long").alias("per_mille"), "rank")


def retention(rows: DataFrame) -> DataFrame:
    """Large business credits and those of them of which QUICK_SHARE left again within QUICK_DAYS, each rupee of a debit counted once.

    rows: without duplicates. A credit takes what it needs from the earliest debits of its days that are still left, and
    the days of later credits begin no earlier. On the line of all debits one after the other, what is taken is therefore
    all that lies before one point: a credit has what lies between that point (or its first day) and its last day. That
    point is folded over each run of credits whose days touch; other credits cannot share a debit.
    """
    account = Window.partitionBy("account_key")
    daily = rows.groupBy("account_key", "txn_date").agg(F.sum("debit").alias("paid"))
    reach = daily.withColumn("upto", F.sum("paid").over(account.orderBy("txn_date"))).where("paid > 0").select("account_key", F.col("txn_date").alias("day"), "upto")
    large = banking.tag(rows).where(F.col("tag").isin("business", "cash_deposit") & (F.col("credit") >= LARGE_CREDIT)).select("account_key", "txn_date", "seq", "txn_id", "credit")
    # the debits up to a day are those of the last day on which there were any
    asked = large.select("account_key", F.explode(F.array(F.date_sub("txn_date", 1), F.date_add("txn_date", QUICK_DAYS))).alias("day")).distinct()
    line = account.orderBy("day", F.col("upto").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = reach.unionByName(asked.withColumn("upto", F.lit(None).cast(reach.schema["upto"].dataType)))
    known = both.withColumn("debits", F.coalesce(F.last("upto", ignorenulls=True).over(line), F.lit(0))).where("upto IS NULL").drop("upto")
    at = lambda day, name: known.select("account_key", F.col("day").alias(day), F.col("debits").alias(name))
    spans = large.withColumns({"before": F.date_sub("txn_date", 1), "until": F.date_add("txn_date", QUICK_DAYS)}).join(at("before", "s"), ["account_key", "before"]).join(at("until", "e"), ["account_key", "until"])
    order = account.orderBy("txn_date", "seq", "txn_id")
    opens = F.coalesce((F.datediff("txn_date", F.lag("txn_date").over(order)) > QUICK_DAYS).cast("int"), F.lit(1))
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    credit = F.struct("txn_date", "seq", "txn_id", F.col("s").cast("decimal(30,2)").alias("s"), F.col("e").cast("decimal(30,2)").alias("e"), F.col("credit").cast("decimal(30,2)").alias("credit"))
    zero = F.lit(0).cast("decimal(30,2)")
    start = F.struct(zero.alias("taken"), F.lit(0).cast("long").alias("n"), zero.alias("amount"))

    def allot(done: Column, c: Column) -> Column:
        since = F.greatest(done["taken"], c["s"])
        need = (c["credit"] * F.lit(QUICK_SHARE).cast("decimal(2,1)")).cast("decimal(30,2)")
        left = c["e"] - since >= need
        return F.struct(
            F.when(left, since + need).otherwise(done["taken"]).cast("decimal(30,2)").alias("taken"),
            (done["n"] + left.cast("long")).alias("n"),
            (done["amount"] + F.when(left, c["credit"]).otherwise(zero)).cast("decimal(30,2)").alias("amount"),
        )

    folded = runs.groupBy("account_key", "run").agg(F.count("*").alias("n"), F.sum("credit").alias("amount"), F.array_sort(F.collect_list(credit)).alias("credits")).withColumn("done", F.aggregate("credits", start, allot))
    return folded.groupBy("account_key").agg(
        F.sum("n").alias("n_large"), F.sum("done.n").alias("n_quick"), F.sum("amount").alias("large_amount"), F.sum("done.amount").cast("decimal(38,2)").alias("quick_amount")
    )


def eligibility(cases: DataFrame) -> DataFrame:
    """Instalment capacity, principal and present ratio at the assumptions; status invalid, needs_input or computed.

    Invalid: an income not above 0, negative obligations, a ratio not above 0 or over 100 %, a rate outside 0 to 60 %, a
    tenure that is no whole number of 1 to 480 months. The capacity is rounded first; the principal is of the rounded one.
    """
    income, owed, ratio, rate, tenure = (F.col(c).cast("decimal(18,4)") for c in ("income", "obligations", "ratio_pct", "rate_pct", "tenure"))
    bad = (income <= 0) | (owed < 0) | (ratio <= 0) | (ratio > 100) | ~rate.between(0, 60) | ~tenure.between(1, 480) | (tenure != F.floor(tenure))
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in ("income", "obligations", "ratio_pct", "rate_pct", "tenure")]) == 1
    status = F.when(F.coalesce(bad, F.lit(False)), "invalid").when(missing, "needs_input").otherwise("computed")
    capacity = F.round(F.greatest(F.lit(0).cast("decimal(38,8)"), (ratio * income / 100 - owed).cast("decimal(38,8)")), 2).cast("double")
    i, n = rate.cast("double") / 1200, tenure.cast("double")
    principal = F.when(rate == 0, capacity * n).otherwise(capacity * (1 - F.pow(1 + i, -n)) / i)
    done = F.col("status") == "computed"
    present = F.when((F.col("status") != "invalid") & (income > 0), F.round(owed * 100 / income, 2).cast("double"))
    return cases.withColumn("status", status).select(
        "case_id", "status", F.when(done, capacity).alias("capacity"), F.when(done, F.round(principal, 0)).alias("principal"), present.alias("present_ratio")
    )


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key of an append-only table."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("row")).select(*key, "row.*")


