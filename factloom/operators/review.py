"""Case review: tax-return JSON, the checklist of documents, findings with acknowledgements, and headline figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: where a tax return may hold each figure, the first place that does counts
RETURN_PATHS = {
    "gross_salary": ["$.ITR1_IncomeDeductions.GrossSalary", "$.ScheduleS.TotalGrossSalary", "$.ScheduleS.Salaries[0].Salarys.GrossSalary"],
    "income_from_salary": ["$.ITR1_IncomeDeductions.IncomeFromSal", "$.ScheduleS.TotIncUnderHeadSalaries"],
    "gross_total_income": ["$.ITR1_IncomeDeductions.GrossTotIncome", "$['PartB-TI'].GrossTotalIncome"],
    "total_income": ["$.ITR1_IncomeDeductions.TotalIncome", "$['PartB-TI'].TotalIncome"],
    "tax_payable": ["$.ITR1_TaxComputation.TotalTaxPayable", "$['PartB_TTI'].ComputationOfTaxLiability.TaxPayableOnTI"],
    "employer": ["$.ScheduleS.Salaries[0].NameOfEmployer"],
}
# fixed values: keys that show pre-filled data
PREFILL_KEYS = ["personalInfo", "insights", "prefillData", "tdsDetails", "salaryDetails"]
# fixed values: statuses of documents that were not read, and kinds that must be read whole
UNREAD, WHOLE_KINDS = ["failed", "unsupported", "processing", "received"], ["credit_report", "bank_statement", "salary_slip"]
# fixed values: shares at which cash deposits and one counterparty are asked about, in per mille
CASH_SHARE, PARTY_SHARE = 300, 500
#: What a salaried case needs: item, kinds of document that serve, how many.
SALARIED = [("salary slips", ["salary_slip"], 3), ("bank statement", ["bank_statement"], 1), ("credit report", ["credit_report"], 1), ("tax return or form 16", ["itr_json", "form16"], 1)]

FINDING = ["case_id", "rule", "item", "kind", "blocking", "by_ack"]


def tax_returns(files: DataFrame) -> DataFrame:
    """Of each file (document_id, raw): json_type (return, prefill, unknown, invalid), form, and whether an acknowledgement proves the filing."""
    keys = F.json_object_keys("raw")
    returned = F.json_object_keys(F.get_json_object("raw", "$.ITR"))
    kind = (
        F.when(F.get_json_object("raw", "$").isNull(), "invalid")
        .when(returned.isNotNull(), "return")
        .when(F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, PREFILL_KEYS))), F.lit(False)), "prefill")
        .otherwise("unknown")
    )
    read = files.select("document_id", "raw", kind.alias("json_type"), F.try_element_at(returned, F.lit(1)).alias("form"))
    body = read.withColumn("body", F.expr("get_json_object(raw, concat('$.ITR.', form))"))
    proof = F.coalesce(F.get_json_object("body", "$.CreationInfo.AckNo"), F.get_json_object("raw", "$.AckNo"))
    return body.withColumn("acknowledged", F.when(F.col("json_type") == "return", F.coalesce(proof, F.lit("")) != ""))


def tax_facts(files: DataFrame) -> DataFrame:
    """One row a figure of a return: document_id, field, value_text, value (null for names and what is no number)."""
    year = F.expr("get_json_object(body, concat('$.Form_', form, '.AssessmentYear'))")
    found = [F.struct(F.lit(f).alias("field"), F.coalesce(*[F.get_json_object("body", p) for p in paths]).alias("value_text")) for f, paths in RETURN_PATHS.items()]
    found.append(F.struct(F.lit("assessment_year").alias("field"), F.concat(F.lit("AY "), year, F.lit("-"), F.right((year.try_cast("int") + 1).cast("string"), F.lit(2))).alias("value_text")))
    rows = tax_returns(files).where("json_type = 'return'").select("document_id", F.inline(F.array(*found))).where("value_text IS NOT NULL")
    return rows.withColumn("value", F.when(~F.col("field").isin("employer", "assessment_year"), F.col("value_text").try_cast("decimal(24,2)")))


def checklist(files: DataFrame, required: list[tuple[str, list[str], int]] = SALARIED) -> DataFrame:
    """case_id, item, received, missing, for each case that has files and each required item; a file counts once, read or not."""
    counts = [F.count_distinct(F.when(F.col("kind").isin(kinds), F.col("document_id"))).alias(f"n{i}") for i, (_, kinds, _) in enumerate(required)]
    items = [F.struct(F.lit(item).alias("item"), F.col(f"n{i}").alias("received"), (F.col(f"n{i}") < least).alias("missing")) for i, (item, _, least) in enumerate(required)]
    return files.groupBy("case_id").agg(*counts).select("case_id", F.inline(F.array(*items)))


def finding(rows: DataFrame, rule: str, item: Column, kind: Column | str, blocking: Column | bool, by_ack: bool = True) -> DataFrame:
    """The rows as findings; kind: missing, discrepancy or confirm; by_ack: an acknowledgement settles it."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("case_id", F.lit(rule).alias("rule"), item.cast("string").alias("item"), as_column(kind).alias("kind"), as_column(blocking).alias("blocking"), F.lit(by_ack).alias("by_ack"))


def document_findings(files: DataFrame) -> DataFrame:
    unread = F.col("status").isin(UNREAD) & (F.col("kind") != "kyc")
    rows = files.where(unread | (F.col("status") == "incomplete"))
    return finding(rows, "document", F.col("document_id"), "missing", unread | F.col("kind").isin(WHOLE_KINDS))


def checklist_findings(listed: DataFrame) -> DataFrame:
    return finding(listed.where("missing"), "checklist", F.col("item"), "missing", False)


def match_findings(matches: DataFrame) -> DataFrame:
    rows = matches.where("status IN ('ambiguous', 'proposed')")
    return finding(rows, "match", F.concat_ws("/", "tradeline_id", "series_id"), "confirm", F.col("status") == "ambiguous", False)


def obligation_findings(obligations: DataFrame) -> DataFrame:
    rows = obligations.where("NOT included AND basis NOT IN ('closed', 'analyst')")
    blank = (F.col("source") == "bureau") & F.col("basis").isin("overdraft", "card", "missing")
    return finding(rows, "obligation", F.concat_ws(":", "source", "key_id"), F.when(blank, "missing").otherwise("confirm"), True, False)


def banking_findings(months: DataFrame, parties: DataFrame) -> DataFrame:
    """From monthly business and counterparties, each with case_id: returns, the share of cash, dependence on one party."""
    sums = months.groupBy("case_id", "account_key").agg(*[F.sum(c).alias(c) for c in ("business_credits", "cash_deposits", "n_returns")])
    account = F.col("account_key")
    cash = (F.col("business_credits") > 0) & (F.col("cash_deposits") * 1000 >= F.col("business_credits") * CASH_SHARE)
    rules = [
        finding(sums.where("n_returns > 0"), "returns", account, "discrepancy", False),
        finding(sums.where(cash), "cash", account, "confirm", False),
        finding(parties.where(f"rank = 1 AND per_mille >= {PARTY_SHARE}"), "concentration", account, "confirm", False),
    ]
    return reduce(DataFrame.unionByName, rules)


def slip_findings(slips: DataFrame) -> DataFrame:
    wrong = slips.where("gross - deductions <> net")
    return finding(slips.where("month IS NULL"), "slip_month", F.col("document_id"), "confirm", False).unionByName(finding(wrong, "slip_sum", F.col("document_id"), "discrepancy", False))


def salary_findings(compared: DataFrame) -> DataFrame:
    said = F.col("finding")
    kind = F.when(said.isin("above", "below"), "discrepancy").when(said == "net_unverified", "confirm").otherwise("missing")
    return finding(compared.where(~said.isin("equal", "not_covered")), "income", F.concat_ws(":", "account_key", "month"), kind, False)


def settled(findings: DataFrame, acks: DataFrame) -> DataFrame:
    """Each finding once, with resolved: the newest acknowledgement settles those that one can settle."""
    key = ["case_id", "rule", "item"]
    first = findings.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("blocking"), "kind"))).where("n = 1").drop("n")
    newest = acks.groupBy(*key).agg(F.max("ack_id").alias("ack_id"))
    joined = first.join(newest, key, "left")
    return joined.select(*key, "kind", "blocking", (F.col("by_ack") & F.col("ack_id").isNotNull()).alias("resolved"))


def headline(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Open findings of each case by kind, what blocks it, and its obligations; a case may lack either."""
    still = lambda *kinds: F.count_if(~F.col("resolved") & F.col("kind").isin(*kinds))
    counted = findings.groupBy("case_id").agg(
        still("missing").alias("n_missing"),
        still("discrepancy").alias("n_discrepancy"),
        still("confirm").alias("n_confirm"),
        F.count_if(~F.col("resolved") & F.col("blocking")).alias("n_blocking"),
        F.count_if("resolved").alias("n_resolved"),
    )
    joined = counted.join(totals, "case_id", "full_outer")
    state = F.when(F.coalesce(F.col("n_blocking"), F.lit(0)) > 0, "provisional").otherwise("computed")
    return joined.select("case_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_discrepancy", "n_confirm", "n_blocking", "n_resolved", "total_included")], state.alias("state"))


def case_list(files: DataFrame) -> DataFrame:
    read = F.count_if(F.col("status") == "complete")
    return files.groupBy("case_id").agg(F.count("*").alias("n_documents"), read.alias("n_read"), F.max("received_on").alias("last_received"))
