"""The engine's inputs (rating actions, claims, statement rows) as views over the star-schema test tables.

Each view is one SELECT that Spark and DuckDB both run; `{orders}` and the like stand for tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ACTIONS = """
SELECT o_orderkey AS claim_id, CAST(floor(o_custkey / 15) AS BIGINT) AS issuer_id, substr(o_orderpriority, 1, 1) AS agency,
       CASE o_orderkey % 3 WHEN 0 THEN 'ncd' WHEN 1 THEN 'bank_facility' ELSE 'commercial_paper' END AS instrument_class,
       CASE WHEN o_orderkey % 3 = 2 THEN 'short_term' ELSE 'long_term' END AS term,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'AA' WHEN o_custkey % 4 = 1 THEN 'AA+' WHEN o_custkey % 4 = 2 THEN 'aa ' ELSE 'A' END AS grade,
       CASE o_custkey % 3 WHEN 0 THEN 'Stable' WHEN 1 THEN 'NEGATIVE ' ELSE NULL END AS outlook,
       CASE o_custkey % 5 WHEN 0 THEN 'Watch with Negative Implications' WHEN 1 THEN 'WATCH with  negative implications' WHEN 2 THEN 'Watch with Developing Implications' END AS watch,
       CASE o_orderkey % 4 WHEN 0 THEN 'Long Term  Long Term Instruments' WHEN 1 THEN 'NCD programme' ELSE 'Facilities ' || CAST(o_orderkey % 9 AS VARCHAR(20)) END AS instrument,
       CASE WHEN o_orderkey % 41 = 0 OR o_orderkey % 23 = 0 THEN 'reaffirmed; withdrawn' WHEN o_orderkey % 7 = 0 THEN 'assigned; downgraded; removed' WHEN o_orderkey % 7 = 1 THEN 'upgraded' WHEN o_orderkey % 7 = 2 THEN 'revised'
            WHEN o_orderkey % 7 = 3 THEN 'placed on' WHEN o_orderkey % 7 = 4 THEN 'assigned' WHEN o_orderkey % 35 = 5 THEN NULL ELSE 'reaffirmed' END AS action,
       CASE WHEN o_orderkey % 3 = 0 THEN 'AA-' END AS previous, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o_orderdate) * 10 + o_orderkey % 7 AS BIGINT) END AS published,
       CAST(o_orderdate AS DATE) AS action_date,
       CASE WHEN o_custkey % 6 = 0 THEN 'history_annexure' ELSE 'primary_rationale' END AS provenance
FROM {orders}
"""

CLAIMS = """
SELECT l_orderkey * 10 + l_linenumber AS claim_id, CAST(floor(l_orderkey / 500) AS BIGINT) AS issuer_id,
       CASE WHEN l_partkey % 50 < 2 THEN 'rated_amount|' WHEN l_partkey % 50 < 4 THEN 'instrument|' WHEN l_partkey % 50 < 5 THEN 'rating_history|' ELSE 'metric|' END || CAST(l_partkey % 50 AS VARCHAR(20)) || '|total' AS fact_key,
       CAST(l_suppkey % 7 AS BIGINT) AS document_id, 'source' || CAST(l_suppkey % 4 AS VARCHAR(20)) AS source_name,
       CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CASE WHEN l_partkey % 50 IN (17, 18) THEN -1 ELSE 1 END * CAST(floor(100000 + l_quantity * CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) END AS value,
       CASE WHEN l_partkey % 2 = 0 THEN 'INR_CRORE' ELSE 'PERCENT' END AS unit,
       CASE WHEN l_partkey % 11 = 0 AND l_suppkey % 2 = 0 THEN 'agency_adjusted' ELSE 'consolidated' END AS basis,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'Negative' WHEN l_suppkey % 3 = 1 THEN 'NEGATIVE ' ELSE 'Stable' END AS value_text
FROM {lineitem}
"""

AGREED = f"""
SELECT claim_id, issuer_id, fact_key, document_id, source_name, CASE WHEN substr(fact_key, 8, 2) IN ('17', '18') THEN -100000 + document_id WHEN substr(fact_key, 8, 1) IN ('1', '2') THEN 100000 + document_id ELSE value END AS value
FROM ({CLAIMS}) c
"""

LEDGER = """
SELECT o_orderkey AS txn_id, o_custkey AS account_key, CAST(o_orderdate AS DATE) AS txn_date, o_orderkey AS seq,
       CAST(year(o_orderdate) * 2 + o_orderkey % 2 AS BIGINT) AS document_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'EMI  HDFC LOAN' WHEN o_orderkey % 5 = 1 THEN 'upi/SHREE TRADERS/9' WHEN o_orderkey % 5 = 2 THEN 'CASH DEP' ELSE 'NEFT-ACME LTD-778' END AS narration,
       CASE WHEN o_orderkey % 5 = 0 THEN 'loan_repayment' WHEN o_orderkey % 5 = 1 THEN 'card_payment' ELSE 'other' END AS category,
       CASE WHEN o_orderkey % 5 < 2 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS debit,
       CASE WHEN o_orderkey % 5 < 2 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS credit
FROM {orders}
"""

BALANCED = f"""
SELECT t.*, CASE WHEN txn_id % 13 = 0 THEN NULL
       ELSE CAST(sum(credit - debit) OVER (PARTITION BY account_key ORDER BY txn_date, document_id, seq ROWS UNBOUNDED PRECEDING) AS BIGINT)
            + CASE WHEN txn_id % 29 = 0 THEN 7 ELSE 0 END END AS balance
FROM ({LEDGER}) t
"""

REPEATED = f"""
SELECT txn_id, CASE WHEN account_key % 10 = 0 THEN 'unnumbered-doc' || CAST(document_id AS VARCHAR(20)) ELSE CAST(account_key AS VARCHAR(20)) END AS account_key, txn_date, seq, document_id, narration, category, debit, credit, balance
FROM (
  SELECT a.*, CASE WHEN txn_id % 9 = 0 THEN NULL ELSE txn_id % 1000 END AS balance FROM ({LEDGER}) a
  UNION ALL SELECT txn_id + 100000000, account_key, txn_date, seq, document_id + 1, upper(narration), category, debit, credit, CASE WHEN txn_id % 9 = 0 THEN NULL WHEN txn_id % 8 = 0 THEN txn_id % 1000 + 1 ELSE txn_id % 1000 END FROM ({LEDGER}) b WHERE txn_id % 4 = 0) r
"""

STATEMENTS = """
SELECT c_custkey AS account_key, c_custkey * 10 + n AS document_id,
       date_add_days(DATE '2024-01-01', CAST(n * 40 + c_custkey % 7 AS INT)) AS period_start,
       date_add_days(DATE '2024-01-01', CAST(n * 40 + c_custkey % 7 + 30 + c_custkey % 20 AS INT)) AS period_end,
       CAST(1000 * n + c_custkey % 100 AS BIGINT) AS opening
FROM {customer} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) k
"""

STATED_ROWS = """
SELECT c_custkey * 100 + k AS txn_id, c_custkey AS account_key, c_custkey * 10 + CAST(floor(k / 4) AS BIGINT) AS document_id, CAST(k AS BIGINT) AS seq,
       date_add_days(DATE '2024-01-01', CAST(floor(k / 4) * 40 + c_custkey % 7 + k % 4 * 9 AS INT)) AS txn_date,
       CASE (c_custkey + k) % 9 WHEN 0 THEN 'ACH-HDFC BANK-EMI 1234' WHEN 1 THEN 'ATM 0042' WHEN 2 THEN 'ECS RETURN CHGS' WHEN 3 THEN 'RTN CHG' WHEN 4 THEN 'UPI/SHREE TRADERS/9'
            WHEN 5 THEN 'NEFT RETURN UNPAID' WHEN 6 THEN 'CASH DEP 0021' WHEN 7 THEN 'OWN A/C SWEEP' ELSE 'IMPS/334455/RAVI STORES' END AS narration,
       CASE WHEN (c_custkey + k) % 9 < 4 THEN CAST(4000 + c_custkey % 13 * 1000 + k * 100 AS BIGINT) ELSE 0 END AS debit,
       CASE WHEN (c_custkey + k) % 9 < 4 THEN 0 ELSE CAST(6000 + c_custkey % 11 * 1000 AS BIGINT) END AS credit,
       CASE WHEN (c_custkey + k) % 5 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE CAST(500 * k - 1500 + c_custkey % 300 AS BIGINT) END AS balance
FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) t
"""

DAYS = """
SELECT event_id AS txn_id, user_id AS account_key, CAST(ts AS DATE) AS txn_date, event_id AS seq,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS balance,
       CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS credit,
       CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS debit
FROM {events}
"""

REPORTS = """
SELECT CAST(l_suppkey % 5 AS BIGINT) AS agency_id, CAST(year(l_shipdate) AS BIGINT) AS report,
       'key' || CAST(l_partkey AS VARCHAR(20)) AS item, 'v' || CAST(l_orderkey % 3 AS VARCHAR(20)) AS value_text, l_orderkey * 10 + l_linenumber AS claim_id
FROM {lineitem}
"""

ASSUMPTIONS = """
SELECT c_custkey AS case_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(floor(c_acctbal * 10) AS BIGINT) END AS income,
       CAST(c_custkey % 4000 AS BIGINT) AS obligations, CAST(CASE WHEN c_custkey % 31 = 0 THEN 150 WHEN c_custkey % 29 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 0.5 ELSE 40 + c_custkey % 20 END AS DECIMAL(9, 2)) AS ratio_pct,
       CAST(c_custkey % 15 AS BIGINT) AS rate_pct, CAST(12 * (c_custkey % 20) + CASE WHEN c_custkey % 37 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(9, 2)) AS tenure
FROM {customer}
"""

NARRATED = """
SELECT o_orderkey AS txn_id, o_custkey AS account_key, CAST(o_orderdate AS DATE) AS txn_date, o_orderkey AS seq,
       CASE o_orderkey % 16 WHEN 0 THEN 'ACH-HDFC BANK-EMI 1234' WHEN 1 THEN 'OD INT charged' WHEN 2 THEN 'CARD BILL AUTOPAY ICICI' WHEN 3 THEN 'UPI/SHREE TRADERS/ok@bank/9981'
            WHEN 4 THEN 'ATM 0042' WHEN 5 THEN 'ECS RETURN CHGS' WHEN 6 THEN 'RTN CHG' WHEN 7 THEN 'NEFT-ICIC0000123-KUMAR STEEL WORKS PVT'
            WHEN 8 THEN 'Salary ACME TECHNOLOGIES' WHEN 9 THEN 'NEFT-ACME-JAN' WHEN 10 THEN 'BY SALARY CREDIT' WHEN 11 THEN 'CASH DEP 0021'
            WHEN 12 THEN 'NEFT RETURN UNPAID' WHEN 13 THEN 'OWN A/C SWEEP' WHEN 14 THEN 'UPI/KUMAR STEEL WORKS/pay@bank' ELSE 'IMPS/334455/RAVI STORES AND SONS LTD' END AS narration,
       CASE WHEN o_orderkey % 16 < 8 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS debit,
       CASE WHEN o_orderkey % 16 < 8 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS credit
FROM {orders}
"""

PARTIES = """
SELECT c_custkey AS account_key, CASE c_custkey % 3 WHEN 0 THEN 'ACME TECHNOLOGIES PVT LTD' WHEN 1 THEN NULL ELSE 'Shree Foods' END AS employer,
       CASE WHEN c_custkey % 2 = 0 THEN 'HDFC Bank' ELSE 'State Bank of India' END AS lenders, CASE WHEN c_custkey % 5 = 0 THEN 'HDFC BANK' ELSE 'ICICI BANK' END AS own_bank
FROM {customer}
"""

SLIPS = """
SELECT c_custkey AS account_key, c_custkey * 10 + n AS document_id, CASE WHEN (c_custkey + n) % 9 = 0 THEN NULL ELSE '1997-0' || CAST(n + 1 AS VARCHAR(4)) END AS month,
       CAST(90000 + c_custkey % 700 AS BIGINT) AS gross, CAST(10000 AS BIGINT) AS deductions,
       CASE WHEN (c_custkey + n) % 7 = 0 THEN NULL ELSE CAST(80000 + c_custkey % 700 - n % 2 AS BIGINT) END AS net
FROM {customer} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k
"""

TRADELINES = """
SELECT c_custkey AS tradeline_id, CAST(floor(c_custkey / 8) AS BIGINT) AS case_id,
       CASE c_custkey % 4 WHEN 0 THEN 'HDFC BANK LTD' WHEN 1 THEN 'American Express Cards' WHEN 2 THEN 'SBI Housing Finance' ELSE NULL END AS lender,
       CASE c_custkey % 5 WHEN 0 THEN 'Personal  Loan' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Overdraft' WHEN 3 THEN 'OD against FD' ELSE 'Housing Loan' END AS account_type,
       CASE c_custkey % 9 WHEN 0 THEN 'Guarantor' WHEN 1 THEN 'Authorised User' WHEN 2 THEN 'Joint' WHEN 3 THEN NULL ELSE 'Individual' END AS ownership,
       CASE c_custkey % 13 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Written-off' WHEN 2 THEN 'Settled' ELSE 'Active' END AS status, c_custkey % 26 <> 0 AS status_verified,
       CASE WHEN c_custkey % 19 = 0 THEN DATE '2023-05-01' END AS date_closed, c_custkey % 38 <> 0 AS date_closed_verified,
       'XX-' || CAST(1000 + c_custkey % 9000 AS VARCHAR(20)) AS account_number,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE 1000 + 100 * (c_custkey % 3) END AS emi,
       CASE WHEN c_custkey % 14 = 0 THEN 'unverified' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'analyst' ELSE 'reported' END AS emi_status
FROM {customer}
"""

SERIES = """
SELECT c_custkey AS series_id, CAST(floor(c_custkey / 8) AS BIGINT) AS case_id, CASE c_custkey % 5 WHEN 1 THEN 'card_payment' WHEN 2 THEN 'od_interest' ELSE 'loan_repayment' END AS category,
       CASE c_custkey % 6 WHEN 0 THEN 'ACH HDFC EMI' WHEN 1 THEN 'AMEX CREDIT CARD autopay' WHEN 2 THEN 'NACH STATE HOUSING LOAN' WHEN 3 THEN 'SI PERSONAL LOAN' WHEN 4 THEN 'ECS DR' ELSE 'EMI' END
         || CASE WHEN c_custkey % 2 = 0 THEN ' ' || CAST(1000 + c_custkey % 9000 AS VARCHAR(20)) ELSE '' END AS narrations,
       'REF' || CAST(1001 + c_custkey % 9000 AS VARCHAR(20)) AS refs, 1000 + 100 * (c_custkey % 4) + 3 * (c_custkey % 2) AS amount, c_custkey % 6 <> 5 AS recurring, c_custkey % 3 <> 0 AS fixed_amount
FROM {customer}
"""

DECISIONS = """
SELECT c_custkey AS decision_id, c_custkey AS tradeline_id, c_custkey AS series_id, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey + 1000000, c_custkey, c_custkey, 'confirmed' FROM {customer} WHERE c_custkey % 9 = 0
"""

TREATMENTS = """
SELECT c_custkey AS treatment_id, CASE WHEN c_custkey % 2 = 0 THEN 'bureau' ELSE 'bank' END AS source, c_custkey AS key_id, c_custkey % 4 < 2 AS include, 700 + c_custkey % 50 AS amount
FROM {customer} WHERE c_custkey % 10 = 0 OR c_custkey % 17 = 0
"""

REGISTRATIONS = """
SELECT s_suppkey AS case_id, 'liability_date' AS field, date_add_days(DATE '2010-01-01', CAST(s_suppkey * 37 % 4000 AS INT)) AS value, CASE WHEN s_suppkey % 4 = 0 THEN 'unverified' ELSE 'reported' END AS status FROM {supplier}
UNION ALL SELECT s_suppkey, 'incorporation_date', date_add_days(DATE '2010-01-01', CAST(s_suppkey * 91 % 4000 AS INT)), CASE WHEN s_suppkey % 6 = 0 THEN 'unverified' ELSE 'reported' END FROM {supplier}
"""

#: Spark's name for the place of a row in its table, for what the twins leave to the order of the rows.
PLACE = "struct(_metadata.file_path, _metadata.row_index)"


def _debts(more: str = "") -> str:
    return f"""
SELECT l_orderkey * 10 + l_linenumber AS claim_id, CAST(floor(l_orderkey / 500) AS BIGINT) AS issuer_id, 'source' || CAST(l_suppkey % 4 AS VARCHAR(20)) AS source_name,
       CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS published, CASE WHEN l_linenumber = 1 THEN 'total' ELSE 'ncd' END AS instrument_type,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS maturity_date, CAST(floor(l_quantity) AS BIGINT) AS amount{more}
FROM {{lineitem}}
"""


DEBTS = _debts()

VERSIONS = """
SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'v1' WHEN l_linenumber IS NOT NULL THEN 'v2' END AS version, o_orderkey % 50 = 0 AS forced
FROM {orders} LEFT JOIN {lineitem} l ON o_orderkey = l_orderkey
"""

ANCHORS = """
SELECT doc_id, CAST(doc_id % 50 AS INT) AS char_start, CAST(doc_id % 50 + CASE doc_id % 31 WHEN 0 THEN -1 WHEN 1 THEN 900000 ELSE 12 END AS INT) AS char_end,
       CASE doc_id % 29 WHEN 0 THEN '' WHEN 1 THEN 'not what is there' ELSE substr(text, CAST(doc_id % 50 + 1 AS INT), 12) END AS evidence_text
FROM {documents}
"""

WORDS = """
SELECT l_orderkey AS page_id, CAST(l_linenumber % 2 AS INT) AS block, CAST(floor(l_linenumber / 3) AS INT) AS line, CAST(l_linenumber AS INT) AS word_no,
       CASE WHEN l_partkey % 20 = 0 THEN '' ELSE 'w' || CAST(l_partkey AS VARCHAR(20)) END AS word,
       CAST(l_linenumber * 40 AS DOUBLE) AS x0, CAST(floor(l_linenumber / 3) * 12 AS DOUBLE) AS y0, CAST(l_linenumber * 40 + 35 AS DOUBLE) AS x1, CAST(floor(l_linenumber / 3) * 12 + 10 AS DOUBLE) AS y1
FROM {lineitem}
"""

STATED = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 6 WHEN 0 THEN 'Balance (` in Crores) 12' WHEN 1 THEN '(Rs. in lakhs) then (INR in  Million) 5' WHEN 2 THEN 'no scale (in part 2)' WHEN 3 THEN '(in trillions)' WHEN 4 THEN NULL ELSE '(Rs in Thousand)' END AS text,
       CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS DECIMAL(20, 0)) / 100 AS amount
FROM {orders}
"""

RETURNS = """
SELECT c_custkey AS document_id, CASE c_custkey % 6
    WHEN 0 THEN '{{"ITR":{{"ITR1":{{"CreationInfo":{{"AckNo":"7"}},"Form_ITR1":{{"AssessmentYear":"2025"}},"ITR1_IncomeDeductions":{{"GrossSalary":' || CAST(900000 + c_custkey AS VARCHAR(20)) || ',"TotalIncome":' || CAST(700000 + c_custkey AS VARCHAR(20)) || '}}}}}}}}'
    WHEN 1 THEN '{{"ITR":{{"ITR2":{{"ScheduleS":{{"TotalGrossSalary":' || CAST(500000 + c_custkey AS VARCHAR(20)) || ',"Salaries":[{{"NameOfEmployer":"ACME ' || CAST(c_custkey AS VARCHAR(20)) || '"}}]}},"PartB-TI":{{"TotalIncome":"unread"}}}}}}}}'
    WHEN 2 THEN '{{"personalInfo":{{"name":"x"}}}}' WHEN 3 THEN '{{"other":1}}' WHEN 4 THEN 'not json' END AS raw
FROM {customer}
"""

CASE_FILES = """
SELECT o_orderkey AS document_id, CAST(floor(o_custkey / 8) AS BIGINT) AS case_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'kyc' WHEN 1 THEN 'salary_slip' WHEN 2 THEN 'bank_statement' WHEN 3 THEN 'credit_report' WHEN 4 THEN 'itr_json' WHEN 5 THEN 'form16' ELSE 'od_sanction' END AS kind,
       CASE o_orderkey % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'received' ELSE 'complete' END AS status, CAST(o_orderdate AS DATE) AS received_on
FROM {orders}
"""

ACKS = """
SELECT c_custkey AS ack_id, CAST(floor(c_custkey / 8) AS BIGINT) AS case_id, 'returns' AS rule, CAST(c_custkey AS VARCHAR(20)) AS item FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 8) AS BIGINT), 'obligation', 'bureau:' || CAST(c_custkey AS VARCHAR(20)) FROM {customer} WHERE c_custkey % 5 = 0
"""


def _totals(debts: str, more: str = "") -> str:
    return f"""
SELECT claim_id, issuer_id, CASE WHEN claim_id % 3 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis, CAST(floor(published / 100) AS BIGINT) AS as_of, source_name, published,
       100000 + CASE WHEN issuer_id % 3 = 0 THEN 0 WHEN issuer_id % 3 = 1 THEN amount ELSE amount % 4 END AS amount{more}
FROM ({debts}) d WHERE instrument_type = 'total'
"""


#: The second for Spark alone: with the place of each row.
TOTALS, PLACED_TOTALS = _totals(DEBTS), _totals(_debts(f", {PLACE} AS place"), ", place")

OD_LINES = f"""
SELECT t.*, CASE tradeline_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 50000 + tradeline_id END AS sanctioned_amount, CASE WHEN tradeline_id % 7 = 0 THEN 'unverified' ELSE 'reported' END AS sanctioned_status,
       CASE WHEN tradeline_id % 6 = 0 THEN NULL ELSE 40000 + tradeline_id END AS credit_limit, CASE WHEN tradeline_id % 11 = 0 THEN 'unverified' ELSE 'analyst' END AS limit_status,
       1000 + tradeline_id AS current_balance, CASE WHEN tradeline_id % 9 = 0 THEN 'unverified' ELSE 'reported' END AS balance_status,
       CASE WHEN tradeline_id % 3 = 0 THEN NULL ELSE 30000 + tradeline_id END AS drawing_power, CASE tradeline_id % 8 WHEN 2 THEN NULL WHEN 3 THEN 'unverified' ELSE 'reported' END AS power_status
FROM ({TRADELINES}) t
"""

ASSUMED = """
SELECT * FROM (
  SELECT c_custkey * 10 + k AS assumption_id, c_custkey AS case_id,
         CASE k WHEN 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN 'eligible_income' END WHEN 1 THEN 'foir_max_pct' WHEN 2 THEN 'annual_rate_pct' WHEN 3 THEN 'tenure_months'
                WHEN 4 THEN CASE WHEN c_custkey % 5 = 0 THEN 'eligible_income' END ELSE 'unknown_key' END AS key,
         CAST(CASE k WHEN 0 THEN 30000 + c_custkey % 9000 WHEN 1 THEN CASE WHEN c_custkey % 31 = 0 THEN 150 ELSE 40 + c_custkey % 20 END WHEN 2 THEN c_custkey % 15 WHEN 3 THEN 12 * (1 + c_custkey % 20)
                WHEN 4 THEN CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE 50000 END ELSE 1 END AS DECIMAL(12, 2)) AS value
  FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) t) r
WHERE key IS NOT NULL
"""

PROPRIETOR_FILES = """
SELECT o_orderkey AS document_id, o_custkey AS case_id,
       CASE (o_orderkey * 7 + o_custkey) % 12 WHEN 0 THEN 'kyc' WHEN 1 THEN 'gst_certificate' WHEN 2 THEN 'business_proof' WHEN 3 THEN 'udyam_certificate' WHEN 4 THEN 'itr_ack' WHEN 5 THEN 'itr_json'
            WHEN 6 THEN 'itr_computation' WHEN 7 THEN 'financials' WHEN 8 THEN 'loan_soa' WHEN 9 THEN 'od_sanction' WHEN 10 THEN 'loan_sanction' ELSE 'bank_statement' END AS kind
FROM {orders}
"""

TYPED_STATEMENTS = """
SELECT c_custkey AS case_id, CASE (c_custkey + n) % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'savings' END AS account_type,
       date_add_days(DATE '2023-01-01', CAST(c_custkey * 13 % 300 AS INT)) AS period_start, CASE WHEN (c_custkey + n) % 19 = 0 THEN NULL ELSE date_add_days(DATE '2024-01-01', CAST(c_custkey % 60 AS INT)) END AS period_end
FROM {customer} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k
"""

NEW_CLAIMS = "SELECT doc_id * 2 + k AS claim_id, doc_id AS document_id, 'v2' AS version FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t"

NEW_ANCHORS = f"""
SELECT doc_id * 2 AS claim_id, doc_id AS document_id, char_start, char_end, evidence_text FROM ({ANCHORS}) a
UNION ALL SELECT doc_id * 2 + 1, doc_id, 0, 5, substr(text, 1, 5) FROM {{documents}} WHERE doc_id % 23 <> 0
"""

OLD_CLAIMS = """
SELECT doc_id * 2 AS claim_id, doc_id AS document_id, 'v1' AS version FROM {documents}
UNION ALL SELECT doc_id * 2 + 2000000000, doc_id + 1000000000, 'v1' FROM {documents}
"""

CORRECTIONS = """
SELECT c_custkey AS correction_id, CAST(floor(c_custkey / 8) AS BIGINT) AS case_id, CASE c_custkey % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'txn' WHEN 2 THEN 'other' ELSE 'obligation' END AS target,
       CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey AS VARCHAR(20)) || ':0:gross' WHEN c_custkey % 59 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR(20)) || ':1' END AS target_id, 'value' AS field,
       CASE c_custkey % 4 WHEN 0 THEN 'salary' WHEN 1 THEN 'bonus' WHEN 2 THEN 'other' END AS value_text, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS include,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN -5 ELSE 100 END AS amount, CASE WHEN c_custkey % 8 = 0 THEN '  ' ELSE 'letter' END AS basis, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'seen' END AS reason
FROM {customer}
"""

CORRECTABLE = """
SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS case_id, 'fact' AS target, CAST(c_custkey AS VARCHAR(20)) || ':0:gross' AS target_id, CAST(c_custkey AS VARCHAR(20)) AS original FROM {customer} WHERE c_acctbal > 0
UNION ALL SELECT CAST(floor(c_custkey / 8) AS BIGINT), 'txn', CAST(c_custkey AS VARCHAR(20)) || ':1', 'other' FROM {customer} WHERE c_acctbal > 0
"""

TWO_PAGES = """
SELECT doc_id AS document_id, 1 AS page_no, substr(text, 1, 300) AS text FROM {documents}
UNION ALL SELECT doc_id, 2, substr(text, 301) FROM {documents}
"""

SAID = """
SELECT doc_id * 8 + k AS field_id, doc_id AS document_id, 'text' AS kind, CASE k WHEN 4 THEN 'blank' WHEN 5 THEN 'not_found' ELSE 'present' END AS status,
       CASE k WHEN 1 THEN substr(text, 330, 9) WHEN 6 THEN 'zzqq nowhere' WHEN 7 THEN 'NA' ELSE substr(text, 20, 8) END AS value,
       CASE k WHEN 0 THEN lower(substr(text, 15, 30)) WHEN 1 THEN substr(text, 325, 30) WHEN 2 THEN 'zzqq nowhere' WHEN 3 THEN NULL WHEN 6 THEN substr(text, 15, 30) ELSE substr(text, 1, 12) END AS quote,
       CASE k WHEN 2 THEN 2 WHEN 7 THEN NULL ELSE 1 END AS page_no
FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) t
"""

PRINTED = """
SELECT document_id, n, CAST(floor((n - 1) / 14) + 1 AS INT) AS page_no, stacked, day, narration, ref, debit, credit, unmarked,
       CASE WHEN unprinted THEN NULL ELSE CAST(5000000 + sum(credit - debit) OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS balance
FROM (
  SELECT o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n, o_custkey % 3 = 1 AS stacked, CAST(o_orderdate AS DATE) AS day,
         CASE o_orderkey % 4 WHEN 0 THEN 'ACH D- BAJAJ FINANCE LTD LOAN ' || CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN 'UPI-SHREE TRADERS' WHEN 2 THEN 'NEFT CR ACME LTD 7.50 back' ELSE 'CASH' END AS narration,
         CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'REF' || CAST(o_orderkey AS VARCHAR(20)) END AS ref, o_orderkey % 13 = 0 AS unprinted, o_custkey % 3 = 1 AND o_orderkey % 11 = 1 AS unmarked,
         CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice * 10) AS BIGINT) ELSE 0 END AS debit, CASE WHEN o_orderkey % 5 < 3 OR o_orderkey % 17 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 10) AS BIGINT) END AS credit
  FROM {orders}) r
"""

HISTORY_CELLS = """
SELECT c_custkey AS document_id, CAST(r AS INT) AS row_no, CAST(k AS INT) AS k, CAST(c_custkey % 3 AS INT) AS layout, c_custkey % 3 = 0 AND c_custkey % 5 = 0 AS orphan, date_add_days(DATE '2022-01-05', CAST(c_custkey % 90 * 7 + k * 37 AS INT)) AS day,
       CASE r WHEN 1 THEN 'NCD programme' WHEN 2 THEN 'Commercial Paper' ELSE 'Term loan' END AS name,
       CASE (c_custkey + r * 2 + k) % 7 WHEN 0 THEN '[ICRA]AA (Stable)' WHEN 1 THEN '[ICRA]A1+' WHEN 2 THEN 'Withdrawn' WHEN 3 THEN 'not rated here' WHEN 4 THEN '-' WHEN 5 THEN '[ICRA]BBB+ (Negative)' ELSE 'CARE A (RWD)' END AS said
FROM {customer} CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) a CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) b
"""

RATIONALES = """
SELECT c_custkey AS document_id, date_add_days(DATE '2025-01-27', CAST(c_custkey % 300 AS INT)) AS published, CAST(1000 + c_custkey AS BIGINT) AS amount, CAST(c_custkey % 5 AS INT) AS v,
       date_add_days(DATE '2023-01-06', CAST(c_custkey % 500 AS INT)) AS day1, CASE WHEN c_custkey % 8 = 0 THEN date_add_days(DATE '2025-01-27', CAST(c_custkey % 300 AS INT)) ELSE date_add_days(DATE '2023-02-06', CAST(c_custkey % 500 AS INT)) END AS day2,
       date_add_days(DATE '2022-03-06', CAST(c_custkey % 500 AS INT)) AS day3, CAST(c_custkey % 7 AS INT) AS gap, CAST(80000 + c_custkey * 3 AS BIGINT) AS assets
FROM {customer}
"""

RATED_LINES = """
SELECT o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS row_no, o_orderkey % 4 AS v, CAST(1000 + o_orderkey % 9000 AS BIGINT) AS previous, CAST(2000 + o_orderkey % 7000 AS BIGINT) AS current,
       'INE' || CAST(100000000 + o_orderkey % 899999999 AS VARCHAR(20)) AS isin, CAST(o_orderdate AS DATE) AS issued, date_add_days(DATE '2030-01-01', CAST(o_orderkey % 3000 AS INT)) AS matures
FROM {orders}
"""

CITED = """
SELECT doc_id * 3 + k AS fact_id, CASE WHEN k = 2 THEN NULL ELSE CAST(doc_id % 40 AS INT) END AS start, CASE WHEN k = 2 THEN NULL WHEN doc_id % 31 = 0 THEN 900000 ELSE CAST(doc_id % 40 + 8 AS INT) END AS stop, doc_id + CASE WHEN k = 1 AND doc_id % 29 = 0 THEN 1000000000 ELSE 0 END AS document_id,
       CASE WHEN k = 2 THEN NULL WHEN doc_id % 17 = 0 THEN 'not what is there' ELSE concat(substr(text, CAST(doc_id % 40 + 1 AS INT), 8), ' ', substr(text, 1, 3)) END AS evidence_text, k < 2 OR doc_id % 3 = 0 AS verified
FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""

SIGHTS = """
SELECT CAST(floor(o_custkey / 4) AS BIGINT) AS document_id, CAST(o_orderkey % 5 AS INT) AS batch, CAST(floor(o_orderkey / 5) AS INT) AS seq, f AS field,
       CASE f WHEN 'lender' THEN CASE o_orderkey % 3 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'hdfc bank' ELSE 'SBI' END WHEN 'account_number' THEN CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'XX' || CAST(1000 + o_orderkey % 13 AS VARCHAR(20)) END
            WHEN 'emi' THEN CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 3 AS VARCHAR(20)) END ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'open' END END AS value
FROM {orders} CROSS JOIN (SELECT 'lender' AS f UNION ALL SELECT 'account_number' UNION ALL SELECT 'emi' UNION ALL SELECT 'status') t
"""

LABEL_ROWS = """
SELECT o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_no, CAST(o_orderkey % 5 AS INT) AS v, CAST(10 + o_orderkey % 40 AS BIGINT) AS size FROM {orders}
"""

PARTICULARS = """
SELECT c_custkey AS document_id, CAST(r AS INT) AS row_no, CAST((c_custkey + r) % 4 AS INT) AS v, CAST(100 + c_custkey * r % 90000 AS BIGINT) AS amount, c_custkey % 6 = 0 AS undated
FROM {customer} CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) t
"""

DATED_CELLS = """
SELECT c_custkey AS document_id, CAST(r AS INT) AS row_no, CAST(100 + r + c_custkey % 70000 * r AS BIGINT) AS amount, c_custkey % 3 > 0 AS totalled, (c_custkey + r) % 5 = 0 AS undated, (c_custkey + r) % 7 = 0 AS unreadable,
       CASE r WHEN 1 THEN 'NCDs ^ Long' WHEN 2 THEN '2 Secured NCD' ELSE 'Bank Loan' END AS name, date_add_days(DATE '2024-01-05', CAST(c_custkey % 300 + r AS INT)) AS day, date_add_days(DATE '2023-01-05', CAST(c_custkey % 300 + r AS INT)) AS earlier
FROM {customer} CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) t
"""

DEBT_PAGES = """
SELECT c_custkey AS document_id, CAST(c_custkey % 4 AS INT) AS page_no, CAST(c_custkey AS BIGINT) AS n,
       concat('Total Debt', chr(10), 'Rs.in Crores', chr(10), '1', chr(10), CASE WHEN c_custkey % 5 = 0 THEN 'Key figures' ELSE 'Key Financial Performance - IIFL Finance Ltd.' END, CASE WHEN c_custkey % 2 = 0 THEN ' (Consolidated)' ELSE ' (Standalone)' END,
              chr(10), 'Particulars', chr(10), 'FY23', chr(10), CASE WHEN c_custkey % 3 = 0 THEN 'Q7FY24' ELSE 'FY24' END, chr(10), 'Q1FY25', chr(10), 'Net worth', chr(10), 'Total Debt', chr(10), 'Rs.in Crores', chr(10),
              CAST(30000 + c_custkey AS VARCHAR(20)), chr(10), CAST(40000 + c_custkey AS VARCHAR(20)), chr(10), '50,000', chr(10), '9', chr(10), 'Total Income') AS text
FROM {customer}
"""

TABLES = ("customer", "supplier", "orders", "lineitem", "events", "documents", "pages")


def tasks(spark: SparkSession, sf_dir: str, table: str, rows: int) -> int:
    """Tasks for a table: one for each so many of its rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/{table}.parquet").count() // rows))


def view(spark: SparkSession, sf_dir: str, sql: str, deal: tuple[str, str, int] | None = None, name: str | None = None) -> DataFrame:
    """A view over the tables. deal (table, column, rows): that table's rows are dealt by the column before the view makes more of them, so many to a task.

    A file may be so small, or of so few row groups, that one task reads all of it, and would then do all of the view's work.
    name: what the column is called where it is dealt, if it is known by another name there.
    """
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    if deal:
        table, column, rows = deal
        read = names[table] if name is None else f"(SELECT * EXCEPT ({column}), {column} AS {name} FROM {names[table]})"
        dealt = f"SELECT /*+ REPARTITION({tasks(spark, sf_dir, table, rows)}, {name or column}) */ * FROM {read}"
        names[table] = f"({dealt})" if name is None else f"(SELECT * EXCEPT ({name}), {name} AS {column} FROM ({dealt}))"
    return spark.sql(sql.replace("date_add_days(", "date_add(").format(**names))


def literal(value: str) -> str:
    """A string literal of a view: both engines read quotes doubled and line feeds as they are; braces are for format."""
    return "'" + value.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def duck(sql: str) -> str:
    """The same view for DuckDB."""
    text = sql.format(**{t: t for t in TABLES})
    return re.sub(r"date_add_days\((DATE '[0-9-]+'), ", r"(\1 + ", text)
