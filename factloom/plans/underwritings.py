"""Registered queries of underwriting and of what writes may do, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import credit, fields, underwriting, writes
from factloom.plans import registers  # noqa: F401 - registers statement_accounts
from factloom.plans.cases import _FOUND, _matches, _obligations
from factloom.plans.catalog import ORACLES, QUERIES, query
from factloom.sources import driver_tables as src

__all__ = ["ORACLES", "QUERIES"]

_SANCTION = f"(SELECT case_id, count(DISTINCT document_id) AS n FROM ({src.duck(src.CASE_FILES)}) WHERE kind = 'od_sanction' GROUP BY 1)"
_LIVE = f"(SELECT *, row_number() OVER (PARTITION BY tradeline_id ORDER BY status, series_id) AS k FROM ({ORACLES['bureau_matches']}) WHERE status IN ('confirmed', 'proposed'))"


@query(f"""
WITH f AS (SELECT * FROM ({src.duck(src.OD_LINES)}) WHERE regexp_matches(upper(coalesce(account_type, '')), 'OVERDRAFT|\\bOD\\b'))
SELECT f.case_id, f.tradeline_id, f.lender,
       CAST(CASE WHEN sanctioned_status <> 'unverified' AND sanctioned_amount <> 0 THEN sanctioned_amount WHEN limit_status <> 'unverified' THEN credit_limit END AS BIGINT) AS sanctioned_limit,
       CAST(CASE WHEN balance_status <> 'unverified' THEN current_balance END AS BIGINT) AS outstanding,
       CAST(CASE WHEN power_status IS NULL OR power_status <> 'unverified' THEN drawing_power END AS BIGINT) AS drawing_power,
       CASE WHEN power_status IS NULL THEN 'not reported' WHEN power_status = 'unverified' THEN 'unverified' WHEN drawing_power IS NULL THEN 'reported blank' ELSE 'reported' END AS drawing_power_state,
       m.series_id, m.status AS match_status, coalesce(s.n, 0) AS n_sanction_papers, o.basis, o.included, o.amount AS obligation
FROM f LEFT JOIN {_LIVE} m ON m.tradeline_id = f.tradeline_id AND m.k = 1 LEFT JOIN {_SANCTION} s ON s.case_id = f.case_id
LEFT JOIN ({ORACLES['obligations']}) o ON o.source = 'bureau' AND o.key_id = f.tradeline_id""")
def overdraft_view(spark, sf_dir):
    lines, files = src.view(spark, sf_dir, src.OD_LINES), src.view(spark, sf_dir, src.CASE_FILES)
    return underwriting.overdrafts(lines, _matches(spark, sf_dir), _obligations(spark, sf_dir), files)


_ASSUMED = f"""
a AS (SELECT case_id, key, list_last(list(value ORDER BY assumption_id)) AS value, max(assumption_id) AS assumption_id, count(*) AS n_recorded
      FROM ({src.duck(src.ASSUMED)}) WHERE key IN ('eligible_income', 'foir_max_pct', 'annual_rate_pct', 'tenure_months') GROUP BY ALL)"""


@query(f"WITH {_ASSUMED} SELECT case_id, key, CAST(value AS DOUBLE) AS value, assumption_id, n_recorded FROM a")
def newest_assumptions(spark, sf_dir):
    return underwriting.assumptions(src.view(spark, sf_dir, src.ASSUMED)).withColumn("value", F.col("value").cast("double"))


@query(f"""
WITH {_ASSUMED},
w AS (SELECT case_id, bool_or(key = 'eligible_income') AS by_analyst, max(value) FILTER (WHERE key = 'eligible_income') AS own, max(value) FILTER (WHERE key = 'foir_max_pct') AS ratio,
             max(value) FILTER (WHERE key = 'annual_rate_pct') AS rate, max(value) FILTER (WHERE key = 'tenure_months') AS tenure FROM a GROUP BY 1),
i AS (SELECT w.*, CAST(round(CASE WHEN by_analyst THEN own ELSE s.income END * 100) AS BIGINT) AS cents, coalesce(t.total_included, 0) AS owed, coalesce(t.n_unresolved, 0) AS n_unresolved,
             CASE WHEN by_analyst THEN 'analyst' WHEN s.income IS NOT NULL THEN 'suggested' END AS income_origin
      FROM w LEFT JOIN ({ORACLES['suggested_income']}) s ON s.account_key = w.case_id LEFT JOIN ({ORACLES['obligation_totals']}) t ON t.case_id = w.case_id),
j AS (SELECT *, CASE WHEN coalesce(cents <= 0 OR owed < 0 OR ratio <= 0 OR ratio > 100 OR NOT rate BETWEEN 0 AND 60 OR NOT tenure BETWEEN 1 AND 480 OR tenure <> floor(tenure), false) THEN 'invalid'
                     WHEN cents IS NULL OR ratio IS NULL OR rate IS NULL OR tenure IS NULL THEN 'needs_input' ELSE 'computed' END AS first_status,
             CAST((greatest(0, CAST(ratio * 100 AS BIGINT) * cents - owed * 1000000) * 2 + 10000) // 20000 AS DOUBLE) / 100 AS cap FROM i)
SELECT case_id, CASE WHEN first_status = 'computed' AND (income_origin = 'suggested' OR n_unresolved > 0) THEN 'provisional' ELSE first_status END AS status,
       CASE WHEN first_status = 'computed' THEN cap END AS capacity,
       CASE WHEN first_status = 'computed' THEN round(CASE WHEN rate = 0 THEN cap * CAST(tenure AS DOUBLE) ELSE cap * (1 - pow(1 + CAST(rate AS DOUBLE) / 1200, -CAST(tenure AS DOUBLE))) / (CAST(rate AS DOUBLE) / 1200) END, 0) END AS principal,
       CASE WHEN first_status <> 'invalid' AND cents > 0 THEN ((owed * 2000000 + cents) // (2 * cents)) / 100.0 END AS present_ratio, income_origin, n_unresolved
FROM j""")
def case_eligibility(spark, sf_dir):
    recorded = underwriting.assumptions(src.view(spark, sf_dir, src.ASSUMED))
    suggested = credit.suggested_income(src.view(spark, sf_dir, src.SLIPS)).withColumnRenamed("account_key", "case_id")
    return underwriting.case_eligibility(recorded, suggested, credit.obligation_totals(_obligations(spark, sf_dir)))


@query(f"""
WITH h AS (SELECT account_key AS case_id, list(DISTINCT month) AS months FROM ({src.duck(src.SLIPS)}) WHERE month IS NOT NULL GROUP BY 1)
SELECT case_id, CAST(len(months) AS INT) AS n_months,
       array_to_string(list_filter(list_transform([2, 1, 0], lambda n: strftime(strptime(list_max(months) || '-01', '%Y-%m-%d') - to_months(n), '%Y-%m')), lambda m: NOT list_contains(months, m)), ',') AS missing_months FROM h""")
def salaried_slips(spark, sf_dir):
    return underwriting.salaried_slips(src.view(spark, sf_dir, src.SLIPS).withColumnRenamed("account_key", "case_id"))


@query(f"""
WITH a AS (SELECT CAST(floor(account_key / 8) AS BIGINT) AS case_id, account_key, CAST(first_day AS DATE) AS f, CAST(last_day AS DATE) AS t, n_gaps, unique_rows FROM ({ORACLES['statement_accounts']})),
c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY unique_rows DESC, account_key) AS k, CAST(date_trunc('month', date_trunc('month', t) - INTERVAL 150 DAY) AS DATE) AS wanted FROM a)
SELECT case_id, account_key, f AS first_day, t AS last_day, wanted AS wanted_from, n_gaps, f <= wanted AND n_gaps = 0 AS ok FROM c WHERE k = 1""", dates=("first_day", "last_day", "wanted_from"))
def salary_accounts(spark, sf_dir):
    held = QUERIES["statement_accounts"](spark, sf_dir).withColumns({c: F.col(c).cast("date") for c in ("first_day", "last_day")})
    return underwriting.salary_account(held.withColumn("case_id", F.floor(F.col("account_key") / 8).cast("long")))


def _held(item: str, kinds: list[str], ok: str = "received > 0") -> str:
    return f"SELECT case_id, '{item}' AS item, count(DISTINCT document_id) FILTER (WHERE list_contains({kinds}, kind)) AS received, {ok} AS ok FROM p GROUP BY case_id"


_ITEMS = " UNION ALL ".join(
    _held(i, k, "received >= 2 AND bool_or(kind IN ('itr_computation', 'itr_json'))" if i == "itr" else "received > 0 OR case_id NOT IN (SELECT case_id FROM open)" if i == "loan_papers" else "received > 0")
    for i, k in underwriting.PROPRIETOR_KINDS.items()
)
_COVERED = " UNION ALL ".join(
    f"""SELECT case_id, '{t}_statement', CAST(coalesce(l - f + 1, 0) AS BIGINT), coalesce(f <= CAST(date_trunc('month', l) - INTERVAL {m - 1} MONTH + INTERVAL 3 DAY AS DATE), false)
    FROM (SELECT DISTINCT case_id FROM p) LEFT JOIN (SELECT case_id, min(period_start) AS f, max(period_end) AS l FROM s WHERE account_type = '{t}' GROUP BY 1) USING (case_id)"""
    for t, m in underwriting.COVERED_MONTHS.items()
)


@query(f"""
WITH {_FOUND}, p AS ({src.duck(src.PROPRIETOR_FILES)}),
s AS (SELECT case_id, account_type, CAST(period_start AS DATE) AS period_start, CAST(period_end AS DATE) AS period_end FROM ({src.duck(src.TYPED_STATEMENTS)}) WHERE period_end IS NOT NULL),
open AS (SELECT case_id FROM lines WHERE NOT closed AND kind IN ('loan', 'od') UNION ALL SELECT case_id FROM series WHERE category = 'loan_repayment' AND recurring)
{_ITEMS} UNION ALL {_COVERED}""")
def proprietor_checklist(spark, sf_dir):
    lines, series = src.view(spark, sf_dir, src.TRADELINES), src.view(spark, sf_dir, src.SERIES)
    open_lines = credit.tradelines(lines).where("NOT closed AND kind IN ('loan', 'od')").select("case_id")
    open_loans = open_lines.unionByName(series.where("category = 'loan_repayment' AND recurring").select("case_id"))
    return underwriting.proprietor_checklist(src.view(spark, sf_dir, src.PROPRIETOR_FILES), src.view(spark, sf_dir, src.TYPED_STATEMENTS), open_loans)


_REFUSED = f"""
n AS ({src.duck(src.NEW_CLAIMS)}), x AS ({src.duck(src.NEW_ANCHORS)}), o AS ({src.duck(src.OLD_CLAIMS)}),
why AS (
  SELECT document_id, 'unanchored' AS reason FROM n WHERE claim_id NOT IN (SELECT claim_id FROM x)
  UNION ALL SELECT document_id, CASE WHEN coalesce(evidence_text, '') = '' THEN 'empty' WHEN char_end <= char_start OR char_start < 0 THEN 'range' WHEN coalesce(char_end > length(text), true) THEN 'beyond_text'
            WHEN substr(text, char_start + 1, char_end - char_start) <> evidence_text THEN 'other_text' END FROM x JOIN documents d ON d.doc_id = x.document_id),
refused AS (SELECT document_id, min(reason) AS reason FROM why WHERE reason IS NOT NULL GROUP BY 1)"""


def _load(spark, sf_dir):
    old, new, anchors = [src.view(spark, sf_dir, v) for v in (src.OLD_CLAIMS, src.NEW_CLAIMS, src.NEW_ANCHORS)]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    return old, new, writes.refused_documents(new, anchors, documents)


@query(f"""
WITH {_REFUSED}, good AS (SELECT * FROM n WHERE document_id NOT IN (SELECT document_id FROM refused))
SELECT * FROM good UNION ALL SELECT * FROM o WHERE document_id NOT IN (SELECT document_id FROM good)""")
def claim_load(spark, sf_dir):
    return writes.loaded(*_load(spark, sf_dir))


@query(f"""
WITH {_REFUSED}, b AS (SELECT document_id, count(*) AS n FROM o GROUP BY 1), w AS (SELECT document_id, count(*) AS n FROM n GROUP BY 1)
SELECT document_id, 'run1' AS run, CASE WHEN reason IS NULL THEN w.n ELSE 0 END AS claims_written, CASE WHEN reason IS NULL THEN coalesce(b.n, 0) ELSE 0 END AS claims_replaced, reason AS refused_for
FROM w LEFT JOIN b USING (document_id) LEFT JOIN refused USING (document_id)""")
def load_audit(spark, sf_dir):
    return writes.extraction_runs(*_load(spark, sf_dir), "run1")


@query(f"""
SELECT c.correction_id, k.original, CASE WHEN target NOT IN ('fact', 'txn', 'obligation') OR trim(reason) = '' THEN 'target or reason' WHEN target_id = '' THEN 'length' WHEN target = 'fact' AND k.here IS NULL THEN 'no such fact'
       WHEN target = 'txn' AND k.here IS NULL THEN 'no such transaction' WHEN target = 'txn' AND coalesce(value_text NOT IN ('salary', 'loan_repayment', 'card_payment', 'od_interest', 'other'), true) THEN 'unknown category'
       WHEN target = 'obligation' AND include IS NULL THEN 'include' WHEN target = 'obligation' AND include AND coalesce(amount < 0, true) THEN 'amount' WHEN target = 'obligation' AND include AND trim(basis) = '' THEN 'basis' END AS refusal
FROM ({src.duck(src.CORRECTIONS)}) c LEFT JOIN (SELECT *, true AS here FROM ({src.duck(src.CORRECTABLE)})) k USING (case_id, target, target_id)""")
def correction_checks(spark, sf_dir):
    return writes.checked_corrections(src.view(spark, sf_dir, src.CORRECTIONS), src.view(spark, sf_dir, src.CORRECTABLE)).select("correction_id", "original", "refusal")


@query(f"""
SELECT claim_id, document_id FROM ({src.duck(src.CLAIMS)}) WHERE claim_id IN (SELECT a_claim_id FROM ({ORACLES['concurrent_pairs']}) UNION ALL SELECT b_claim_id FROM ({ORACLES['concurrent_pairs']}) UNION ALL SELECT claim_id FROM ({ORACLES['maturity_ladder']}))""")
def published_claims(spark, sf_dir):
    pairs, ladder = QUERIES["concurrent_pairs"](spark, sf_dir), QUERIES["maturity_ladder"](spark, sf_dir)
    shown = pairs.select(F.explode(F.array("a_claim_id", "b_claim_id")).alias("claim_id"))
    return writes.reachable(src.view(spark, sf_dir, src.CLAIMS), (shown, "claim_id"), (ladder, "claim_id")).select("claim_id", "document_id")


_FLAT = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))".format


@query(f"""
WITH f AS (SELECT *, {_FLAT('quote')} AS q, {_FLAT('value')} AS v FROM ({src.duck(src.SAID)}) WHERE status IN ('present', 'blank')),
g AS (SELECT *, status = 'blank' OR value IS NULL OR lower(trim(value)) IN {tuple(fields.BLANK)} AS blank FROM f),
h AS (SELECT g.field_id, count(*) AS n, bool_or(p.page_no = g.page_no) AS here, min(p.page_no) AS any_page
      FROM g JOIN (SELECT document_id, page_no, {_FLAT('text')} AS t FROM ({src.duck(src.TWO_PAGES)})) p ON p.document_id = g.document_id AND length(q) >= 2 AND contains(t, q) GROUP BY 1),
r AS (SELECT g.*, n, here, CASE WHEN here THEN page_no WHEN n = 1 THEN any_page END AS hit, blank OR contains(q, v) AS holds FROM g LEFT JOIN h USING (field_id))
SELECT field_id, coalesce(hit IS NOT NULL AND holds, false) AS verified, coalesce(hit, page_no) AS page_no,
       CASE WHEN coalesce(q, '') = '' THEN 'no_quote' WHEN n IS NULL THEN 'not_found' WHEN hit IS NULL THEN 'several_pages' WHEN NOT holds THEN 'not_in_quote' WHEN NOT coalesce(here, false) AND page_no IS NOT NULL THEN 'other_page' END AS note
FROM r""")
def model_fields(spark, sf_dir):
    found = fields.verified_fields(src.view(spark, sf_dir, src.SAID), src.view(spark, sf_dir, src.TWO_PAGES))
    return found.select("field_id", "verified", "page_no", "note")
