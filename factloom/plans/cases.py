"""Registered queries of the case assessment, the document views and the stream, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import banking, credit, evidence
from factloom.plans.catalog import ORACLES, QUERIES, query
from factloom.sources import driver_tables as src
from factloom.streaming import activity

__all__ = ["ORACLES", "QUERIES"]


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(x: str) -> str:
    named = f"list_filter(list_distinct(regexp_extract_all(upper(coalesce({x}, '')), '[A-Z]{{3,}}')), lambda w: w NOT IN {_in(banking.GENERIC)})"
    cases = " ".join(f"WHEN '{k}' THEN ['{v[0]}', '{v[1]}']" for k, v in banking.ALIASES.items())
    return f"list_distinct(flatten(list_transform({named}, lambda w: CASE w {cases} ELSE [w] END)))"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


_N = "upper(narration)"
_CATEGORISED = f"""
SELECT t.*, CASE WHEN credit > 0 THEN CASE WHEN list_has_any({_tokens('employer')}, {_tokens('narration')}) OR {_has(_N, banking.SALARY_WORDS)} THEN 'salary' ELSE 'other' END
  WHEN {_has(_N, banking.OD_INTEREST)} THEN 'od_interest' WHEN {_has(_N, banking.CARD_WORDS)} AND {_has(_N, banking.CARD_PAYMENT)} THEN 'card_payment'
  WHEN {_has(_N, banking.LOAN_WORDS)} OR list_has_any(list_filter({_tokens('lenders')}, lambda w: NOT list_contains({_tokens('own_bank')}, w)), {_tokens('narration')}) THEN 'loan_repayment' ELSE 'other' END AS category
FROM ({src.duck(src.NARRATED)}) t LEFT JOIN ({src.duck(src.PARTIES)}) p USING (account_key)"""


@query(f"SELECT txn_id, account_key, category FROM ({_CATEGORISED})")
def transaction_categories(spark, sf_dir):
    rows = banking.categorise(src.view(spark, sf_dir, src.NARRATED), src.view(spark, sf_dir, src.PARTIES))
    return rows.select("txn_id", "account_key", "category")


_TAGGED = f"""
SELECT *, CASE WHEN credit > 0 THEN CASE WHEN {_has(_N, banking.RETURNED)} THEN 'return' WHEN {_has(_N, banking.CASH_IN)} THEN 'cash_deposit' WHEN {_has(_N, banking.OWN)} THEN 'own' ELSE 'business' END
  WHEN {_has(_N, banking.RETURNED)} AND NOT ({_has(_N, banking.CHARGE)} AND NOT {_has(_N, banking.MANDATE)}) THEN 'return' WHEN {_has(_N, banking.CASH_OUT)} THEN 'cash_withdrawal' ELSE 'payment' END AS tag
FROM ({src.duck(src.NARRATED)})"""


@query(f"""
SELECT account_key, strftime(txn_date, '%Y-%m') AS month, CAST(sum(CASE WHEN tag IN ('business', 'cash_deposit') THEN credit ELSE 0 END) AS BIGINT) AS business_credits,
       CAST(sum(CASE WHEN tag = 'cash_deposit' THEN credit ELSE 0 END) AS BIGINT) AS cash_deposits, CAST(sum(CASE WHEN tag = 'cash_withdrawal' THEN debit ELSE 0 END) AS BIGINT) AS cash_withdrawals,
       count(*) FILTER (WHERE tag = 'return') AS n_returns
FROM ({_TAGGED}) GROUP BY ALL""")
def monthly_business(spark, sf_dir):
    return banking.monthly_business(src.view(spark, sf_dir, src.NARRATED))


_PARTS = f"list_filter(list_transform(regexp_split_to_array({_N}, '[-/:]'), lambda p: trim(p)), lambda p: p <> '' AND p NOT IN {_in(banking.CHANNELS)} AND NOT {_has('p', banking.IFSC)} AND length(regexp_replace(p, '[^0-9]', '', 'g')) * 3 <= length(p) AND NOT contains(p, '@'))"
_NAMED = f"list_filter(list_transform({_PARTS}, lambda p: list_filter(regexp_extract_all(p, '[A-Z]{{2,}}'), lambda w: w NOT IN {_in(banking.CHANNELS)})), lambda w: len(w) > 0)"


@query(f"""
WITH p AS (SELECT account_key, coalesce(array_to_string(list_slice(({_NAMED})[1], 1, 3), ' '), 'UNIDENTIFIED') AS party, CAST(sum(credit) AS BIGINT) AS credits
           FROM ({_TAGGED}) WHERE credit > 0 AND tag = 'business' GROUP BY ALL),
r AS (SELECT *, sum(credits) OVER (PARTITION BY account_key) AS total, row_number() OVER (PARTITION BY account_key ORDER BY credits DESC, party) AS rank FROM p)
SELECT account_key, party, credits, CAST(floor(credits * 1000 / total) AS BIGINT) AS per_mille, rank FROM r WHERE rank <= 5""")
def counterparty_concentration(spark, sf_dir):
    return banking.concentration(src.view(spark, sf_dir, src.NARRATED))


_LINES = f"""
lines AS (
  SELECT *, CASE WHEN regexp_matches(upper(account_type), 'OVERDRAFT|\\bOD\\b') THEN 'od' WHEN contains(upper(account_type), 'CARD') THEN 'card' ELSE 'loan' END AS kind,
         CASE WHEN contains(upper(ownership), 'GUARANTOR') THEN 'guarantor' WHEN contains(upper(ownership), 'JOINT') THEN 'joint' WHEN contains(upper(ownership), 'AUTHORI') THEN 'authorized user' WHEN ownership <> '' THEN 'individual' END AS role,
         (date_closed IS NOT NULL AND date_closed_verified) OR (status_verified AND regexp_matches(upper(status), 'CLOSED|SETTLED|WRITTEN.*OFF')) AS closed,
         right(regexp_replace(account_number, '\\D', '', 'g'), 4) AS last4
  FROM ({src.duck(src.TRADELINES)}))"""


@query(f"WITH {_LINES} SELECT tradeline_id, case_id, kind, role, closed, last4 FROM lines")
def credit_tradelines(spark, sf_dir):
    return credit.tradelines(src.view(spark, sf_dir, src.TRADELINES)).select("tradeline_id", "case_id", "kind", "role", "closed", "last4")


_FOUND = f"""{_LINES},
series AS ({src.duck(src.SERIES)}),
pairs AS (
  SELECT l.case_id, l.tradeline_id, s.series_id, s.category, s.recurring, l.kind,
         coalesce(abs(s.amount - l.emi) * 200 <= greatest(200, l.emi), false) AS am, list_has_any({_tokens('l.lender')}, {_tokens('s.narrations')}) AS le,
         coalesce(contains(upper(s.narrations) || ' ' || s.refs, l.last4), false) AS ac,
         coalesce(contains(upper(s.narrations), trim(regexp_replace(upper(l.account_type), '\\s+', ' ', 'g'))), false) AS ty
  FROM lines l JOIN series s USING (case_id) WHERE NOT closed),
told AS (
  SELECT *, CAST(am AS INT) + CAST(le AS INT) + CAST(ac AS INT) >= 2 AS strong FROM pairs
  WHERE (category = CASE kind WHEN 'card' THEN 'card_payment' WHEN 'od' THEN 'od_interest' ELSE 'loan_repayment' END OR (category = 'loan_repayment' AND (le OR ac)))
    AND (le OR ac OR ty OR (am AND recurring))),
rated AS (SELECT *, CASE WHEN NOT strong THEN 'weak' WHEN count(*) FILTER (WHERE strong) OVER (PARTITION BY case_id, series_id) > 1 THEN 'contested' ELSE 'strong' END AS strength FROM told),
decided AS (SELECT tradeline_id, series_id, arg_max(status, decision_id) AS st FROM ({src.duck(src.DECISIONS)}) GROUP BY ALL),
found AS (
  SELECT case_id, tradeline_id, series_id, concat_ws(',', CASE WHEN am THEN 'amount' END, CASE WHEN le THEN 'lender' END, CASE WHEN ac THEN 'account' END, CASE WHEN ty THEN 'type' END, CASE WHEN recurring THEN 'monthly' END) AS signals,
         strength, coalesce(st, CASE WHEN strength = 'strong' THEN 'proposed' ELSE 'ambiguous' END) AS status
  FROM rated LEFT JOIN decided USING (tradeline_id, series_id))"""


def _matches(spark, sf_dir):
    return credit.matches(*[src.view(spark, sf_dir, v) for v in (src.TRADELINES, src.SERIES, src.DECISIONS)])


@query(f"WITH {_FOUND} SELECT * FROM found")
def bureau_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


_OBLIGATIONS = f"""{_FOUND},
taken AS (SELECT tradeline_id, arg_min(series_id, CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END * 1000000000 + series_id) AS series_id FROM found WHERE status IN ('confirmed', 'proposed') GROUP BY ALL),
bureau AS (
  SELECT l.*, s.amount AS seen, CASE WHEN closed THEN 'closed' WHEN kind = 'od' THEN 'overdraft' WHEN kind = 'card' THEN 'card' WHEN role IN ('guarantor', 'authorized user') THEN 'role'
         WHEN emi > 0 THEN 'emi' WHEN fixed_amount THEN 'observed' WHEN emi_status = 'unverified' THEN 'unverified' ELSE 'missing' END AS basis
  FROM lines l LEFT JOIN taken t USING (tradeline_id) LEFT JOIN series s ON s.series_id = t.series_id),
every AS (
  SELECT case_id, 'bureau' AS source, tradeline_id AS key_id, basis, CASE basis WHEN 'emi' THEN emi WHEN 'observed' THEN seen END AS amount, CASE basis WHEN 'closed' THEN 'reported' WHEN 'emi' THEN emi_status WHEN 'observed' THEN 'inferred' END AS origin FROM bureau
  UNION ALL SELECT case_id, 'bank', series_id, 'bank_only', NULL, NULL FROM series s WHERE category = 'loan_repayment' AND recurring AND NOT EXISTS (SELECT 1 FROM found f WHERE f.series_id = s.series_id AND status <> 'rejected')),
treated AS (SELECT source, key_id, arg_max(include, treatment_id) AS inc, arg_max(amount, treatment_id) AS amt FROM ({src.duck(src.TREATMENTS)}) GROUP BY ALL),
obligations AS (
  SELECT case_id, source, key_id, CASE WHEN inc IS NOT NULL THEN 'analyst' ELSE basis END AS basis, coalesce(inc, basis IN ('emi', 'observed')) AS included,
         CAST(CASE WHEN inc IS NULL THEN amount WHEN inc THEN amt END AS BIGINT) AS amount, CASE WHEN inc IS NOT NULL THEN 'analyst' ELSE origin END AS origin
  FROM every LEFT JOIN treated USING (source, key_id))"""


def _obligations(spark, sf_dir):
    lines, series, treatments = [src.view(spark, sf_dir, v) for v in (src.TRADELINES, src.SERIES, src.TREATMENTS)]
    return credit.obligations(lines, series, _matches(spark, sf_dir), treatments)


@query(f"WITH {_OBLIGATIONS} SELECT * FROM obligations")
def obligations(spark, sf_dir):
    return _obligations(spark, sf_dir)


@query(f"""WITH {_OBLIGATIONS}
SELECT case_id, CAST(coalesce(sum(amount) FILTER (WHERE included), 0) AS BIGINT) AS total_included, count(*) FILTER (WHERE NOT included AND basis NOT IN ('closed', 'analyst')) AS n_unresolved
FROM obligations GROUP BY ALL""")
def obligation_totals(spark, sf_dir):
    return credit.obligation_totals(_obligations(spark, sf_dir))


@query(f"""
WITH paid AS (SELECT account_key, strftime(CASE WHEN day(txn_date) <= 10 THEN txn_date - INTERVAL 1 MONTH ELSE txn_date END, '%Y-%m') AS month, CAST(sum(credit) AS BIGINT) AS bank_total
              FROM ({_CATEGORISED}) WHERE category = 'salary' GROUP BY ALL),
slips AS (SELECT account_key, month, true AS slip, arg_min_null(net, document_id) AS slip_net FROM ({src.duck(src.SLIPS)}) WHERE month IS NOT NULL GROUP BY ALL),
span AS (SELECT account_key, date_trunc('month', min(txn_date)) AS lo, date_trunc('month', max(txn_date)) AS hi FROM ({src.duck(src.NARRATED)}) GROUP BY 1)
SELECT account_key, month, slip_net, bank_total, bank_total - slip_net AS difference,
       CASE WHEN slip IS NULL THEN 'no_slip' WHEN slip_net IS NULL THEN 'net_unverified'
            WHEN bank_total IS NULL THEN CASE WHEN strptime(month || '-01', '%Y-%m-%d') BETWEEN lo - INTERVAL 1 MONTH AND hi THEN 'no_credit' ELSE 'not_covered' END
            WHEN bank_total = slip_net THEN 'equal' WHEN bank_total > slip_net THEN 'above' ELSE 'below' END AS finding
FROM slips FULL OUTER JOIN paid USING (account_key, month) LEFT JOIN span USING (account_key)""")
def salary_comparison(spark, sf_dir):
    rows, parties, slips = [src.view(spark, sf_dir, v) for v in (src.NARRATED, src.PARTIES, src.SLIPS)]
    statements = rows.groupBy("account_key").agg(F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"))
    return credit.salary_comparison(slips, banking.categorise(rows, parties).where("category = 'salary'"), statements)


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY month DESC, document_id DESC) AS n FROM ({src.duck(src.SLIPS)}) WHERE net IS NOT NULL AND gross IS NOT NULL AND month IS NOT NULL)
SELECT account_key, count(*) AS n_slips, CAST(round_even(sum(net) / count(*), 2) AS DOUBLE) AS income, CAST(round_even(sum(gross) * 12 / count(*), 0) AS BIGINT) AS annual_gross FROM v WHERE n <= 3 GROUP BY 1""")
def suggested_income(spark, sf_dir):
    return credit.suggested_income(src.view(spark, sf_dir, src.SLIPS))


@query(f"""
WITH f AS (SELECT case_id, min(value) AS since, arg_min(field, (value, field)) AS field FROM ({src.duck(src.REGISTRATIONS)}) WHERE status <> 'unverified' GROUP BY 1)
SELECT case_id, since, field, CAST(round_even((DATE '2024-06-30' - CAST(since AS DATE)) / 365.25, 1) AS DOUBLE) AS years FROM f""", dates=("since",))
def business_vintage(spark, sf_dir):
    return credit.vintage(src.view(spark, sf_dir, src.REGISTRATIONS), "2024-06-30")


_CLAIMS, _ACTIONS, _ANCHORS = src.duck(src.CLAIMS), src.duck(src.ACTIONS), src.duck(src.ANCHORS)


@query(f"""
SELECT issuer_id, fact_key, count(DISTINCT source_name) AS sources, min(value) AS low, max(value) AS high, max(value) - min(value) AS variance
FROM ({src.duck(src.AGREED)}) WHERE value IS NOT NULL AND NOT (starts_with(fact_key, 'rated_amount|') OR starts_with(fact_key, 'instrument|') OR starts_with(fact_key, 'rating_history|')) GROUP BY issuer_id, fact_key
HAVING count(DISTINCT document_id) > 1 AND count(DISTINCT source_name) > 1 AND (max(value) - min(value)) / nullif(min(value), 0) * 100 <= 0.10 AND max(value) - min(value) <= 5""")
def corroborations(spark, sf_dir):
    return evidence.corroborations(src.view(spark, sf_dir, src.AGREED))


@query(f"""
WITH listed AS (SELECT DISTINCT issuer_id, agency, CAST(action_date AS VARCHAR) AS action_date FROM ({_ACTIONS}) WHERE provenance = 'history_annexure'),
missing AS (SELECT issuer_id, agency, action_date, bool_or(scope = 'within_corpus') AS within, bool_or(changes_view) AS changes FROM ({ORACLES['corpus_gaps']}) GROUP BY ALL)
SELECT issuer_id, agency, count(*) AS listed, min(action_date) AS listed_since, count(*) FILTER (WHERE within IS NULL) AS loaded, count(*) FILTER (WHERE within) AS missing_within,
       count(*) FILTER (WHERE NOT within) AS missing_before, coalesce(string_agg(action_date, ',' ORDER BY action_date) FILTER (WHERE within), '') AS missing_dates,
       count(*) FILTER (WHERE within AND changes) AS missing_material, coalesce(string_agg(action_date || ':' || changes, ',' ORDER BY action_date) FILTER (WHERE within), '') AS detail
FROM listed LEFT JOIN missing USING (issuer_id, agency, action_date) GROUP BY issuer_id, agency""", dates=("listed_since",))
def gap_summary(spark, sf_dir):
    actions = src.view(spark, sf_dir, src.ACTIONS)
    return evidence.gap_summary(actions.where("provenance = 'history_annexure'"), actions.where("provenance = 'primary_rationale'"))


@query(f"""
WITH d AS ({src.duck(src.DEBTS)}), l AS (SELECT issuer_id, source_name, max(published) AS published FROM d GROUP BY ALL)
SELECT issuer_id, source_name, claim_id, maturity_date, amount FROM d JOIN l USING (issuer_id, source_name, published) WHERE instrument_type <> 'total' AND maturity_date IS NOT NULL""", dates=("maturity_date",))
def maturity_ladder(spark, sf_dir):
    return evidence.maturity_ladder(src.view(spark, sf_dir, src.DEBTS))


@query(f"""
SELECT document_id, CASE WHEN count(version) = 0 THEN 'initial' WHEN bool_or(forced) THEN 'forced' WHEN min(version) = 'v2' AND max(version) = 'v2' THEN 'cached' ELSE 'version_changed' END AS decision
FROM ({src.duck(src.VERSIONS)}) GROUP BY document_id""")
def extraction_decisions(spark, sf_dir):
    return evidence.extraction_decisions(src.view(spark, sf_dir, src.VERSIONS), "v2")


_REQUIRED = [f"metric|{k}|total" for k in range(10, 30)]


@query(f"""
WITH f AS (SELECT issuer_id, list(DISTINCT fact_key) FILTER (WHERE fact_key IN {_in(_REQUIRED)}) AS got FROM ({_CLAIMS}) GROUP BY 1), m AS (SELECT *, list_sort(list_filter([{_in(_REQUIRED)[1:-1]}], lambda k: NOT list_contains(coalesce(got, []), k))) AS miss FROM f)
SELECT issuer_id, {len(_REQUIRED)} AS expected, CAST({len(_REQUIRED)} - len(miss) AS INT) AS found, array_to_string(miss, ',') AS missing, CASE WHEN len(miss) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM m""")
def coverage(spark, sf_dir):
    return evidence.coverage(src.view(spark, sf_dir, src.CLAIMS), "issuer_id", "fact_key", _REQUIRED)


@query(f"""
SELECT a.doc_id, CASE WHEN coalesce(evidence_text, '') = '' THEN 'empty' WHEN char_end <= char_start OR char_start < 0 THEN 'range' WHEN coalesce(char_end > length(text), true) THEN 'beyond_text'
       WHEN substr(text, char_start + 1, char_end - char_start) <> evidence_text THEN 'other_text' ELSE 'verified' END AS verdict
FROM ({_ANCHORS}) a JOIN documents d ON a.doc_id = d.doc_id""")
def anchor_verification(spark, sf_dir):
    return evidence.verify_anchors(src.view(spark, sf_dir, src.ANCHORS), spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def streamed_activity(spark, sf_dir):
    # the pattern makes a single file and a folder of files alike sources of a stream
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    cents = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    made = activity.windowed(cents, "ts", ["event_type"], "cents")
    rows = activity.drain(made, ["start", "event_type"], activity.workspace(spark, "activity"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
