"""The registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import gaps, ledger, reconcile, timeline
from factloom.session import ship
from factloom.sources import driver_tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query; `dates` are its date columns, returned as ISO text by either engine."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[f.__name__] = run
        if sql:
            replaced = ", ".join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if dates else sql
        return f

    return register


_A, _C, _L = src.duck(src.ACTIONS), src.duck(src.CLAIMS), src.duck(src.LEDGER)
_NORM = "nullif(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '')".format
_GONE = "coalesce(contains(lower(action), 'withdrawn'), false)"

_STATES = f"""
actions AS ({_A}),
days AS (
  SELECT issuer_id, agency, instrument_class, term, action_date, bool_or(provenance = 'primary_rationale') AS prim,
         min(claim_id) FILTER (WHERE provenance = 'history_annexure') AS hist
  FROM actions GROUP BY ALL),
nexts AS (
  SELECT issuer_id, agency, instrument_class, term, action_date, lead(action_date) OVER w AS nd, lead(prim) OVER w AS np, lead(hist) OVER w AS nh
  FROM days WINDOW w AS (PARTITION BY issuer_id, agency, instrument_class, term ORDER BY action_date)),
states AS (
  SELECT claim_id, issuer_id, agency, instrument_class, term, grade, outlook, watch, instrument, action_date AS effective_from,
         CASE WHEN {_GONE} THEN action_date ELSE nd END AS effective_to, {_GONE} AS withdrawn,
         CASE WHEN {_GONE} THEN 'withdrawn' WHEN nd IS NULL THEN NULL WHEN np THEN 'primary' ELSE 'history' END AS end_basis,
         CASE WHEN NOT {_GONE} AND nd IS NOT NULL AND NOT np THEN nh END AS superseded_by, provenance
  FROM actions JOIN nexts USING (issuer_id, agency, instrument_class, term, action_date))"""

_PAIRS = f"""{_STATES},
held AS (SELECT *, coalesce(effective_to, DATE '9999-12-31') AS until FROM states WHERE NOT withdrawn AND effective_from < coalesce(effective_to, DATE '9999-12-31')),
pairs AS (
  SELECT a.issuer_id, a.instrument_class, a.term, a.claim_id AS a_claim_id, b.claim_id AS b_claim_id, a.agency AS a_agency, b.agency AS b_agency,
         a.grade AS a_grade, b.grade AS b_grade, a.outlook AS a_outlook, b.outlook AS b_outlook, a.watch AS a_watch, b.watch AS b_watch, a.instrument AS a_instrument, b.instrument AS b_instrument,
         greatest(a.effective_from, b.effective_from) AS s, nullif(least(a.until, b.until), DATE '9999-12-31') AS e
  FROM held a JOIN held b ON a.issuer_id = b.issuer_id AND a.instrument_class = b.instrument_class AND a.term = b.term
   AND a.agency < b.agency AND a.effective_from < b.until AND b.effective_from < a.until)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.view(spark, sf_dir, src.ACTIONS)


@query(f"WITH {_STATES} SELECT * FROM states", dates=("effective_from", "effective_to"))
def rating_states(spark, sf_dir):
    return timeline.states(_actions(spark, sf_dir))


@query(f"WITH {_STATES} SELECT claim_id, issuer_id, agency, grade FROM states WHERE effective_from <= DATE '1998-06-01' AND coalesce(effective_to, DATE '9999-12-31') > DATE '1998-06-01'")
def ratings_in_force(spark, sf_dir):
    return timeline.in_force(timeline.states(_actions(spark, sf_dir)), "1998-06-01").select("claim_id", "issuer_id", "agency", "grade")


@query(f'WITH {_PAIRS} SELECT issuer_id, instrument_class, term, a_claim_id, b_claim_id, s AS "start", e AS "end" FROM pairs', dates=("start", "end"))
def concurrent_pairs(spark, sf_dir):
    pairs = timeline.concurrent(timeline.states(_actions(spark, sf_dir)))
    return pairs.select("issuer_id", "instrument_class", "term", "a_claim_id", "b_claim_id", "start", "end")


_RUNS = f"""{_PAIRS},
sides AS (
  SELECT *, 'grade' AS aspect, a_grade AS a_said, b_grade AS b_said, {_NORM('a_grade')} AS a_value, {_NORM('b_grade')} AS b_value FROM pairs
  UNION ALL SELECT *, 'outlook', a_outlook, b_outlook, {_NORM('a_outlook')}, {_NORM('b_outlook')} FROM pairs
  UNION ALL SELECT *, 'watch', a_watch, b_watch, {_NORM('a_watch')}, {_NORM('b_watch')} FROM pairs),
windows AS (SELECT * FROM sides WHERE a_value <> b_value),
marked AS (
  SELECT *, CASE WHEN s <= max(coalesce(e, DATE '9999-12-31')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM windows WINDOW w AS (PARTITION BY issuer_id, instrument_class, term, aspect, a_agency, b_agency, a_value, b_value ORDER BY s, a_claim_id, b_claim_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY issuer_id, instrument_class, term, aspect, a_agency, b_agency, a_value, b_value ORDER BY s, a_claim_id, b_claim_id ROWS UNBOUNDED PRECEDING) AS run
  FROM marked)"""


@query(f"""
WITH {_RUNS}
SELECT issuer_id, instrument_class, term, aspect, a_agency, b_agency, a_value, b_value, min(s) AS "start",
       nullif(max(coalesce(e, DATE '9999-12-31')), DATE '9999-12-31') AS "end", count(*) AS n_windows,
       (count(DISTINCT a_claim_id) + count(DISTINCT b_claim_id)) AS n_members
FROM numbered GROUP BY issuer_id, instrument_class, term, aspect, a_agency, b_agency, a_value, b_value, run""", dates=("start", "end"))
def rating_conflict_runs(spark, sf_dir):
    found = timeline.rating_conflicts(_actions(spark, sf_dir))
    return found.withColumn("n_members", F.size("members").cast("long")).drop("members")


_GAPS = f"""
h AS (SELECT * FROM actions WHERE provenance = 'history_annexure'), p AS (SELECT * FROM actions WHERE provenance = 'primary_rationale'),
near AS (
  SELECT p.claim_id, h.issuer_id, h.agency, h.instrument_class, h.term, h.action_date AS d, h.grade AS g,
         row_number() OVER (PARTITION BY p.claim_id ORDER BY abs(date_diff('day', h.action_date, p.action_date)), h.action_date, h.grade NULLS FIRST) AS n
  FROM p JOIN h USING (issuer_id, agency, instrument_class, term)
  WHERE abs(date_diff('day', h.action_date, p.action_date)) <= 3
    AND CASE WHEN h.grade IS NULL THEN coalesce(contains(lower(p.action), 'withdrawn'), false) ELSE h.grade IS NOT DISTINCT FROM p.grade END),
matched AS (SELECT DISTINCT issuer_id, agency, instrument_class, term, d, g FROM near WHERE n = 1),
since AS (SELECT issuer_id, agency, instrument_class, term, min(action_date) AS since FROM p GROUP BY ALL),
bare AS (
  SELECT h.issuer_id, h.agency, h.instrument_class, h.term, h.action_date, coalesce(h.grade, '') AS grade,
         min(CASE WHEN h.action_date > s.since THEN 'within_corpus' ELSE 'before_corpus' END) AS scope, count(*) AS n_evidence, min(claim_id) AS first_claim,
         list(claim_id ORDER BY claim_id) AS evidence, first(outlook ORDER BY claim_id) AS outlook, first(watch ORDER BY claim_id) AS watch
  FROM h LEFT JOIN since s USING (issuer_id, agency, instrument_class, term)
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.issuer_id = h.issuer_id AND m.agency = h.agency AND m.instrument_class = h.instrument_class
                    AND m.term = h.term AND m.d = h.action_date AND m.g IS NOT DISTINCT FROM h.grade)
  GROUP BY h.issuer_id, h.agency, h.instrument_class, h.term, h.action_date, coalesce(h.grade, '')),
dated AS (
  SELECT b.*, (SELECT max(x.action_date) FROM actions x WHERE x.issuer_id = b.issuer_id AND x.agency = b.agency AND x.instrument_class = b.instrument_class AND x.term = b.term AND x.action_date < b.action_date) AS before FROM bare b),
gaps AS (
  SELECT d.*, NOT EXISTS (SELECT 1 FROM actions x WHERE x.issuer_id = d.issuer_id AND x.agency = d.agency AND x.instrument_class = d.instrument_class AND x.term = d.term AND x.action_date = d.before
                          AND x.grade IS NOT DISTINCT FROM nullif(d.grade, '') AND x.outlook IS NOT DISTINCT FROM d.outlook AND x.watch IS NOT DISTINCT FROM d.watch) AS changes_view FROM dated d)"""


@query(f"WITH actions AS ({_A}), {_GAPS} SELECT issuer_id, agency, instrument_class, term, action_date, grade, scope, n_evidence, first_claim, changes_view FROM gaps", dates=("action_date",))
def corpus_gaps(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    found = gaps.find_gaps(actions.where("provenance = 'history_annexure'"), actions.where("provenance = 'primary_rationale'"))
    return found.drop("evidence", "outlook", "watch")


_KEPT = "NOT (starts_with(fact_key, 'rated_amount|') OR starts_with(fact_key, 'instrument|') OR starts_with(fact_key, 'rating_history|'))"


def _facts(said: str) -> str:
    return f"""
claims AS ({_C}),
facts AS (
  SELECT issuer_id, fact_key, count(DISTINCT document_id) AS n_documents, count(DISTINCT source_name) AS n_sources,
         bool_or(basis = 'agency_adjusted') AND bool_or(basis <> 'agency_adjusted') AS mixed, min(value) AS low, max(value) AS high,
         arg_min(unit, claim_id) AS unit, count(DISTINCT {_NORM('value_text')}) AS n_texts
  FROM claims WHERE {said} IS NOT NULL GROUP BY issuer_id, fact_key
  HAVING count(DISTINCT document_id) > 1 AND count(DISTINCT source_name) > 1)"""


@query(f"""WITH {_facts('value')},
spread AS (SELECT *, high - low AS gap, CASE WHEN low = 0 THEN 0 ELSE (high - low) * 100.0 / low END AS pct FROM facts WHERE {_KEPT}),
judged AS (SELECT *, pct > 0.10 AS over_pct, unit = 'INR_CRORE' AND gap > 5 AS over_abs, printf('%.3f', pct) || '%' AS told FROM spread)
SELECT issuer_id, fact_key, n_documents, n_sources, low, high, unit, CASE WHEN mixed THEN 'mixed_basis' WHEN over_pct OR over_abs THEN 'conflict' ELSE 'corroborated' END AS status,
       CASE WHEN mixed THEN NULL WHEN over_pct AND over_abs THEN '₹' || gap || ' crore (' || told || ') — over both the 0.10% and ₹5 crore tolerances' WHEN over_pct THEN '₹' || gap || ' crore (' || told || ') — above the 0.10% tolerance'
            WHEN over_abs THEN '₹' || gap || ' crore — above the ₹5 crore tolerance, though only ' || told || ' of the reported figure' ELSE '₹' || gap || ' crore (' || told || ') — within both tolerances' END AS why
FROM judged""")
def numeric_facts(spark, sf_dir):
    return reconcile.numeric_facts(src.view(spark, sf_dir, src.CLAIMS))


@query(f"""WITH {_facts(_NORM('value_text'))},
by_source AS (
  SELECT issuer_id, fact_key, source_name, string_agg(value_text, ' / ' ORDER BY value_text) AS says
  FROM (SELECT DISTINCT issuer_id, fact_key, source_name, value_text FROM claims WHERE value_text IS NOT NULL) GROUP BY ALL)
SELECT f.issuer_id, f.fact_key, f.n_texts, string_agg(source_name || ' says ' || says, '; ' ORDER BY source_name || ' says ' || says) AS summary
FROM facts f JOIN by_source USING (issuer_id, fact_key) WHERE n_texts > 1 AND NOT mixed AND {_KEPT} GROUP BY f.issuer_id, f.fact_key, f.n_texts""")
def categorical_conflicts(spark, sf_dir):
    return reconcile.categorical_conflicts(src.view(spark, sf_dir, src.CLAIMS))


@query(f"""
WITH latest AS (SELECT agency_id, report, item, arg_max(value_text, claim_id) AS v FROM ({src.duck(src.REPORTS)}) GROUP BY ALL),
pairs AS (SELECT agency_id, report AS f, lead(report) OVER (PARTITION BY agency_id ORDER BY report) AS t FROM (SELECT DISTINCT agency_id, report FROM latest)),
keys AS (SELECT DISTINCT p.agency_id, f, t, item FROM pairs p JOIN latest l ON l.agency_id = p.agency_id AND l.report IN (f, t) WHERE t IS NOT NULL)
SELECT k.agency_id, f AS from_report, t AS to_report, k.item, o.v AS "before", n.v AS "after",
       CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS direction
FROM keys k LEFT JOIN latest o ON o.agency_id = k.agency_id AND o.report = f AND o.item = k.item
LEFT JOIN latest n ON n.agency_id = k.agency_id AND n.report = t AND n.item = k.item WHERE o.v IS DISTINCT FROM n.v""")
def report_diff(spark, sf_dir):
    return reconcile.report_diff(src.view(spark, sf_dir, src.REPORTS))


@query(f"""
WITH s AS (SELECT DISTINCT issuer_id, fact_key FROM ({_C}) WHERE document_id < 4), f AS (SELECT DISTINCT issuer_id, fact_key FROM ({_C}) WHERE document_id > 2)
SELECT issuer_id, fact_key, CASE WHEN s.issuer_id IS NULL THEN 'run2' ELSE 'run1' END AS first_seen,
       CASE WHEN f.issuer_id IS NULL THEN 'run1' ELSE 'run2' END AS last_seen, CASE WHEN f.issuer_id IS NULL THEN 'run2' END AS resolved_at
FROM s FULL OUTER JOIN f USING (issuer_id, fact_key)""")
def durable_state(spark, sf_dir):
    claims = src.view(spark, sf_dir, src.CLAIMS)
    key = ["issuer_id", "fact_key"]
    state = claims.where("document_id < 4").select(*key).distinct().withColumns({"first_seen": F.lit("run1"), "last_seen": F.lit("run1"), "resolved_at": F.lit(None).cast("string")})
    return reconcile.merge_state(state, claims.where("document_id > 2"), key, "run2")


@query(f"""
SELECT txn_id, account_key, document_id, document_id <> first_value(document_id) OVER (
  PARTITION BY account_key, txn_date, debit, credit, balance, {_NORM('narration')} ORDER BY document_id, seq, txn_id) AND NOT ends_with(account_key, 'doc' || document_id) AS duplicate
FROM ({src.duck(src.REPEATED)})""")
def duplicate_transactions(spark, sf_dir):
    return ledger.mark_duplicates(src.view(spark, sf_dir, src.REPEATED)).select("txn_id", "account_key", "document_id", "duplicate")


@query(f"""
WITH t AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY account_key ORDER BY txn_date, document_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
           FROM ({src.duck(src.BALANCED)}))
SELECT txn_id, account_key, previous, balance, previous + credit - debit - balance AS off_by FROM t WHERE balance IS NOT NULL AND previous IS NOT NULL AND previous + credit - debit - balance <> 0""")
def balance_breaks(spark, sf_dir):
    return ledger.balance_breaks(src.view(spark, sf_dir, src.BALANCED)).select("txn_id", "account_key", "previous", "balance", "off_by")


@query(f"""
WITH d AS ({src.duck(src.DAYS)}),
eod AS (SELECT account_key, txn_date, arg_max(balance, seq) AS eod FROM d WHERE balance IS NOT NULL GROUP BY ALL),
span AS (SELECT account_key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS txn_date FROM (SELECT account_key, min(txn_date) AS lo, max(txn_date) AS hi FROM d GROUP BY 1))
SELECT account_key, txn_date, last_value(eod IGNORE NULLS) OVER (PARTITION BY account_key ORDER BY txn_date ROWS UNBOUNDED PRECEDING) AS balance
FROM span LEFT JOIN eod USING (account_key, txn_date)""", dates=("txn_date",))
def daily_balances(spark, sf_dir):
    return ledger.daily_balances(src.view(spark, sf_dir, src.DAYS))


@query(f"""
SELECT account_key, strftime(txn_date, '%Y-%m') AS month, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits,
       count(*) FILTER (WHERE credit > 0) AS n_credits, count(*) FILTER (WHERE debit > 0) AS n_debits,
       CAST(coalesce(sum(credit) FILTER (WHERE contains(upper(narration), 'CASH')), 0) AS BIGINT) AS cash_in
FROM ({_L}) GROUP BY ALL""")
def monthly_banking(spark, sf_dir):
    return ledger.monthly(src.view(spark, sf_dir, src.LEDGER))


@query(f"""
WITH s AS (SELECT *, lead(period_start) OVER w AS next_start, lead(period_end) OVER w AS next_end FROM ({src.duck(src.STATEMENTS)}) WINDOW w AS (PARTITION BY account_key ORDER BY period_start, document_id)),
k AS (SELECT account_key, document_id, period_end, next_start, next_end, CASE WHEN next_start > period_end + 1 THEN 'gap' WHEN next_start <= period_end THEN 'overlap' END AS kind FROM s)
SELECT * EXCLUDE (next_end), CASE kind WHEN 'gap' THEN period_end + 1 ELSE next_start END AS first_day, CASE kind WHEN 'gap' THEN next_start - 1 ELSE least(period_end, next_end) END AS last_day
FROM k WHERE kind IS NOT NULL""", dates=("period_end", "next_start", "first_day", "last_day"))
def statement_gaps(spark, sf_dir):
    return ledger.statement_gaps(src.view(spark, sf_dir, src.STATEMENTS))


_SIGNED = "array_to_string(list_filter(regexp_extract_all(upper(narration), '[A-Z][A-Z]+'), lambda w: w NOT IN ('UPI', 'IMPS', 'NEFT'))[1:4], ' ')"


@query(f"""
WITH d AS ({ORACLES["duplicate_transactions"]}),
g AS (
  SELECT account_key, category, {_SIGNED} AS signature, count(*) AS n, count(DISTINCT strftime(txn_date, '%Y-%m')) AS n_months, list(debit ORDER BY debit) AS a, sum(debit) AS total
  FROM ({src.duck(src.REPEATED)}) WHERE txn_id IN (SELECT txn_id FROM d WHERE NOT duplicate) AND category IN ('loan_repayment', 'card_payment', 'od_interest') GROUP BY ALL)
SELECT account_key, category, signature, n, n_months, a[n // 2 + 1] AS typical, a[1] AS low, a[n] AS high, CAST(round_even(total / n, 2) AS DOUBLE) AS average, (a[n] - a[1]) * 200 <= greatest(200, a[n // 2 + 1]) AS fixed_amount
FROM g WHERE n_months >= 2 OR category = 'od_interest'""")
def recurring_series(spark, sf_dir):
    return ledger.recurring(ledger.mark_duplicates(src.view(spark, sf_dir, src.REPEATED)))


@query(f"""
WITH p AS (SELECT account_key, {_SIGNED} AS payer, CAST(sum(credit) AS BIGINT) AS credits FROM ({_L}) WHERE credit > 0 GROUP BY ALL),
r AS (SELECT *, sum(credits) OVER (PARTITION BY account_key) AS total, row_number() OVER (PARTITION BY account_key ORDER BY credits DESC, payer) AS rank FROM p)
SELECT account_key, payer, credits, CAST(floor(credits * 1000 / total) AS BIGINT) AS per_mille, rank FROM r WHERE rank <= 5""")
def top_payers(spark, sf_dir):
    return ledger.top_payers(src.view(spark, sf_dir, src.LEDGER))


@query(f"""
WITH RECURSIVE t AS (SELECT * FROM ({src.duck(src.NARRATED)})),
large AS (
  SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY txn_date, seq, txn_id) AS n FROM t
  WHERE credit >= 10000 AND NOT regexp_matches(narration, '(?i)\\b(RETURN|RTN|RET|BOUNCE|BOUNCED|DISHONOU?R|INSUFFICIENT|UNPAID|REJECT(ED)?)\\b')
    AND (regexp_matches(narration, '(?i)\\b(CASH DEP|CASH DEPOSIT|BY CASH|CDM|CASH-DEP|CSH DEP)\\b') OR NOT regexp_matches(narration, '(?i)\\b(SELF|OWN A/?C|TRF TO SB|TRF FROM SB|SWEEP)\\b'))),
spans AS (
  SELECT account_key, n, credit, (SELECT coalesce(sum(debit), 0) FROM t d WHERE d.account_key = l.account_key AND d.txn_date < l.txn_date) AS s,
         (SELECT coalesce(sum(debit), 0) FROM t d WHERE d.account_key = l.account_key AND d.txn_date <= l.txn_date + 2) AS e FROM large l),
walk(account_key, n, taken, quick, amount) AS (
  SELECT DISTINCT account_key, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(30, 2)), CAST(0 AS BIGINT), CAST(0 AS DECIMAL(30, 2)) FROM spans
  UNION ALL
  SELECT w.account_key, s.n, CAST(CASE WHEN s.e - greatest(w.taken, s.s) >= s.credit * 0.8 THEN greatest(w.taken, s.s) + s.credit * 0.8 ELSE w.taken END AS DECIMAL(30, 2)),
         w.quick + CASE WHEN s.e - greatest(w.taken, s.s) >= s.credit * 0.8 THEN 1 ELSE 0 END, CAST(w.amount + CASE WHEN s.e - greatest(w.taken, s.s) >= s.credit * 0.8 THEN s.credit ELSE 0 END AS DECIMAL(30, 2))
  FROM walk w JOIN spans s ON s.account_key = w.account_key AND s.n = w.n + 1)
SELECT account_key, max(n) AS n_large, max(quick) AS n_quick, CAST(max(amount) AS BIGINT) AS quick_amount, CAST((SELECT sum(credit) FROM spans s WHERE s.account_key = walk.account_key) AS BIGINT) AS large_amount
FROM walk GROUP BY account_key""")
def retention(spark, sf_dir):
    return ledger.retention(src.view(spark, sf_dir, src.NARRATED)).withColumn("quick_amount", F.col("quick_amount").cast("long"))


@query(f"""
WITH c AS ({src.duck(src.ASSUMPTIONS)}),
s AS (SELECT *, CASE WHEN coalesce(income <= 0 OR obligations < 0 OR ratio_pct <= 0 OR ratio_pct > 100 OR NOT rate_pct BETWEEN 0 AND 60 OR NOT tenure BETWEEN 1 AND 480 OR tenure <> floor(tenure), false) THEN 'invalid'
             WHEN income IS NULL THEN 'needs_input' ELSE 'computed' END AS status, greatest(0, CAST(ratio_pct * 100 AS BIGINT) * income - obligations * 10000) AS scaled FROM c),
k AS (SELECT *, CAST((scaled * 2 + 100) // 200 AS DOUBLE) / 100 AS cap FROM s)
SELECT case_id, status, CASE WHEN status = 'computed' THEN cap END AS capacity,
       CASE WHEN status = 'computed' THEN round(CASE WHEN rate_pct = 0 THEN cap * CAST(tenure AS DOUBLE) ELSE cap * (1 - pow(1 + rate_pct / 1200.0, -CAST(tenure AS DOUBLE))) / (rate_pct / 1200.0) END, 0) END AS principal,
       CASE WHEN status <> 'invalid' AND income > 0 THEN ((obligations * 20000 + income) // (2 * income)) / 100.0 END AS present_ratio
FROM k""")
def eligibility(spark, sf_dir):
    return ledger.eligibility(src.view(spark, sf_dir, src.ASSUMPTIONS))


@query(f"SELECT account_key, max(txn_id) AS txn_id, arg_max(narration, txn_id) AS narration FROM ({_L}) GROUP BY account_key")
def latest_overlay(spark, sf_dir):
    rows = src.view(spark, sf_dir, src.LEDGER).select("account_key", "txn_id", "narration")
    return ledger.latest(rows, ["account_key"], "txn_id")


@query(f"""
WITH c AS (SELECT issuer_id, count(*) AS n_claims, count(DISTINCT document_id) AS n_documents FROM ({_C}) GROUP BY 1), a AS (SELECT issuer_id, count(*) AS n_actions, max(action_date) AS last_action FROM ({_A}) GROUP BY 1)
SELECT issuer_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_documents, 0) AS n_documents, coalesce(n_actions, 0) AS n_actions, last_action FROM c FULL OUTER JOIN a USING (issuer_id)""", dates=("last_action",))
def issuers(spark, sf_dir):
    claims = src.view(spark, sf_dir, src.CLAIMS).groupBy("issuer_id").agg(F.count("*").alias("n_claims"), F.count_distinct("document_id").alias("n_documents"))
    actions = _actions(spark, sf_dir).groupBy("issuer_id").agg(F.count("*").alias("n_actions"), F.max("action_date").alias("last_action"))
    return claims.join(actions, "issuer_id", "full_outer").fillna(0, ["n_claims", "n_documents", "n_actions"])


@query(f"""
WITH c AS ({_C})
SELECT x.issuer_id, x.fact_key, x.claim_id AS from_claim, y.claim_id AS to_claim, x.value AS before_value, y.value AS after_value
FROM c x JOIN c y ON x.issuer_id = y.issuer_id AND x.fact_key = y.fact_key AND y.document_id = x.document_id + 1 WHERE x.value IS DISTINCT FROM y.value""")
def restatements(spark, sf_dir):
    claims = src.view(spark, sf_dir, src.CLAIMS).select("issuer_id", "fact_key", "document_id", "claim_id", "value")
    old = claims.select("issuer_id", "fact_key", (F.col("document_id") + 1).alias("document_id"), F.col("claim_id").alias("from_claim"), F.col("value").alias("before_value"))
    new = claims.withColumnsRenamed({"claim_id": "to_claim", "value": "after_value"})
    joined = old.join(new, ["issuer_id", "fact_key", "document_id"]).where(~F.col("before_value").eqNullSafe(F.col("after_value")))
    return joined.drop("document_id")


@query(f"""
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '…' END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def evidence_excerpts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("""
SELECT doc_id, CAST(n AS INT) AS line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n FROM documents)""")
def anchored_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
