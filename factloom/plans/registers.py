"""Registered queries of the conflict and gap registers, the views over them and the covered accounts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import reading
from factloom.operators import conflicts, evidence, ledger, reconcile, timeline
from factloom.plans.catalog import _A, _C, _GAPS, _KEPT, _NORM, _RUNS, _STATES, ORACLES, QUERIES, query
from factloom.sources import driver_tables as src
from factloom.streaming.activity import workspace

__all__ = ["ORACLES", "QUERIES"]

_NUMERIC = "((min(value) > 0 AND (max(value) - min(value)) * 1000 > min(value)) OR (arg_min(unit, claim_id) = 'INR_CRORE' AND max(value) - min(value) > 5))"
_SEVERAL = "count(DISTINCT document_id) > 1 AND count(DISTINCT source_name) > 1 AND NOT (bool_or(basis = 'agency_adjusted') AND bool_or(basis <> 'agency_adjusted'))"


def _found(name: str, condition: str) -> str:
    return f"""{name} AS (
  SELECT issuer_id, fact_key, 'numeric_disagreement' AS kind, count(*) AS n FROM claims WHERE {condition} AND {_KEPT} AND value IS NOT NULL GROUP BY ALL HAVING {_SEVERAL} AND {_NUMERIC}
  UNION ALL SELECT issuer_id, fact_key, 'categorical_disagreement', count(*) FROM claims WHERE {condition} AND {_KEPT} AND {_NORM('value_text')} IS NOT NULL GROUP BY ALL HAVING {_SEVERAL} AND count(DISTINCT {_NORM('value_text')}) > 1)"""


_RUN = {"run1": "document_id < 4", "run2": "document_id > 2", "run3": "document_id <> 5"}
_REGISTER = f"""
claims AS ({_C}), {', '.join(_found(r, c) for r, c in _RUN.items())},
keys AS (SELECT issuer_id, fact_key, kind FROM run1 UNION SELECT issuer_id, fact_key, kind FROM run2 UNION SELECT issuer_id, fact_key, kind FROM run3),
register AS (
  SELECT k.issuer_id, k.fact_key, k.kind, CASE WHEN a.n IS NOT NULL THEN 'run1' WHEN b.n IS NOT NULL THEN 'run2' ELSE 'run3' END AS first_seen,
         CASE WHEN c.n IS NOT NULL THEN 'run3' WHEN b.n IS NOT NULL THEN 'run2' ELSE 'run1' END AS last_seen,
         CASE WHEN c.n IS NOT NULL THEN NULL WHEN b.n IS NOT NULL THEN 'run3' ELSE 'run2' END AS resolved_at, coalesce(c.n, b.n, a.n) AS n_members
  FROM keys k LEFT JOIN run1 a ON a.issuer_id = k.issuer_id AND a.fact_key = k.fact_key AND a.kind = k.kind LEFT JOIN run2 b ON b.issuer_id = k.issuer_id AND b.fact_key = k.fact_key AND b.kind = k.kind
  LEFT JOIN run3 c ON c.issuer_id = k.issuer_id AND c.fact_key = k.fact_key AND c.kind = k.kind)"""


def _register(spark, sf_dir):
    claims, rows = src.view(spark, sf_dir, src.CLAIMS), None
    for run, condition in _RUN.items():
        rows = conflicts.register(rows, conflicts.claim_conflicts(claims.where(condition)), run)
    return rows


@query(f"WITH {_REGISTER} SELECT *, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' ELSE 'open' END AS status FROM register")
def conflict_register(spark, sf_dir):
    rows = conflicts.status(_register(spark, sf_dir))
    return rows.select(*conflicts.KEY, "first_seen", "last_seen", "resolved_at", F.size("members").cast("long").alias("n_members"), "status")


@query(f"WITH {_REGISTER} SELECT issuer_id, fact_key, kind, last_seen FROM register WHERE resolved_at IS NULL")
def open_conflicts(spark, sf_dir):
    return conflicts.status(_register(spark, sf_dir), closed=False).select(*conflicts.KEY, "last_seen")


@query(f"""
WITH claims AS ({_C}),
facts AS (SELECT issuer_id, fact_key, bool_or(basis = 'agency_adjusted') AND bool_or(basis <> 'agency_adjusted') AS mixed FROM claims WHERE coalesce(CAST(value AS VARCHAR), {_NORM('value_text')}) IS NOT NULL
          GROUP BY ALL HAVING count(DISTINCT document_id) > 1 AND count(DISTINCT source_name) > 1)
SELECT issuer_id, fact_key, CASE split_part(fact_key, '|', 1) WHEN 'rated_amount' THEN '{reconcile.EXCLUDED[0][1]}' WHEN 'instrument' THEN '{reconcile.EXCLUDED[1][1]}' WHEN 'rating_history' THEN '{reconcile.EXCLUDED[2][1].replace("'", "''")}' ELSE '{reconcile.MIXED}' END AS reason
FROM facts WHERE mixed OR NOT {_KEPT}""")
def excluded_keys(spark, sf_dir):
    return reconcile.excluded_keys(src.view(spark, sf_dir, src.CLAIMS))


_GROUPED = "issuer_id, instrument_class, term, aspect, a_agency, b_agency, a_value, b_value, run"
_KEYED = "'rating_' || aspect || '|' || instrument_class || '|' || term || '|' || a_agency || '~' || b_agency || '|' || s"
_FLAGS = f"""{_RUNS},
spans AS (SELECT {_GROUPED}, min(s) AS s, nullif(max(coalesce(e, DATE '9999-12-31')), DATE '9999-12-31') AS e FROM numbered GROUP BY {_GROUPED}),
held_by AS (
  SELECT DISTINCT n.issuer_id, {_KEYED.replace('|| s', '|| x.s')} AS fact_key, n.instrument_class, n.term, n.a_agency, n.b_agency, x.s, x.e, unnest([a_claim_id, b_claim_id]) AS claim_id
  FROM numbered n JOIN spans x USING ({_GROUPED})),
{_GAPS},
inside AS (SELECT *, unnest(evidence) AS claim_id FROM gaps WHERE scope = 'within_corpus')"""
_FLAGS = _FLAGS.replace("aspect || '|' || instrument_class || '|' || term || '|' || a_agency || '~' || b_agency", "n.aspect || '|' || n.instrument_class || '|' || n.term || '|' || n.a_agency || '~' || n.b_agency", 1)


def _kept(df, name):
    """df, worked out once, as plain files in the shared folder. Its joins are merges: the files are many times smaller than the rows in them."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


@query(f"""
WITH {_FLAGS},
hit AS (
  SELECT h.issuer_id, h.fact_key, bool_or(g.changes_view) AS material FROM held_by h JOIN inside g ON g.issuer_id = h.issuer_id AND g.instrument_class = h.instrument_class AND g.term = h.term AND g.agency IN (h.a_agency, h.b_agency)
  AND ((g.action_date >= h.s AND (h.e IS NULL OR g.action_date <= h.e)) OR g.claim_id = h.claim_id) GROUP BY ALL)
SELECT h.issuer_id, h.fact_key, bool_or(c.provenance = 'history_annexure') OR count(hit.material) > 0 AS incomplete, coalesce(bool_or(hit.material), false) AS material
FROM held_by h JOIN actions c USING (claim_id) LEFT JOIN hit ON hit.issuer_id = h.issuer_id AND hit.fact_key = h.fact_key GROUP BY h.issuer_id, h.fact_key""")
def rating_conflict_flags(spark, sf_dir):
    actions = src.view(spark, sf_dir, src.ACTIONS)
    found = conflicts.rating_conflicts(conflicts.rating_runs(timeline.concurrent(timeline.states(actions))))
    # both are looked at several times: what is asked of them is worked out once
    runs = _kept(found.select("issuer_id", "fact_key", "instrument_class", "term", "a_agency", "b_agency", "start", "ended_on", "members"), "runs")
    missing = _kept(conflicts.found_gaps(actions).where("scope = 'within_corpus'").select(*timeline.LINE, "action_date", "scope", "changes_view", "evidence"), "gaps")
    told = conflicts.completeness(runs, actions.where("provenance = 'history_annexure'"), missing)
    return told.select("issuer_id", "fact_key", "incomplete", "material").distinct()


_WINDOW = "'from ' || s || CASE WHEN e IS NULL THEN ' (still in force)' ELSE ' to ' || e END"


@query(f"""
WITH {_RUNS},
spans AS (SELECT {_GROUPED}, min(s) AS s, nullif(max(coalesce(e, DATE '9999-12-31')), DATE '9999-12-31') AS e FROM numbered GROUP BY {_GROUPED}),
firsts AS (SELECT {_GROUPED}, a_said, a_instrument, b_said, b_instrument, row_number() OVER (PARTITION BY {_GROUPED} ORDER BY s, a_said, a_instrument, b_said, b_instrument) AS n FROM numbered)
SELECT issuer_id, {_KEYED} AS fact_key, CASE term WHEN 'long_term' THEN 'Long-term ' ELSE 'Short-term ' END || aspect || ' on ' || CASE instrument_class WHEN 'ncd' THEN 'non-convertible debentures' WHEN 'bank_facility' THEN 'bank facilities' ELSE 'commercial paper' END || ', ' || {_WINDOW} AS subject,
       a_agency || ' says ' || a_said || ' (' || a_instrument || ') · ' || b_agency || ' says ' || b_said || ' (' || b_instrument || ') — both in force ' || {_WINDOW} AS note, e AS ended_on
FROM spans JOIN firsts USING ({_GROUPED}) WHERE n = 1""", dates=("ended_on",))
def rating_conflict_notes(spark, sf_dir):
    found = conflicts.rating_conflicts(conflicts.rating_runs(timeline.concurrent(timeline.states(src.view(spark, sf_dir, src.ACTIONS)))))
    return found.select("issuer_id", "fact_key", "subject", "note", "ended_on")


@query(f"""
WITH {_RUNS}, spans AS (SELECT {_GROUPED}, min(s) AS s FROM numbered GROUP BY {_GROUPED})
SELECT DISTINCT issuer_id, 'rating_' || aspect AS aspect, instrument_class, term, a_agency AS agency_a, b_agency AS agency_b, s AS since FROM spans""", dates=("since",))
def rating_conflict_keys(spark, sf_dir):
    found = conflicts.rating_conflicts(conflicts.rating_runs(timeline.concurrent(timeline.states(src.view(spark, sf_dir, src.ACTIONS)))))
    return conflicts.key_parts(found.select("issuer_id", "fact_key")).drop("fact_key").distinct()


_HELD = {"run1": "published % 3 = 0", "run2": "true"}
_GAP_KEY = ["issuer_id", "agency", "instrument_class", "term", "action_date", "grade"]


@query(f"""
WITH one AS (WITH actions AS (SELECT * FROM ({_A}) WHERE provenance = 'history_annexure' OR {_HELD['run1']}), {_GAPS} SELECT * FROM gaps),
two AS (WITH actions AS ({_A}), {_GAPS} SELECT * FROM gaps)
SELECT {', '.join(f'coalesce(b.{c}, a.{c}) AS {c}' for c in _GAP_KEY)}, coalesce(b.scope, a.scope) AS scope, CASE WHEN b.scope IS NULL THEN a.changes_view ELSE b.changes_view END AS changes_view,
       CASE WHEN a.scope IS NULL THEN 'run2' ELSE 'run1' END AS first_seen, CASE WHEN b.scope IS NULL THEN 'run1' ELSE 'run2' END AS last_seen, CASE WHEN b.scope IS NULL THEN 'run2' END AS resolved_at
FROM one a FULL OUTER JOIN two b ON {' AND '.join(f'a.{c} = b.{c}' for c in _GAP_KEY)}""", dates=("action_date",))
def gap_register(spark, sf_dir):
    actions, rows = src.view(spark, sf_dir, src.ACTIONS), None
    for run, condition in _HELD.items():
        rows = conflicts.gap_register(rows, conflicts.found_gaps(actions.where(f"provenance = 'history_annexure' OR {condition}")), run)
    return rows.drop("evidence")


@query(f"""
WITH actions AS ({_A}), {_GAPS},
shown AS (SELECT *, unnest(evidence) AS claim_id FROM gaps WHERE scope = 'within_corpus'),
best AS (SELECT s.*, row_number() OVER (PARTITION BY s.issuer_id, s.agency, s.instrument_class, s.term, s.action_date, s.grade ORDER BY a.published DESC NULLS LAST, a.instrument, s.claim_id) AS n FROM shown s JOIN actions a USING (claim_id))
SELECT issuer_id, agency, instrument_class, term, action_date, nullif(grade, '') AS grade, changes_view, claim_id FROM best WHERE n = 1""", dates=("action_date",))
def open_gaps(spark, sf_dir):
    actions = src.view(spark, sf_dir, src.ACTIONS)
    rows = conflicts.gap_register(None, conflicts.found_gaps(actions), "run1")
    return conflicts.open_gaps(rows, actions.select("claim_id", "published", F.col("instrument").alias("fact_key")))


@query(f"""
WITH {_STATES} SELECT issuer_id, instrument_class, term, agency, instrument, grade, effective_from, effective_to, claim_id, withdrawn, provenance, end_basis, effective_to IS NULL AS current FROM states""", dates=("effective_from", "effective_to"))
def rating_timeline(spark, sf_dir):
    states = timeline.states(src.view(spark, sf_dir, src.ACTIONS))
    return states.select(*timeline.SHARED, "agency", "instrument", "grade", "effective_from", "effective_to", "claim_id", "withdrawn", "provenance", "end_basis", F.col("effective_to").isNull().alias("current"))


_SAID = """
CASE WHEN v = [] THEN CASE WHEN grade IS NULL THEN 'no action stated' ELSE 'rated ' || grade || coalesce('/' || outlook, '') END
     WHEN list_contains(v, 'downgraded') THEN array_to_string(list_filter(['downgraded to ' || coalesce(grade, 'None') || coalesce(' from ' || previous, ''), 'removed from watch', outlook || ' outlook assigned'], lambda x: x IS NOT NULL), ', ')
     WHEN list_contains(v, 'upgraded') THEN 'upgraded to ' || coalesce(grade, 'None') || coalesce(' from ' || previous, '')
     WHEN v = ['reaffirmed', 'withdrawn'] THEN coalesce('reaffirmed at ' || grade, 'reaffirmed') || ', withdrawn'
     WHEN v = ['revised'] THEN CASE WHEN watch IS NOT NULL THEN 'watch revised to ' || regexp_replace(lower(watch), '^watch with ', '') || coalesce('/' || outlook, '') ELSE coalesce('outlook revised to ' || outlook, 'revised') END
     ELSE CASE v[1] WHEN 'reaffirmed' THEN coalesce('reaffirmed at ' || grade, 'reaffirmed') WHEN 'assigned' THEN coalesce('assigned ' || grade, 'assigned') ELSE coalesce('placed on ' || lower(watch), 'placed on') END || coalesce('/' || outlook, '') END"""


@query(f"""
WITH {_STATES}, told AS (SELECT *, CASE WHEN action IS NULL THEN [] ELSE string_split(action, '; ') END AS v FROM actions)
SELECT t.claim_id, t.agency, CASE WHEN t.instrument LIKE 'Long Term%' THEN 'Long Term Instruments (' || CASE t.instrument_class WHEN 'ncd' THEN 'debentures' WHEN 'bank_facility' THEN 'bank facilities' ELSE 'commercial paper' END || ')' ELSE t.instrument END AS display_name,
       {_SAID.replace('grade', 't.grade').replace('downt.grade', 'downgrade').replace('upt.grade', 'upgrade').replace('outlook ||', 't.outlook ||').replace("|| outlook", "|| t.outlook").replace('watch IS', 't.watch IS').replace('lower(watch)', 'lower(t.watch)')} AS action_text, s.effective_from, s.effective_to, s.end_basis
FROM told t LEFT JOIN states s USING (claim_id) WHERE t.provenance = 'primary_rationale'""", dates=("effective_from", "effective_to"))
def ratings_view(spark, sf_dir):
    actions = src.view(spark, sf_dir, src.ACTIONS)
    windows = timeline.states(actions).select("claim_id", "effective_from", "effective_to", "end_basis")
    shown = actions.where("provenance = 'primary_rationale'").join(windows, "claim_id", "left")
    sentence = reading.action_sentence(*[F.col(c) for c in ("action", "grade", "outlook", "watch", "previous")])
    return shown.select("claim_id", "agency", reading.named_instrument(F.col("instrument"), F.col("instrument_class")).alias("display_name"), sentence.alias("action_text"), "effective_from", "effective_to", "end_basis")


@query(f"""
WITH d AS ({ORACLES["report_diff"]}), r AS (SELECT DISTINCT agency_id, report, report % 3 <> 0 AS complete FROM ({src.duck(src.REPORTS)}))
SELECT d.agency_id, from_report, to_report, item, direction, CASE WHEN direction = 'added' AND NOT o.complete OR direction = 'removed' AND NOT n.complete THEN 'unconfirmed' ELSE 'confirmed' END AS certainty
FROM d JOIN r o ON o.agency_id = d.agency_id AND o.report = from_report JOIN r n ON n.agency_id = d.agency_id AND n.report = to_report""")
def changes_feed(spark, sf_dir):
    reports = src.view(spark, sf_dir, src.REPORTS)
    read = reports.select("agency_id", "report", (F.col("report") % 3 != 0).alias("complete")).distinct()
    return reconcile.certain(reconcile.report_diff(reports), read).select("agency_id", "from_report", "to_report", "item", "direction", "certainty")


_S, _R = src.duck(src.STATEMENTS), src.duck(src.STATED_ROWS)
_COVERED = f"""
s AS ({_S}), t AS ({_R}),
eod AS (SELECT account_key, txn_date, arg_max(balance, seq) AS eod FROM t WHERE balance IS NOT NULL GROUP BY ALL),
firsts AS (SELECT account_key, arg_min(opening, period_start) AS opening, min(period_start) AS since FROM s GROUP BY 1 HAVING account_key IN (SELECT account_key FROM eod)),
cover AS (SELECT DISTINCT account_key, CAST(unnest(generate_series(period_start, period_end, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
begun AS (SELECT account_key, period_start, min(opening) AS opening FROM s GROUP BY ALL),
stated AS (
  SELECT c.account_key, c.day, true AS covered, coalesce(e.eod, CASE WHEN p.day IS NULL THEN CASE WHEN c.day = f.since THEN f.opening ELSE b.opening END END) AS stated
  FROM cover c JOIN firsts f USING (account_key) LEFT JOIN cover p ON p.account_key = c.account_key AND p.day = c.day - 1 LEFT JOIN eod e ON e.account_key = c.account_key AND e.txn_date = c.day
  LEFT JOIN begun b ON b.account_key = c.account_key AND b.period_start = c.day
  UNION ALL SELECT e.account_key, e.txn_date, false, e.eod FROM eod e JOIN firsts f USING (account_key) LEFT JOIN cover c ON c.account_key = e.account_key AND c.day = e.txn_date WHERE e.txn_date >= f.since AND c.day IS NULL),
daily AS (
  SELECT account_key, day, balance FROM (SELECT *, last_value(stated IGNORE NULLS) OVER (PARTITION BY account_key ORDER BY day ROWS UNBOUNDED PRECEDING) AS balance FROM stated) x WHERE covered),
months AS (SELECT account_key, strftime(day, '%Y-%m') AS month, count(*) AS days, round_even(avg(balance), 2) AS average, min(balance) AS lowest, count(*) FILTER (WHERE balance < 0) AS negative_days FROM daily GROUP BY ALL)"""


#: Customers whose statements and rows one task makes and reads.
ACCOUNTS = ("customer", "c_custkey", 25_000)


def _stated_rows(spark, sf_dir):
    return src.view(spark, sf_dir, src.STATED_ROWS, ACCOUNTS)


def _daily(spark, sf_dir):
    return ledger.covered_balances(_stated_rows(spark, sf_dir), src.view(spark, sf_dir, src.STATEMENTS, ACCOUNTS))


@query(f"WITH {_COVERED} SELECT account_key, day AS txn_date, balance FROM daily", dates=("txn_date",))
def covered_balances(spark, sf_dir):
    return _daily(spark, sf_dir)


@query(f"WITH {_COVERED} SELECT account_key, round_even(sum(CAST(round(average * 100) AS BIGINT)) FILTER (WHERE days >= 20) * 1.0 / count(*) FILTER (WHERE days >= 20), 0) / 100 AS average FROM months GROUP BY account_key")
def average_balances(spark, sf_dir):
    return ledger.average_balances(ledger.balance_months(_daily(spark, sf_dir)))


_RETURN = r"regexp_matches(narration, '\b(RETURN|RTN|RET|BOUNCE|BOUNCED|DISHONOU?R|INSUFFICIENT|UNPAID|REJECT(ED)?)\b')"
_CASH = r"regexp_matches(narration, '\b(CASH DEP|CASH DEPOSIT|BY CASH|CDM|CASH-DEP|CSH DEP)\b')"
_OWN = r"regexp_matches(narration, '\b(SELF|OWN A/?C|TRF TO SB|TRF FROM SB|SWEEP)\b')"
_OUT = r"regexp_matches(narration, '\b(ATM|ATW|NWD|CASH WDL|CASH WITHDRAWAL|CASH-WDL|SELF CHQ|CSH WDL)\b')"
_BACK = rf"({_RETURN} AND (credit > 0 OR NOT (regexp_matches(narration, '\b(CHG|CHGS|CHARGES?|PENALTY|FEE)\b') AND NOT regexp_matches(narration, '\b(ECS|NACH|ACH|CHQ|CHEQUE)\b'))))"


@query(f"""
WITH {_COVERED},
moved AS (
  SELECT account_key, strftime(txn_date, '%Y-%m') AS month, sum(credit) AS credits, count(*) FILTER (WHERE credit > 0) AS n_credits, sum(debit) AS debits, count(*) FILTER (WHERE debit > 0) AS n_debits,
         coalesce(sum(credit) FILTER (WHERE NOT {_RETURN} AND ({_CASH} OR NOT {_OWN})), 0) AS business_credits, coalesce(sum(credit) FILTER (WHERE NOT {_RETURN} AND {_CASH}), 0) AS cash_in,
         coalesce(sum(debit) FILTER (WHERE NOT {_BACK} AND {_OUT}), 0) AS cash_out, coalesce(string_agg(CAST(txn_id AS VARCHAR), ',' ORDER BY txn_id) FILTER (WHERE {_BACK}), '') AS return_ids
  FROM t GROUP BY ALL)
SELECT account_key, month, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('credits', 'n_credits', 'debits', 'n_debits', 'business_credits', 'cash_in', 'cash_out', 'days', 'negative_days'))}, average, lowest, coalesce(return_ids, '') AS return_ids
FROM moved FULL OUTER JOIN months USING (account_key, month)""")
def business_months(spark, sf_dir):
    rows = ledger.business_months(_stated_rows(spark, sf_dir), _daily(spark, sf_dir))
    return rows.withColumn("return_ids", F.array_join("return_ids", ","))


@query(f"""
WITH s AS ({_S}), t AS ({_R}), g AS ({ORACLES["statement_gaps"]}),
d AS (SELECT *, document_id <> first_value(document_id) OVER (PARTITION BY account_key, txn_date, debit, credit, balance, {_NORM('narration')} ORDER BY document_id, seq, txn_id) AS duplicate FROM t)
SELECT account_key, n_statements, first_day, last_day, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_overlaps, 0) AS n_overlaps, unique_rows, duplicate_rows, total_credits, total_debits
FROM (SELECT account_key, count(*) AS n_statements, min(period_start) AS first_day, max(period_end) AS last_day FROM s GROUP BY 1)
LEFT JOIN (SELECT account_key, count(*) FILTER (WHERE kind = 'gap') AS n_gaps, count(*) FILTER (WHERE kind = 'overlap') AS n_overlaps FROM g GROUP BY 1) USING (account_key)
LEFT JOIN (SELECT account_key, count(*) FILTER (WHERE NOT duplicate) AS unique_rows, count(*) FILTER (WHERE duplicate) AS duplicate_rows, CAST(coalesce(sum(credit) FILTER (WHERE NOT duplicate), 0) AS BIGINT) AS total_credits,
                  CAST(coalesce(sum(debit) FILTER (WHERE NOT duplicate), 0) AS BIGINT) AS total_debits FROM d GROUP BY 1) USING (account_key)""", dates=("first_day", "last_day"))
def statement_accounts(spark, sf_dir):
    return ledger.accounts(ledger.mark_duplicates(src.view(spark, sf_dir, src.STATED_ROWS)), src.view(spark, sf_dir, src.STATEMENTS))


@query(f"""
WITH s AS ({_S}), t AS (SELECT r.*, s.opening, coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY r.document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.opening) AS previous FROM ({_R}) r LEFT JOIN s USING (document_id))
SELECT txn_id, document_id, previous, balance, previous + credit - debit - balance AS off_by FROM t WHERE balance IS NOT NULL AND previous IS NOT NULL AND previous + credit - debit - balance <> 0""")
def statement_breaks(spark, sf_dir):
    found = ledger.balance_breaks(src.view(spark, sf_dir, src.STATED_ROWS), src.view(spark, sf_dir, src.STATEMENTS))
    return found.select("txn_id", "document_id", "previous", "balance", "off_by")


@query(f"""
WITH s AS ({_S}), t AS ({_R}), sums AS (SELECT document_id, count(*) AS n_rows, CAST(sum(debit) AS BIGINT) AS debits, CAST(sum(credit) AS BIGINT) AS credits, arg_max(balance, seq) AS closing FROM t GROUP BY 1)
SELECT document_id, n_rows, opening, closing, opening + credits - debits AS expected, closing - (opening + credits - debits) AS difference, CASE WHEN closing - (opening + credits - debits) = 0 THEN 'reconciles' WHEN closing - (opening + credits - debits) <> 0 THEN 'differs' END AS status FROM sums JOIN s USING (document_id)""")
def statement_reconciliation(spark, sf_dir):
    return ledger.reconciliation(src.view(spark, sf_dir, src.STATED_ROWS), src.view(spark, sf_dir, src.STATEMENTS))


@query(f"""
WITH c AS ({_C}), a AS (SELECT claim_id FROM c WHERE claim_id % 97 <> 0) SELECT c.claim_id, c.document_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.claim_id = c.claim_id)""")
def unanchored_claims(spark, sf_dir):
    claims = src.view(spark, sf_dir, src.CLAIMS)
    return evidence.unanchored(claims, claims.where("claim_id % 97 <> 0").select("claim_id")).select("claim_id", "document_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 7 <> 0 AS intact FROM documents")
def stored_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    told = F.when(F.col("doc_id") % 7 != 0, F.sha2("bytes", 256)).otherwise("0")
    return evidence.rehashed(docs.withColumn("sha256", told)).select("doc_id", F.sha2("bytes", 256).alias("sha256"), "intact")


@query(f"""
WITH d AS (SELECT issuer_id, document_id, value_text, count(*) AS n FROM ({_C}) WHERE value_text IS NOT NULL GROUP BY ALL)
SELECT issuer_id, document_id, value_text AS stated FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, document_id ORDER BY n DESC, value_text DESC) AS k FROM d) WHERE k = 1""")
def most_stated(spark, sf_dir):
    return evidence.most_stated(src.view(spark, sf_dir, src.CLAIMS), ["issuer_id", "document_id"], "value_text").withColumnRenamed("value_text", "stated")
