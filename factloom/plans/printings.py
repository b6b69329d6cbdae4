"""Registered queries of the readers of printed tables, over pages that are printed from the test tables' rows.

The twins state the rows that were printed, so what is compared is whether the reader gets them back from the boxes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import bureau, columns, histories, pages, particulars, rationales, statements, summaries
from factloom.plans.catalog import ORACLES, QUERIES, query
from factloom.sources import driver_tables as src
from factloom.sources import printed
from factloom.streaming.activity import workspace

__all__ = ["ORACLES", "QUERIES"]

_P = src.duck(src.PRINTED)
_READ = f"""
read AS (
  SELECT *, CASE WHEN unmarked AND debit + credit > 0 THEN 'an amount without a Dr/Cr marker; not read' WHEN debit + credit = 0 THEN 'no withdrawal or deposit amount; not read' END AS issue FROM ({_P})),
numbered AS (SELECT *, CASE WHEN issue IS NULL THEN CAST(count(*) FILTER (WHERE issue IS NULL) OVER (PARTITION BY document_id ORDER BY n) AS BIGINT) END AS seq FROM read)"""


#: Rows of a table whose pages one task prints and reads: what a row prints is bounded, so a task's memory is too, however large the table.
CUSTOMERS, ORDERS = 5_000, 40_000
#: The tables' columns that the printed views call document_id.
KEYS = {"customer": "c_custkey", "orders": "o_custkey"}


_tasks = src.tasks


def _dealt(spark, sf_dir, view, table: str = "customer", rows: int = CUSTOMERS):
    """The view's rows, a document's in one task: numbering, printing and reading them is then done where they are.

    The table's rows are dealt, not the view's: a view that numbers them would shuffle them before, into tasks that grow with the table.
    """
    return src.view(spark, sf_dir, view, (table, KEYS[table], rows), "document_id")


def _written(df, name, tasks: int, dealt: bool = False):
    """df, worked out once for readers that look at it several times: written into the shared folder in buckets of documents, so that no reader has to shuffle it.

    Its joins are merges: the files are many times smaller than the rows in them, and by the files' size the driver would
    gather and broadcast them. dealt: its tasks hold a bucket's documents each already, which the plan does not know behind Python.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows = df if dealt else df.repartition(tasks, "document_id")
    rows.write.bucketBy(tasks, "document_id").sortBy("document_id").option("path", path).saveAsTable(table)
    return spark.table(table).hint("merge")


def _kept(df, name):
    """df, worked out once, as plain files in the shared folder."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _words(spark, sf_dir):
    return printed.statement_words(_dealt(spark, sf_dir, src.PRINTED, "orders", ORDERS))


def _cents(c: str):
    return (F.col(c) * 100).cast("long").alias(c)


@query(f"""
WITH {_READ}
SELECT document_id, seq, page_no, day AS txn_date, CASE WHEN NOT stacked THEN day END AS value_date, narration, CASE WHEN NOT stacked THEN ref END AS ref,
       CASE WHEN issue IS NULL AND debit > 0 THEN debit END AS debit, CASE WHEN issue IS NULL AND credit > 0 THEN credit END AS credit, balance, issue
FROM numbered""", dates=("txn_date", "value_date"))
def printed_statement_rows(spark, sf_dir):
    rows = statements.statement_rows(_words(spark, sf_dir))
    return rows.select("document_id", "seq", "page_no", "txn_date", "value_date", "narration", "ref", *map(_cents, ("debit", "credit", "balance")), "issue")


@query(f"""
WITH {_READ}, kept AS (SELECT * FROM numbered WHERE seq IS NOT NULL),
firsts AS (SELECT document_id, balance - credit + debit AS first FROM kept WHERE seq = 1),
stated AS (SELECT document_id, 5000000 AS opening, 5000000 + sum(credit - debit) AS closing FROM ({_P}) WHERE NOT stacked GROUP BY 1),
steps AS (
  SELECT k.*, coalesce(last_value(k.balance IGNORE NULLS) OVER (PARTITION BY k.document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.opening, f.first) AS before, coalesce(s.opening, f.first) AS opening, s.closing
  FROM kept k LEFT JOIN stated s USING (document_id) LEFT JOIN firsts f USING (document_id)),
sums AS (
  SELECT document_id, count(*) AS n_rows, CAST(sum(debit) AS BIGINT) AS total_debits, CAST(sum(credit) AS BIGINT) AS total_credits, count(*) FILTER (WHERE debit > 0) AS debit_count, count(*) FILTER (WHERE credit > 0) AS credit_count,
         max(opening) AS opening_balance, CAST(coalesce(max(closing), arg_max_null(balance, seq)) AS BIGINT) AS closing_balance, count(balance) AS running_rows, count(*) FILTER (WHERE balance IS NOT NULL AND before + credit - debit <> balance) AS n_breaks, bool_or(NOT stacked) AS stated
  FROM steps GROUP BY document_id)
SELECT document_id, n_rows, total_debits, total_credits, debit_count, credit_count, opening_balance, closing_balance, CAST(closing_balance - opening_balance - total_credits + total_debits AS BIGINT) AS difference, running_rows, n_breaks, stated FROM sums""")
def printed_statement_checks(spark, sf_dir):
    told = statements.statement_checks(statements.statement_rows(_words(spark, sf_dir), summed=True))
    amounts = ("total_debits", "total_credits", "opening_balance", "closing_balance", "difference")
    return told.select("document_id", "n_rows", "debit_count", "credit_count", *map(_cents, amounts), "running_rows", "n_breaks", F.col("opening_stated").alias("stated"))


_H = src.duck(src.HISTORY_CELLS)
_TOLD = f"""
told AS (
  SELECT *, CASE WHEN starts_with(said, '[ICRA]') THEN regexp_extract(said, '\\](\\S+)', 1) WHEN starts_with(said, 'CARE') THEN 'A' END AS grade, said = 'Withdrawn' AS withdrawn, CASE WHEN contains(said, 'Stable') THEN 'Stable' WHEN contains(said, 'Negative') THEN 'Negative' END AS outlook,
         CASE WHEN contains(said, 'RWD') THEN 'Watch with Developing Implications' END AS watch, said <> 'not rated here' AS readable, CASE row_no WHEN 1 THEN 'ncd' WHEN 2 THEN 'commercial_paper' ELSE 'bank_facility' END AS class
  FROM ({_H}) WHERE said <> '-')"""


def _history(spark, sf_dir):
    lines = printed.history_lines(_dealt(spark, sf_dir, src.HISTORY_CELLS))
    table = histories.table_lines(lines, "Rating history for past three years", ["Complexity level"])
    return _written(table, "history", _tasks(spark, sf_dir, "customer", CUSTOMERS), dealt=True)


@query(f"WITH {_TOLD} SELECT document_id, row_no, name, day AS action_date, said AS rating_text, grade, outlook, watch, withdrawn, readable FROM told", dates=("action_date",))
def rating_history_entries(spark, sf_dir):
    return histories.entries(_history(spark, sf_dir)).select("document_id", "row_no", "name", "action_date", "rating_text", "grade", "outlook", "watch", "withdrawn", "readable")


@query(f"""
WITH {_TOLD}, own AS (SELECT document_id, min(day) AS own_date FROM ({_H}) WHERE document_id % 4 = 0 GROUP BY 1)
SELECT document_id, class AS instrument_class, CASE WHEN class = 'commercial_paper' OR grade = 'A1+' THEN 'short_term' ELSE 'long_term' END AS term,
       'rating_history|agency|' || class || '|' || CASE WHEN class = 'commercial_paper' OR grade = 'A1+' THEN 'short_term' ELSE 'long_term' END || '|' || CAST(day AS VARCHAR) || '|' || lower(name) AS fact_key, said AS value_text
FROM told LEFT JOIN own USING (document_id) WHERE readable AND (own_date IS NULL OR day <> own_date)""")
def rating_history_claims(spark, sf_dir):
    cells = src.view(spark, sf_dir, src.HISTORY_CELLS)
    own = cells.where("document_id % 4 = 0").groupBy("document_id").agg(F.min("day").alias("own_date"))
    known = cells.select("document_id").distinct().join(own, "document_id", "left").withColumn("agency", F.lit("agency"))
    return histories.history_claims(histories.entries(_history(spark, sf_dir)), known).select("document_id", "instrument_class", "term", "fact_key", "value_text")


_R = src.duck(src.RATIONALES)


def _units(spark, sf_dir):
    units = pages.html_units(printed.rationale_pages(_dealt(spark, sf_dir, src.RATIONALES, "customer", CUSTOMERS)), "document_id", "html")
    tasks = _tasks(spark, sf_dir, "customer", CUSTOMERS)
    return _written(rationales.placed(units, counted=True), "units", tasks, dealt=True)


def _rationales(spark, sf_dir):
    units = _units(spark, sf_dir)
    return units, _written(rationales.shapes(rationales.grid_rows(units)), "grids", _tasks(spark, sf_dir, "customer", CUSTOMERS))


@query(f"""
WITH r AS ({_R})
SELECT document_id, 'bank' AS part, 'Bank Loan Facilities' AS instrument, 'bank_facility' AS instrument_class, CAST(amount AS DOUBLE) AS amount, 'AA' AS grade, 'Stable' AS outlook, NULL AS watch, 'reaffirmed' AS action, '' AS qualifiers, '' AS note, true AS readable FROM r
UNION ALL SELECT document_id, 'action', 'Non Convertible Debentures', 'ncd', amount + 1, CASE v WHEN 0 THEN 'AA' WHEN 1 THEN 'AA' WHEN 4 THEN 'AA-' END, CASE v WHEN 0 THEN 'Stable' WHEN 1 THEN 'Negative' END, CASE v WHEN 4 THEN 'Watch with Developing Implications' END,
       CASE v WHEN 0 THEN 'reaffirmed' WHEN 1 THEN 'downgraded' WHEN 3 THEN 'withdrawn' WHEN 4 THEN 'placed on' END, CASE v WHEN 1 THEN 'ppmld,legacy_r,' ELSE '' END || 'retail,secured', '', v <> 2 FROM r
UNION ALL SELECT document_id, 'action', 'Commercial Paper', 'commercial_paper', 8500, 'A1+', NULL, NULL, 'reaffirmed', '', '', true FROM r
UNION ALL SELECT document_id, 'annexure', 'Subordinated NCD', 'subordinated_debt', NULL, 'AA', 'Stable', NULL, NULL, 'interchangeable_subordinated', '|NA|7-365 days', true FROM r""")
def rationale_ratings(spark, sf_dir):
    rated = rationales.ratings(*_rationales(spark, sf_dir))
    return rated.select("document_id", "part", "instrument", "instrument_class", F.col("amount").cast("double").alias("amount"), "grade", "outlook", "watch", "action", F.array_join("qualifiers", ",").alias("qualifiers"), "note", "readable")


@query(f"""
SELECT document_id, 'INE' || document_id AS isin, 'NCD' AS instrument, '9.5' AS coupon, '2028-06-30' AS maturity_date, '30-Jun-28' AS due, CASE WHEN gap > 0 THEN CAST(amount + 2 AS DOUBLE) END AS amount, gap > 0 AS readable FROM ({_R})
UNION ALL SELECT document_id, 'NA', 'Subordinated NCD', 'NA', NULL, '7-365 days', 50.25, true FROM ({_R})""")
def rationale_instruments(spark, sf_dir):
    listed = rationales.instruments(_rationales(spark, sf_dir)[1])
    return listed.select("document_id", "isin", "instrument", "coupon", F.col("maturity_date").cast("string").alias("maturity_date"), "due", F.col("amount").cast("double").alias("amount"), "readable")


@query(f"""
WITH r AS ({_R})
SELECT document_id, 'Fund Based Facilities' AS instrument, 'long_term' AS term, day1 AS action_date, 'AA' AS grade, 'Stable' AS outlook, false AS withdrawn, true AS readable FROM r WHERE day1 <> published
UNION ALL SELECT document_id, 'Fund Based Facilities', 'long_term', day2, NULL, NULL, gap <> 1, gap <> 1 FROM r WHERE day2 <> published
UNION ALL SELECT document_id, 'Fund Based Facilities', 'short_term', day3, 'A1+', NULL, false, true FROM r WHERE day3 <> published""", dates=("action_date",))
def rationale_history(spark, sf_dir):
    units, rows = _rationales(spark, sf_dir)
    return rationales.history(rows, rationales.published(units)).select("document_id", "instrument", "term", "action_date", "grade", "outlook", "withdrawn", "readable")


@query(f"""
WITH r AS (SELECT * FROM ({_R}) WHERE gap <> 2)
SELECT document_id, 'consolidated' AS scope, 'total_assets' AS slug, '2025-12-31' AS as_of, CAST(assets AS DOUBLE) AS value, 'INR_CRORE' AS unit FROM r
UNION ALL SELECT document_id, 'consolidated', 'gearing', '2025-12-31', -1.2, 'TIMES' FROM r UNION ALL SELECT document_id, 'consolidated', 'gearing', '2025-03-31', 3.45, 'TIMES' FROM r
UNION ALL SELECT document_id, NULL, NULL, NULL, NULL, NULL FROM ({_R}) WHERE gap = 2
UNION ALL SELECT document_id, 'lender', 'Term Loan', 'State Bank of India', amount, NULL FROM ({_R})""")
def rationale_figures(spark, sf_dir):
    units, rows = _rationales(spark, sf_dir)
    measured = rationales.indicators(units, rows).select("document_id", "scope", "slug", F.col("as_of").cast("string").alias("as_of"), F.col("value").cast("double").alias("value"), "unit")
    lent = rationales.lenders(rows).select("document_id", F.lit("lender").alias("scope"), F.col("facility").alias("slug"), F.col("lender").alias("as_of"), F.col("amount").cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    return measured.unionByName(lent)


@query(f"""
SELECT document_id, unnest(['outlook', 'liquidity', 'liquidity_detail', 'driver', 'factors', 'factors', 'updated_on']) AS part, unnest(['', '', '', 'strengths', 'positive', 'negative', '']) AS key,
       unnest(['Stable', 'Strong', 'The company keeps liquid funds that cover its debt of the next quarter.', 'Comfortable capital', 'more profit', 'less', '2026-05-22']) AS value FROM ({_R})""")
def rationale_prose(spark, sf_dir):
    return rationales.prose(_units(spark, sf_dir)).select("document_id", "part", "key", "value")


@query(f"""
WITH r AS ({_R})
SELECT document_id, CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'incomplete' END AS status, array_to_string(missing, '; ') AS missing FROM (
  SELECT document_id, list_filter([CASE WHEN gap = 2 THEN 'indicators without an adjusted heading' END, CASE WHEN gap = 0 THEN 'no instrument' END, CASE WHEN v = 2 THEN 'no rating' END, CASE WHEN gap = 1 AND day2 <> published THEN 'unreadable history of Fund Based Facilities ' || day2 END, CASE WHEN v = 2 THEN 'unreadable rating of Non Convertible Debentures' END], lambda x: x IS NOT NULL) AS missing FROM r)""")
def rationale_coverage(spark, sf_dir):
    units, rows = _rationales(spark, sf_dir)
    told = rationales.coverage(units, rows, rationales.ratings(units, rows), rationales.instruments(rows), rationales.history(rows, rationales.published(units)), rationales.indicators(units, rows), rationales.prose(units))
    return told.select("document_id", "status", F.regexp_replace(F.array_join("missing", "; "), r" in the row of unit \d+", "").alias("missing"))


_RL = src.duck(src.RATED_LINES)


@query(f"""
WITH r AS (SELECT *, lag(v) OVER (PARTITION BY document_id ORDER BY row_no) AS before FROM ({_RL})),
-- an unrated row's lines stay in the label of the next rated one; six lines of them at most
runs AS (SELECT *, count(*) FILTER (WHERE v <> 0) OVER (PARTITION BY document_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM r),
said AS (
  SELECT *, CASE v WHEN 0 THEN ['Bank lines', format('{{:,}}', current) || '.00', 'not rated, assigned'] WHEN 1 THEN ['Non-convertible', 'debentures'] WHEN 2 THEN ['Commercial paper'] ELSE ['Bank lines'] END AS lines FROM runs),
labels AS (SELECT document_id, run, flatten(list(lines ORDER BY row_no)) AS lines, max(row_no) FILTER (WHERE v <> 0) AS row_no FROM said GROUP BY document_id, run)
SELECT r.document_id, array_to_string(l.lines[greatest(len(l.lines) - 5, 1):], ' ') AS label, CASE WHEN r.v <> 3 THEN previous END AS previous, current,
       CASE r.v WHEN 1 THEN '[ICRA]AA (Stable); reaffirmed, removed from watch and withdrawn' WHEN 2 THEN '[ICRA]A1+; reaffirmed' ELSE '[ICRA]AA (Stable); outlook Negative' END AS rating_text
FROM r JOIN labels l ON l.document_id = r.document_id AND l.row_no = r.row_no""")
def rated_amount_lines(spark, sf_dir):
    rows = summaries.rated_amounts(printed.rated_lines(_dealt(spark, sf_dir, src.RATED_LINES, "orders", ORDERS), listed=False))
    return rows.select("document_id", "label", F.col("previous_amount").cast("long").alias("previous"), F.col("current_amount").cast("long").alias("current"), "rating_text")


@query(f"""
SELECT document_id, CASE v WHEN 1 THEN 'Not placed' ELSE isin END AS isin, 'NCD Series II' AS name, CASE WHEN v <> 1 THEN issued END AS issuance, '9.50%' AS coupon, matures AS maturity_date, current AS amount
FROM ({_RL}) WHERE v IN (0, 1)""", dates=("issuance", "maturity_date"))
def listed_instrument_lines(spark, sf_dir):
    rows = summaries.listed_instruments(printed.rated_lines(_dealt(spark, sf_dir, src.RATED_LINES, "orders", ORDERS), listed=True))
    return rows.select("document_id", "isin", "name", "issuance", "coupon", "maturity_date", F.col("amount").cast("long").alias("amount"))


_LR = src.duck(src.LABEL_ROWS)


@query(f"""
WITH r AS ({_LR}),
classes AS (SELECT document_id, v, size, CASE v WHEN 4 THEN 'subordinated_debt' ELSE 'perpetual_debt' END AS class, CASE v WHEN 4 THEN 'Subordinated debt' ELSE 'Perpetual bonds' END AS name FROM r WHERE v IN (3, 4)),
fits AS (
  SELECT r.document_id, r.row_no, c.name, c.class FROM r JOIN classes c ON c.document_id = r.document_id AND c.v = 4 AND c.size = r.size WHERE r.v NOT IN (0, 3)
  UNION ALL SELECT r.document_id, r.row_no, c.name, c.class FROM r JOIN classes c ON c.document_id = r.document_id AND c.v = 3 WHERE r.v = 3),
single AS (SELECT document_id, row_no, min(name) AS name, min(class) AS class FROM fits GROUP BY ALL HAVING count(*) = 1)
SELECT r.document_id, r.row_no AS group_no, CASE WHEN v = 0 THEN 'Long Term Bank Facilities' ELSE 'Long Term Instruments' END AS label, CASE WHEN v <> 3 THEN size END AS amount, CASE v WHEN 1 THEN 'CARE AA; Stable' WHEN 3 THEN '-' ELSE 'CARE A' END AS rating_text,
       'Reaffirmed as before' AS action_text, s.name AS told_name, s.class AS told_class
FROM r LEFT JOIN single s USING (document_id, row_no)""")
def label_column_rows(spark, sf_dir):
    rows = _dealt(spark, sf_dir, src.LABEL_ROWS, "orders", ORDERS)
    table, annexure = (printed.label_lines(rows, a) for a in (False, True))
    # both are looked at several times: read once, the lines are not printed and sorted again for each
    tasks = _tasks(spark, sf_dir, "orders", ORDERS)
    told = columns.told_by_size(_written(columns.rated_rows(table), "rated", tasks), _written(columns.sized_names(annexure), "sized", tasks))
    return told.select("document_id", F.col("group_no").cast("int").alias("group_no"), "label", F.col("amount").cast("long").alias("amount"), "rating_text", "action_text", "told_name", "told_class")


@query(f"""
WITH s AS (SELECT * FROM ({src.duck(src.SIGHTS)}) WHERE value IS NOT NULL),
accounts AS (SELECT document_id, batch, seq, min(value) FILTER (WHERE field = 'account_number') AS number, min(value) FILTER (WHERE field = 'lender') AS lender FROM s GROUP BY ALL),
keyed AS (SELECT *, CASE WHEN number IS NULL THEN 'alone' || batch || ':' || seq ELSE lower(lender) || '|' || right(number, 4) END AS same FROM accounts),
seen AS (SELECT *, first_value(batch) OVER w AS b, first_value(seq) OVER w AS q, count(*) OVER (PARTITION BY document_id, same) AS sights FROM keyed WINDOW w AS (PARTITION BY document_id, same ORDER BY batch, seq)),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY b, q) AS account_no FROM seen),
told AS (SELECT n.document_id, n.account_no, n.sights, s.batch, s.seq, s.field, s.value, first_value(s.value) OVER (PARTITION BY n.document_id, n.account_no, s.field ORDER BY s.batch, s.seq) AS kept FROM s JOIN numbered n USING (document_id, batch, seq))
SELECT document_id, account_no, field, max(kept) AS value, arg_min(value, batch * 100000000 + seq) FILTER (WHERE value <> kept) AS conflict, CAST(max(sights) AS INTEGER) AS sights FROM told GROUP BY document_id, account_no, field""")
def merged_bureau_accounts(spark, sf_dir):
    return bureau.merged_accounts(src.view(spark, sf_dir, src.SIGHTS)).withColumn("account_no", F.col("account_no").cast("long"))


@query(f"""
SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY row_no) AS nth, label, amount, rating_text, previous_text, grade, action FROM (
  SELECT *, CASE v WHEN 0 THEN 'NCDs Public Issue' WHEN 1 THEN 'Commercial Paper' ELSE 'Secured NCD' END AS label, CASE v WHEN 0 THEN 'BWR AA+ Reaffirmed and removed Rating Watch with Negative Implications' WHEN 1 THEN 'BWR A1+ Reaffirmed' ELSE 'BWR A Assignment' END AS rating_text,
         CASE WHEN v <> 1 THEN 'BWR AA' END AS previous_text, CASE v WHEN 0 THEN 'AA+' WHEN 1 THEN 'A1+' ELSE 'A' END AS grade, CASE v WHEN 0 THEN 'reaffirmed; removed' WHEN 1 THEN 'reaffirmed' ELSE 'assigned' END AS action
  FROM ({src.duck(src.PARTICULARS)}) WHERE v <> 2) r""")
def printed_particulars(spark, sf_dir):
    read = particulars.rated_particulars(printed.particulars_words(_dealt(spark, sf_dir, src.PARTICULARS))).where("readable")
    nth = F.dense_rank().over(Window.partitionBy("document_id").orderBy("row_no")).cast("long").alias("nth")
    return read.select("document_id", nth, "label", F.col("amount").cast("long").alias("amount"), "rating_text", "previous_text", "grade", "action")


@query(f"""
WITH r AS (SELECT *, CASE row_no WHEN 1 THEN 'NCDs' WHEN 2 THEN 'Secured NCD' ELSE 'Bank Loan' END AS said FROM ({src.duck(src.DATED_CELLS)}))
SELECT document_id, row_no, said AS name, DATE '2025-09-15' AS action_date, 'BWR AA+' AS rating_text, 'AA+' AS grade, NULL AS outlook, false AS withdrawn, 'read' AS status FROM r
UNION ALL SELECT document_id, row_no, said, CASE WHEN NOT undated THEN day END, CASE WHEN undated THEN 'Withdrawn' ELSE 'BWR AA (Stable) ' || strftime(day, '%-d %b %Y') END, CASE WHEN NOT undated THEN 'AA' END, CASE WHEN NOT undated THEN 'Stable' END, undated, CASE WHEN undated THEN 'undated' ELSE 'read' END FROM r
UNION ALL SELECT document_id, row_no, said, earlier, 'BWR A+ (' || strftime(earlier, '%d.%m.%Y') || ')', 'A+', NULL, false, 'read' FROM r
UNION ALL SELECT document_id, row_no, said, DATE '2023-05-03', 'BWR said 3 May 2023', NULL, NULL, false, 'unreadable' FROM r WHERE unreadable""", dates=("action_date",))
def dated_history_entries(spark, sf_dir):
    lines = printed.dated_lines(src.view(spark, sf_dir, src.DATED_CELLS))
    table = _kept(histories.table_lines(lines, "Rating History", ["The end"]), "dated")
    return particulars.dated_entries(table).select("document_id", F.col("row_no").cast("int").alias("row_no"), "name", "action_date", "rating_text", "grade", "outlook", "withdrawn", "status")


@query(f"""
SELECT document_id, page_no, CASE WHEN n % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS basis, unnest(['FY23', 'FY24', 'Q1FY25']) AS period, unnest([DATE '2023-03-31', DATE '2024-03-31', DATE '2024-06-30']) AS as_of, unnest([30000 + n, 40000 + n, 50000]) AS amount
FROM ({src.duck(src.DEBT_PAGES)}) WHERE n % 5 <> 0 AND n % 3 <> 0
UNION ALL SELECT document_id, page_no, CASE WHEN n % 2 = 0 THEN 'consolidated' ELSE 'standalone' END, unnest(['FY23', 'Q1FY25']), unnest([DATE '2023-03-31', DATE '2024-06-30']), unnest([30000 + n, 50000]) FROM ({src.duck(src.DEBT_PAGES)}) WHERE n % 5 <> 0 AND n % 3 = 0""", dates=("as_of",))
def debt_under_periods(spark, sf_dir):
    return particulars.total_debt(src.view(spark, sf_dir, src.DEBT_PAGES)).select("document_id", "page_no", "basis", "period", "as_of", F.col("amount").cast("long").alias("amount"))
