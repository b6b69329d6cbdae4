"""Tables by their label column, names told by size, and credit reports read in batches."""

from decimal import Decimal as D

from factloom.operators import bureau, columns

LINES = "document_id long, page_no int, line_no int, text string, start int, stop int, x0 double"


def lines(spark, *pages):
    rows = []
    for document, page, cells in pages:
        at = 0
        for n, (said, x) in enumerate(cells):
            rows.append((document, page, n, said, at, at + len(said), float(x)))
            at += len(said) + 1
    return spark.createDataFrame(rows, LINES).repartition(4)


TABLE = [
    ("Facilities/Instruments", 12), ("Amount (₹", 200), ("crore)", 200), ("Rating1", 300), ("Rating Action", 400), ("stray", 90),
    ("Long Term Bank", 10), ("Facilities", 11), ("1,000.00", 200), ("CARE AA", 300), ("(RWN)", 300), ("Placed on Rating Watch with", 400), ("Negative", 400), ("Implications", 400),
    ("Long Term Long Term", 10), ("Instruments", 10), ("250.00", 200), ("CARE AA-;", 300), ("Stable", 300), ("Revised from CARE AA", 400),
    ("Short Term Instruments", 10), ("-", 200), ("-", 300), ("Withdrawn", 400), ("Other", 10), ("no amount", 200), (" ", 10),
]


def test_rows_begin_at_the_label_column(spark):
    got = columns.rated_rows(lines(spark, (1, 1, TABLE), (1, 2, TABLE[:6]))).orderBy("group_no").collect()
    assert [(r.label, r.amount, r.rating_text, r.action_text) for r in got] == [
        ("Long Term Bank Facilities", D(1000), "CARE AA (RWN)", "Placed on Rating Watch with Negative Implications"),
        ("Long Term Long Term Instruments", D(250), "CARE AA-; Stable", "Revised from CARE AA"),
        ("Short Term Instruments", None, "-", "Withdrawn"),
        ("Other", None, None, "no amount"),
    ]
    text = "\n".join(c for c, _ in TABLE)
    assert all(text[r.label_start : r.label_stop].split() == r.label.split() for r in got) and text[got[0].rating_start : got[0].rating_stop] == "CARE AA\n(RWN)"


def test_generic_names_are_told_by_the_only_instrument_of_their_size(spark):
    annexure = [("Subordinated debt", 10), ("INE1", 60), ("250.00", 200), ("Commercial paper", 10), ("0.00", 200), ("Bank facilities", 10), ("0.00", 200), ("NCD", 10), ("70.00", 200), ("Market linked debenture", 10), ("70.00", 200), ("Two sizes NCD", 10), ("1.00", 200), ("2.00", 200), ("Unclassed", 10), ("250.00", 200)]
    listed = columns.sized_names(lines(spark, (1, 3, annexure)))
    assert {(r.name, r.size) for r in listed.collect()} == {("Subordinated debt", D(250)), ("Commercial paper", D(0)), ("Bank facilities", D(0)), ("NCD", D(70)), ("Market linked debenture", D(70)), ("Unclassed", D(250))}
    table = [*TABLE, ("Medium Instruments", 10), ("70.00", 200)]
    got = columns.told_by_size(columns.rated_rows(lines(spark, (1, 1, table), (2, 1, TABLE))), listed).collect()
    told = {(r.document_id, r.label): (r.told_name, r.told_class) for r in got}
    assert told[1, "Long Term Long Term Instruments"] == ("Subordinated debt", "subordinated_debt")
    assert told[1, "Short Term Instruments"] == ("Commercial paper", "commercial_paper")  # the table itself names bank facilities
    assert told[1, "Medium Instruments"] == (None, None) and told[1, "Long Term Bank Facilities"] == (None, None) and told[2, "Short Term Instruments"] == (None, None)


def test_page_batches_share_a_page(spark):
    rows = [(1, p, "x" * 9_000) for p in range(1, 17)] + [(2, p, "x" * 30_000) for p in range(1, 7)] + [(3, p, "short") for p in range(1, 40)] + [(4, 5, None)]
    got = {}
    for r in bureau.page_batches(spark.createDataFrame(rows, "document_id long, page_no int, text string")).collect():
        got.setdefault((r.document_id, r.batch), []).append(r.page_no)
    assert {k: sorted(v) for k, v in got.items() if k[0] == 1} == {(1, 0): [1, 2, 3, 4, 5, 6], (1, 1): [6, 7, 8, 9, 10, 11], (1, 2): [11, 12, 13, 14, 15, 16], (1, 3): [16]}
    assert len(got[2, 0]) == 6 and len(got[3, 0]) == 39 and got[4, 0] == [5]


def test_accounts_that_batches_share_are_one(spark):
    rows = []

    def account(document, batch, seq, **fields):
        rows.extend((document, batch, seq, f, v) for f, v in fields.items())

    account(1, 0, 0, lender="HDFC Bank", account_number="XX1234", emi="100")
    account(1, 0, 1, lender="Axis", account_number=None, emi="5")
    account(1, 0, 2, lender="ICICI", account_number="99", overdue="0")
    account(1, 1, 0, lender="hdfc bank", account_number="000-1234", emi="120", status="closed")
    account(1, 1, 1, lender="Axis", emi="5")
    account(1, 1, 2, lender="SBI", account_number="XX1234")
    account(1, 2, 0, lender="HDFC BANK", account_number="1234", emi="100", status="open")
    account(2, 0, 0, account_number="1234")
    account(2, 1, 0, account_number="1234", emi="7")
    got = {}
    for r in bureau.merged_accounts(spark.createDataFrame(rows, "document_id long, batch int, seq int, field string, value string").repartition(5)).collect():
        got.setdefault((r.document_id, r.account_no), {})[r.field] = (r.value, r.conflict, r.sights)
    assert len([k for k in got if k[0] == 1]) == 5 and got[1, 1] == {"lender": ("HDFC Bank", "hdfc bank", 3), "account_number": ("XX1234", "000-1234", 3), "emi": ("100", "120", 3), "status": ("closed", "open", 3)}
    assert got[1, 2] == {"lender": ("Axis", None, 1), "emi": ("5", None, 1)} and got[2, 1] == {"account_number": ("1234", None, 2), "emi": ("7", None, 2)}


def test_scores_that_are_no_scores(spark):
    rows = [(1, 0, "score", "NH", "present"), (2, 0, "score", "-1", "present"), (3, 0, "score", None, "not_found"), (3, 1, "score", "742", "present"), (3, 2, "score", "700", "present"), (4, 0, "score", "5", "blank"), (4, 0, "bureau", "X", "present"), (5, 0, "bureau", "Y", None)]
    got = {(r.document_id, r.field): (r.value, r.note is not None) for r in bureau.header(spark.createDataFrame(rows, "document_id long, batch int, field string, value string, status string")).collect()}
    assert got == {(1, "score_code"): ("NH", False), (2, "score_code"): ("-1", True), (3, "score"): ("742", False), (4, "score"): ("5", False), (4, "bureau"): ("X", False)}
