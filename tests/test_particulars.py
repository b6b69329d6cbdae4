"""Tables without lines: rows around tenure cells, entries with their own dates, totals by running sums, the debt row."""

from datetime import date
from decimal import Decimal as D

from factloom.operators import histories, particulars

WORDS = "document_id long, page_no int, word_no int, line_no int, text string, start int, stop int, x0 double, y0 double, x1 double, y1 double"


class Page:
    """Cells are set line by line: (text, left, height); those of one line stand in one line of the text."""

    def __init__(self, document_id, page_no=1):
        self.rows, self.key, self.at, self.line = [], (document_id, page_no), 0, 0

    def set(self, *cells):
        for said, x, y in cells:
            for word in said.split(" "):
                self.rows.append((*self.key, len(self.rows), self.line, word, self.at, self.at + len(word), float(x), y - 4.0, x + 4.0 * len(word), y + 4.0))
                self.at, x = self.at + len(word) + 1, x + 4.0 * (len(word) + 1)
        self.line += 1
        return self


def particulars_page(document_id, heads=True):
    p = Page(document_id).set(("Long Term", 250, 20)).set(("Particulars:", 10, 50))
    p.set(("Instruments", 20, 60), ("Amount (Rs Crs)", 120, 60), ("Tenure", 250, 60), ("Rating", 340, 60))
    if heads:
        p.set(("Previous", 100, 70), ("Present", 170, 70), ("Previous", 320, 70), ("Present", 420, 70)).set(("(30th Sept 2024)", 310, 80))
    p.set(("NCDs Public", 20, 100), ("500.00", 100, 104), ("450.00", 170, 104), ("Long Term", 250, 104), ("BWR AA+", 320, 100), ("BWR AA+", 420, 96))
    p.set(("Issue **", 20, 110)).set(("/Stable", 320, 110)).set(("Reaffirmed and", 420, 106)).set(("removed Rating Watch", 420, 116)).set(("with Negative", 420, 126)).set(("Implications", 420, 136))
    p.set(("Commercial Paper", 20, 150), ("-", 100, 150), ("75.82", 170, 150), ("Short Term", 250, 150), ("-", 320, 150), ("BWR A1+ Assignment", 420, 150))
    p.set(("Unsized notes", 20, 180), ("Long Term", 250, 180), ("BWR A", 420, 180))
    p.set(("Total", 20, 210), ("525.82", 170, 210)).set(("*Please refer below", 10, 230)).set(("NCDs", 20, 240), ("9.00", 170, 240), ("Long Term", 250, 240), ("BWR B", 420, 240))
    return p.rows


def test_rows_are_built_around_their_tenure_cell(spark):
    rows = particulars_page(1) + particulars_page(2, heads=False) + [(3, 1, 0, 0, "Particulars:", 0, 12, 1.0, 1.0, 9.0, 9.0), (3, 1, 1, 0, None, 13, 14, 1.0, 1.0, 9.0, 9.0), (3, 1, 2, 0, "x", None, None, None, 1.0, 9.0, 9.0)]
    got = particulars.rated_particulars(spark.createDataFrame(rows, WORDS).repartition(3)).orderBy("row_no").collect()
    assert [(r.document_id, r.label, r.amount, r.rating_text, r.previous_text, r.grade, r.action, r.readable) for r in got] == [
        (1, "NCDs Public Issue", D(450), "BWR AA+ Reaffirmed and removed Rating Watch with Negative Implications", "BWR AA+ /Stable", "AA+", "reaffirmed; removed", True),
        (1, "Commercial Paper", D("75.82"), "BWR A1+ Assignment", None, "A1+", "assigned", True),
    ]
    # only `removed from` ends a watch
    assert got[0].watch == "Watch with Negative Implications" and got[0].amount_span.stop - got[0].amount_span.start == 6 and len(got[0].rating_spans) == 5
    assert particulars.rated_particulars(spark.createDataFrame([], WORDS)).count() == 0


def test_words_close_together_are_a_cell(spark):
    p = Page(1).set(("Public Issue", 10, 10), ("975.82", 64, 10), ("far", 120, 10)).set(("Public", 30, 20))
    got = particulars.cells(spark.createDataFrame(p.rows, WORDS)).orderBy("start").collect()
    assert [(r.text, r.start, r.stop, r.x0) for r in got] == [("Public Issue 975.82", 0, 19, 10.0), ("far", 20, 23, 120.0), ("Public", 24, 30, 30.0)]


def test_a_total_is_the_first_sum_of_those_before(spark):
    rows = [(1, 1, "5.00"), (1, 2, "5.00"), (1, 3, "10.01"), (2, 1, "1.00"), (2, 2, None), (2, 3, "2.00"), (2, 4, "3.019"), (2, 5, "6.019"), (3, 1, "4.00"), (3, 2, "4.02"), (4, 1, None), (4, 2, "0.01")]
    df = spark.createDataFrame([(d, n, v and D(v)) for d, n, v in rows], "document_id long, n int, value decimal(10,3)").repartition(4)
    got = {(r.document_id, r.n): (r.is_row, r.is_total) for r in particulars.before_total(df, ["n"]).collect()}
    assert {k for k, v in got.items() if v[1]} == {(1, 2), (2, 4), (4, 2)} and {k for k, v in got.items() if not v[0]} == {(1, 2), (1, 3), (2, 4), (2, 5), (4, 2)}
    plain = {}
    for d, n, v in rows:  # the loop that the windows stand for
        total, seen, done = plain.get(d, (D(0), 0, False))
        done = done or bool(seen and v is not None and abs(D(v) - total) < D("0.02"))
        assert got[d, n][0] is not done
        plain[d] = (total if done else total + D(v or 0), seen + (not done), done)


LINES = "document_id long, page_no int, line_no int, text string, start int, stop int, x0 double, x1 double, y double"


def history(document_id, *pages):
    rows = []
    for page_no, cells in enumerate(pages, 1):
        at = 0
        for n, (said, x, y) in enumerate(cells):
            rows.append((document_id, page_no, n, said, at, at + len(said), float(x), x + 4.0 * len(said), float(y)))
            at += len(said) + 1
    return rows


HEADS = [
    ("Rating History", 10, 10), ("Sl", 5, 30), ("Instruments", 30, 30), ("Amount", 120, 30), ("Rating", 200, 30), ("(15", 300, 30), ("(15 Sept", 290, 30), ("2025)", 300, 40), ("2024", 400, 30), ("2023", 500, 30),
]
ROWS = [
    ("1", 5, 110), ("NCDs ^ Long", 30, 100), ("Term", 70, 110), ("450.00", 120, 105), ("BWR AA", 190, 100), ("Stable", 200, 110), ("BWR AA+", 290, 95), ("(Stable)", 290, 105), ("BWR AA", 390, 90), ("(Negative)", 390, 100), ("12 Mar", 390, 110), ("2024", 400, 120), ("BWR A+ (05.01.2024)", 370, 130), ("Withdrawn", 490, 100),
]
NEXT = [("3 Secured", 20, 20), ("NCD", 30, 30), ("50.00", 120, 25), ("BWR A1+", 290, 20), ("31 Foo 2024", 390, 10), ("Withdrawn", 385, 20), ("30 Feb 2024", 390, 30), ("BWR said", 490, 20), ("3 May 2023", 490, 30), ("tail name", 30, 50), ("500.00", 120, 60), ("BWR D", 290, 70), ("The end", 10, 90)]


def test_entries_carry_their_own_dates(spark):
    rows = history(1, HEADS + ROWS, NEXT) + history(2, HEADS[:3] + HEADS[4:] + ROWS) + history(3, HEADS) + history(4, [h for h in HEADS if h[0] in ("Rating History", "Amount")] + ROWS)
    table = histories.table_lines(spark.createDataFrame(rows, LINES).repartition(4), "Rating History", ["The end"])
    read = particulars.dated_entries(table)
    got = read.orderBy("row_no", "action_date", "rating_text").collect()
    assert {r.document_id for r in got} == {1}
    assert [(r.row_no, r.name, r.action_date, r.rating_text, r.grade, r.outlook, r.withdrawn, r.status) for r in got] == [
        (1, "NCDs", None, "Withdrawn", None, None, True, "undated"),
        (1, "NCDs", date(2024, 1, 5), "BWR A+ (05.01.2024)", "A+", None, False, "read"),
        (1, "NCDs", date(2024, 3, 12), "BWR AA (Negative) 12 Mar 2024", "AA", "Negative", False, "read"),
        (1, "NCDs", date(2025, 9, 15), "BWR AA+ (Stable)", "AA+", "Stable", False, "read"),
        (2, "Secured NCD", None, "Withdrawn 30 Feb 2024", None, None, True, "undated"),
        (2, "Secured NCD", date(2023, 5, 3), "BWR said 3 May 2023", None, None, False, "unreadable"),
        (2, "Secured NCD", date(2025, 9, 15), "BWR A1+", "A1+", None, False, "read"),
    ]
    said = {r.at: r.text for r in table.where("document_id = 1").collect()}
    words = lambda at: " ".join(said[k] for k in at)
    assert all(words(r.rating_at).strip() == r.rating_text for r in got) and words(got[3].date_at) == "(15 Sept 2025)"
    assert [words(r.label_at) for r in got if r.row_no == 2][:1] == ["3 Secured NCD"]
    own = spark.createDataFrame([(1, date(2024, 1, 5), "A")], "document_id long, own_date date, agency string")
    assert {r.action_date for r in histories.history_claims(read, own).collect()} == {date(2024, 3, 12), date(2025, 9, 15)}
    runs = histories.anchors(read, table).where("row_no = 1 AND part = 'rating' AND action_date = DATE'2024-03-12'").collect()
    assert len(runs) == 1


def test_debt_stands_under_its_periods(spark):
    heading = "Key Financial Performance - IIFL Finance Ltd. (Consolidated)"
    text = f"Total Debt\nRs.in Crores\n1\nFY20\nFY21\nx\n{heading}\nParticulars\nFY23\nFY24\nQ1FY25\nQ4FY25\nQ7FY25\nTotal Debt\nRs.in Crores\n39,604\n46,694\n,\n50\n60\n70\nTotal Income\n5"
    rows = [(1, 1, text), (1, 2, text.replace("Total Debt", "Total Dues")), (2, 1, None), (3, 1, ""), (4, 1, heading.replace("Consolidated", "Standalone") + "\nFY24\nFY25\nTotal Debt\nRs.in Crores\n7\n8\n9")]
    got = particulars.total_debt(spark.createDataFrame(rows, "document_id long, page_no int, text string").repartition(2)).orderBy("document_id", "start").collect()
    assert [(r.document_id, r.basis, r.period, r.as_of, r.amount) for r in got] == [
        (1, "consolidated", "FY23", date(2023, 3, 31), D(39604)), (1, "consolidated", "FY24", date(2024, 3, 31), D(46694)), (1, "consolidated", "Q4FY25", date(2025, 3, 31), D(50)),
        (4, "standalone", "FY24", date(2024, 3, 31), D(7)), (4, "standalone", "FY25", date(2025, 3, 31), D(8)),
    ]
    texts = {d: t for d, p, t in rows if p == 1}
    assert all(texts[r.document_id][r.start : r.stop].replace(",", "") == str(int(r.amount)) for r in got)
