"""Rating histories from page lines: each layout, a table over two pages, orphan names, and what cannot be read."""

from datetime import date

from factloom.operators import histories
from factloom.plans import printings
from factloom.sources import driver_tables as src
from factloom.sources import printed

LINES = "document_id long, page_no int, line_no int, text string, start int, stop int, x0 double, x1 double, y double"


class Table:
    def __init__(self, document_id=1):
        self.rows, self.document_id, self.page_no, self.at, self.y, self.line = [], document_id, 1, 0, 0.0, 0

    def page(self):
        self.page_no, self.at, self.y, self.line = self.page_no + 1, 0, 0.0, 0
        return self

    def add(self, *cells):
        for said, middle in cells:
            self.line += 1
            self.y += 10
            self.rows.append((self.document_id, self.page_no, self.line, said, self.at, self.at + len(said), middle - 2.0 * len(said), middle + 2.0 * len(said), self.y))
            self.at += len(said) + 1
        return self


def read(spark, tables, ends=("Complexity level",), furniture=None):
    lines = spark.createDataFrame([r for t in tables for r in t.rows], LINES).repartition(5)
    table = histories.table_lines(lines, "History", list(ends), furniture)
    return table, histories.entries(table)


HEAD = [("Instrument", 50), ("Type", 120)]


def test_dates_in_cells_over_a_page_break(spark):
    t = Table().add(("Complexity level", 90), ("History of ratings", 90), *HEAD, ("Date", 200), ("Rating", 200))
    t.add(("NCD", 50), ("programme", 50), ("Long", 120), ("term", 120), ("Sep-", 200), ("25-", 200), ("2024", 200), ("PP-MLD[ICRA]", 200))
    t.page().add(("www.agency.example", 10), ("4", 300), *HEAD, ("Date", 200), ("Rating", 200), ("AA (Stable)", 200), ("29-DEC-", 300), ("2023", 300), ("[ICRA]A A-", 300), ("-", 400), ("stray words", 400))
    t.add(("Complexity level", 90), ("[ICRA]D", 200))
    t.page().add(("NCD", 50), ("Long", 120), ("Sep-", 200), ("25-", 200), ("2024", 200), ("[ICRA]D", 200))
    table, got = read(spark, [t, Table(2).add(("no heading", 50))], furniture=r"^www\.")
    rows = got.orderBy("action_date").collect()
    assert [(r.name, r.action_date, r.rating_text, r.grade, r.outlook) for r in rows] == [("NCD programme", date(2023, 12, 29), "[ICRA]A A-", "AA-", None), ("NCD programme", date(2024, 9, 25), "PP-MLD[ICRA] AA (Stable)", "AA", "Stable")]
    runs = histories.anchors(got, table).where("action_date = '2024-09-25'").collect()
    assert sorted((r.part, r.page_no) for r in runs) == [("date", 1), ("label", 1), ("rating", 1), ("rating", 2)]


def test_dates_in_heads_by_the_nearest_column(spark):
    t = Table().add(("History", 90), *HEAD, ("Mar 12, 2024", 200), ("Aug 03,", 290), ("2022", 290), ("30 Sept 2021", 380), ("March", 470), ("25, 2020", 470))
    t.add(("Bank", 50), ("lines", 50), ("LT", 120), ("CARE AA; Stable", 205), ("withdrawn", 300), ("-", 380), ("too far away", 560), ("unclear", 465), ("Total", 50), ("[ICRA]D", 200))
    table, got = read(spark, [t], ends=("^Public", "\nTotal\n"))
    rows = {r.action_date: r for r in got.collect()}
    assert {d: (r.grade, r.outlook, r.withdrawn, r.readable) for d, r in rows.items()} == {date(2024, 3, 12): ("AA", "Stable", False, True), date(2022, 8, 3): (None, None, True, True), date(2020, 3, 25): (None, None, False, False)}
    own = spark.createDataFrame([(1, date(2024, 3, 12), "care")], "document_id long, own_date date, agency string")
    claims = histories.history_claims(got, own).collect()
    assert [(c.fact_key, c.instrument_class, c.term) for c in claims] == [("rating_history|care|bank_facility|long_term|2022-08-03|bank lines", "bank_facility", "long_term")]
    (told,) = histories.history_coverage(table, histories.history_claims(got, own), got).collect()
    assert told.status == "incomplete" and told.missing == ["unreadable cell: Bank lines 2020-03-25 unclear"]


def test_numbered_rows_and_orphan_names(spark):
    numbered = Table(1).add(("History", 90), ("Sr.", 15), *HEAD, ("Mar 12, 2024", 200))
    numbered.add(("1", 15), ("NCD", 50), ("Long term", 120), ("[ICRA]AA", 200), ("77", 200), ("2", 15), ("CP", 50), ("ST", 120), ("[ICRA]A1+", 200))
    orphans = Table(2).add(("History", 90), *HEAD, ("Mar 12, 2024", 200))
    # the next two rows open without names; two orphan names take the last that waits, then the first
    orphans.add(("Zero", 50), ("LT", 120), ("[ICRA]C", 200))  # the head ends at the first name
    orphans.add(("Long", 120), ("[ICRA]AA", 200), ("Short", 120), ("[ICRA]A1", 200), ("Second", 50), ("[ICRA]A1+", 210), ("First", 50), ("name", 50), ("[ICRA]BBB", 190), ("Third", 50), ("ST", 120), ("[ICRA]A2", 200), ("lost", 50))
    _, got = read(spark, [numbered, orphans])
    assert sorted((r.document_id, r.row_no, r.name, r.rating_text) for r in got.collect()) == [
        (1, 1, "NCD", "[ICRA]AA"),
        (1, 2, "CP", "[ICRA]A1+"),
        (2, 1, "Zero", "[ICRA]C"),
        (2, 2, "First name", "[ICRA]AA"),
        (2, 3, "Second", "[ICRA]A1 [ICRA]A1+ [ICRA]BBB"),
        (2, 4, "Third", "[ICRA]A2"),
    ]


def test_empty_and_blank_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert histories.entries(histories.table_lines(empty, "History", ["x"])).count() == 0
    blank = Table().add(("History", 50), ("Instrument", 50))
    blank.rows.append((1, 1, 9, "  ", 0, 2, None, None, None))
    assert read(spark, [blank])[1].count() == 0


def test_lines_are_printed_and_placed_in_one_pass(spark):
    cells = src.view(spark, "/root/testdata/sf0.001", src.HISTORY_CELLS, ("customer", "c_custkey", 50), "document_id")
    table = histories.table_lines(printed.history_lines(cells), "Rating history for past three years", ["Complexity level"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    # a document's lines are made and looked through where its customer is dealt: no second shuffle, no join, no second reading
    assert plan.count("hashpartitioning") == 1 and plan.count("FileScan parquet") == 1 and "MergeJoin" not in plan and "HashJoin" not in plan


def test_entries_read_the_table_where_it_lies(spark):
    plan = printings.QUERIES["rating_history_entries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Union" not in plan and "hashpartitioning" not in plan
