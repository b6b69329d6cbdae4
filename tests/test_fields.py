"""Model-read fields against the pages they cite."""

from datetime import date
from decimal import Decimal as D

from factloom.operators import fields

SHAPE = "field_id int, document_id long, kind string, status string, value string, quote string, page_no int"
PAGES = [(1, 1, "Score  742\nReport date 05 Mar 2024"), (1, 2, "Sanctioned\nRs. 1,50,000 to ACME\nMember twice"), (1, 3, "Member twice"), (1, 4, None), (2, 1, "other")]


def run(spark, *asked):
    pages = spark.createDataFrame(PAGES, "document_id long, page_no int, text string")
    return {r.field_id: r for r in fields.verified_fields(spark.createDataFrame(list(asked), SHAPE), pages).collect()}


def test_values_are_read_and_proved(spark):
    got = run(
        spark,
        (1, 1, "int", "present", "742", "score 742", 1),
        (2, 1, "date", "present", "5 March 2024", "Report date 05 Mar 2024", 1),
        (3, 1, "amount", "present", "Rs. 150,000", "sanctioned rs. 1,50,000", 1),
        (4, 1, "text", "present", " acme ", "to ACME", None),
        (5, 1, "amount", "blank", "ignored", "Sanctioned", 2),
        (6, 1, "text", "present", "n/a", "to ACME", 2),
    )
    assert (got[1].amount, got[1].verified, got[1].page_no, got[1].start, got[1].stop, got[1].note) == (D("742.00"), True, 1, 0, 10, None)
    assert (got[2].day, got[2].verified) == (date(2024, 3, 5), True)
    assert (got[3].amount, got[3].verified, got[3].page_no, got[3].note) == (D("150000.00"), True, 2, "other_page")
    assert (got[4].value_text, got[4].verified, got[4].note) == ("acme", True, None)
    assert (got[5].amount, got[5].verified) == (None, True) and (got[6].value_text, got[6].verified) == (None, True)


def test_what_is_not_proved_says_why(spark):
    got = run(
        spark,
        (1, 1, "int", "present", "seven", "Score 742", 1),
        (2, 1, "int", "present", "742", "  ", 1),
        (3, 1, "text", "present", "Member", "member twice", 1),
        (4, 1, "text", "present", "Member", "member twice", 3),
        (5, 1, "text", "present", "x", "nowhere to be read", 1),
        (6, 1, "amount", "present", "9", "Sanctioned Rs. 1,50,000", 2),
        (7, 1, "date", "present", "6 Mar 2024", "Report date 05 Mar 2024", 1),
        (8, 1, "text", "not_found", "x", "Score", 1),
        (9, 1, "text", None, "x", "Score", 1),
        (10, 3, "text", "present", "x", "Score", 1),
        (11, 2, "text", "present", "o", "o", 1),
    )
    assert {i: (r.verified, r.note) for i, r in got.items()} == {
        1: (False, "unreadable"), 2: (False, "no_quote"), 3: (False, "several_pages"), 4: (True, None), 5: (False, "not_found"), 6: (False, "not_in_quote"), 7: (False, "not_in_quote"),
        10: (False, "not_found"), 11: (False, "not_found"),
    }
    assert got[2].amount == D("742.00") and got[6].start is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    pages = spark.createDataFrame(PAGES, "document_id long, page_no int, text string")
    assert fields.verified_fields(none, pages).count() == 0
