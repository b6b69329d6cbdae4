"""Fields that a model read from a document, held against the pages they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import reading
from factloom.operators import pages as on_pages

# fixed values: what a document prints for a value that is not there
BLANK = ["-", "--", "na", "n/a", "nil", "not reported", "", "xx"]
#: A date in a quote is looked for in so many words running.
DATE_WORDS = 3


def is_blank(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(BLANK)


def _day_in(span: Column, raw: Column, day: Column) -> Column:
    """Whether the span prints the date as the model gave it or in another form."""
    said = F.split(reading.flat(span), " ")
    running = lambda n: F.transform(said, lambda _, i: F.array_join(F.slice(said, i + 1, n), " "))
    grams = F.flatten(F.array(said, *[running(n) for n in range(2, DATE_WORDS + 1)]))
    return F.contains(reading.flat(span), reading.flat(raw)) | F.exists(grams, lambda g: F.coalesce(reading.any_date(g) == day, F.lit(False)))


def verified_fields(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Every field that is present or blank, its typed value, whether a quote proves it, where, and what was found on the way.

    fields: field_id (unique), document_id, kind (amount, date, int or text),
    status, value, quote, page_no; pages: document_id, page_no, text. A quote
    counts on the page it cites; if it is not there, on the one other page that
    has it. Gives field_id, kind, value_text, amount, day, verified, page_no,
    start, stop and note: unreadable, no_quote, several_pages, not_found,
    not_in_quote, other_page, or null. A field not found by the model, or of
    an unknown status, is left out; a blank field is verified by its quote
    alone and has no value.

    Quotes meet the pages of their document in a shuffle join, so a document's
    pages are repeated for each of its quotes, and only the ranges go on.
    """
    raw, kind = F.col("value"), F.col("kind")
    given = fields.where("status IN ('present', 'blank')")
    blank = (F.col("status") == "blank") | is_blank(raw)
    typed = {
        "amount": F.when(~F.col("blank") & (kind == "amount"), reading.amount_text(raw)).when(~F.col("blank") & (kind == "int"), F.regexp_replace(F.trim(raw), ",", "").try_cast("long").cast("decimal(38,6)")),
        "day": F.when(~F.col("blank") & (kind == "date"), reading.any_date(raw)),
        "value_text": F.when(~F.col("blank") & ~kind.isin("amount", "int", "date"), reading.flat(raw)),
    }
    read = given.withColumn("blank", blank).withColumns(typed).withColumn("said", F.nullif(F.trim("quote"), F.lit("")))
    read = read.withColumn("unreadable", ~F.col("blank") & F.coalesce(F.col("amount").cast("string"), F.col("day").cast("string"), "value_text").isNull())

    asked = read.where("said IS NOT NULL AND NOT unreadable").select("field_id", "document_id", F.col("page_no").alias("cited"), "said", kind.alias("of"), raw.alias("raw"), "amount", "day", "value_text", "blank")
    met = asked.join(pages.select("document_id", F.col("page_no").alias("on_page"), "text"), "document_id")
    first = met.withColumn("at", F.get(on_pages.quote_spans("text", "said"), F.lit(0))).where("at IS NOT NULL")
    span = F.substring(F.col("text"), F.col("at.start") + 1, F.col("at.stop") - F.col("at.start"))
    holds = (
        F.when(F.col("blank"), True)
        .when(F.col("of") == "amount", on_pages.amount_in(F.col("span"), F.col("amount")))
        .when(F.col("of") == "date", _day_in(F.col("span"), F.col("raw"), F.col("day")))
        .when(F.col("of") == "int", F.contains(F.regexp_replace("span", ",", ""), F.col("amount").cast("long").cast("string")))
        .otherwise(F.contains(F.lower(reading.flat(F.col("span"))), F.lower("value_text")))
    )
    hits = first.withColumn("span", span).select("field_id", (F.col("on_page") == F.col("cited")).alias("here"), "on_page", "at", F.coalesce(holds, F.lit(False)).alias("holds"))
    place = F.struct("on_page", "at", "holds")
    seen = hits.groupBy("field_id").agg(F.count_distinct("on_page").alias("n_pages"), F.min(F.when(F.col("here"), place)).alias("cited_hit"), F.min(place).alias("any_hit"))

    joined = read.join(seen, "field_id", "left").withColumn("hit", F.coalesce("cited_hit", F.when(F.col("n_pages") == 1, F.col("any_hit"))))
    note = (
        F.when(F.col("unreadable"), "unreadable")
        .when(F.col("said").isNull(), "no_quote")
        .when(F.col("n_pages").isNull(), "not_found")
        .when(F.col("hit").isNull(), "several_pages")
        .when(~F.col("hit.holds"), "not_in_quote")
        .when(F.col("cited_hit").isNull() & F.col("page_no").isNotNull(), "other_page")
    )
    verified = F.coalesce(F.col("hit.holds"), F.lit(False)) & ~F.col("unreadable")
    where = lambda c: F.when(verified, F.col(f"hit.at.{c}")).alias(c)
    return joined.select(
        "field_id",
        "kind",
        "value_text",
        F.col("amount").cast("decimal(20,2)").alias("amount"),
        "day",
        verified.alias("verified"),
        F.coalesce("hit.on_page", "page_no").alias("page_no"),
        where("start"),
        where("stop"),
        note.alias("note"),
    )
