"""Credit reports that a model reads batch by batch: which pages go together, one header, and accounts that batches share merged into one.

accounts: document_id, batch, seq (its place in the batch), field, value, found (the
status: not `not_found`). An account that is cut by the end of a batch is seen by
the next one too, since batches share a page; both sights are one account if they
name the same lender and the same last four characters of its number.

Defined results: accounts without a number are never merged; the first value of a
field counts, in the order of batches and places; a later value that differs is
told as a conflict and not taken; empty reports give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: pages of a batch, characters that one call may hold, and the highest score that means there is none
BATCH_PAGES, SINGLE_CALL, NO_SCORE = 6, 120_000, 5

ACCOUNT = ["document_id", "batch", "seq"]


def page_batches(pages: DataFrame) -> DataFrame:
    """document_id, batch, page_no: the pages of each batch; neighbours share a page. A short report is one batch. pages: document_id, page_no, text."""
    whole = Window.partitionBy("document_id")
    placed = pages.select("document_id", "page_no", (F.row_number().over(whole.orderBy("page_no")) - 1).alias("i"), F.count("*").over(whole).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).over(whole).alias("chars"))
    step = BATCH_PAGES - 1
    own = F.floor(F.col("i") / step).cast("int")
    batches = F.when((F.col("chars") <= SINGLE_CALL) | (F.col("n") <= BATCH_PAGES), F.array(F.lit(0))).when((F.col("i") % step == 0) & (F.col("i") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    return placed.select("document_id", F.explode(batches).alias("batch"), "page_no")


def header(fields: DataFrame) -> DataFrame:
    """A report's header (document_id, field, value, note): of each field the first batch that found it. fields: document_id, batch, field, value, status.

    A score that is printed as words is a score_code; so is a number up to NO_SCORE, which bureaus print for no history.
    """
    first = fields.where("coalesce(status, 'not_found') <> 'not_found'").groupBy("document_id", "field").agg(F.min_by(F.struct("value", "status"), "batch").alias("f")).select("document_id", "field", "f.*")
    number = F.trim(F.coalesce("value", F.lit(""))).rlike(r"^-?\d+$")
    is_score = (F.col("field") == "score") & (F.col("status") == "present")
    low = is_score & number & (F.col("value").try_cast("long") <= NO_SCORE)
    field = F.when(is_score & (~number | low), "score_code").otherwise(F.col("field"))
    return first.select("document_id", field.alias("field"), "value", F.when(low, "bureau no-score code, not a score").alias("note"))


def merged_accounts(accounts: DataFrame) -> DataFrame:
    """One row a field of each account: document_id, account_no (from 1, in order of first sight), field, value, conflict (the first later value that differs), sights."""
    said = accounts.where("value IS NOT NULL")
    value = lambda f: F.min(F.when(F.col("field") == f, F.col("value")))
    named = said.groupBy(*ACCOUNT).agg(value("account_number").alias("number"), value("lender").alias("lender"))
    alone = F.concat_ws(":", F.lit("alone"), "batch", "seq")
    # a lender that is not named is one name too, as both sights lack it
    key = F.when(F.coalesce("number", F.lit("")) != "", F.concat_ws("|", F.lit("as"), F.coalesce(F.lower("lender"), F.lit("none")), F.substring("number", -4, 4))).otherwise(alone)
    keyed = named.select(*ACCOUNT, key.alias("same"))
    first = Window.partitionBy("document_id", "same").orderBy("batch", "seq")
    seen = keyed.withColumn("first", F.first(F.struct("batch", "seq")).over(first)).withColumn("sights", F.count("*").over(Window.partitionBy("document_id", "same")))
    numbered = seen.withColumn("account_no", F.dense_rank().over(Window.partitionBy("document_id").orderBy("first")))
    order = Window.partitionBy("document_id", "account_no", "field").orderBy("batch", "seq")
    each = said.select(*ACCOUNT, "field", "value").join(numbered.select(*ACCOUNT, "account_no", "sights"), ACCOUNT)
    taken = each.withColumn("kept", F.first("value").over(order)).withColumn("place", F.struct("batch", "seq"))
    later = F.min_by("value", F.when(F.col("value") != F.col("kept"), F.col("place")))
    return taken.groupBy("document_id", "account_no", "field").agg(F.first("kept").alias("value"), later.alias("conflict"), F.max("sights").cast("int").alias("sights"))
