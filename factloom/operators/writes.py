"""What a write may do: loading a document's claims whole or not at all, its audit, subjects by name, analysts' overlays, the published snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import evidence

# fixed values: what an analyst may correct, and the categories a transaction may be given
TARGETS = ("fact", "txn", "obligation")
CATEGORIES = ("salary", "loan_repayment", "card_payment", "od_interest", "other")
# fixed values: longest target id, field and reason
LONGEST = {"target_id": 300, "field": 60, "reason": 1000}


def refused_documents(claims: DataFrame, anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, reason: documents with a claim no anchor proves or an anchor that their text does not bear out.

    claims: claim_id, document_id; anchors: claim_id, document_id, char_start,
    char_end, evidence_text; documents: document_id, text. Of several reasons the
    first in the alphabet is told. An anchor into a document that is not stored
    proves nothing.
    """
    bare = evidence.unanchored(claims.select("claim_id", "document_id"), anchors).select("document_id", F.lit("unanchored").alias("reason"))
    stored = documents.select(F.col("document_id").alias("doc_id"), "text")
    held = evidence.verify_anchors(anchors.withColumnRenamed("document_id", "doc_id"), stored)
    wrong = held.where("verdict <> 'verified'").select(F.col("doc_id").alias("document_id"), F.col("verdict").alias("reason"))
    lost = anchors.select("document_id").join(stored.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").select("document_id", F.lit("no_document").alias("reason"))
    return bare.unionByName(wrong).unionByName(lost).groupBy("document_id").agg(F.min("reason").alias("reason"))


def loaded(known: DataFrame, claims: DataFrame, refused: DataFrame) -> DataFrame:
    """The claims after a load: a document's new claims replace all its old ones; a refused document keeps those it had.

    Write the result to a new folder and switch to it once it is whole: readers
    never see half a load, and a job that dies leaves the old table.
    """
    new = claims.join(refused.select("document_id"), "document_id", "left_anti")
    replaced = new.select("document_id").distinct()
    return known.join(replaced, "document_id", "left_anti").select(*known.columns).unionByName(new, allowMissingColumns=True)


def extraction_runs(known: DataFrame, claims: DataFrame, refused: DataFrame, run: str) -> DataFrame:
    """The audit rows that a load appends: claims written and replaced of each document it tried, and why one was refused."""
    written = claims.groupBy("document_id").agg(F.count("*").alias("__new"))
    before = known.groupBy("document_id").agg(F.count("*").alias("__old"))
    tried = written.join(before, "document_id", "left").join(refused, "document_id", "left")
    done = F.col("reason").isNull()
    return tried.select(
        "document_id",
        F.lit(run).alias("run"),
        F.when(done, F.col("__new")).otherwise(0).alias("claims_written"),
        F.when(done, F.coalesce("__old", F.lit(0))).otherwise(0).alias("claims_replaced"),
        F.col("reason").alias("refused_for"),
    )


def stamped(documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """documents with the newest coverage of each (status, expected, found, missing); those without one keep nulls."""
    told = coverage.select("document_id", *[F.col(c).alias(f"extraction_{c}") for c in ("status", "expected", "found", "missing")])
    return documents.drop(*[c for c in told.columns if c != "document_id"]).join(told, "document_id", "left")


def named(known: DataFrame, found: DataFrame) -> DataFrame:
    """Subjects by name: a known name keeps its id and takes the new aliases, a new one gets an id above the largest known.

    known: id, name, aliases; found: name, aliases. New ids are unique but not
    dense: each task numbers its own range of names. Rows without a name are no
    subject; of several rows of one name the first aliases in sort order count.
    Write the result before the ids are used.
    """
    told = found.where("name IS NOT NULL").groupBy("name").agg(F.min("aliases").alias("__aliases"))
    kept = known.join(told, "name", "left").select("id", "name", F.coalesce("__aliases", "aliases").alias("aliases"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = told.join(known.select("name"), "name", "left_anti").repartitionByRange("name").sortWithinPartitions("name").withColumn("n", F.monotonically_increasing_id())
    numbered = fresh.join(F.broadcast(top))  # top is one row
    return kept.unionByName(numbered.select((F.col("top") + F.col("n") + 1).alias("id"), "name", F.col("__aliases").alias("aliases")))


def checked_corrections(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Corrections with the value each overrides and why it is refused (null: it may be appended).

    rows: case_id, target, target_id, field, value_text, include, amount, basis,
    reason; known: case_id, target (fact or txn), target_id, original.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    there = known.groupBy("case_id", "target", "target_id").agg(F.min("original").alias("original"), F.lit(True).alias("__there"))
    joined = rows.join(there, ["case_id", "target", "target_id"], "left")
    missing = F.col("__there").isNull()
    too_long = [F.length(c) > most for c, most in LONGEST.items()]
    is_target = lambda t: F.col("target") == t
    refusal = (
        F.when(~F.coalesce(F.col("target").isin(*TARGETS), F.lit(False)) | blank("reason"), "target or reason")
        .when(blank("target_id") | blank("field") | F.coalesce(too_long[0] | too_long[1] | too_long[2], F.lit(False)), "length")
        .when(is_target("fact") & missing, "no such fact")
        .when(is_target("txn") & missing, "no such transaction")
        .when(is_target("txn") & ~F.coalesce(F.col("value_text").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(is_target("obligation") & F.col("include").isNull(), "include")
        .when(is_target("obligation") & F.col("include") & F.coalesce(F.col("amount") < 0, F.lit(True)), "amount")
        .when(is_target("obligation") & F.col("include") & blank("basis"), "basis")
    )
    return joined.withColumn("refusal", refusal).drop("__there")


def checked_decisions(rows: DataFrame) -> DataFrame:
    """Decisions on matches (match_key, status, reason) with why each is refused."""
    empty = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    refusal = F.when(~F.coalesce(F.col("status").isin("confirmed", "rejected"), F.lit(False)), "status").when(empty("match_key") | (F.length("match_key") > 500) | empty("reason") | (F.length("reason") > 1000), "length")
    return rows.withColumn("refusal", refusal)


def append(rows: DataFrame, folder: str) -> None:
    """Appends an overlay's or an audit's rows that nothing refuses; the newest of a key is what readers take."""
    kept = rows.where("refusal IS NULL").drop("refusal") if "refusal" in rows.columns else rows
    kept.write.mode("append").parquet(folder)


def reachable(claims: DataFrame, *views: tuple[DataFrame, str | Column]) -> DataFrame:
    """The claims that a snapshot publishes: those some shown view names. views: a frame and its column of a claim id."""
    shown = [v.select(F.col(c) if isinstance(c, str) else c).toDF("claim_id") for v, c in views]
    ids = shown[0]
    for more in shown[1:]:
        ids = ids.unionByName(more)
    return claims.join(ids.where("claim_id IS NOT NULL").distinct(), "claim_id", "left_semi")
