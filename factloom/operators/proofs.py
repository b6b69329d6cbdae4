"""Proof of what is published: every fact is read again from what is stored before a snapshot is written, and nothing is written that should not leave.

facts: fact_id, document_id, page_no, spans (array of start, stop), evidence_text,
json_path, value_num, value_text, verified. A fact that says it is verified must be
borne out by its page (spans that read as its evidence) or by its JSON document (a
path that holds its value); others are only shown. Each stored page and document is
read once for all facts that cite it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import versions
from factloom.operators.layout import spans_read

# fixed values: what a snapshot must not hold
LEAKS = ["/Users/", "stored_path", "data/assess"]




def proofs(facts: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """fact_id, verdict: shown (not said to be verified), proved, or why not. pages: document_id, page_no, text; documents: document_id, raw."""
    claimed = facts.where("verified")
    cited = claimed.where("spans IS NOT NULL").groupBy("document_id", "page_no").agg(F.collect_list(F.struct("fact_id", "spans", "evidence_text")).alias("facts"))
    on_page = cited.join(pages.select("document_id", "page_no", "text"), ["document_id", "page_no"], "left").select("text", F.explode("facts").alias("f"))
    read = on_page.select("f.fact_id", F.when(F.col("text").isNull(), "no such page").when(spans_read(F.col("text"), F.col("f.spans"), F.col("f.evidence_text")), "proved").otherwise("the page does not say it").alias("verdict"))

    by_path = claimed.where("spans IS NULL AND json_path IS NOT NULL").groupBy("document_id").agg(F.collect_list(F.struct("fact_id", "json_path", "value_num", "value_text")).alias("facts"))
    in_json = by_path.join(documents.select("document_id", "raw"), "document_id", "left").select("raw", F.explode("facts").alias("f"))
    found = in_json.select("raw", "f.*").withColumn("held", F.expr("get_json_object(raw, concat('$', array_join(transform(split(json_path, '\\\\.'), p -> CASE WHEN p RLIKE '^[0-9]+$' THEN concat('[', p, ']') ELSE concat('.', p) END), '')))"))
    same = F.when(F.col("value_num").isNotNull(), F.col("held").try_cast("decimal(38,6)") == F.col("value_num").cast("decimal(38,6)")).otherwise(F.col("value_text").contains(F.col("held")))
    told = found.select("fact_id", F.when(F.col("raw").isNull(), "no such document").when(F.coalesce(same, F.lit(False)), "proved").otherwise("the path does not hold it").alias("verdict"))

    bare = claimed.where("spans IS NULL AND json_path IS NULL").select("fact_id", F.lit("verified without an anchor").alias("verdict"))
    shown = facts.where("NOT coalesce(verified, false)").select("fact_id", F.lit("shown").alias("verdict"))
    return read.unionByName(told).unionByName(bare).unionByName(shown)


def leaks(rows: DataFrame) -> DataFrame:
    """The rows whose text says where something is stored, in any column."""
    said = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.where(reduce(Column.__or__, [said.contains(m) for m in LEAKS]))


def refusals(facts: DataFrame, pages: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    """what, id, reason: all that forbids a snapshot of these facts. facts have case_id too; cases: case_id, synthetic."""
    unproved = proofs(facts, pages, documents).where("verdict NOT IN ('proved', 'shown')").select(F.lit("fact").alias("what"), F.col("fact_id").alias("id"), F.col("verdict").alias("reason"))
    real = facts.select("case_id").distinct().join(cases, "case_id", "left").where("NOT coalesce(synthetic, false)").select(F.lit("case").alias("what"), F.col("case_id").alias("id"), F.lit("not a synthetic case").alias("reason"))
    told = leaks(facts).select(F.lit("fact").alias("what"), F.col("fact_id").alias("id"), F.lit("says where it is stored").alias("reason"))
    return unproved.unionByName(real).unionByName(told)


def publish(facts: DataFrame, pages: DataFrame, documents: DataFrame, cases: DataFrame, root: str) -> int:
    """Writes the snapshot's facts with their verdicts, if nothing forbids it; what is written is read again before it counts."""
    found = refusals(facts, pages, documents, cases).orderBy("what", "id", "reason").head(5)
    if found:
        raise versions.Refused(f"{root}: {[r.asDict() for r in found]}")
    told = facts.join(proofs(facts, pages, documents), "fact_id")
    return versions.rebuild(told, root, "case_id", check=lambda written: refusals(written.drop("verdict"), pages, documents, cases))
