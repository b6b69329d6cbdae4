"""Registered queries of what is written: a claim load as versions of a table, a build of the cases that changed, and the proof of cited facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import proofs, versions
from factloom.plans import underwritings
from factloom.plans.catalog import ORACLES, QUERIES, query
from factloom.sources import driver_tables as src
from factloom.sources import folders
from factloom.streaming.activity import workspace

__all__ = ["ORACLES", "QUERIES", "underwritings"]


@query(ORACLES["claim_load"])
def versioned_claim_load(spark, sf_dir):
    old, new, anchors = [src.view(spark, sf_dir, v) for v in (src.OLD_CLAIMS, src.NEW_CLAIMS, src.NEW_ANCHORS)]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    root = workspace(spark, "claims")
    versions.rebuild(old, root, "document_id")
    versions.load_claims(spark, root, new, anchors, documents)
    return versions.read(spark, root).select(*new.columns)


_BEFORE = "SELECT o_custkey AS case_id, o_orderkey AS item, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM {orders}"
_AFTER = "SELECT o_custkey AS case_id, o_orderkey AS item, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS amount FROM {orders} WHERE o_custkey % 11 <> 0"


@query(f"""
WITH b AS ({src.duck(_BEFORE)}), a AS ({src.duck(_AFTER)}),
x AS (SELECT case_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM b GROUP BY 1), y AS (SELECT case_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM a GROUP BY 1)
SELECT case_id, y.n, y.total, CASE WHEN y.case_id IS NULL THEN 'gone' WHEN x.n = y.n AND x.total = y.total THEN 'kept' ELSE 'built' END AS step FROM x LEFT JOIN y USING (case_id)""")
def incremental_case_build(spark, sf_dir):
    root = workspace(spark, "cases")

    def build(inputs):
        return inputs["items"].groupBy("case_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))

    before, after = ({"items": src.view(spark, sf_dir, v)} for v in (_BEFORE, _AFTER))
    versions.build_changed(spark, root, "case_id", before, build)
    known = versions.read(spark, root).select("case_id")
    changed = versions.build_changed(spark, root, "case_id", after, build)
    now = known.join(versions.read(spark, root), "case_id", "left").join(changed, "case_id", "left")
    return now.select("case_id", "n", "total", F.when(F.col("gone"), "gone").when(F.col("gone").isNull(), "kept").otherwise("built").alias("step"))


@query(f"""
SELECT f.fact_id, CASE WHEN NOT verified THEN 'shown' WHEN f.start IS NULL THEN 'verified without an anchor' WHEN d.doc_id IS NULL THEN 'no such page'
  WHEN f.stop <= length(d.text) AND f.start < f.stop AND length(d.text) >= 3 AND concat(substr(d.text, f.start + 1, f.stop - f.start), ' ', substr(d.text, 1, 3)) = f.evidence_text THEN 'proved' ELSE 'the page does not say it' END AS verdict
FROM ({src.duck(src.CITED)}) f LEFT JOIN documents d ON d.doc_id = f.document_id""")
def fact_proofs(spark, sf_dir):
    cited = src.view(spark, sf_dir, src.CITED)
    spans = F.when(F.col("start").isNotNull(), F.array(F.struct("start", "stop"), F.struct(F.lit(0).alias("start"), F.lit(3).alias("stop"))))
    facts = cited.withColumn("spans", spans).withColumn("page_no", F.lit(1)).withColumns({"json_path": F.lit(None).cast("string"), "value_num": F.lit(None).cast("decimal(20,2)"), "value_text": F.lit(None).cast("string")})
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text")
    return proofs.proofs(facts, pages, documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw")))


_FETCHED = "SELECT doc_id AS document_id, k AS fetched_at, CASE WHEN doc_id % 13 = k THEN NULL WHEN doc_id % 5 = 0 AND doc_id % 4 < k THEN concat(text, CASE WHEN doc_id % 3 = 0 THEN CAST(k AS VARCHAR(2)) ELSE '!' END) ELSE text END AS body, doc_id % 13 = k AS failed FROM {documents} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) t WHERE doc_id % 5 > 0 OR k < 3 OR doc_id % 2 = 0"


@query(f"""
WITH f AS (SELECT document_id, fetched_at, CASE WHEN NOT failed THEN sha256(coalesce(body, '')) END AS now FROM ({src.duck(_FETCHED)})),
d AS (SELECT doc_id AS document_id, doc_id % 7 > 0 AS looked, sha256(coalesce(text, '')) AS sha256 FROM documents),
-- before each look, the looks since the last that matched: the first that differed stamps, the last that differed gives the hash
a AS (SELECT d.*, f.fetched_at, f.now, max(f.fetched_at) FILTER (WHERE f.now = d.sha256) OVER (PARTITION BY d.document_id) AS ok FROM d LEFT JOIN f ON f.document_id = d.document_id AND looked)
SELECT document_id, CAST(min(fetched_at) FILTER (WHERE now <> sha256 AND fetched_at > coalesce(ok, 0)) AS INTEGER) AS source_changed_at, arg_max(now, fetched_at) FILTER (WHERE now <> sha256 AND fetched_at > coalesce(ok, 0)) AS source_changed_sha256 FROM a GROUP BY document_id""")
def source_drift(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = documents.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 > 0, folders.QUOTED).otherwise("full").alias("policy"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit(None).cast("int").alias("source_changed_at"), F.lit(None).cast("string").alias("source_changed_sha256"))
    seen = src.view(spark, sf_dir, _FETCHED).select("document_id", "fetched_at", F.when(~F.col("failed"), F.sha2(F.coalesce("body", F.lit("")), 256)).alias("sha256"))
    for k in (1, 2, 3):
        held = folders.drift(held, seen.where(F.col("fetched_at") == k)).drop("drift")
    return held.select("document_id", "source_changed_at", "source_changed_sha256")


_FILES = "SELECT CAST(floor(page_id / 40) AS BIGINT) AS case_id, concat('in/', CASE page_id % 50 WHEN 49 THEN 'manifest.json' ELSE concat(CAST(page_id AS VARCHAR(20)), CASE page_id % 3 WHEN 0 THEN '.json' ELSE '.pdf' END) END) AS path, CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 5 = 0 THEN concat('%PDF', CAST(page_id % 7 AS VARCHAR(2))) ELSE html END AS html FROM {pages}"
_NAMED = "SELECT concat(CAST(page_id AS VARCHAR(20)), '.pdf') AS file, k AS n, CASE WHEN page_id % 9 = 0 THEN 'no kind' WHEN k = 1 THEN 'kyc' ELSE 'financials' END AS kind FROM {pages} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) t WHERE page_id % 4 = 1 AND (k = 1 OR page_id % 8 = 1)"


@query(f"""
WITH named AS (SELECT file, arg_max(kind, n) AS stated FROM ({src.duck(_NAMED)}) GROUP BY file),
f AS (SELECT case_id, substr(path, 4) AS filename, coalesce(html, '') AS said FROM ({src.duck(_FILES)}) WHERE path <> 'in/manifest.json'),
r AS (SELECT f.*, sha256(said) AS sha256, CAST(strlen(said) AS BIGINT) AS byte_size, CASE WHEN ends_with(filename, '.json') THEN 'application/json' WHEN starts_with(said, '%PDF') THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type,
             coalesce(stated, CASE WHEN ends_with(filename, '.json') THEN 'itr_json' ELSE 'other' END) AS kind FROM f LEFT JOIN named ON file = filename),
g AS (SELECT case_id, sha256, min(filename) AS same_as FROM r WHERE kind <> 'no kind' GROUP BY 1, 2)
SELECT r.case_id, filename, r.sha256, byte_size, media_type, kind, same_as, coalesce(kind <> 'no kind' AND filename = same_as AND NOT (r.case_id % 10 = 0 AND byte_size = 0), false) AS is_new FROM r LEFT JOIN g ON g.case_id = r.case_id AND g.sha256 = r.sha256""")
def imported_files(spark, sf_dir):
    files = src.view(spark, sf_dir, _FILES).withColumn("content", F.encode("html", "UTF-8")).drop("html")
    known = files.where("case_id % 10 = 0").select("case_id", F.sha2(F.lit(b""), 256).alias("sha256"))
    told = folders.imported(files, src.view(spark, sf_dir, _NAMED), known)
    return told.select("case_id", "filename", "sha256", "byte_size", "media_type", "kind", "same_as", "is_new")
