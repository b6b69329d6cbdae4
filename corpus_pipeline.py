"""A training corpus from raw documents: each stage works on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet into the shared folder and read again as the next one's docs.

Defined results, for every stage: columns beyond those of documents are dropped
(so no name can clash), rows keep the columns of documents, an empty table gives
an empty one. What null ids, null and empty texts and repeated rows give is in
each stage's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import bpe, chunks, decontaminate, neardup, quality
from factloom.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes from which a repeated run counts as a passage; shorter ones are turns of phrase that any two documents may share.
PASSAGE_BYTES = 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as texts without words; repeated rows are scored alike; a null doc_id is never a
    label's, but its row is scored. Without any label every score is 0.5, which accepts.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows of one doc_id, or of none, with the same text are one document: the first by the other columns stays. Rows of
    one doc_id with other texts all stay with it; a row without a doc_id is near to no other.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # the doc_id as the join deals it, so that rows are not shuffled again
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0).cast("long")), F.isnull("doc_id"), F.sha2("text", 256)).orderBy("lang", "source", "n_chars")
    return rows.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages (runs of PASSAGE_BYTES or more) that an earlier one has, or that they said before.

    A null text stays null; rows that share a doc_id do not shorten each other, rows without one stay whole. What is cut
    wholly stays as an empty text.
    """
    cut = chunks.deduplicate(docs.select(*COLUMNS), min_run=PASSAGE_BYTES)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows go or stay together, whatever their ids."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digest of the text that they decode to. A null text is an empty one; every row gives one."""
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS)))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_distinct),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the content-defined chunks have no SQL form; the tests hold what each stage keeps against plain versions on fixtures.
ORACLE_SQL = None
