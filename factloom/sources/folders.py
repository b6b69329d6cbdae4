"""Documents that come from outside: the files of a folder with its manifest, and what became of sources since they were read.

Files are rows of Spark's binaryFile source, so a file's bytes go from its task to
the store and never through the driver. A hash decides what is known: equal files
of a case are one document, whatever they are called.

Defined results: files without content are of zero bytes; a name that a manifest
states twice has the last of its kinds; a null hash of a fetch is a fetch that
failed, and a document that was not fetched keeps what it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import versions

# fixed values: files that are imported, what beside them is none, the first bytes of a PDF, and how a kind was found
SUFFIXES, NO_DOCUMENT = "{[pP][dD][fF],[jJ][sS][oO][nN]}", ["manifest.json", "model_responses.json"]
PDF, SET, BY_SUFFIX = b"%PDF", "Set when added.", "JSON file."
# fixed values: kinds of documents
KINDS = ["salary_slip", "bank_statement", "credit_report", "itr_json", "od_sanction", "other", "form16_part_a", "form16_part_b", "tax_statement", "itr_ack", "kyc", "loan_sanction", "gst_certificate", "udyam_certificate", "financials", "itr_computation", "business_proof", "loan_soa"]
# fixed value: of these sources only quotes and a link are shown, so they are looked up again
QUOTED = "quote_and_link"

FILES = "path string, content binary"


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the documents that lie in the folder itself, not under it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = f"{folder}/*.{SUFFIXES}"
    listed = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern))
    # the source passes over files of no bytes
    bare = spark.createDataFrame([(s.getPath().toString(), bytearray()) for s in listed if s.isFile() and not s.getLen()], FILES)
    if not listed:
        return bare
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    # a folder that is called like a file is no file
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    return found.where(depth == F.lit(files.makeQualified(root).toString().rstrip("/").count("/") + 1)).select("path", "content").unionByName(bare)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file and kind of each file that the folder's manifest names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string, kind string, n long")
    return spark.read.schema("file string, kind string").json(str(path), multiLine=True).withColumn("n", F.monotonically_increasing_id())


def imported(files: DataFrame, named: DataFrame, known: DataFrame) -> DataFrame:
    """One row a file: case_id, filename, sha256, byte_size, media_type, kind, kind_basis, refusal, same_as (the case's first file, by name, with its bytes) and is_new, with path and content.

    files: case_id, path, content; named: file, kind, and n, their order; known: case_id, sha256. Files that are no document
    by their name are left out; a kind that is none is refused, and such a file is not new.
    """
    kinds = named.groupBy("file").agg(F.max_by("kind", "n").alias("stated"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    data = F.coalesce("content", F.lit(b""))
    told = files.withColumn("filename", name).where(~F.col("filename").isin(NO_DOCUMENT)).join(kinds, F.col("filename") == F.col("file"), "left")
    is_json = F.lower("filename").endswith(".json")
    media = F.when(is_json, "application/json").when(F.substring(data, 1, 4) == F.lit(PDF), "application/pdf").otherwise("application/octet-stream")
    kind = F.coalesce("stated", F.when(is_json, "itr_json").otherwise("other"))
    basis = F.when(F.col("stated").isNotNull(), SET).when(is_json, BY_SUFFIX)
    refusal = F.when(~kind.isin(KINDS), F.concat(F.lit("unknown document kind "), kind))
    read = told.select("case_id", "filename", F.sha2(data, 256).alias("sha256"), F.length(data).cast("long").alias("byte_size"), media.alias("media_type"), kind.alias("kind"), basis.alias("kind_basis"), refusal.alias("refusal"), "path", data.alias("content"))
    # only names and hashes are ordered; the bytes do not pass through the window
    heads = read.where("refusal IS NULL").select("case_id", "sha256", "filename", "path")
    first = heads.groupBy("case_id", "sha256").agg(F.min(F.struct("filename", "path")).alias("first"))
    old = known.select("case_id", "sha256").distinct().withColumn("__known", F.lit(True))
    joined = read.join(first, ["case_id", "sha256"], "left").join(old, ["case_id", "sha256"], "left")
    new = F.col("refusal").isNull() & F.col("__known").isNull() & (F.struct("filename", "path") == F.col("first"))
    return joined.withColumn("same_as", F.col("first.filename")).withColumn("is_new", F.coalesce(new, F.lit(False))).drop("first", "__known")


STORED = ["case_id", "filename", "sha256", "byte_size", "media_type", "kind", "kind_basis", "content"]


def import_folder(spark: SparkSession, root: str, case_id: int, folder: str) -> DataFrame:
    """Adds a folder's new documents to the store at `root`, all or none; what each file became, without its bytes."""
    files = folder_files(spark, folder).withColumn("case_id", F.lit(case_id).cast("long"))
    empty = files.select("case_id", F.lit("").alias("filename"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("byte_size"), *[F.lit("").alias(c) for c in STORED[4:7]], "content").schema
    known = versions.read(spark, root, empty).select("case_id", "sha256")
    told = imported(files, manifest(spark, folder), known)
    new = told.where("is_new").select(*STORED)
    # the answer is taken before the load: afterwards nothing would be new
    rows = [r.asDict() for r in told.drop("content").collect()]  # a case's folder: names, not bytes
    versions.replace(spark, root, "sha256", new, lambda old: old.unionByName(new), empty)
    return spark.createDataFrame([tuple(r[c] for c in r) for r in rows], told.drop("content").schema)


def drift(documents: DataFrame, fetched: DataFrame) -> DataFrame:
    """documents with source_changed_at and source_changed_sha256 as a look at their sources leaves them, and what is to be told of it (drift).

    documents: document_id, policy, sha256, source_changed_at, source_changed_sha256; fetched: document_id, fetched_at, sha256. The newest fetch
    counts. A hash other than the stored one stamps the document, when it was first noticed; the stored one clears it.
    """
    newest = Window.partitionBy("document_id").orderBy(F.desc("fetched_at"), F.desc_nulls_last("sha256"))
    seen = fetched.withColumn("__n", F.row_number().over(newest)).where("__n = 1").select("document_id", F.col("fetched_at").alias("__at"), F.col("sha256").alias("__now"))
    joined = documents.join(seen, "document_id", "left")
    looked = F.coalesce(F.col("policy") == QUOTED, F.lit(False)) & F.col("__at").isNotNull()
    same, other = F.col("__now") == F.col("sha256"), F.col("__now").isNotNull() & ~F.coalesce(F.col("__now") == F.col("sha256"), F.lit(False))
    told = F.when(looked & F.col("__now").isNull(), "not fetched").when(looked & other, "changed").when(looked & same & F.col("source_changed_at").isNotNull(), "matches again")
    marked = joined.withColumn("drift", told)
    at = F.when(F.col("drift") == "changed", F.coalesce("source_changed_at", "__at")).when(F.col("drift") == "matches again", None).otherwise(F.col("source_changed_at"))
    what = F.when(F.col("drift") == "changed", F.col("__now")).when(F.col("drift") == "matches again", None).otherwise(F.col("source_changed_sha256"))
    return marked.withColumns({"source_changed_at": at, "source_changed_sha256": what}).drop("__at", "__now")
