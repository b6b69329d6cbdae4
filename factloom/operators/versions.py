"""Tables that change whole or not at all: buckets written beside the old ones, a check, and one atomic step that makes them current.

A table is a folder: `data/<load>/bucket=<k>` holds rows, `versions/<n>` says which
folder each bucket is read from. A load writes only the buckets of the keys that it
touches, checks what it has written, and then puts the next version in place by a
rename that fails if that version is there already. So readers see the old table
or the new one, a job that dies before the rename leaves the old one, and of two
loads at once the later fails and may run again. What a dead job left is data that
no version names; `sweep` deletes it.

The work of a load is in proportion to the touched buckets. What passes through
the driver is the version: a bucket's number and folder, at most BUCKETS of them.

Defined results: rows with a null key are in a bucket of their own; a load of no
rows changes nothing; a table that is not there reads as empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import writes

#: Buckets of a table; a version names a folder for each.
BUCKETS = 64


class Refused(Exception):
    """What was written did not pass its check; the table stays as it was."""


class Overtaken(Exception):
    """Another load has put its version in place first; read the table again and repeat the load."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([root, *parts]))


def current(spark: SparkSession, root: str) -> dict:
    """The newest version: number, schema, and the folder of each bucket."""
    files, at = _files(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(at("versions"))] if files.exists(at("versions")) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return {"number": 0, "schema": None, "buckets": {}}
    (line,) = spark.read.text(f"{root}/versions/{max(numbers)}", wholetext=True).collect()
    return json.loads(line.value)


def read(spark: SparkSession, root: str, schema: T.StructType | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of all buckets or some. schema: of a table that is not there yet."""
    version = current(spark, root)
    known = T.StructType.fromJson(version["schema"]) if version["schema"] else schema
    if known is None:
        raise FileNotFoundError(f"no table at {root}")
    folders = [f"{root}/{f}" for k, f in version["buckets"].items() if buckets is None or int(k) in buckets]
    return spark.read.schema(known).parquet(*folders) if folders else spark.createDataFrame([], known)


def bucket_of(key: str) -> Column:
    return F.when(F.col(key).isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS))).cast("int")


def stage(rows: DataFrame, root: str, key: str) -> dict[int, str]:
    """Writes rows by bucket into a new folder that nobody reads yet; the folder of each bucket."""
    load = f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket_of(key))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{load}")
    files, at = _files(rows.sparkSession, root)
    names = [s.getPath().getName() for s in files.listStatus(at(load))]
    return {int(n.removeprefix("bucket=")): f"{load}/{n}" for n in names if n.startswith("bucket=")}


def switch(spark: SparkSession, root: str, before: dict, schema: T.StructType, buckets: dict[int, str]) -> int:
    """Makes these buckets the table, if the version read before is still the newest; its number."""
    files, at = _files(spark, root)
    number = before["number"] + 1
    draft, target = at("versions", f"draft-{uuid.uuid4().hex}"), at("versions", str(number))
    files.mkdirs(at("versions"))
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"number": number, "schema": json.loads(schema.json()), "buckets": {str(k): f for k, f in sorted(buckets.items())}}).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise Overtaken(f"version {number} of {root} is there already")
    return number


def replace(spark: SparkSession, root: str, key: str, touched: DataFrame, merge: Callable[[DataFrame], DataFrame], schema: T.StructType, check: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Replaces the buckets of the touched keys by merge(their rows), if check(what was written) finds no row; the version's number.

    touched: rows with the key; merge gets the old rows of the buckets that these fall into, all keys of them. Nothing touched changes nothing.
    """
    before = current(spark, root)
    hit = sorted(r.bucket for r in touched.select(bucket_of(key).alias("bucket")).distinct().collect())  # at most BUCKETS + 1 numbers
    if not hit:
        return before["number"]
    merged = merge(read(spark, root, schema, hit))
    staged = stage(merged, root, key)
    if check is not None:
        written = spark.read.schema(merged.schema).parquet(*[f"{root}/{f}" for f in staged.values()]) if staged else spark.createDataFrame([], merged.schema)
        found = check(written).head(5)
        if found:
            raise Refused(f"{root}: {[r.asDict() for r in found]}")
    kept = {int(k): f for k, f in before["buckets"].items() if int(k) not in hit}
    return switch(spark, root, before, merged.schema, kept | staged)


def rebuild(rows: DataFrame, root: str, key: str, check: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Replaces a derived table whole."""
    spark = rows.sparkSession
    before = current(spark, root)
    staged = stage(rows, root, key)
    if check is not None and staged:
        found = check(spark.read.schema(rows.schema).parquet(*[f"{root}/{f}" for f in staged.values()])).head(5)
        if found:
            raise Refused(f"{root}: {[r.asDict() for r in found]}")
    return switch(spark, root, before, rows.schema, staged)


def reset(spark: SparkSession, root: str) -> int:
    """Empties a table, in one step too."""
    before = current(spark, root)
    if not before["schema"]:
        return 0
    return switch(spark, root, before, T.StructType.fromJson(before["schema"]), {})


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Deletes what the newest version does not read: data of old versions and of dead jobs, old versions, drafts. Run it while no load runs and no old version is read."""
    files, at = _files(spark, root)
    version = current(spark, root)
    used = {f.split("/")[1] for f in version["buckets"].values()}
    gone = []
    for folder, keep in (("data", used), ("versions", {str(version["number"])})):
        if files.exists(at(folder)):
            for status in files.listStatus(at(folder)):
                name = status.getPath().getName()
                if name not in keep and not name.startswith("."):
                    files.delete(status.getPath(), True)
                    gone.append(f"{folder}/{name}")
    return sorted(gone)


def load_claims(spark: SparkSession, root: str, claims: DataFrame, anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """Loads the claims of documents: those of a document replace all that it had, or none where one is not proved. The refused documents, with the reason.

    What was written is checked before it counts: no claim of a refused document may be among its new rows, and every new claim is there once.
    """
    refused = writes.refused_documents(claims, anchors, documents)
    new = claims.join(refused.select("document_id"), "document_id", "left_anti")
    wanted = new.groupBy("claim_id").agg(F.count("*").alias("n"))

    def check(written: DataFrame) -> DataFrame:
        own = written.join(new.select("document_id").distinct(), "document_id", "left_semi").groupBy("claim_id").agg(F.count("*").alias("m"))
        return wanted.join(own, "claim_id", "full").where("n IS NULL OR m IS NULL OR n <> m")

    replace(spark, root, "document_id", new, lambda old: writes.loaded(old, claims, refused).select(*claims.columns), claims.schema, check)
    return refused


# --- only what changed


def fingerprints(key: str, **inputs: DataFrame) -> DataFrame:
    """key, fingerprint: of all rows of the inputs that belong to a key, whatever their order and layout.

    A row counts by two hashes of its columns, each input by the number of its rows and the sums of these, so nothing is
    gathered by key; equal rows count as often as they are there.
    """
    parts = []
    for name, rows in sorted(inputs.items()):
        columns = sorted(c for c in rows.columns if c != key)
        said = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        hashed = rows.where(F.col(key).isNotNull()).select(key, F.xxhash64(said).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), said).cast("decimal(38,0)").alias("b"))
        sums = hashed.groupBy(key).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        parts.append(sums.select(key, F.concat_ws(":", F.lit(name), "n", "a", "b").alias("part")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "|"), 256).alias("fingerprint"))


def build_changed(spark: SparkSession, root: str, key: str, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """Builds the keys anew whose inputs changed since they were built, drops those that are gone, and gives the changed keys.

    build gets the inputs of the changed keys alone and returns rows with the key. What each key was built from is a table
    beside the results (`<root>-built`), written after them: a job that dies in between builds those keys again.
    """
    now = fingerprints(key, **inputs)
    kind = T.StructType([now.schema[key], now.schema["fingerprint"]])
    known = read(spark, f"{root}-built", kind)
    both = now.withColumnRenamed("fingerprint", "now").join(known.withColumnRenamed("fingerprint", "built"), key, "full")
    changed = both.where(~F.col("now").eqNullSafe(F.col("built"))).select(key, "now")
    # written once: the table it is read from changes below
    path = f"{root}/data/{uuid.uuid4().hex}"
    changed.write.parquet(path)
    changed = spark.read.schema(changed.schema).parquet(path)
    alive = changed.where("now IS NOT NULL").select(key)
    made = build({name: rows.join(alive, key, "left_semi") for name, rows in inputs.items()})
    replace(spark, root, key, changed, lambda old: old.join(changed, key, "left_anti").select(*made.columns).unionByName(made), made.schema)
    fresh = changed.where("now IS NOT NULL").withColumnRenamed("now", "fingerprint")
    replace(spark, f"{root}-built", key, changed, lambda old: old.join(changed, key, "left_anti").select(*fresh.columns).unionByName(fresh), kind)
    return changed.select(key, F.col("now").isNull().alias("gone"))
