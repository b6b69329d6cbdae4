"""Near-duplicate groups by MinHash with sequential Bayesian verification.

A document's set is its distinct shingles of five words. Documents with equal
sets are one class from the start. Classes that agree in a band of their
MinHash signatures are candidates; signatures are compared batch by batch, and
a pair is dropped once the posterior probability that its similarity reaches
the threshold falls below `miss` (prior: all similarities alike). Survivors are
verified exactly on their full sets.

Pairs within a bucket are never written out as such. First every member is
paired with the bucket's smallest one, and those pairs are pruned and verified.
Where a bucket still holds several components, its members are compared with
each other inside the tasks, in blocks: pairs of different components are
pruned and verified there (in the first band that they share), and only links
that connect components are written, fewer than there are members. So every
candidate pair is verified, pruned by its posterior, or already connected by
verified links: no link is lost but for the banding's and the posterior's
stated chances (at 0.75 the banding misses a pair with probability 5e-6, above
it less).

Components are found by alternating large-star and small-star steps, each
written to the shared folder.

Defined results: null and empty texts have empty sets, which are linked with
nothing; texts of one to four words are one shingle; rows that share a doc_id
are one document with several texts; rows with a null doc_id are their own
component (null) and kept; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import packed
from factloom.llm.common import join_hot, materialize, schema_of, tidy
from factloom.llm.words import WordHashes, shingle_hashes

WORDS, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Members of a bucket that are compared with each other in one block.
BLOCK = 4096

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_ODD = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

SKETCH = schema_of(id="long", n_shingles="long", digest="binary", signature="binary")
PAIR = schema_of(a="long", b="long")


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (ASCII letters lower-cased, words divided by ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(hashes.of(words), min(WORDS, len(words))) + np.uint64(min(WORDS, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash signature: for each hash function the least value over the set."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(low, ((h[None, at : at + 1024] ^ _XOR) * _ODD).min(axis=1), out=low)
    return low


def sketch(docs: DataFrame) -> DataFrame:
    """docs (id, text) with the size and digest of each set, and its signature (null for empty sets)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"", hashes)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).tobytes() if len(s) else None))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=SKETCH.names)

    return docs.mapInArrow(run, SKETCH)


def shared_buckets(signatures: DataFrame) -> DataFrame:
    """(bucket, id) for all band buckets with several ids. signatures: id, signature."""
    tasks = packed.tasks_for(signatures.sparkSession, signatures.count() * 4 * HASHES)
    parts = packed.parts_of(tasks)
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix = np.uint64(0xD6E8FEB86659FD93)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                ids = batch.column(0).slice(at, 10_000).to_numpy(zero_copy_only=False)
                packed_signatures = b"".join(batch.column(1).slice(at, 10_000).to_pylist())
                values = np.frombuffer(packed_signatures, np.uint32).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
                keys = np.broadcast_to(band, (len(ids), BANDS)).copy()
                for k in range(ROWS):
                    keys = (keys ^ values[:, :, k]) * mix
                    keys ^= keys >> np.uint64(32)
                keys = keys & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)  # the band can be told from the bucket
                yield packed.batch_of(list(packed.send(keys.ravel(), np.repeat(ids, BANDS), parts, all_of_shared=True, width=8)))

    @tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = np.frombuffer(b"".join(keys), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), i, np.int64))], names=["bucket", "id"])

    answers = packed.answer(signatures.mapInArrow(send, packed.SENT), tasks, width=8, all_of_shared=True)
    return answers.mapInArrow(unpack, schema_of(bucket="long", id="long")).distinct()


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n hashes a pair with fewer than m matches is dropped.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), whose
    upper tail is a binomial sum.
    """

    def posterior(m: int, n: int) -> float:
        return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 1) if posterior(m, n) >= miss)) for n in range(BATCH, HASHES + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of signatures a and b that no batch drops."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        passed = matches >= least
        alive, matches, done = alive[passed], matches[passed], n
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def prune(pairs: DataFrame, sketches: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that survive the comparison of their signatures."""
    left = sketches.select(F.col("id").alias("a"), F.col("signature").alias("of_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("signature").alias("of_b"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = pa.array(survivors(_signatures(batch.column("of_a")), _signatures(batch.column("of_b")), bounds))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(alive) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, PAIR)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union, on full sets. sets: id, shingles."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.intersect1d(s, t, assume_unique=True).size
                linked.append(100 * both >= threshold * (len(s) + len(t) - both))
            chosen = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, PAIR)


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of a sorted set with each other set."""
    joined = np.concatenate(others)
    at = np.searchsorted(one, joined)
    at[at == len(one)] = 0
    ends = np.cumsum([len(x) for x in others])
    return np.diff(np.concatenate([[0], np.cumsum(one[at] == joined)[ends - 1]]))


class _Block:
    """Members of one bucket: two blocks of it, or one with itself."""

    def __init__(self, rows: list[tuple], band: int) -> None:
        self.band = band
        self.mine, self.ids, self.labels = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.signatures = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, HASHES)
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows]

    def first_shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others with which i shares no earlier band than this."""
        earlier = self.signatures[others, : self.band * ROWS] == self.signatures[i, : self.band * ROWS]
        return others[~earlier.reshape(len(others), self.band, ROWS).all(axis=2).any(axis=1)]

    def links(self, low: int, high: int, bounds: list[tuple[int, int]], threshold: int) -> Iterator[tuple[int, int]]:
        """Verified links that connect components, each of them new to what was connected before."""
        one, two = np.flatnonzero(self.mine == low), np.flatnonzero(self.mine == high)
        for k, i in enumerate(one.tolist()):
            others = two[k + 1 :] if low == high else two
            others = others[self.labels[others] != self.labels[i]]
            if not len(others):
                continue
            others = self.first_shared(i, others)
            others = others[survivors(np.broadcast_to(self.signatures[i], (len(others), HASHES)), self.signatures[others], bounds)]
            for at in range(0, len(others), 256):
                part = others[at : at + 256]
                part = part[self.labels[part] != self.labels[i]]
                if not len(part):
                    continue
                sizes = np.array([len(self.sets[j]) for j in part.tolist()])
                both = _overlaps(self.sets[i], [self.sets[j] for j in part.tolist()])
                for j in part[100 * both >= threshold * (sizes + len(self.sets[i]) - both)].tolist():
                    if self.labels[j] != self.labels[i]:
                        yield int(self.ids[i]), int(self.ids[j])
                        self.labels[self.labels == self.labels[j]] = self.labels[i]


def compare_rest(members: DataFrame, signatures: DataFrame, sets: DataFrame, bounds: list[tuple[int, int]], threshold: int) -> DataFrame:
    """Verified links between different components within each bucket. members: bucket, id, component.

    A bucket of more than BLOCK members is dealt out as pairs of blocks.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = join_hot(members, sizes, ["bucket"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = (
        placed.join(signatures, "id")
        .join(sets, "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "id", "component", "signature", "shingles")
    )

    def flush(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(_Block(rows, key[0] % BANDS).links(key[1], key[2], bounds, threshold))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found]), pa.array([max(p) for p in found])], names=["a", "b"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for bucket, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (bucket, low, high):
                    if rows:
                        yield from flush(key, rows)
                    key, rows = (bucket, low, high), []
                rows.append(row)
        if rows:
            yield from flush(key, rows)

    grouped = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return grouped.mapInArrow(run, PAIR).where("a <> b")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    pointed = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    chained = pointed.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return pointed.where("n > 1").select("u").unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes of edges (a, b), by alternating star steps."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while not _is_forest_of_stars(now):
        # large star: every larger neighbour points to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = join_hot(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_hot(large, least, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold several."""
    named = join_hot(buckets, labels.withColumnRenamed("node", "id"), ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return join_hot(named, mixed, ["bucket"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, miss: float = MISS) -> DataFrame:
    """One row for each of docs: id, n_shingles, component_id, kept. threshold: of similarity, in hundredths."""
    spark: SparkSession = docs.sparkSession
    bounds = least_matches(threshold / 100, miss)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(sketch(plain), "sketches")
    usable = sketches.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = usable.groupBy("digest").agg(F.min("id").alias("class"))
    signatures = materialize(usable.join(classes.select(F.col("class").alias("id")).distinct(), "id", "left_semi").select("id", "signature"), "signatures")
    buckets = materialize(shared_buckets(signatures), "buckets")
    wanted = buckets.select("id").distinct()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [shingle_set(t.as_py() or b"", hashes).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    sets = materialize(plain.join(wanted, "id", "left_semi").mapInArrow(run, schema_of(id="long", shingles="binary")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(verify(prune(pairs, signatures, bounds), sets, threshold), "links")

    smallest = buckets.groupBy("bucket").agg(F.min("id").alias("a"))
    star = join_hot(buckets, smallest, ["bucket"]).where("a <> id").select("a", F.col("id").alias("b")).distinct()
    edges = linked(star)
    labels = components(edges)
    rest = materialize(_labelled(buckets, labels), "mixed")
    if not rest.isEmpty():
        more = materialize(compare_rest(rest, signatures, sets, bounds, threshold), "links")
        if not more.isEmpty():
            labels = components(edges.unionByName(more))

    rows = join_hot(sketches.select("id", "n_shingles", "digest"), classes, ["digest"], "left").withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")))
    named = join_hot(rows.select("id", "n_shingles", "node"), labels, ["node"], "left").withColumn("component_id", F.coalesce("component", "node"))
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
