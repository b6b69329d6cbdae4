"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is `window` consecutive words of an item (a shorter item is one
window). The tokens of a window are its shingles of `shingle` consecutive
words.

1. Rarity: all occurrences of the windows' shingles are counted over all
   documents, and a window's shingles are ordered by that count. A window must
   be contained whole, so its necessary prefix is its single rarest shingle;
   a window with a shingle that occurs nowhere cannot occur and is done with.
2. Join: every occurrence of a prefix shingle in a document meets the windows
   of that prefix in a hash join. It brings the few words around it, so that
   the join's rows can be verified where they are; occurrences alike in all of
   these words are one row of a task, with the list of their places.
3. Bounds and verification: the window's place follows from the shingle's
   position in it (positional bound), its words must all be there (length
   bound), and are then compared as text.

No part of the benchmark goes through the driver. A Bloom filter of bounded
size (bits.py) keeps shingles that no window has from being shuffled.

Defined results: null texts have no words; items without words have no
windows; repeated item_ids are one item with the windows of all its rows; null
item_ids are left out; repeated documents each get their own row (equal texts
are searched once a task and joined back by a 128-bit digest); extra columns
stay, columns of the names that are added are replaced; an empty table gives
no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.bits import BitFilter, filter_of
from factloom.llm.common import SPANS, free_names, join_hot, materialize, schema_of, tidy
from factloom.llm.words import WordHashes, shingle_hashes

#: Occurrences that a task holds before it sends them, and distinct shingles before it adds up their counts.
HELD, COUNTED = 1 << 15, 1 << 20
#: Words that are hashed together.
LINE = 1 << 16

_TO_SPACE = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 32 if 0x41 <= b < 0x5B else 0x20 for b in range(256))
_MIX = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text in lower case (A-Z only): runs of digits, letters a-z and characters beyond ASCII."""
    return text.translate(_TO_SPACE).split()


def count_words(text: bytes) -> int:
    """How many there are, without making them."""
    inside = np.frombuffer(text.translate(_TO_SPACE), np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """A key of each shingle of so many words; shingles of other sizes have other keys."""
    return shingle_hashes(hashes, size) ^ np.uint64(size * _MIX % (1 << 64))


WINDOWS = schema_of(id="binary", item="string", words="string", length="int", keys=T.ArrayType(T.LongType()))


def cut_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """A row for each window of each item. benchmark: item, text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py() or b"")
                n = min(window, len(words))
                k = min(shingle, n)
                keys = shingle_keys(hashes.of(words), k).view(np.int64) if words else None
                for at in range(0, len(words) - n + 1 if words else 0, 4096):
                    starts = range(at, min(at + 4096, len(words) - n + 1))
                    joined = [b" ".join(words[i : i + n]) for i in starts]
                    own = np.concatenate([keys[i : i + n - k + 1] for i in starts])
                    offsets = np.arange(0, len(own) + 1, n - k + 1, dtype=np.int32)
                    columns = [pa.array([xxhash.xxh3_128_digest(w) for w in joined], pa.binary()), pa.array([item] * len(joined), pa.string())]
                    columns += [pa.array([w.decode() for w in joined], pa.string()), pa.array([n] * len(joined), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, own)], names=WINDOWS.names)

    return benchmark.mapInArrow(run, WINDOWS)


class Words:
    """The words of several texts in one line, so that their shingles are hashed and looked up together."""

    def __init__(self, digests: list[bytes], texts: list[list[bytes]], hashes: WordHashes) -> None:
        self.digests, self.words = digests, list(itertools.chain.from_iterable(texts))
        self.ends = np.cumsum([len(t) for t in texts])
        self.hashes = hashes.of(self.words)

    def wanted(self, bits: BitFilter, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, place in the line and text of the shingles of this size that the filter lets pass."""
        keys = shingle_keys(self.hashes, size)
        at = bits.passing(keys)
        text = np.searchsorted(self.ends, at, side="right")
        inside = at + size <= self.ends[text]
        return keys[at[inside]], at[inside], text[inside]


def lines_of(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[Words]:
    """The texts of batches of (digest, text) in groups; once: equal texts that are near each other count as one."""
    hashes, seen = WordHashes(), set()
    digests, texts, n = [], [], 0
    for batch in batches:
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if once:
                if digest in seen:
                    continue
                if len(seen) >= HELD:
                    seen.clear()
                seen.add(digest)
            digests.append(digest)
            texts.append(words_of(text.as_py()))
            n += len(texts[-1])
            if n >= LINE:
                yield Words(digests, texts, hashes)
                digests, texts, n = [], [], 0
    if n:
        yield Words(digests, texts, hashes)


def count_shingles(texts: DataFrame, wanted: BitFilter, sizes: list[int]) -> DataFrame:
    """(key, n): how often the wanted shingles occur in all documents; a few others are counted too. texts: digest, text."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def total() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for line in lines_of(batches, once=False):
            for k in sizes:
                held.append(line.wanted(shared.value, k)[0])
                n_held += len(held[-1])
            if n_held > COUNTED:
                yield total()
                held, n_held = [], 0
        if n_held:
            yield total()

    return texts.mapInArrow(run, schema_of(key="long", n="long")).groupBy("key").agg(F.sum("n").alias("n"))


def rarest_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows that can occur, each with its rarest shingle: id, words, length, key, offset."""
    tokens = windows.select("id", F.posexplode("keys").alias("offset", "key"))
    counted = join_hot(tokens, counts, ["key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("id").agg(F.min(F.struct("n", "offset", "key")).alias("rarest")).where("rarest.n > 0")
    return windows.join(rarest, "id").select("id", "words", "length", "rarest.key", "rarest.offset")


OCCURRENCES = schema_of(key="long", lead="int", context="string", digests=T.ArrayType(T.BinaryType()), places=T.ArrayType(T.IntegerType()))


def occurrences(texts: DataFrame, wanted: BitFilter, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """Where the wanted shingles occur: the words around (lead of them before the shingle), and all places with the same words."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def send(held: dict[tuple, list]) -> pa.RecordBatch:
        keys, leads, contexts = zip(*held, strict=True)
        digests, places = ([[p[i] for p in found] for found in held.values()] for i in (0, 1))
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, leads, [c.decode() for c in contexts], digests, places), kinds, strict=True)], names=OCCURRENCES.names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = defaultdict(list)
        n_held = 0
        for line in lines_of(batches, once=True):
            starts = np.concatenate([[0], line.ends[:-1]]).tolist()
            for k in sizes:
                reach = window if k == shingle else k  # an item of fewer words is one shingle
                keys, at, text = line.wanted(shared.value, k)
                for key, place, t in zip(keys.view(np.int64).tolist(), at.tolist(), text.tolist(), strict=True):
                    first = max(starts[t], place - reach + k)
                    held[key, place - first, b" ".join(line.words[first : min(place + reach, line.ends[t])])].append((line.digests[t], place - starts[t]))
                n_held += len(keys)
                if n_held >= HELD:
                    yield send(held)
                    held, n_held = defaultdict(list), 0
        if held:
            yield send(held)

    return texts.mapInArrow(run, OCCURRENCES)


def verified(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(digest, start, stop, id): the windows of the prefixes that stand whole around the occurrences."""
    whole = F.slice(F.split("context", " "), F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1)), F.col("length"))
    fits = (F.col("lead") >= F.col("offset")) & (F.array_join(whole, " ") == F.col("words"))
    hits = found.join(prefixes, "key").where(fits).select("id", "offset", "length", F.explode(F.arrays_zip("digests", "places")).alias("at"))
    start = F.col("at.places") - F.col("offset")
    return hits.select(F.col("at.digests").alias("digest"), start.alias("start"), (start + F.col("length")).alias("stop"), "id")


def _runs(hits: DataFrame) -> DataFrame:
    """The spans of each text, overlapping or touching ones merged."""
    line = Window.partitionBy("digest").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("digest", "start", "stop").distinct().withColumn("opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    runs = opened.withColumn("run", F.sum("opens").over(line)).groupBy("digest", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hit_spans"))


HITS = schema_of(n_words="long", hit_spans=SPANS, items=T.ArrayType(T.StringType()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """docs with n_words, hit_spans (runs of hit words) and items (those with a window in the document)."""
    (digest,) = free_names(docs, "__digest")
    text = F.col(text_col).cast("string")
    key = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    kept = docs.select(*[c for c in docs.columns if c not in HITS.names], key.alias(digest))

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_words(t.as_py() or b"") for t in batch.column(text_col).cast(pa.string()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_words"])

    whole = kept.mapInArrow(counted, T.StructType([*kept.schema.fields, HITS["n_words"]]))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("digest"), text.alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string"))
    cut = materialize(cut_windows(items, window, shingle), "windows")
    sizes = sorted(r[0] for r in cut.select(F.col("length") - F.size("keys") + 1).distinct().collect())  # at most `shingle` numbers
    if not sizes:
        return whole.drop(digest).withColumns({n: F.array().cast(HITS[n].dataType) for n in HITS.names[1:]})
    windows = materialize(cut.drop("item").dropDuplicates(["id"]), "windows")
    vocabulary = materialize(windows.select(F.explode("keys").alias("key")).distinct(), "shingles")
    prefixes = materialize(rarest_prefixes(windows, count_shingles(texts, filter_of(vocabulary), sizes)), "prefixes")
    rare = filter_of(materialize(prefixes.select("key").distinct(), "shingles"))
    hits = materialize(verified(occurrences(texts, rare, sizes, window, shingle), prefixes), "hits")
    held = hits.select("digest", "id").distinct().join(cut.select("id", "item").distinct(), "id")
    names = held.select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = _runs(hits).join(names, "digest").withColumnRenamed("digest", digest)
    empty = {n: F.coalesce(n, F.array().cast(HITS[n].dataType)) for n in HITS.names[1:]}
    return join_hot(whole, found, [digest], "left").drop(digest).withColumns(empty)
