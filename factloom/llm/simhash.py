"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint has 64 bits: bit b is 1 if over half of the hashes (XXH64, seed 42)
of a text's shingles of three words, repeats included, have it. Two fingerprints
that differ in at most two bits are linked.

Cut into two halves, at least one half of such a pair differs by at most one bit.
The index has the high half with one of its 32 bits left out, for each bit
(pairs whose high halves differ by at most one bit meet in the variant without
that bit), and the low half as it is (for pairs whose two bits are both in the
high half). That is 33 rows a fingerprint. Equal variants meet in a shuffle, and
their members are verified on all 64 bits inside the task; only links that
connect are written, fewer than a bucket has members.

Equal fingerprints are one from the start, so exact copies cost nothing. A half
that more than `HOT` fingerprints share (a group of near copies) is cut further:
for equal high halves the low half is indexed by its own two quarters in the same
way (16 variants and one), for high halves that differ in one bit each low quarter
as it is, since one of them is equal then. A bucket of these has at most 17 free
bits, so it holds at most 131,072 different fingerprints, whatever the table.
Large buckets are searched by flipping free bits, which takes time in proportion
to their members, not to their pairs.

Defined results: null and empty texts and texts without words have fingerprint
zero, which is linked like any other; texts of one or two words are one shingle;
repeated rows are each returned; a row without an id has a fingerprint, and its
links count, but no id of its own (its component is the smallest id reachable, or
null); very long texts are read in pieces of PIECE_BYTES; other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import join_hot, materialize, schema_of, tidy
from factloom.llm.neardup import components

WORDS, SEED = 3, 42
#: Fingerprints that share a half, from which it is cut further.
HOT = 1024
#: Bytes of a text, and hashes, that are worked on at once.
PIECE_BYTES, PIECE_HASHES = 1 << 20, 1 << 14
#: Members of a bucket from which bits are flipped instead of comparing pairs, and pairs held at once.
FLIPPED, PAIRS = 1024, 1 << 20

_digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
_HALF = (1 << 32) - 1


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (ASCII letters lower-cased, divided by ASCII white space), a piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            found = min((k for k in (text.find(s, end) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if k >= 0), default=len(text))
            end = found
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, in order, a piece at a time."""
    tail: list[bytes] = []
    short = True
    for piece in _word_pieces(text):
        words = tail + piece
        if len(words) >= WORDS:
            short = False
            yield np.fromiter(map(_digest, map(b" ".join, zip(words, words[1:], words[2:]))), np.uint64, len(words) - 2)  # noqa: B905 - of unlike lengths on purpose
            tail = words[-2:]
        else:
            tail = words
    if short and tail:
        yield np.array([_digest(b" ".join(tail))], np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        n += len(hashes)
        for at in range(0, len(hashes), PIECE_HASHES):
            bits = np.unpackbits(hashes[at : at + PIECE_HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (id, text) as id, fp (the fingerprint's 64 bits as a long)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(run, schema_of(id="long", fp="long"))




def hot_halves(fps: DataFrame, hot: int) -> DataFrame:
    """fps (distinct fp) with `bits`, the bits of its high half whose variant a hot high half fills, and `hot_low`."""
    halves = fps.select("fp", F.shiftrightunsigned("fp", 32).alias("high"), F.col("fp").bitwiseAND(F.lit(_HALF)).alias("low"))
    high = halves.groupBy("high").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    ones = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    filled = F.concat(F.array(F.struct("high", F.lit(_HALF).alias("bits"))), F.transform(ones, lambda b: F.struct(F.col("high").bitwiseXOR(b).alias("high"), b.alias("bits"))))
    near = high.select(F.explode(filled).alias("x")).groupBy(F.col("x.high").alias("high")).agg(F.bit_or("x.bits").alias("bits"))
    low = halves.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("low", F.lit(True).alias("hot_low"))
    known = join_hot(join_hot(halves, near, ["high"], "left"), low, ["low"], "left")
    return known.select("fp", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"), F.coalesce("hot_low", F.lit(False)).alias("hot_low"))


def _key(kind: int, bit: int, part: np.ndarray, rest: np.ndarray | int = 0) -> np.ndarray:
    """A bucket's name: what must agree (part, rest), and where it was taken from (kind, bit)."""
    return np.uint64(kind << 53 | bit << 48) | part << np.uint64(16) | np.uint64(rest)


def keys_of(fps: np.ndarray, bits: np.ndarray, hot_low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets (key) of fingerprints, with the index of each key's fingerprint."""
    high, low = fps >> np.uint64(32), fps & np.uint64(_HALF)
    quarter = {0: (low & np.uint64(0xFFFF), low >> np.uint64(16)), 1: (high & np.uint64(0xFFFF), high >> np.uint64(16))}

    def within(kind: int, at: np.ndarray, same: np.ndarray, other: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Equal `same` halves: of the other half the upper quarter without one bit, or the lower quarter as it is."""
        lower, upper = quarter[other]
        for b in range(16):
            yield _key(kind, b, same[at], upper[at] & np.uint64(0xFFFF ^ 1 << b)), at
        yield _key(kind + 1, 0, same[at], lower[at]), at

    for b in range(32):
        rest = high & np.uint64(_HALF ^ 1 << b)
        filled = (bits >> np.uint64(b) & np.uint64(1)).astype(bool)
        cold, warm = np.flatnonzero(~filled), np.flatnonzero(filled)
        yield _key(0, b, rest[cold]), cold
        for k in (0, 1):  # the high halves differ in this bit, so one of the low quarters is equal
            yield _key(1 + k, b, rest[warm], quarter[0][k][warm]), warm
    yield from within(3, np.flatnonzero(bits == _HALF), high, 0)
    yield _key(7, 0, low[~hot_low]), np.flatnonzero(~hot_low)
    yield from within(5, np.flatnonzero(hot_low), low, 1)


def variants(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """The index: rows (key, fp); fingerprints (distinct) that may be linked share a key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "bits"))
            for key, at in keys_of(own, bits, batch.column("hot_low").to_numpy(zero_copy_only=False).astype(bool)):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[at].view(np.int64))], names=["key", "fp"])

    return hot_halves(fps, hot).mapInArrow(run, schema_of(key="long", fp="long"))


def connect(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its component) once the pairs a, b are linked too."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def linked(fps: np.ndarray, distance: int = 2) -> np.ndarray:
    """For each of some distinct fingerprints (sorted, uint64) the index of the first of its component."""
    n = len(fps)
    labels = np.arange(n)
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    ones = [1 << b for b in range(64) if free >> b & 1]
    flips = ones + [x | y for k, x in enumerate(ones) for y in ones[:k]] if distance > 1 else ones
    if n < max(FLIPPED, len(flips)):
        step = max(1, PAIRS // n)
        for at in range(0, n, step):
            near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= distance
            a, b = np.nonzero(near)
            labels = connect(labels, a + at, b)
        return labels
    for flip in flips:
        for at in range(0, n, PAIRS):
            wanted = fps[at : at + PAIRS] ^ np.uint64(flip)
            place = np.searchsorted(fps, wanted)
            place[place == n] = 0
            a = np.flatnonzero(fps[place] == wanted)
            labels = connect(labels, a + at, place[a])
    return labels


def links(index: DataFrame) -> DataFrame:
    """Verified links (a, b) of the members of each bucket of the index, a the first of b's component there."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps = np.unique(np.concatenate(parts))
        if len(fps) > 1:
            labels = linked(fps)
            at = np.flatnonzero(labels != np.arange(len(fps)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fps[labels[at]].view(np.int64)), pa.array(fps[at].view(np.int64))], names=["a", "b"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
            # runs of one row inside the batch meet nothing
            some = (stops - starts > 1) | (starts == 0) | (stops == len(keys))
            for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True):
                if keys[a] != last:
                    if parts:
                        yield from flush(parts)
                    last, parts = keys[a], []
                parts.append(fps[a:b])
        if parts:
            yield from flush(parts)

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema_of(a="long", b="long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each of docs: id, fingerprint (16 hexadecimal digits), component_id."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(fingerprints(plain), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    edges = materialize(links(variants(classes.select("fp"), hot)).distinct(), "links")
    labels = materialize(components(edges), "components")
    named = classes.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = join_hot(named.select("fp", "component"), least, ["component"]).select("fp", "component_id")
    return join_hot(marked, found, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
