"""Phrase collocations by bucket-counted passes (PCY, DHP) with Apriori pruning.

Pass k counts phrases of k words, and hashes those of k + 1 words into buckets.
A phrase of k words is counted exactly only if its bucket of the pass before
reached the least count, and both its phrases of k - 1 words may be frequent
(a bounded Bloom filter of the frequent ones; the bucket bitmap and the filter
pass too much at times, never too little). Exact counts are kept by the words
themselves, combined in each task and then summed by (group, phrase); the
frequent ones are written to the shared folder, and everything after (cuts,
scores, containment, ranking) is joins of those tables. Bucket counts are
combined in each task and summed by pieces of the bucket range; only the bitmap
comes to the driver. It has a bit for about each 64 bytes of text, at most
LARGEST (64 MB); beyond that (some 30 GB) buckets get fuller and prune less, and
the Apriori filter does most of the work.

Words and pieces: ASCII letters are lower-cased; texts are split at
`[.,;:!?\\x0A-\\x0D]` into pieces, those at spaces and tabs into words; phrases do
not cross pieces.

A candidate is a phrase of 2 to 5 words that occurs `least` times in its group.
Cut after its first k words, with l and r the counts of the two parts and n that
of all words, a cut scores floor(1000 a n / (l r)); the cut with the lowest score
counts. Candidates that a longer candidate contains and nearly always
accompanies (100 f(longer) >= absorbed a) are dropped. It is enough to look at
candidates of one word more: what a longer one contains, one of these contains
too, and it is at least as frequent.

Defined results: null and empty texts have no words; a null group is `und`, one
group with rows that say so; repeated rows and rows without an id count each;
equal scores and counts are ordered by the phrase's bytes; long texts are taken
whole (a text's words are held in one task, as numbers); other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bits import LARGEST, PIECE, BitFilter, filter_of
from factloom.llm.common import join_hot, materialize, schema_of, tidy
from factloom.llm.words import shingle_hashes

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text for each bucket, and the smallest number of buckets.
BYTES_A_BUCKET, FEWEST_BUCKETS = 64, PIECE
#: Different words that a task numbers, phrase occurrences held, and bytes of text read at once.
VOCABULARY, HELD, BATCH_BYTES = 1 << 20, 1 << 20, 4 << 20

# fixed values: what ends a piece
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = b"."

COUNTS = schema_of(lang="string", phrase="string", n="long")


class _Numbered(dict):
    """Numbers for the words of a task, in order of appearance; 0 is the end of a piece."""

    def __init__(self) -> None:
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def numbered(texts: list[bytes], numbers: _Numbered) -> np.ndarray:
    """The words of texts as numbers, with a 0 at each end of a piece."""
    joined = _BREAK.join(texts).translate(_TABLE)
    words = joined.replace(_BREAK, b" . ").split()
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def starts_of(ids: np.ndarray, k: int) -> np.ndarray:
    """Where phrases of k words start."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(ends[k:] == ends[:-k])


def summed(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows once, with their counts added. Rows are grouped by hash and then compared, so the sums are exact."""
    if not len(rows):
        return hashes, rows, counts
    kept, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    if (rows[first][of] == rows).all():
        return kept, rows[first], np.bincount(of, counts, len(kept)).astype(np.int64)
    found: dict[tuple, list] = {}
    for h, row, n in zip(hashes.tolist(), map(tuple, rows.tolist()), counts.tolist(), strict=True):
        found.setdefault(row, [h, 0])[1] += n
    return np.array([x[0] for x in found.values()], np.uint64), np.array(list(found), rows.dtype), np.array([x[1] for x in found.values()], np.int64)


def phrase_keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from those of the words (which have the group mixed in)."""
    return shingle_hashes(hashes, k) if k > 1 else hashes * np.uint64(0x9E3779B97F4A7C15)


def _group_seed(group: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(group.encode()))


class _Pass:
    """One task's share of pass k: exact counts of candidates, and buckets of the next length."""

    def __init__(self, k: int, last: int, width: int, frequent: BitFilter | None, filled: BitMap | None) -> None:
        self.k, self.last, self.width, self.frequent, self.filled = k, last, width, frequent, filled
        self.numbers, self.hashes = _Numbered(), np.zeros(0, np.uint64)
        self.counted: dict[str, list[tuple]] = {}
        self.held = 0
        self.buckets: list[np.ndarray] = []
        self.in_buckets = 0

    def word_hashes(self) -> np.ndarray:
        if len(self.hashes) < len(self.numbers):
            new = list(self.numbers)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return self.hashes

    def read(self, group: str, texts: list[bytes]) -> None:
        ids = numbered(texts, self.numbers)
        hashes = self.word_hashes()[ids] ^ _group_seed(group)
        starts = starts_of(ids, self.k)
        own = phrase_keys(hashes, self.k)
        taken = np.zeros(len(own), bool)
        taken[starts] = True
        if self.k > 1:
            # a phrase one shorter may be frequent or not: asked once for each different one
            shorter, of = np.unique(phrase_keys(hashes, self.k - 1), return_inverse=True)
            may_be = np.zeros(len(shorter), bool)
            may_be[self.frequent.passing(shorter)] = True
            may_be = may_be[of]
            taken &= may_be[:-1] & may_be[1:] & self.filled.has(own)
        at = np.flatnonzero(taken)
        rows = ids[at[:, None] + np.arange(self.k)].astype(np.int32)
        counts = summed(own[at], rows, np.ones(len(at), np.int64))
        self.counted.setdefault(group, []).append(counts)
        self.held += len(counts[1])
        if self.k < self.last:
            following = starts_of(ids, self.k + 1)
            if self.k > 1:
                following = following[taken[following] & taken[following + 1]]
            self.buckets.append(phrase_keys(hashes, self.k + 1)[following] >> np.uint64(65 - self.width.bit_length()))
            self.in_buckets += len(following)

    def combine(self) -> None:
        for group, parts in self.counted.items():
            self.counted[group] = [summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
        self.held = sum(len(parts[0][1]) for parts in self.counted.values())

    def send_counts(self) -> Iterator[pa.RecordBatch]:
        self.combine()
        words = list(self.numbers)
        for group, ((_, rows, counts),) in self.counted.items():
            for at in range(0, len(rows), 65_536):
                phrases = [b" ".join([words[i] for i in row]) for row in rows[at : at + 65_536].tolist()]
                made = pa.array(phrases, pa.binary()).cast(pa.string())
                yield _sent(pa.array([group] * len(phrases), pa.string()), made, pa.array(counts[at : at + 65_536]), None, None)
        self.counted, self.held = {}, 0
        self.numbers, self.hashes = _Numbered(), np.zeros(0, np.uint64)

    def send_buckets(self) -> Iterator[pa.RecordBatch]:
        """Counts of buckets, packed by pieces of the bucket range."""
        if not self.in_buckets:
            return
        buckets, counts = np.unique(np.concatenate(self.buckets), return_counts=True)
        self.buckets, self.in_buckets = [], 0
        pieces = (buckets >> np.uint64(PIECE.bit_length() - 1)).astype(np.int64)
        edges = np.flatnonzero(pieces[1:] != pieces[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pieces)], strict=True):
            places = (buckets[a:b] & np.uint64(PIECE - 1)).astype(np.uint32)
            packed = pa.array([places.tobytes() + counts[a:b].astype(np.uint32).tobytes()], pa.binary())
            yield _sent(None, None, None, pa.array([int(pieces[a])], pa.int32()), packed)


class BitMap:
    """The buckets that reached the least count."""

    def __init__(self, width: int) -> None:
        self.shift, self.bytes = np.uint64(65 - width.bit_length()), np.zeros(width // 8, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_SENT = schema_of(lang="string", phrase="string", n="long", piece="int", packed="binary")


def _sent(lang: pa.Array | None, phrase: pa.Array | None, n: pa.Array | None, piece: pa.Array | None, packed: pa.Array | None) -> pa.RecordBatch:
    rows = len(n if n is not None else piece)
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    columns = [c if c is not None else pa.nulls(rows, t) for c, t in zip((lang, phrase, n, piece, packed), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=_SENT.names)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a batch by group, BATCH_BYTES or a single text at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for group, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
        text = text.as_py()
        held.setdefault(group.as_py(), []).append(text)
        size += len(text)
        if size > BATCH_BYTES:
            yield from held.items()
            held, size = {}, 0
    yield from held.items()


def run_pass(texts: DataFrame, k: int, last: int, width: int, frequent: BitFilter | None, filled: BitMap | None) -> DataFrame:
    """Rows of exact partial counts (lang, phrase, n) and of packed bucket counts (piece, packed) of texts (lang, text)."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((frequent, filled))  # at most 64 MB each

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Pass(k, last, width, *shared.value)
        for batch in batches:
            for group, part in _slices(batch):
                own.read(group, part)
                if own.held > HELD:
                    own.combine()
                if own.held > HELD // 2 or len(own.numbers) > VOCABULARY:
                    yield from own.send_counts()
                if own.in_buckets > HELD:
                    yield from own.send_buckets()
        yield from own.send_counts()
        yield from own.send_buckets()

    return texts.mapInArrow(run, _SENT)


def filled_buckets(sent: DataFrame, width: int, least: int) -> BitMap:
    """The bitmap of the buckets that reached `least`, summed by pieces of the bucket range. Its size is bounded by LARGEST bits."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(PIECE, np.int64)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["piece", "bits"])

        for batch in batches:
            for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if piece != now:
                    if now is not None:
                        yield bits()
                    now = piece
                    total[:] = 0
                both = np.frombuffer(packed.as_py(), np.uint32)
                total[both[: len(both) // 2]] += both[len(both) // 2 :]
        if now is not None:
            yield bits()

    out = BitMap(width)
    dealt = sent.where("piece IS NOT NULL").select("piece", "packed").repartition("piece").sortWithinPartitions("piece")
    for row in dealt.mapInArrow(add, schema_of(piece="int", bits="binary")).toLocalIterator():
        out.bytes[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def phrase_filter(frequent: DataFrame, k: int) -> BitFilter:
    """A Bloom filter of phrases (lang, phrase) of k words, by the keys that run_pass makes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = b" ".join(batch.column(1).cast(pa.binary()).to_pylist()).split(b" ")
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            seeds = np.array([_group_seed(g) for g in batch.column(0).to_pylist()], np.uint64)
            keys = phrase_keys(hashes ^ np.repeat(seeds, k), k)[::k]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return filter_of(frequent.select("lang", "phrase").mapInArrow(run, schema_of(key="long")))


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words that occur `least` times, and (lang, total) of all words. texts: lang, text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(LARGEST, max(FEWEST_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length()))
    found, totals, frequent, filled = [], None, None, None
    for k in range(1, longest + 1):
        sent = materialize(run_pass(texts, k, longest, width, frequent, filled), f"phrases-{k}")
        counted = sent.where("piece IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if totals is None:
            totals = materialize(sent.where("piece IS NULL").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
        found.append(materialize(counted.where(F.col("f") >= least).withColumn("words", F.lit(k)), f"frequent-{k}"))
        if k == longest or found[-1].isEmpty():
            break
        frequent, filled = phrase_filter(found[-1], k), filled_buckets(sent, width, least)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def ranked(frequent: DataFrame, totals: DataFrame, top: int = TOP, absorbed: int = 100) -> DataFrame:
    """The `top` collocations of each group, from frequent (lang, phrase, words, f) and totals (lang, total)."""
    known = frequent.select("lang", "phrase", "f")
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # what a candidate of one word more contains
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    inner = candidates.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(absorbed) * F.col("a"))).drop("longer")

    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = join_hot(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = join_hot(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = join_hot(cuts, totals, ["lang"])
    # products may pass 64 bits; division of decimals would round, that of whole numbers does not
    cuts = cuts.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("total").cast("decimal(17,0)")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("down", (F.col("l").cast("decimal(17,0)") * F.col("r").cast("decimal(17,0)")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", F.col("total").alias("n"), "score"), F.struct("score", "k")).alias("cut"))
    scored = weakest.select("lang", "phrase", "cut.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = 100) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the `top` collocations of each group."""
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent, totals = frequent_phrases(texts.where("text <> ''"), least, longest)
    return ranked(frequent, totals, top, absorbed)
