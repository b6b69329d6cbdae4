"""Exact substring dedup over all documents: suffixes compared by bucket-pointer refinement.

A byte is removed if a 50-byte string over it also starts in a document with a
smaller doc_id. Sorting every suffix of the corpus is not needed for that:

1. Every 50-byte window has a least q-gram (by hash), its anchor. Equal windows
   have equal anchors at equal places, so only suffixes around anchors whose
   q-gram stands in several documents can match. One packed shuffle finds
   those initial q-gram buckets.
2. The bytes around such anchors (all windows over the anchor lie in them) are
   shuffled by q-gram, so each initial bucket is in one partition. Contexts
   equal as a whole are settled at once: all their windows are repeats in all
   documents but the smallest. What is left is sorted: buckets of 5 bytes are
   refined by the bucket identifiers 5 bytes later, those of 10 by the ones 10
   later, then 20 and 40, every step reusing the identifiers that the step
   before has just updated, until suffixes in one bucket agree in 50 bytes.
3. A window is a repeat if its bucket has a smaller doc_id. The repeats' spans
   go back to the documents.

Identifiers are ranks of the bytes themselves, so matches are exact; the
q-gram hash only decides which suffixes are compared.

No task holds more than HOT_CONTEXTS unlike contexts of a q-gram: they are
counted with the initial buckets, and a bucket of more is taken apart by what
its suffixes go on with: each of its windows is a suffix of its own, whose
initial bucket is a hash of all its 50 bytes. The bytes go with it, and buckets
that several documents share are refined as above, so here too the hash only
decides what is compared. A group of documents sends a window once, for its
smallest document.

Defined results: null texts are empty; rows that share a doc_id do not match
each other; rows with a null doc_id match nothing; texts under 50 bytes lose
nothing; extra columns stay, columns of the names that are added are replaced;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import packed
from factloom.llm.bits import BitFilter, filter_of
from factloom.llm.common import SPANS, free_names, materialize, schema_of, tidy

LENGTH, Q = 50, 16
BEFORE = AFTER = LENGTH - Q
CONTEXT = BEFORE + Q + AFTER
OFFSETS = LENGTH - Q + 1
GROUP_BYTES = 8 << 20
#: Bytes of a q-gram hash that are shuffled, at least. A false match costs a comparison, no more; see sent_bytes().
SENT_BYTES = 5
#: Anchors of a text, at most about one for each so many bytes, and how rarely one may be taken for another.
ANCHOR_BYTES, FALSE_MATCH = 16, 100
#: Contexts that are refined together (whole buckets; a larger bucket is refined alone), and most of a bucket.
REFINED_TOGETHER, HOT_CONTEXTS = 8192, 1 << 15
#: Contexts that a task gathers before it sends them.
GATHERED = 1 << 16

_rng = np.random.default_rng(2)
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_STEP = [np.uint64(x | 1) for x in _rng.integers(1, 1 << 63, 4).tolist()]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x | 1) for x in _rng.integers(1, 1 << 63, 8).tolist()]


def sent_bytes(n_bytes: int) -> int:
    """How many bytes of a q-gram hash keep unlike anchors of so many bytes of text apart, but for one in FALSE_MATCH."""
    width = SENT_BYTES
    while width < 8 and n_bytes // ANCHOR_BYTES * FALSE_MATCH > 1 << 8 * width:
        width += 1
    return width


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << 8 * width) - 1)


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` values in a row."""
    span = 1
    while span * 2 <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The hash of each row of Q bytes, as anchors() has it."""
    h = _BYTE[grams]
    for k, c in zip((1, 2, 4, 8), _STEP, strict=True):
        h = h[:, :-k] * c + h[:, k:]
    return _mixed(h[:, 0])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and q-gram hashes of the anchors of all windows inside the texts that `bounds` divides data into, and a hash of the bytes around."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _BYTE[data]
    for k, c in zip((1, 2, 4, 8), _STEP, strict=True):
        h = h[:-k] * c + h[k:]
    h = _mixed(h)
    least = _slide(h, OFFSETS, np.minimum)
    for end in bounds[1:].tolist():
        least[max(0, end - LENGTH + 1) : end] = 0  # windows over the end of a text
    edge = np.zeros(OFFSETS - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), OFFSETS, np.maximum)
    places = np.flatnonzero(most == h)
    around = np.zeros(len(places), np.uint64)
    for k in (-BEFORE, Q - BEFORE, -Q, Q, 2 * Q, AFTER):  # q-grams that together cover a context
        around = (around ^ h[np.clip(places + k, 0, len(h) - 1)]) * _MIX
    return places, h[places], around


def window_hashes(context: np.ndarray) -> np.ndarray:
    """A hash of the 50 bytes from each place of each context (row) that has so many."""
    h = _BYTE[context]
    spans = {1: h}
    for k, c in zip((1, 2, 4, 8, 16), _STEPS[:5], strict=True):
        h = h[:, :-k] * c + h[:, k:]
        h ^= h >> np.uint64(31)
        spans[2 * k] = h
    n = context.shape[1] - LENGTH + 1
    h = (spans[32][:, :n] * _STEPS[5] + spans[16][:, 32 : 32 + n]) * _STEPS[6] + spans[2][:, 48 : 48 + n]
    return _mixed(h * _STEPS[7])


def _blocks(ids: list, texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """ids, joined bytes and bounds of texts that are hashed together."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k == len(texts) - 1:
            chosen = texts[start : k + 1]
            bounds = np.zeros(len(chosen) + 1, np.int64)
            np.cumsum([len(x) for x in chosen], out=bounds[1:])
            yield ids[start : k + 1], np.frombuffer(b"".join(chosen), np.uint8), bounds
            start, held = k + 1, 0


def initial_buckets(docs: DataFrame, tasks: int, width: int = SENT_BYTES) -> DataFrame:
    """For each id the anchors' q-gram hashes that other documents have too; without an id, those of too many contexts. docs: id, text; width: bytes that are sent of a hash."""
    parts = packed.parts_of(tasks)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in packed.groups(batches, GROUP_BYTES):
            keys, owners, around = [], [], []
            for some, data, bounds in _blocks(ids, texts):
                places, h, near = anchors(data, bounds)
                around.append(near)
                owners.append(np.array(some, np.int64)[np.searchsorted(bounds, places, side="right") - 1])
                keys.append(h)
            yield packed.batch_of(list(packed.send(np.concatenate(keys), np.concatenate(owners), parts, all_of_shared=True, width=width, variants=np.concatenate(around))))

    return packed.answer(docs.mapInArrow(send, packed.SENT), tasks, width=width, all_of_shared=True, hot=HOT_CONTEXTS)


#: ids, rows (text hashes) and counts: of the texts. kind KEYS: then for each context its place and, compressed, its bytes
#: and how many there are before and after; kind LOCAL: the starts and stops of spans; kind HOT: starts and, compressed, bytes of windows
CONTEXTS = schema_of(part="int", kind="int", ids="binary", rows="binary", counts="binary", places="binary", bytes="binary", room="binary")
FOUND = schema_of(id="long", row="long", starts="binary", stops="binary")
#: Spans of many texts on their way to the part of their ids
SPANS_SENT = schema_of(part="int", ids="binary", rows="binary", counts="binary", starts="binary", stops="binary")


class _Contexts:
    """Suffixes around anchors: equal-length arrays."""

    def __init__(self, h, ids, rows, places, context, room) -> None:
        self.all = h, ids, rows, places, context, room
        self.h, self.ids, self.rows, self.places, self.context, self.room = self.all

    def __getitem__(self, chosen) -> _Contexts:
        return _Contexts(*[x[chosen] for x in self.all])

    @classmethod
    def join(cls, parts: list[_Contexts]) -> _Contexts:
        return cls(*[np.concatenate(x) for x in zip(*(p.all for p in parts), strict=True)])

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """id, row, start and stop of the spans that the windows at offsets first..last (of the context) cover."""
        at = self.places - BEFORE
        return self.ids, self.rows, at + first, at + last + LENGTH


def context_rows(data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around each anchor (zeros beyond its text) and how many of them there are before and after."""
    text = np.searchsorted(bounds, places, side="right") - 1
    before = np.minimum(places - bounds[text], BEFORE)
    after = np.minimum(bounds[text + 1] - places - Q, AFTER)
    at = places[:, None] + np.arange(-BEFORE, Q + AFTER)
    inside = (at >= (places - before)[:, None]) & (at < (places + Q + after)[:, None])
    context = np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))], 0).astype(np.uint8)
    return context, np.stack([before, after], axis=1).astype(np.uint8)


def settle_equal(c: _Contexts) -> tuple[tuple[np.ndarray, ...], _Contexts]:
    """Spans of whole contexts that a smaller document has too, and the contexts of smallest documents (ordered by h)."""
    n = len(c.h)
    padded = np.zeros((n, 11), np.uint64)
    padded.view(np.uint8)[:, :CONTEXT] = c.context
    padded.view(np.uint8)[:, CONTEXT : CONTEXT + 2] = c.room
    mixed = c.h.copy()
    for k in range(11):
        mixed = (mixed ^ padded[:, k]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((mixed, c.h))
    c, padded, mixed = c[order], padded[order], mixed[order]
    # neighbours in the order that differ anywhere begin a new group, so equal hashes of unequal bytes stay apart
    new = np.concatenate([np.ones(min(1, n), bool), (c.h[1:] != c.h[:-1]) | (padded[1:] != padded[:-1]).any(axis=1)])
    starts = np.flatnonzero(new)
    low = packed.spread(np.minimum.reduceat(c.ids, starts), starts, n) if n else c.ids
    later = c.ids > low
    lost = c[later]
    first, last = BEFORE - lost.room[:, 0].astype(np.int64), lost.room[:, 1].astype(np.int64)
    fits = last >= first
    return lost[fits].spans(first[fits], last[fits]), c[~later]


def refine(context: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the 50 bytes from each offset of each context: equal exactly where the bytes are."""

    def ranks(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].reshape(values.shape).astype(np.uint64)

    def pointed(ids: np.ndarray, later: np.ndarray, by: int) -> np.ndarray:
        """Refines each bucket by the identifier of the bucket that the suffix `by` bytes later is in."""
        width = min(ids.shape[1], later.shape[1] - by)
        return ranks(ids[:, :width] << np.uint64(32) | later[:, by : by + width])

    width = context.shape[1] - 4
    start = np.zeros((len(context), width), np.uint64)
    for k in range(5):
        start = start << np.uint64(8) | context[:, k : width + k]
    by5 = ranks(start)
    by10 = pointed(by5, by5, 5)
    by20 = pointed(by10, by10, 10)
    by40 = pointed(by20, by20, 20)
    return pointed(by40, by10, 40)


def repeated_windows(c: _Contexts) -> np.ndarray:
    """Which windows of each context (by offset) a smaller document has; c holds whole buckets."""
    bucket = refine(c.context)
    offset = np.arange(bucket.shape[1])
    fits = (offset >= BEFORE - c.room[:, :1].astype(np.int64)) & (offset <= c.room[:, 1:].astype(np.int64))
    owner = np.where(fits, c.ids[:, None], np.iinfo(np.int64).max)
    low = np.full(int(bucket.max()) + 1 if bucket.size else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, bucket.ravel(), owner.ravel())
    return fits & (low[bucket] < c.ids[:, None])


def repeats(windows: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which windows (rows of LENGTH bytes) a smaller document has; keys: their hashes.

    Windows that share their hash with another document's are refined, whole buckets at a time; of equal neighbours in a
    bucket the first stands for all, so a window that very many groups send is refined once.
    """
    order, firsts, low, high = packed.compare(keys, ids)
    n = len(order)
    order = order[packed.spread(low != high, firsts, n)]
    out = np.zeros(n, bool)
    if not len(order):
        return out
    keys = keys[order]
    new = np.ones(len(order), bool)
    for at in range(1, len(order), REFINED_TOGETHER):  # equal neighbours, in blocks
        here = order[at - 1 : at + REFINED_TOGETHER]
        new[at : at + REFINED_TOGETHER] = (windows[here[1:]] != windows[here[:-1]]).any(axis=1)
    stand_in, first = np.cumsum(new) - 1, np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], first)
    of, held = keys[first], order[first]
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    at = 0
    while at < len(held):
        stop = int(ends[max(np.searchsorted(ends, at + REFINED_TOGETHER, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        bucket = refine(windows[held[at:stop]])[:, 0]
        lowest = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, bucket, least[at:stop])
        least[at:stop] = lowest[bucket]
        at = stop
    out[order] = ids[order] > least[stand_in]
    return out


def _covered(c: _Contexts, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of each run of repeated windows."""
    edge = np.zeros((len(repeated), 1), np.int8)
    steps = np.diff(np.concatenate([edge, repeated.astype(np.int8), edge], axis=1), axis=1)
    (row, first), (_, stop) = np.nonzero(steps == 1), np.nonzero(steps == -1)
    return c[row].spans(first, stop - 1)


def _refined_spans(c: _Contexts) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans from the contexts that are not settled; c is ordered by h."""
    n = len(c.h)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), c.h[1:] != c.h[:-1]]))
    sizes = np.diff(np.append(starts, n))
    several = packed.spread(np.minimum.reduceat(c.ids, starts) != np.maximum.reduceat(c.ids, starts), starts, n) if n else np.zeros(0, bool)
    c = c[several]
    sizes = sizes[several[starts]] if n else sizes
    ends = np.cumsum(sizes)
    at = 0
    while at < len(c.h):
        k = np.searchsorted(ends, at + REFINED_TOGETHER, side="right")
        stop = int(ends[max(k - 1, np.searchsorted(ends, at, side="right"))])
        block = c[slice(at, stop)]
        yield _covered(block, repeated_windows(block))
        at = stop


def _merge_spans(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, rows, starts and stops of the spans, ordered by text, overlapping or touching ones merged."""
    if not len(ids):
        return ids, rows, starts, stops
    order = np.lexsort((starts, rows, ids))
    ids, rows, starts, stops = ids[order], rows[order], starts[order], stops[order]
    text = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]))])
    base = text * (int(stops.max()) + 1)  # texts one behind the other on one line
    reach = np.maximum.accumulate(base + stops)
    new = np.concatenate([[True], (base + starts)[1:] > reach[:-1]])
    new |= np.concatenate([[True], text[1:] != text[:-1]])
    first = np.flatnonzero(new)
    starts, stops, text = starts[first], (reach - base)[np.append(first[1:], len(ids)) - 1], text[first]
    return ids[first], rows[first], starts, stops


def _send_spans(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray, parts: int) -> pa.RecordBatch:
    ids, rows, starts, stops = _merge_spans(ids, rows, starts, stops)
    part = ids % parts
    order, out = np.argsort(part, kind="stable"), []
    for chosen in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(chosen):
            by_text, *texts = _by_text(ids[chosen], rows[chosen])
            at = chosen[by_text]
            out.append((int(part[chosen[0]]), *texts, starts[at].astype(np.int32).tobytes(), stops[at].astype(np.int32).tobytes()))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=SPANS_SENT.names)


@tidy
def _gather_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A FOUND row for each text, from all the spans that were sent to its part."""
    got: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for ids, rows, counts, starts, stops in zip(*(batch.column(c).to_pylist() for c in SPANS_SENT.names[1:]), strict=True):
            n = np.frombuffer(counts, np.uint32)
            texts = [np.repeat(np.frombuffer(x, np.int64), n) for x in (ids, rows)]
            got.append((*texts, np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(stops, np.int32).astype(np.int64)))
    if not got:
        return
    ids, rows, starts, stops = _merge_spans(*[np.concatenate(x) for x in zip(*got, strict=True)])
    if not len(ids):
        return
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]), [True]]))
    starts, stops = starts.astype(np.int32), stops.astype(np.int32)
    for a in range(0, len(cuts) - 1, 10_000):
        own = cuts[a : a + 10_001]
        spans = list(zip(own[:-1].tolist(), own[1:].tolist(), strict=True))
        made = [pa.array(ids[own[:-1]]), pa.array(rows[own[:-1]]), pa.array([starts[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([stops[x:y].tobytes() for x, y in spans], pa.binary())]
        yield pa.RecordBatch.from_arrays(made, names=FOUND.names)


_CONTEXT_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _by_text(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """An order by text, and the texts with their counts, packed."""
    order = np.lexsort((rows, ids))
    ids, rows = ids[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]))
    return order, ids[first].tobytes(), rows[first].tobytes(), np.diff(np.append(first, len(ids))).astype(np.uint32).tobytes()


def _send_contexts(c: _Contexts, parts: int) -> pa.RecordBatch:
    """Settles what it can among its own and sends the rest by q-gram."""
    (ids, rows, starts, stops), c = settle_equal(c)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = []
    if len(ids):
        order, *texts = _by_text(ids, rows)
        out.append((int(ids[0]) % parts, packed.LOCAL, *texts, starts[order].astype(np.int32).tobytes(), stops[order].astype(np.int32).tobytes(), b""))
    part = packed.part_of(c.h, parts)
    by_part = np.argsort(part, kind="stable")
    for chosen in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        if len(chosen):
            order, *texts = _by_text(c.ids[chosen], c.rows[chosen])
            x = c[chosen[order]]
            out.append((int(part[chosen[0]]), packed.KEYS, *texts, x.places.astype(np.int32).tobytes(), squeeze(x.context.tobytes()), squeeze(x.room.tobytes())))
    columns = list(zip(*out, strict=True)) if out else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, _CONTEXT_KINDS, strict=True)], names=CONTEXTS.names)


def _send_all(c: _Contexts, hot: BitFilter, parts: int, mask: np.uint64) -> Iterator[pa.RecordBatch]:
    """Contexts by q-gram; those of hot q-grams window by window."""
    often = np.zeros(len(c.h), bool)
    often[hot.passing(c.h & mask)] = True
    yield _send_contexts(c[~often], parts)
    for at in range(0, int(often.sum()), REFINED_TOGETHER):
        yield _send_windows(c[np.flatnonzero(often)[at : at + REFINED_TOGETHER]], parts)


def _send_windows(c: _Contexts, parts: int) -> pa.RecordBatch:
    """Settles windows that a smaller document of the group has, and sends the others, with their bytes, by their hash."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    offset = np.arange(OFFSETS)
    fits = (offset >= BEFORE - c.room[:, :1].astype(np.int64)) & (offset <= c.room[:, 1:].astype(np.int64))
    of, at = np.nonzero(fits)
    ids, rows, starts = c.ids[of], c.rows[of], c.places[of] - BEFORE + at
    windows = np.lib.stride_tricks.sliding_window_view(c.context, LENGTH, axis=1)[of, at]
    keys = window_hashes(c.context)[of, at]
    later = repeats(windows, ids, keys)
    out = []
    if later.any():
        told = _merge_spans(ids[later], rows[later], starts[later], starts[later] + LENGTH)
        order, *texts = _by_text(told[0], told[1])
        out.append((int(told[0][0]) % parts, packed.LOCAL, *texts, told[2][order].astype(np.int32).tobytes(), told[3][order].astype(np.int32).tobytes(), b""))
    left = np.flatnonzero(~later)
    part = packed.part_of(keys[left], parts)
    by_part = np.argsort(part, kind="stable")
    for chosen in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        if len(chosen):
            x = left[chosen]
            order, *texts = _by_text(ids[x], rows[x])
            x = x[order]
            out.append((int(part[chosen[0]]), packed.HOT, *texts, starts[x].astype(np.int32).tobytes(), squeeze(windows[x].tobytes()), b""))
    columns = list(zip(*out, strict=True)) if out else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, _CONTEXT_KINDS, strict=True)], names=CONTEXTS.names)


def _row_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@tidy
def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, width in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(packed.unpack(b"".join(keys), width).view(np.int64))], names=["key"])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each id and text hash the spans to remove. docs: rows with an id."""
    spark = docs.sparkSession
    n_bytes = packed.text_bytes(docs, text_col)
    tasks, width = packed.tasks_for(spark, n_bytes), sent_bytes(n_bytes)
    parts = packed.parts_of(tasks)
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    other, keys = free_names(docs, "__id", "__keys")
    buckets = materialize(initial_buckets(docs.select(number, text), tasks, width), "buckets")
    told = spark.sparkContext.broadcast(filter_of(buckets.where("id IS NULL").select("keys", F.lit(width)).mapInArrow(_numbers, schema_of(key="long"))))
    shared = buckets.where("id IS NOT NULL").withColumnsRenamed({"id": other, "keys": keys})
    joined = docs.join(shared, number == F.col(other)).select(number, text, keys)

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Contexts] = []
        size = 0
        for batch in batches:
            for i, text, known in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                t = text.as_py()
                if t is None:
                    continue
                data, bounds = np.frombuffer(t, np.uint8), np.array([0, len(t)])
                places, h, _ = anchors(data, bounds)
                wanted = np.isin(h & _mask(width), packed.unpack(b"".join(known), width))
                places, h = places[wanted], h[wanted]
                if not len(h):
                    continue
                context, room = context_rows(data, bounds, places)
                held.append(_Contexts(h, np.full(len(h), i, np.int64), np.full(len(h), _row_hash(t), np.int64), places.astype(np.int64), context, room))
                size += len(h)
                if size >= GATHERED:
                    yield from _send_all(_Contexts.join(held), told.value, parts, _mask(width))
                    held, size = [], 0
        if held:
            yield from _send_all(_Contexts.join(held), told.value, parts, _mask(width))

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[_Contexts] = []
        windows: list[tuple[np.ndarray, ...]] = []
        spans: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for kind, *texts, places, context, room in zip(*(batch.column(c).to_pylist() for c in CONTEXTS.names[1:]), strict=True):
                counts = np.frombuffer(texts[2], np.uint32)
                ids, rows = (np.repeat(np.frombuffer(x, np.int64), counts) for x in texts[:2])
                places = np.frombuffer(places, np.int32).astype(np.int64)
                if kind == packed.LOCAL:
                    spans.append((ids, rows, places, np.frombuffer(context, np.int32).astype(np.int64)))
                elif kind == packed.HOT:
                    expand = zstandard.ZstdDecompressor().decompress
                    windows.append((np.frombuffer(expand(context), np.uint8).reshape(-1, LENGTH), ids, rows, places))
                else:
                    expand = zstandard.ZstdDecompressor().decompress
                    around = np.frombuffer(expand(context), np.uint8).reshape(-1, CONTEXT)
                    kept.append(_Contexts(gram_hashes(around[:, BEFORE : BEFORE + Q]), ids, rows, places, around, np.frombuffer(expand(room), np.uint8).reshape(-1, 2)))
        if kept:
            whole, rest = settle_equal(_Contexts.join(kept))
            spans.append(whole)
            spans += _refined_spans(rest)
        if windows:
            held, ids, rows, starts = (np.concatenate(x) for x in zip(*windows, strict=True))
            windows.clear()
            blocks = range(0, len(held), REFINED_TOGETHER)
            later = repeats(held, ids, np.concatenate([window_hashes(held[k : k + REFINED_TOGETHER])[:, 0] for k in blocks]))
            spans.append((ids[later], rows[later], starts[later], starts[later] + LENGTH))
        if spans:
            yield _send_spans(*[np.concatenate(x) for x in zip(*spans, strict=True)], parts)

    found = joined.mapInArrow(gather, CONTEXTS).repartition(tasks, "part").mapInArrow(compare, SPANS_SENT)
    return found.repartition(tasks, "part").mapInArrow(_gather_spans, FOUND)


ADDED = schema_of(n_bytes="long", removed_spans=SPANS, kept="binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, removed_spans (maximal runs, in UTF-8 bytes) and kept (the bytes that are left)."""
    kept = [c for c in docs.columns if c not in ADDED.names]
    other, spans = free_names(docs, "__id", "__found")
    # both joins read one shuffle of the rows that have an id
    named = docs.select(*kept).where(F.col(id_col).isNotNull())
    found = repeated_spans(named, id_col, text_col).groupBy("id").agg(F.collect_list(F.struct("row", "starts", "stops")).alias(spans)).withColumnRenamed("id", other)
    joined = named.join(found, F.col(id_col).cast("long") == F.col(other), "left").drop(other)
    nameless = docs.select(*kept).where(F.col(id_col).isNull()).withColumn(spans, F.lit(None).cast(joined.schema[spans].dataType))
    joined = joined.unionByName(nameless)

    @tidy
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rows = []
                for text, found in zip(batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    t = text.as_py() or b""
                    spans = merged(found or [], _row_hash(t) if found else 0)
                    left, at = [], 0
                    for s in spans:
                        left.append(t[at : s["start"]])
                        at = s["stop"]
                    left.append(t[at:])
                    rows.append((len(t), spans, b"".join(left)))
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ADDED_KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *made], names=[*kept, *ADDED.names])

    return joined.mapInArrow(cut_out, T.StructType([*[docs.schema[c] for c in kept], *ADDED.fields]))


_ADDED_KINDS = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary()]


def merged(found: list[dict], row: int) -> list[dict]:
    """The spans of the text with that hash, sorted and merged."""
    spans = sorted(s for f in found if f["row"] == row for s in zip(np.frombuffer(f["starts"], np.int32).tolist(), np.frombuffer(f["stops"], np.int32).tolist(), strict=True))
    out: list[dict] = []
    for a, b in spans:
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out
