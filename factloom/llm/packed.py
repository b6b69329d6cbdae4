"""Shuffling many small keys as packed arrays.

Tables of hundreds of millions of short keys are shuffled as a few rows of
arrays: each group of documents sends, for each part of the key space, one row
with its distinct keys and the smallest document that has each. A key that a
third of all documents share is thus one entry for each group, not one for
each document; what a group knows of itself it answers at once. The parts go
to as many partitions as any shuffle of the session, or more, as the input's
size asks for: what a task holds does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import schema_of, shuffle_width, tidy

#: ids: the documents; counts: how many of the keys each has; keys: in the order of the documents
#: many: positions and counts of the keys that the group has in COUNTED variants or more (where they are counted)
SENT = schema_of(part="int", kind="int", ids="binary", counts="binary", keys="binary", many="binary")
ANSWERS = schema_of(id="long", keys="binary")
#: kind of a row: keys to compare with those of other groups, answers that only pass through, or keys that very many have
KEYS, LOCAL, HOT = 0, 1, 2
#: Bytes of input for each task of a shuffle.
TASK_BYTES = 32 << 20
#: A group that has a key in fewer variants does not say in how many.
COUNTED = 4


def tasks_for(spark: SparkSession, n_bytes: int | None) -> int:
    """How many tasks a packed shuffle of so many bytes of input takes."""
    return max(shuffle_width(spark), -(-(n_bytes or 0) // TASK_BYTES))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def parts_of(tasks: int) -> int:
    return 2 * tasks


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; keys are uint64 or rows of several uint64."""
    return ((keys if keys.ndim == 1 else keys[:, 0]) >> np.uint64(40)) % np.uint64(parts)


def pack(keys: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1)[:, :width].tobytes()


def unpack(packed: bytes, width: int) -> np.ndarray:
    """Keys of up to 8 bytes as uint64, longer ones as rows of uint64."""
    words = -(-width // 8)
    raw = np.frombuffer(packed, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8 * words), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).reshape(-1) if words == 1 else out.view(np.uint64)


def _key_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each new key begins."""
    if keys.ndim == 1:
        order = np.argsort(keys)
        ranked = keys[order]
        new = ranked[1:] != ranked[:-1]
    else:
        order = np.lexsort(keys.T[::-1])
        ranked = keys[order]
        new = (ranked[1:] != ranked[:-1]).any(axis=1)
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), new]))


def compare(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, starts of the groups of equal keys in it, each group's smallest and largest id."""
    order, starts = _key_order(keys)
    if not len(order):
        return order, starts, ids, ids
    own = ids[order]
    return order, starts, np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value of each group for each of its n members."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def _with_source(keys: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Keys of several words followed by the document that an answer names."""
    return np.column_stack([keys, sources.view(np.uint64)])


def send(keys: np.ndarray, ids: np.ndarray, parts: int, all_of_shared: bool, width: int, sources: bool = False, variants: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of SENT for one group of documents. keys, ids: each key of a document with its id (a repeated one counts once).

    all_of_shared: answer every document of a key that several have; else all but the smallest.
    width: bytes that are sent of each key; fewer than it has make rare false matches.
    sources: answers name a smaller document that has the key, in 8 bytes after it (keys of whole words only).
    variants: of each key; say which keys the group has in COUNTED variants or more.
    """
    order, starts, low, high = compare(keys, ids)
    n = len(order)
    if not n:
        return
    own, lows = ids[order], spread(low, starts, n)
    answered = spread(low != high, starts, n) if all_of_shared else own > lows
    if answered.any():
        told = order[answered]
        named = _with_source(keys[told], lows[answered]) if sources else keys[told]
        yield _row(int(part_of(keys[told[:1]], parts)[0]), LOCAL, named, ids[told], width + 8 * sources)
    unique, smallest = keys[order[starts]], low
    times = None if variants is None else _varied(order, starts, variants)
    part = part_of(unique, parts)
    by_part = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by_part])) + 1
    for chosen in np.split(by_part, cuts):
        yield _row(int(part[chosen[0]]), KEYS, unique[chosen], smallest[chosen], width, None if times is None else times[chosen])


def _varied(order: np.ndarray, starts: np.ndarray, variants: np.ndarray) -> np.ndarray:
    """How many variants each key has; exact from COUNTED on."""
    n = len(order)
    times = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), times)
    many = np.flatnonzero(times[group] >= COUNTED)
    group, own = group[many], variants[order[many]]
    ranked = np.lexsort((own, group))
    group, own = group[ranked], own[ranked]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
    times[np.unique(group)] = 0
    np.add.at(times, group[new], 1)
    return times


def _row(part: int, kind: int, keys: np.ndarray, ids: np.ndarray, width: int, times: np.ndarray | None = None) -> tuple:
    order = np.argsort(ids, kind="stable")
    distinct, counts = np.unique(ids[order], return_counts=True)
    many = b""
    if times is not None:
        at = np.flatnonzero(times[order] >= COUNTED)
        many = np.stack([at, times[order][at]]).astype(np.uint32).tobytes()
    return part, kind, distinct.tobytes(), counts.astype(np.uint32).tobytes(), pack(keys[order], width), many


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SENT.names)


def answer(sent: DataFrame, tasks: int, width: int, all_of_shared: bool, sources: bool = False, hot: int = 0) -> DataFrame:
    """For each document the packed keys that others share (or that a smaller document has): one row an id.

    hot: rows without an id name the keys that all documents together may have in so many variants or more. A group that
    does not say how many it has counts as COUNTED - 1, so a key that is not named has surely fewer.
    """
    told_width = width + 8 * sources
    parts = parts_of(tasks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, times, told_keys, told_ids = [], [], [], [], []
        for batch in batches:
            for kind, distinct, counts, packed, many in zip(*(batch.column(c).to_pylist() for c in SENT.names[1:]), strict=True):
                k = unpack(packed, width if kind == KEYS else told_width)
                i = np.repeat(np.frombuffer(distinct, np.int64), np.frombuffer(counts, np.uint32))
                (keys if kind == KEYS else told_keys).append(k)
                (ids if kind == KEYS else told_ids).append(i)
                if kind == KEYS and hot:
                    times.append(np.full(len(k), COUNTED - 1, np.uint32))
                    at, n = np.frombuffer(many, np.uint32).reshape(2, -1)
                    times[-1][at] = n
        if keys:
            k, i = np.concatenate(keys), np.concatenate(ids)
            keys.clear()
            order, starts, low, high = compare(k, i)
            shared = low != high
            if hot and len(order):
                often = shared & (np.add.reduceat(np.concatenate(times)[order].astype(np.int64), starts) >= hot)
                if often.any():
                    named = k[order[starts[often]]]
                    yield batch_of([_row(int(part_of(named[:1], parts)[0]), HOT, named, np.zeros(len(named), np.int64), told_width)])
            lows = spread(low, starts, len(order))
            chosen = spread(shared, starts, len(order)) if all_of_shared else i[order] > lows
            told_keys.append(_with_source(k[order[chosen]], lows[chosen]) if sources else k[order[chosen]])
            told_ids.append(i[order[chosen]])
        if told_keys:
            k, i = np.concatenate(told_keys), np.concatenate(told_ids)
            part = i % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            yield batch_of([_row(int(part[c[0]]), LOCAL, k[c], i[c], told_width) for c in np.split(order, cuts) if len(c)])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row an id, from the rows of its part."""
        keys, ids = [], []
        for batch in batches:
            for kind, distinct, counts, packed in zip(*(batch.column(c).to_pylist() for c in SENT.names[1:5]), strict=True):
                if kind == HOT:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([packed], pa.binary())], names=ANSWERS.names)
                    continue
                keys.append(unpack(packed, told_width))
                ids.append(np.repeat(np.frombuffer(distinct, np.int64), np.frombuffer(counts, np.uint32)))
        if keys:
            yield from _by_id(np.concatenate(keys), np.concatenate(ids), told_width)

    answers = sent.repartition(tasks, "part").mapInArrow(run, SENT).repartition(tasks, "part").mapInArrow(gather, ANSWERS)
    return answers.select("id", F.array("keys").alias("keys"))


def _by_id(keys: np.ndarray, ids: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    stops = np.append(starts[1:], len(ids))
    for a in range(0, len(starts), 10_000):
        chosen = list(zip(starts[a : a + 10_000].tolist(), stops[a : a + 10_000].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts[a : a + 10_000]]), pa.array([pack(keys[x:y], width) for x, y in chosen], pa.binary())], names=ANSWERS.names)


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids (not null) and UTF-8 texts of the first two columns, in groups of about `size` bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if i is None or not text.is_valid:
                continue
            data = text.as_py()
            ids.append(i)
            texts.append(data)
            held += len(data)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
