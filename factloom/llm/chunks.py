"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the bytes before has its
mask bits zero, at the next start of a character, with least and largest chunk
sizes. A cut depends on nothing but the last few bytes and the cut before it,
so after an insertion the chunks of two equal passages fall together again
within a chunk or two. Chunks are compared by 128-bit digest over all
documents: a chunk is repeated if a document with a smaller doc_id has it or
if it stands earlier in the same text. The chunk over each edge of a repeated
passage matches nothing, so a run of repeated chunks is widened byte by byte: at
its first chunk to the left, at its last to the right, as far as the bytes are
those around that chunk's first place in the document of smallest doc_id that has
it, or around its first place in the text itself, whichever goes further, and at
most `largest` + 4 bytes (a chunk and a character: where the texts agree over
more, the chunk between would have been cut alike, but for texts so monotonous
that only the largest size cuts them). These places follow from the documents
alone, so the result does not depend on how the table is partitioned. All widened
runs are removed, or, where `min_run` is given, those of at least so many bytes:
then `n_repeated` counts the repeated chunks of all runs. A passage that holds no
whole chunk of its own is not found.

Edges of runs, and what stands around their chunks in the documents that are
asked, are rows that meet in a join by digest; a chunk that very many documents
share is one row on the asked side, and the askers are split over tasks.

Defined results: null and empty texts have no chunks and stay as they are;
rows that share a doc_id do not count as repeats of each other (of several texts
of the smallest doc_id, the one that reaches furthest counts); rows with a
null doc_id stay whole and make nothing a repeat; equal places count once; long
texts take time in proportion to their length; extra columns stay, columns
of the names that are added are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import packed
from factloom.llm.common import SPANS, free_names, join_hot, materialize, schema_of, tidy

#: About so many bytes a chunk beyond the least: one cut in so many places.
AVERAGE, LEAST, LARGEST = 32, 16, 256
GROUP_BYTES = 8 << 20
#: Bytes beyond `largest` that a run may be widened by: those of a character.
CHARACTER = 4
_REACH = 16  # bytes that a 16-bit gear hash sees


def _gear() -> np.ndarray:
    """A random 16-bit number for each byte; zero for NUL, so a text begins as if NULs stood before it."""
    table = np.random.default_rng(8).integers(1, 1 << 16, 256).astype(np.uint16)
    table[0] = 0
    return table


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h = 2 h + gear, 16 bits) after each byte, by doubling the span that is summed."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def cuts(text: bytes, hashes: np.ndarray, average: int = AVERAGE, least: int = LEAST, largest: int = LARGEST) -> list[int]:
    """Where the chunks of a text end (the last at its end)."""
    mask = np.uint16((average - 1) << (16 - (average - 1).bit_length()))
    out, last, n = [], 0, len(text)

    def at_start(i: int) -> int:
        while i < n and text[i] & 0xC0 == 0x80:
            i += 1
        return i

    for i in (np.flatnonzero(hashes & mask == 0) + 1).tolist():
        while i - last > largest:
            last = at_start(last + largest)
            out.append(last)
        if i - last >= least:
            last = at_start(i)
            out.append(last)
    while n - last > largest:
        last = at_start(last + largest)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunk_digests(text: bytes, hashes: np.ndarray, sizes: dict) -> tuple[list[int], np.ndarray]:
    """The chunks' ends and their digests, two words each."""
    ends = cuts(text, hashes, **sizes)
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)])
    return ends, np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _hash_texts(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts with their gear hashes; short ones are hashed together."""
    block, held = [], 0

    def flush() -> Iterator[tuple[bytes, np.ndarray]]:
        h = gear_hashes(np.frombuffer((b"\0" * _REACH).join(block), np.uint8))
        at = 0
        for t in block:
            yield t, h[at : at + len(t)]
            at += len(t) + _REACH

    for t in texts:
        block.append(t)
        held += len(t)
        if held >= 1 << 18:
            yield from flush()
            block, held = [], 0
    if block:
        yield from flush()


ADDED = schema_of(n_bytes="long", n_chunks="long", n_repeated="long", removed_spans=SPANS, kept="string")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, least: int = LEAST, largest: int = LARGEST, min_run: int = 0
) -> DataFrame:
    """docs with n_bytes, n_chunks, n_repeated, removed_spans (in UTF-8 bytes) and kept (the text that is left)."""
    sizes = {"average": average, "least": least, "largest": largest}
    tasks = packed.tasks_for(docs.sparkSession, packed.text_bytes(docs, text_col))
    parts = packed.parts_of(tasks)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in packed.groups(batches, GROUP_BYTES):
            found = [chunk_digests(t, h, sizes)[1] for t, h in _hash_texts(texts)]
            keys = np.concatenate(found)
            owners = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
            rows = list(packed.send(keys, owners, parts, all_of_shared=False, width=16, sources=True))
            yield packed.batch_of(rows)

    sent = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(send, packed.SENT)
    number, found_runs = free_names(docs, "__id", "__runs")
    answers = materialize(packed.answer(sent, tasks, width=16, all_of_shared=False, sources=True), "answers")
    kept = [c for c in docs.columns if c not in ADDED.names]
    whole_docs = docs.select(*kept)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    @tidy
    def find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, keys in _in_groups(batches, GROUP_BYTES):
            rows = [row for (t, h), i, k in zip(_hash_texts(data), ids, keys, strict=True) for row in edges_of(i, t, *chunk_digests(t, h, sizes), k or [], largest)]
            yield _batch(rows, _EDGES, _EDGE_KINDS)

    edges = materialize(texts.join(answers, "id", "left").mapInArrow(find_edges, _EDGES), "edges")

    # the document of smallest id that has each edge's chunk: the smallest that any answer names
    holders = answers.mapInArrow(_holders, _HOLDERS).groupBy("digest").agg(F.min("source").alias("source"))
    asked = edges.select("digest").distinct().join(holders, "digest").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list("digest")).alias("asked"))

    @tidy
    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, wanted in _in_groups(batches, GROUP_BYTES):
            rows = [row for (t, h), i, k in zip(_hash_texts(data), ids, wanted, strict=True) for row in surroundings(i, t, *chunk_digests(t, h, sizes), set(k), largest)]
            yield _batch(rows, _SERVED, [pa.binary(), pa.int64(), pa.binary(), pa.binary()])

    served = texts.join(asked, "id").mapInArrow(serve, _SERVED).distinct()
    reached = join_hot(edges, served, ["digest"], "left").mapInArrow(_reach, _REACHED)
    gathered = reached.groupBy(F.col("id").alias(number)).agg(F.collect_list(F.struct("text_key", "start", "stop", "n", "side", "reach")).alias(found_runs))
    joined = whole_docs.join(gathered, F.col(id_col).cast("long") == F.col(number), "left").drop(number)

    @tidy
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
                data = [t.as_py() or b"" for t in column]
                known_ids = batch.column(batch.schema.get_field_index(id_col)).is_valid().to_pylist()
                rows = []
                for (t, h), valid, runs, has_id in zip(_hash_texts(data), column.is_valid().to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), known_ids, strict=True):
                    n_chunks = len(cuts(t, h, **sizes)) if has_id else 0
                    spans, again = removed_spans(t, runs or [], min_run)
                    left, at = [], 0
                    for a, b in spans:
                        left.append(t[at:a])
                        at = b
                    left.append(t[at:])
                    rows.append((len(t), n_chunks, again, [{"start": a, "stop": b} for a, b in spans], b"".join(left).decode("utf-8", "replace") if valid else None))
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *made], names=[*kept, *ADDED.names])

    return joined.mapInArrow(cut_out, T.StructType([*[docs.schema[c] for c in kept], *ADDED.fields]))


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string()]


#: An edge of a run (side 0: its first chunk, 1: its last): the bytes that follow outwards, and how far the text itself agrees with its first place.
_EDGES = schema_of(id="long", text_key="binary", start="int", stop="int", n="int", side="int", digest="binary", own="int", outwards="binary")
_EDGE_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
_HOLDERS = schema_of(digest="binary", source="long")
#: What stands around a chunk: before it (nearest byte first) and after it.
_SERVED = schema_of(digest="binary", source="long", before="binary", after="binary")
_REACHED = schema_of(id="long", text_key="binary", start="int", stop="int", n="int", side="int", reach="int")
_ANSWER = 24  # bytes: a digest and a document that has it


def _batch(rows: list[tuple], schema: T.StructType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def _in_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[bytes], list[list[bytes] | None]]]:
    """The three columns id, text and a list of keys, in groups of about `size` bytes."""
    ids, texts, keys, held = [], [], [], 0
    for batch in batches:
        for i, text, k in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            ids.append(i)
            texts.append(text.as_py())
            keys.append(k.as_py())
            held += len(texts[-1])
            if held >= size:
                yield ids, texts, keys
                ids, texts, keys, held = [], [], [], 0
    if ids:
        yield ids, texts, keys


@tidy
def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of answers with the documents that they name, each digest once a batch, by its smallest."""
    for batch in batches:
        told = np.frombuffer(b"".join(k for keys in batch.column(1).to_pylist() for k in keys), np.uint64).reshape(-1, 3)
        order = np.lexsort((told[:, 2].view(np.int64) if len(told) else told[:, 2], told[:, 1], told[:, 0]))
        told = told[order]
        new = np.ones(len(told), bool)
        new[1:] = (told[1:, :2] != told[:-1, :2]).any(axis=1)
        told = told[new]
        digests = [told[k, :2].tobytes() for k in range(len(told))]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.ascontiguousarray(told[:, 2]).view(np.int64))], names=_HOLDERS.names)


def _outwards(text: bytes, side: int, start: int, stop: int, reach: int) -> bytes:
    """The bytes beyond a chunk, the nearest first."""
    return text[max(0, start - reach) : start][::-1] if side == 0 else text[stop : stop + reach]


def edges_of(i: int, text: bytes, ends: list[int], digests: np.ndarray, known: list[bytes], largest: int) -> Iterator[tuple]:
    """Rows of _EDGES: two for each run of chunks that are known or were seen before in the text."""
    elsewhere = set()
    for packed_keys in known:
        elsewhere.update(packed_keys[k : k + 16] for k in range(0, len(packed_keys), _ANSWER))
    raw, reach = digests.tobytes(), largest + CHARACTER
    first: dict[bytes, tuple[int, int]] = {}
    runs: list[list] = []
    at, open_run = 0, False
    for k, end in enumerate(ends):
        d = raw[16 * k : 16 * k + 16]
        if d in elsewhere or d in first:
            chunk = (at, end, d)
            if open_run:
                runs[-1][1:] = [chunk, runs[-1][2] + 1]
            else:
                runs.append([chunk, chunk, 1])
            open_run = True
        else:
            open_run = False
        first.setdefault(d, (at, end))
        at = end
    if not runs:
        return
    text_key = xxhash.xxh3_128_digest(text)
    for head, tail, n in runs:
        for side, (a, b, d) in enumerate((head, tail)):
            near = _outwards(text, side, a, b, reach)
            place = first[d]
            own = _alike(near, _outwards(text, side, *place, reach)) if place != (a, b) else 0
            yield i, text_key, head[0], tail[1], n, side, d, own, near


def surroundings(i: int, text: bytes, ends: list[int], digests: np.ndarray, wanted: set[bytes], largest: int) -> Iterator[tuple]:
    """Rows of _SERVED: what stands around the first place of each wanted chunk."""
    raw, at = digests.tobytes(), 0
    for k, end in enumerate(ends):
        d = raw[16 * k : 16 * k + 16]
        if d in wanted:
            wanted.discard(d)
            yield d, i, _outwards(text, 0, at, end, largest + CHARACTER), _outwards(text, 1, at, end, largest + CHARACTER)
        at = end


def _alike(a: bytes, b: bytes) -> int:
    """How many first bytes two strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


@tidy
def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far each edge may move outwards."""
    for batch in batches:
        get = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
        reach = [
            own if source is None or source >= i else max(own, _alike(near, before if side == 0 else after))
            for i, side, own, near, source, before, after in zip(*map(get, ("id", "side", "own", "outwards", "source", "before", "after")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _REACHED.names[:-1]], pa.array(reach, pa.int32())], names=_REACHED.names)


def removed_spans(text: bytes, edges: list[dict], min_run: int) -> tuple[list[tuple[int, int]], int]:
    """The spans to remove, and how many chunks are repeated. edges: those of all texts of the document, at times more than one for a side."""
    text_key = xxhash.xxh3_128_digest(text) if edges else b""
    runs: dict[tuple[int, int], list[int]] = {}
    for e in edges:
        if bytes(e["text_key"]) == text_key:
            found = runs.setdefault((e["start"], e["stop"]), [e["n"], 0, 0])
            found[1 + e["side"]] = max(found[1 + e["side"]], e["reach"])
    spans: list[tuple[int, int]] = []
    for (a, b), (_, left, right) in sorted(runs.items()):
        a, b = a - left, b + right
        while text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        while spans and a <= spans[-1][1]:
            before = spans.pop()
            a, b = min(a, before[0]), max(b, before[1])
        spans.append((a, b))
    return [(a, b) for a, b in spans if b - a >= min_run], sum(n for n, _, _ in runs.values())
