"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are split before the regex runs, at places where no match of the
pattern can cross: in front of a white-space character that follows a
non-space character. No branch of the pattern holds white space behind a
non-space, and its one look-ahead concerns white space alone, so the pieces
match exactly as the whole text does.

Runs without such a place (a megabyte of one letter or of blanks) would take
tiktoken time quadratic in their length; their matches are found with the
`regex` library and the long ones merged with a heap, to the same ids.

Defined results: a null text encodes as the empty text (no ids); null ids
decode to no bytes; an existing column of the output's name is replaced;
tables without rows give no rows.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import tidy

#: Texts are encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 16
#: Matches of more bytes than this are merged with a heap.
LONG_MATCH = 2048
_LONG_BLANK = re.compile(r"\s{%d}" % (LONG_MATCH // 4))
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each begins: by these, ids are decoded without a loop."""
    ranks = _ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=starts[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), starts


def merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one match: lowest rank first, leftmost among equals, by a heap of neighbouring pairs."""
    if data in ranks:
        return [ranks[data]]
    n = len(data)
    start, end = list(range(n)), list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(data[start[left] : end[right]])
            if rank is not None:
                heap.append((rank, left, end[right])) if not built else heapq.heappush(heap, (rank, left, end[right]))

    built = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    built = True
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left] if alive[left] else n
        if right >= n or end[right] != stop or end[left] > start[right]:
            continue
        end[left], alive[right] = stop, False
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[data[start[i] : end[i]]] for i in range(n) if alive[i]]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, split only at safe boundaries."""
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def _ids(ids: list[int]) -> np.ndarray:
    return np.frombuffer(array.array("i", ids), np.int32)


def has_long_run(text: str, least: int = LONG_MATCH // 4) -> bool:
    """Whether so many characters in a row are white space, or none of them is."""
    words = text.split()
    lengths = list(map(len, words))
    if max(lengths, default=0) >= least:
        return True
    return len(text) - sum(lengths) - len(words) >= least - 2 and _LONG_BLANK.search(text) is not None


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    enc = encoding(path, pattern)
    if len(text) <= LONG_MATCH // 4:
        return _ids(enc.encode_ordinary(text))
    parts = []
    for piece in pieces(text):
        if not has_long_run(piece):
            parts.append(_ids(enc.encode_ordinary(piece)))
            continue
        import regex

        ranks, got = _ranks(path), []
        for match in regex.finditer(pattern, piece):
            data = match.group().encode()
            got += merge_long(data, ranks) if len(data) > LONG_MATCH else enc.encode_ordinary(match.group())
        parts.append(_ids(got))
    return np.concatenate(parts)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, starts = _vocabulary(path)
    lengths = starts[ids + 1] - starts[ids]
    total = int(lengths.sum())
    at = np.arange(total) + np.repeat(starts[ids] - (np.cumsum(lengths) - lengths), lengths)
    return flat[at].tobytes()


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return path, pattern


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, convert) -> DataFrame:
    """df with a column computed from another one, batch by batch."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind)])

    @tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, convert(part.column(source))], names=[*kept, name])

    return df.mapInArrow(run, schema)


def encode(
    df: DataFrame,
    text_col: str = "text",
    ids_col: str = "token_ids",
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """df and a column of token ids (array<int>): each match of the pattern encoded separately, no special tokens.

    ranks_path: a tiktoken rank file that exists on every node; by default the public 50k byte-level one.
    """
    path, pattern = _default(ranks_path, pattern)

    def convert(texts: pa.Array) -> pa.Array:
        rows = [encode_text(t.as_py() or "", path, pattern) for t in texts]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    return _with_column(df, ids_col, T.ArrayType(T.IntegerType()), text_col, convert)


def decode(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """df and a column of the raw bytes that the ids stand for (binary; not necessarily UTF-8 for arbitrary ids)."""
    path, _ = _default(ranks_path, "")

    def convert(ids: pa.Array) -> pa.Array:
        flat, offsets = ids.flatten(), np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
        values = flat.to_numpy(zero_copy_only=False)
        return pa.array([decode_ids(values[offsets[i] : offsets[i + 1]].astype(np.int64), path) for i in range(len(ids))], pa.binary())

    return _with_column(df, bytes_col, T.BinaryType(), ids_col, convert)
