r"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A
visitor flattens them into one string in which each attachment stands as a
placeholder, and records for each attachment its reference, its place and the
number of tokens that its placeholder expands to. A turn is written

    <|turn|>ROLE\nCONTENT<|end|>\n

Inside roles and texts a backslash is doubled and every control string gets a
backslash behind its first character, so no control string of this template
or of the other common ones survives in a text; a backslash before any
character stands for that character, which makes it reversible. In a role a
line feed is written as a backslash and a line feed.

The formatted conversation is the concatenation of its turns' segments in the
order of (turn, role, content); segments stay one row each, so a conversation
of any length is held in constant memory, also when it is read back.

Defined results: null texts, roles and parts are empty; null part types count
as text, unknown ones are an error; turns of equal number are ordered by role
and content, those without a number come last; repeated rows are repeated turns; rows with a null conv_id form
one conversation; columns of other names are not looked at; no rows give none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm.common import SPANS, schema_of

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# fixed values: the control strings of this template and of other common ones
CONTROLS = [TURN, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]

PART = schema_of(type="string", text="string", ref="string", width="int", height="int", seconds="double", pages="int")
ATTACHMENTS = T.ArrayType(schema_of(kind="string", ref="string", start="int", tokens="long"))
SEGMENT = schema_of(conv_id="long", turn="long", role="string", segment="string", loss_spans=SPANS, attachments=ATTACHMENTS, expanded_tokens="long")

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Flattener:
    """Visits a turn's parts in order; `out` is the content, `loss` the text spans in it, `attached` the attachments."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512) -> None:
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def start(self, at: int) -> None:
        self.at, self.out, self.loss, self.attached = at, [], [], []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}")(part)

    def _put(self, piece: str) -> int:
        self.out.append(piece)
        self.at += len(piece)
        return self.at - len(piece)

    def _attach(self, part: dict, tokens: int) -> None:
        start = self._put(PLACEHOLDERS[part["type"]])
        self.attached.append({"kind": part["type"], "ref": part["ref"], "start": start, "tokens": tokens})

    def visit_text(self, part: dict) -> None:
        if part["text"]:
            start = self._put(escape(part["text"]))
            self.loss.append({"start": start, "stop": self.at})

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * self.page_tokens)


def format_turns(turns: DataFrame, loss_role: str = "assistant", **sizes) -> DataFrame:
    """A segment for each row of turns (conv_id, turn, role, parts), with what is trained on as spans of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Flattener(**sizes)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                role = row["role"] or ""
                head = TURN + escape(role).replace("\n", "\\\n") + "\n"
                visitor.start(len(head))
                for part in row["parts"] or []:
                    if part is not None:
                        visitor.visit(part)
                rows.append(
                    {
                        "conv_id": row["conv_id"],
                        "turn": row["turn"],
                        "role": role,
                        "segment": head + "".join(visitor.out) + END + "\n",
                        "loss_spans": visitor.loss if role == loss_role else [],
                        "attachments": visitor.attached,
                        "expanded_tokens": sum(a["tokens"] for a in visitor.attached),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(SEGMENT)
    chosen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(T.ArrayType(PART)))
    return chosen.mapInArrow(run, SEGMENT)


def text_parts(turns: DataFrame) -> DataFrame:
    """Rows of plain text (conv_id, turn, role, text) as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]])
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def parse_segment(segment: str) -> tuple[str, str]:
    """The role and the content (escaped) of a turn as written."""
    head = _HEAD.match(segment, len(TURN))
    if not segment.startswith(TURN) or head is None or not segment.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), segment[head.end() : -len(END) - 1]


def _plain(segment: Column) -> Column:
    """The segment without its end and its escapes: segments of one role sort by it as their texts do."""
    body = F.substring(segment, F.lit(1), F.length(segment) - len(END) - 1)
    return F.when(F.contains(body, F.lit("\\")), F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(body)


READ = schema_of(conv_id="long", n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long", expanded_tokens="long", n_attachments="long")


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, from its segments alone: digests of the turns read back and of the text under the loss mask.

    The segments are sorted inside partitions and streamed through running
    digests: no conversation is ever held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, state = [], object(), {}

        def close() -> None:
            if state:
                done.append(state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

        for batch in batches:
            for conv, segment, spans, attachments, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_spans", "attachments", "expanded_tokens")), strict=True):
                if conv != now:
                    close()
                    now = conv
                    state = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "expanded_tokens": 0, "n_attachments": 0}
                role, content = parse_segment(segment)
                state["turns_sha256"].update(f"{role}\n{unescape(content)}\n".encode())
                state["n_turns"] += 1
                state["formatted_chars"] += len(segment)
                state["expanded_tokens"] += tokens
                state["n_attachments"] += len(attachments)
                for span in spans:
                    trained = unescape(segment[span["start"] : span["stop"]])
                    state["loss_chars"] += len(trained)
                    state["loss_sha256"].update(trained.encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = to_arrow_schema(READ)
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", _plain(F.col("segment")), "segment")
    return dealt.mapInArrow(run, READ)
