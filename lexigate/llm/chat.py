"""Chat formatting by event-sourced reconstruction.

A log of events (message, delta, edit, regenerate) is partitioned by conversation,
sorted by turn and sequence and folded into final messages: ``message`` opens a turn
with a role and text, ``delta`` appends, ``edit`` replaces the text, ``regenerate``
empties it for the deltas that follow. Events of one turn stand together in the sort,
so the fold holds one message at a time and a conversation of any length passes
through in bounded memory. Each message is rendered as one segment of its
conversation's text with the span that the loss covers (assistant text only).

The template is ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Control strings
inside a text or role get a backslash after their first character, one more than
they had; reading back removes it, so every text comes back exactly.

Defined cases: null text or role is empty; repeated rows are separate messages,
ordered by role and text within a turn; a null turn comes first; rows without
conv_id form one conversation; events before any ``message`` of their turn open one
with an empty role; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
# Fixed control strings of common templates, without their first character < or [.
_CONTROL = r"(\|(?:im_start|im_end|endoftext|system|user|assistant|eot_id|start_header_id|end_header_id)\|>|/?s>|/?INST\]|/?SYS>>)"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
DELTA_CHARS = 256


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_in(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start, end): the span of the text in the segment if the loss covers
    it, else an empty one."""
    head, body = f"{START}{_role_in(role)}\n", escape(text)
    start = len(head)
    return f"{head}{body}{END}\n", start, start + (len(body) if role == ASSISTANT else 0)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(_role_out(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def event_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that streaming them would leave:
    an opening message and its text in deltas."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    copies = rows.withColumn("copy", F.row_number().over(
        Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    parts = F.ceil(F.char_length("text") / delta_chars).cast("int")
    events = F.concat(
        F.array(F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("text"))),
        F.when(parts > 0, F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda k: F.struct(
            k.alias("seq"), F.lit("delta").alias("kind"),
            F.substring("text", (k - 1) * delta_chars + 1, F.lit(delta_chars)).alias("text"))))
        .otherwise(F.array().cast("array<struct<seq:int,kind:string,text:string>>")))
    return copies.select("conv_id", "turn", "copy", "role", F.inline(events))


def format_conversations(log: DataFrame) -> DataFrame:
    """Segments (conv_id, position, role, formatted, loss_start, loss_end) of the log
    (conv_id, turn, copy, seq, kind, role, text). A conversation's segments stand
    together and in order; joined they are its formatted text."""
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, role, parts, position = None, "", [], 0  # the message being folded

        def closed() -> tuple:
            segment, start, end = render(role, "".join(parts))
            return open_[0], position, role, segment, start, end

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "copy", "kind", "role", "text")]
            for conv, turn, copy, kind, own, text in zip(*columns):
                if open_ != (conv, turn, copy):
                    if open_ is not None:
                        out.append(closed())
                        position = position + 1 if open_[0] == conv else 0
                    open_, role, parts = (conv, turn, copy), "", []
                if kind == "message":
                    role, parts = own or "", [text or ""]
                elif kind == "delta":
                    parts.append(text or "")
                elif kind == "edit":
                    parts = [text or ""]
                elif kind == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown event kind {kind!r}")
            yield _segments(out, kind_of)
        if open_ is not None:
            yield _segments([closed()], kind_of)

    kind_of = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[
        log.schema["conv_id"].dataType.simpleString()]
    return dealt.select("conv_id", "turn", "copy", "kind", "role", "text").mapInArrow(
        run, f"conv_id {log.schema['conv_id'].dataType.simpleString()}, position long, role string, "
             "formatted string, loss_start long, loss_end long")


def _segments(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "position", "role", "formatted", "loss_start", "loss_end"]
    types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        self.chars += len(formatted)
        for role, text in read_back(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        covered = unescape(formatted[start:end])
        self.loss_chars += len(covered)
        self.loss.update(covered.encode("utf-8", "surrogatepass"))


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments. The segments must stand
    as ``format_conversations`` leaves them (no shuffle in between); hashes run along
    them, so memory does not grow with a conversation."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d.conv for d in done], conv_type), pa.array([d.turns for d in done], pa.int64()),
             pa.array([d.all.hexdigest() for d in done], pa.string()),
             pa.array([d.loss_chars for d in done], pa.int64()),
             pa.array([d.loss.hexdigest() for d in done], pa.string()),
             pa.array([d.chars for d in done], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "position", "formatted", "loss_start", "loss_end")]
            for conv, position, formatted, start, end in zip(*columns):
                if own is None or own.conv != conv or position == 0:
                    if own is not None:
                        done.append(own)
                    own = _Digest(conv)
                own.add(formatted, start, end)
            yield rows(done)
        if own is not None:
            yield rows([own])

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long")
