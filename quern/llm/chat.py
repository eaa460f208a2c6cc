"""Chat formatting of conversations whose turns hold typed content parts.

A visitor flattens a turn's parts into one string: texts as they are, with control
strings escaped, and images, audio and documents as numbered placeholders. Texts that
stand next to each other are escaped as one, so no control string arises between them. It notes
each attachment's reference, its place and the tokens that its placeholder expands
to. A conversation's turns are sorted within one task and streamed, so a very long
conversation needs no memory of its own length.

Null texts, roles and parts are empty; turns with equal numbers are ordered by role
and then text, null numbers come first; all rows with a null conversation id form one
conversation. Sizes that are null, negative, NaN or infinite count as zero, and every
attachment expands to one token at least; a part of an unknown type is an attachment of
kind ``other`` and one token. An empty table gives no rows, and other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_or_empty

START, BODY, END = "<|start|>", "<|body|>", "<|end|>\n"
PLACEHOLDER = "<|{kind}:{number}|>"

#: What follows the first character of control strings of common templates (fixed values): <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
AFTER_FIRST = r"(?<=<)\\*(?:\||s>|/s>|<SYS>>|</SYS>>)|(?<=\[)\\*(?:INST\]|/INST\])"
ESCAPE = re.compile(rf"(?:{AFTER_FIRST})")
UNESCAPE = re.compile(r"(?<=<)\\(?=\\*(?:\||s>|/s>|<SYS>>|</SYS>>))|(?<=\[)\\(?=\\*(?:INST\]|/INST\]))")
TURN = re.compile(r"<\|start\|>(.*?)<\|body\|>(.*?)<\|end\|>\n", re.DOTALL)
FOUND = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")

#: What fits in a long, for attachments of absurd sizes.
MOST_TOKENS = (1 << 63) - 1

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<number:int,kind:string,ref:string,at:long,tokens:long>>"
TURNS = f"conv_id {{id}}, turn_index long, role string, formatted string, loss array<struct<start:long,end:long>>, attachments {ATTACHMENTS}"


def escape(text: str) -> str:
    """Put one backslash more after the first character of each control string."""
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("", text)


def measure(size: float | None) -> float:
    return size if size and size > 0 and isfinite(size) else 0


class Flatten:
    """Visits the parts of one turn after another; numbers go on through a conversation."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 256) -> None:
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.number = 0
        self.begin_turn(0)

    def begin_turn(self, at: int) -> None:
        """``at``: code points of the turn before its body."""
        self.out: list[str] = []
        self.at = at
        self.waiting: list[str] = []
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def end_turn(self) -> str:
        self._put_texts()
        return "".join(self.out)

    def _put(self, piece: str) -> int:
        self.out.append(piece)
        self.at += len(piece)
        return self.at - len(piece)

    def _put_texts(self) -> None:
        """The texts since the last attachment, which are escaped together."""
        if self.waiting:
            start = self._put(escape("".join(self.waiting)))
            self.texts.append((start, self.at))
            self.waiting = []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part.get("type") or "text", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        w, h = (max(1, ceil(measure(part.get(k)) / self.patch)) for k in ("width", "height"))
        self._attach("image", part, w * h)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, ceil(measure(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(measure(part.get("pages")))) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._put_texts()
        at = self._put(PLACEHOLDER.format(kind=kind, number=self.number))
        self.attachments.append({"number": self.number, "kind": kind, "ref": part.get("ref"), "at": at, "tokens": min(tokens, MOST_TOKENS)})
        self.number += 1


def format_turn(visitor: Flatten, role: str, parts: list[dict | None]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """A turn's text, the spans of it that are under the loss (an assistant's texts), and its attachments."""
    head = START + escape(role) + BODY
    visitor.begin_turn(len(head))
    for part in parts:
        visitor.visit(part)
    return head + visitor.end_turn() + END, visitor.texts if role == "assistant" else [], visitor.attachments


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, or of a part of it between turns."""
    return [(unescape(role), unescape(body)) for role, body in TURN.findall(formatted)]


def parse_attachments(formatted: str) -> list[tuple[str, int]]:
    return [(kind, int(number)) for kind, number in FOUND.findall(formatted)]


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text, or an array of parts) -> a formatted string per turn, in order.

    Joined in order of ``turn_index`` they are the conversation. A conversation's
    rows stay together, and sorted, in one partition.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    content = F.col(parts).cast(PARTS) if parts else F.array(F.struct(F.lit("text").alias("type"), text_or_empty(F.col("text")).alias("text")))
    rows = turns.select("conv_id", "turn", text_or_empty(F.col("role")).alias("role"), content.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, visitor = object(), 0, Flatten()
        for batch in batches:
            ids, roles, all_parts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "parts"))
            numbers, texts, loss, attached = [], [], [], []
            for conv, role, some in zip(ids, roles, all_parts, strict=True):
                if conv != now:
                    now, index, visitor = conv, 0, Flatten()
                text, spans, attachments = format_turn(visitor, role, some or [])
                numbers.append(index), texts.append(text), attached.append(attachments)
                loss.append([{"start": a, "end": b} for a, b in spans])
                index += 1
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            held = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(numbers, pa.int64()), batch.column("role"), pa.array(texts, pa.string()), pa.array(loss, span), pa.array(attached, held)],
                ["conv_id", "turn_index", "role", "formatted", "loss", "attachments"],
            )

    return rows.mapInArrow(run, TURNS.format(id=kind))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted turns say, a row per conversation (see the query op1)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, attachment_tokens long"

    class Read:
        def __init__(self, conv: object) -> None:
            self.conv, self.turns, self.chars, self.loss_chars, self.held, self.tokens = conv, 0, 0, 0, 0, 0
            self.said, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, spans: list[dict], attached: list[dict]) -> None:
            for role, body in parse_turns(text):
                self.turns += 1
                self.said.update(f"{role}\n{body}\n".encode())
            for span in spans:
                learned = unescape(text[span["start"] : span["end"]])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode())
            self.chars += len(text)
            self.held += len(attached)
            self.tokens += sum(x["tokens"] for x in attached)

        def row(self) -> tuple:
            return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.held, self.tokens

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "attachment_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type = None, None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else None) for k, c in enumerate(zip(*rows, strict=True))], names)
        for batch in batches:
            id_type, done = batch.column("conv_id").type, []
            for conv, text, spans, attached in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "attachments")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = Read(conv)
                now.add(text, spans, attached)
            if done:
                yield table(done)
        if now:
            yield table([now.row()])

    return formatted.mapInArrow(run, schema)


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured as (
  select *, len(regexp_extract_all(text, '<\\*(\||s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])'))
          + len(regexp_extract_all(role, '<\\*(\||s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) as escapes
  from turns)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(text) + escapes + 9 + 8 + 8)::bigint as formatted_chars,
       0::bigint as attachments, 0::bigint as attachment_tokens
from measured group by conv_id
"""
