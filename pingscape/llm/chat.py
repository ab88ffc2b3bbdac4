"""Chat formatting: turns with typed content parts, flattened into marked text and back.

A turn's content is a text (one text part) or an array of parts (`PART_TYPE`).  A visitor visits
the parts of every turn in order: text is escaped and written out, every image, audio and
document becomes a numbered placeholder, its reference is recorded with the number
of tokens it expands to.  A turn is

    ### Role:\\n  content  \\n</turn>\\n

Control strings inside texts (`### `, `</turn>`, `<part `) get one more backslash
before them, however many are there, and lose one on the way back; a real control
string follows a line feed that the template wrote (or begins a segment), so the
two never meet.  Texts
without control strings are written unchanged.

A conversation is written as segments of at most SEGMENT_TURNS turn numbers, so
one with very many turns is spread over tasks; a segment is cut into pieces of at most
SEGMENT_TURNS rows and about PIECE_CHARS characters while it streams, so no task holds a
conversation whole, also where turn numbers are null or repeat.  Its pieces one after
the other are its text.  Turns come in the order of (turn,
role, text), a null turn first; null role and text are empty; rows that repeat a
turn are further turns.  A text of any length is read in linear time.  An empty table gives
an empty one.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 256
PIECE_CHARS = 1 << 20
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_CONTROL = r"### |</turn>|<part "
# the look behind comes first, so that a run of backslashes is read once
_ESCAPE = re.compile(rf"(?<!\\)(?=\\*(?:{_CONTROL}))")
_UNESCAPE = re.compile(rf"(?<!\\)\\(?=\\*(?:{_CONTROL}))")
_TURN = re.compile(r"### ([^\n]*):\n(.*?)\n</turn>\n", re.DOTALL)
_PART = re.compile(r"\n<part (\d+) (image|audio|document) (\d+)>\n")


def escape(text: str) -> str:
    """One more backslash before every control string of a text."""
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    """The inverse of `escape`."""
    return _UNESCAPE.sub("", text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class PartVisitor:
    """Flattens content parts in order; remembers attachments and what they expand to."""

    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256
    attachments: list[dict] = field(default_factory=list)

    def visit_all(self, parts: list[dict]) -> str:
        """Parts in order; neighbouring texts are one text, so that no control string arises where they meet."""
        out: list[str] = []
        held = ""
        for part in parts:
            if self._is_text(part):
                held += part.get("text") or ""
            else:
                out += [escape(held), self.visit(part)]
                held = ""
        return "".join([*out, escape(held)])

    def _is_text(self, part: dict) -> bool:
        return (part.get("type") or "text") not in ("image", "audio", "document")

    def visit(self, part: dict) -> str:
        return self.visit_text(part) if self._is_text(part) else getattr(self, f"visit_{part['type']}")(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        rows, columns = (math.ceil((part.get(k) or 0) / self.image_patch) for k in ("height", "width"))
        return self._attach("image", part, rows * columns)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.audio_tokens_per_second))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 0) * self.document_tokens_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"number": n, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"\n<part {n} {kind} {tokens}>\n"


def as_parts(content: str | list[dict] | None) -> list[dict]:
    """Typed parts of a content; a text is one text part."""
    return [{"type": "text", "text": content}] if isinstance(content, str) else content or []


def write_turn(role: str | None, content: str | list[dict] | None, visitor: PartVisitor) -> tuple[str, int, int]:
    """(turn, start of its content in it, end of its content)."""
    head = f"### {_role(role or '')}:\n"
    body = visitor.visit_all(as_parts(content))
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, content start, content end) of each turn of a segment; placeholders stay in the text."""
    for m in _TURN.finditer(formatted):
        yield _role_back(m[1]), unescape(m[2]), m.start(2), m.end(2)


def read_parts(content: str) -> list[tuple]:
    """("text", text) and (kind, number, tokens) entries of a turn's escaped content, in order."""
    out: list[tuple] = []
    at = 0
    for m in _PART.finditer(content):
        if m.start() > at:
            out.append(("text", unescape(content[at : m.start()])))
        out.append((m[2], int(m[1]), int(m[3])))
        at = m.end()
    if at < len(content) or not out:
        out.append(("text", unescape(content[at:])))
    return out


_ATTACHMENT = "struct<number:int,kind:string,ref:string,tokens:int>"
_SPAN = "struct<begin:long,end:long>"


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per piece: conv_id, segment, piece, formatted, loss spans (code points in `formatted`), attachments, n_tokens of attachments.

    Attachments are numbered within their piece.
    """
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    turns = turns.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-(1 << 62))).cast("long"))
    ties = ["turn", "role"] + (["content"] if turns.schema["content"].dataType.simpleString() == "string" else [])
    turns = turns.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", *ties)
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, state, done, held = None, None, [], 0

        def finished() -> dict:
            text, spans, visitor = state
            return {"conv_id": key[0], "segment": key[1], "piece": piece, "formatted": "".join(text), "loss": spans, "attachments": visitor.attachments, "attachment_tokens": sum(a["tokens"] for a in visitor.attachments)}

        for b in batches:
            if schema is None:
                spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                attached = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
                schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("segment", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", spans), ("attachments", attached), ("attachment_tokens", pa.int64())])
            for conv, segment, role, content in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "role", "content")), strict=True):
                same = state is not None and key == (conv, segment)
                if not same or len(state[0]) >= SEGMENT_TURNS or size >= PIECE_CHARS:
                    if state is not None:
                        done.append(finished())
                        held += size
                    piece = piece + 1 if same else 0
                    key, state, size = (conv, segment), ([], [], PartVisitor()), 0
                    if held >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done, held = [], 0
                turn, begin, end = write_turn(role, content, state[2])
                state[0].append(turn)
                if role == loss_role and end > begin:
                    state[1].append({"begin": size + begin, "end": size + end})
                size += len(turn)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done, held = [], 0
        if state is not None:
            yield pa.RecordBatch.from_pylist([finished()], schema=schema)

    return turns.mapInArrow(run, f"conv_id {conv_type}, segment long, piece long, formatted string, loss array<{_SPAN}>, attachments array<{_ATTACHMENT}>, attachment_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted pieces: turn count, digest of the turns, and the text under the loss mask.

    A digest over a conversation is sequential; its pieces stream through one
    task in order and only the running digests are held.
    """
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "segment", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, key, state, done = None, None, None, []

        def finished() -> tuple:
            n, turns, chars, loss, size = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            if types is None:
                types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append(finished())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["begin"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield table(done)
                done = []
        if state is not None:
            yield table([finished()])

    return ordered.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
