"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped,
every other part becomes a placeholder; the attachment's reference, its place among the conversation's
attachments and the tokens that it expands to are recorded. Turns stand between marks, and so do neighbouring texts of a turn. Inside
texts and roles control strings (the template's and those of common formats) are broken by a backslash after their first character,
and backslashes are doubled, so marks and placeholders that stand in the formatted text are the template's own, and parts come
back exactly. The loss mask holds the character spans of assistant content.

Conversations stream through tasks sorted by conversation and turn, so a task holds one conversation at a time; a conversation is
one output string and stays together.

Cases: null text is empty, and empty text parts leave no trace; a null role is an empty role; a turn with null or absent content has
its text as one part; a part of an unknown kind is its text; null sizes of attachments count as 0, a null reference is empty; rows
of equal turn go by role, text, then content, and rows that repeat are turns each; all rows with a null conv_id make one conversation, whose id is null; very
long texts are kept whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
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

from .base import partitions

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
IMAGE, AUDIO, DOCUMENT = "<|image|>", "<|audio|>", "<|document|>"
CONTROL = (TURN, BODY, PART, END, IMAGE, AUDIO, DOCUMENT, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")
ESCAPE = "\\"
_BREAK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + r"|\\")
_MARKS = re.compile("(" + "|".join(re.escape(c) for c in (PART, IMAGE, AUDIO, DOCUMENT)) + ")")
#: The type of a column of parts: kind is text, image, audio or document.
CONTENT = "array<struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>>"
_JOIN = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _JOIN.sub(r"\1", text)


@dataclass(frozen=True)
class Text:
    text: str | None


@dataclass(frozen=True)
class Image:
    uri: str | None
    width: int | None
    height: int | None


@dataclass(frozen=True)
class Audio:
    uri: str | None
    seconds: float | None


@dataclass(frozen=True)
class Document:
    uri: str | None
    pages: int | None


@dataclass(frozen=True)
class Attachment:
    kind: str
    uri: str
    position: int  # among the conversation's attachments
    char: int  # of the placeholder in the formatted text
    tokens: int


@dataclass
class Formatted:
    text: str = ""
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)


Part = Text | Image | Audio | Document


def part_of(p: dict | None) -> Part:
    """A part from a row of a content column."""
    p = p or {}
    match p.get("kind"):
        case "image":
            return Image(p["uri"], p["width"], p["height"])
        case "audio":
            return Audio(p["uri"], p["seconds"])
        case "document":
            return Document(p["uri"], p["pages"])
    return Text(p.get("text"))


class Flattener:
    """Visits parts; ``pieces`` is the formatted text so far. Token counts: an image has one for each tile of ``tile`` pixels
    squared and one for the whole, audio ``per_second``, a document ``per_page`` for each page."""

    def __init__(self, tile: int = 28, per_second: float = 12.5, per_page: int = 512) -> None:
        self.tile, self.per_second, self.per_page = tile, per_second, per_page
        self.pieces: list[str] = []
        self.size = 0
        self.out = Formatted()

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def attach(self, kind: str, mark: str, uri: str | None, tokens: int) -> None:
        self.out.attachments.append(Attachment(kind, uri or "", len(self.out.attachments), self.size, tokens))
        self.put(mark)
        self.after_text = False

    def visit(self, part: Part) -> None:
        getattr(self, f"visit_{type(part).__name__.lower()}")(part)

    def visit_text(self, part: Text) -> None:
        if part.text:
            if self.after_text:  # two texts must not make up a control string together
                self.put(PART)
            self.put(escape(part.text))
            self.after_text = True

    def visit_image(self, part: Image) -> None:
        self.attach("image", IMAGE, part.uri, math.ceil((part.width or 0) / self.tile) * math.ceil((part.height or 0) / self.tile) + 1)

    def visit_audio(self, part: Audio) -> None:
        self.attach("audio", AUDIO, part.uri, math.ceil((part.seconds or 0) * self.per_second))

    def visit_document(self, part: Document) -> None:
        self.attach("document", DOCUMENT, part.uri, (part.pages or 0) * self.per_page)

    def turn(self, role: str | None, parts: list[Part]) -> None:
        self.after_text = False
        self.put(TURN)
        self.put(escape(role or ""))
        self.put(BODY)
        start = self.size
        for p in parts:
            self.visit(p)
        if role == "assistant":
            self.out.loss.append((start, self.size))
        self.put(END)

    def done(self) -> Formatted:
        self.out.text = "".join(self.pieces)
        return self.out


def parts_of(body: str, attachments: Iterator[Attachment]) -> list[Text | Attachment]:
    """The parts of formatted content. Each placeholder takes the next attachment."""
    out: list[Text | Attachment] = []
    for k, piece in enumerate(_MARKS.split(body)):
        if k % 2 and piece != PART:
            out.append(next(attachments))
        elif k % 2 == 0 and piece:
            out.append(Text(unescape(piece)))
    return out


def parse(formatted: str, attachments: list[Attachment] = ()) -> list[tuple[str, list[Text | Attachment]]]:
    """Roles and parts, read back."""
    out, rest = [], iter(attachments)
    for turn in formatted.split(END)[:-1]:
        role, _, body = turn.removeprefix(TURN).partition(BODY)
        out.append((unescape(role), parts_of(body, rest)))
    return out


def _text(parts: list[Text | Attachment]) -> str:
    return "".join(p.text for p in parts if isinstance(p, Text))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("position", pa.int64()), ("char", pa.int64()), ("tokens", pa.int64())]))
FORMATTED = "conv_id long, formatted string, loss array<struct<start: long, end: long>>, attachments array<struct<kind: string, uri: string, position: long, char: long, tokens: long>>, attachment_tokens long"


def conversations(rows: DataFrame, tile: int = 28, per_second: float = 12.5, per_page: int = 512) -> DataFrame:
    """rows: conv_id, turn, role, text or content (of type CONTENT) or both. conv_id, formatted, the loss mask's spans (start,
    end) in it, the attachments (kind, uri, position among them, char of the placeholder, tokens), and the sum of their tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        flat: Flattener | None = None
        done: list[tuple[int | None, Formatted]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            columns = [
                pa.array([c for c, _ in done], pa.int64()),
                pa.array([f.text for _, f in done], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in f.loss] for _, f in done], _SPANS),
                pa.array([[vars(a) for a in f.attachments] for _, f in done], _ATTACHMENTS),
                pa.array([sum(a.tokens for a in f.attachments) for _, f in done], pa.int64()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "loss", "attachments", "attachment_tokens"])

        for batch in batches:
            for conv, role, text, content in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if flat is None or conv != now:
                    if flat is not None:
                        done.append((now, flat.done()))
                        held += flat.size
                    now, flat = conv, Flattener(tile, per_second, per_page)
                flat.turn(role, [Text(text)] if content is None else [part_of(p) for p in content])
                if held > 4 << 20:
                    yield emit()
                    held = 0
        if flat is not None:
            done.append((now, flat.done()))
        if done:
            yield emit()

    order = ["conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("content").asc_nulls_first()]
    text = F.col("text").cast("string") if "text" in rows.columns else F.lit(None).cast("string")
    content = F.col("content").cast(CONTENT) if "content" in rows.columns else F.lit(None).cast(CONTENT)
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), text.alias("text"), content.alias("content"))
    return source.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(each, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss, attached in zip(*(batch.column(k).to_pylist() for k in range(4))):
                known = [Attachment(**a) for a in attached]
                turns = parse(text, known)
                said = "".join(_text(parts_of(text[s["start"] : s["end"]], iter(known))) for s in loss)
                whole = "".join(f"{role}\n{_text(parts)}\n" for role, parts in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss", "attachments").mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle() -> str:
    """The digests of the table and of conversation -1 as DuckDB SQL."""
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '{ESCAPE}', ''))" + "".join(f" + (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END)} + {escaped("role")} + {escaped("text")}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
