"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor
flattens the parts in order: text goes in with its control strings escaped, the
others become placeholders, and each leaves an attachment reference and the
number of tokens that its placeholder expands to.

The template, for each turn::

    <s>ROLE\\n ... </s>\\n

A placeholder is ``<|kind:N|>``, N the attachment's number in the conversation.
Inside texts and roles every control string (any of `CONTROL`) gets a backslash
after its first character, and a backslash that follows such a first character
is doubled; so escaping is reversible, and no text can end a turn or fake a
placeholder.

Rows are formatted one turn at a time in the order of turn, within the
partition that a conversation is dealt to.  A turn's output holds its own
chunk, its place in the whole, and the loss mask's spans; memory doesn't grow
with the number of a conversation's turns.

Defined cases: a null text is empty; a null role is an empty role.  Turns go in
the order of turn (null first), then role, then text; repeated rows are repeated
turns.  Rows without conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

TURN, END = "<s>", "</s>"
#: What may not appear as itself inside a text: the turn marks, placeholders and common instruction marks.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
LEARNED = "assistant"
#: Tokens that a placeholder expands to: image tiles of so many pixels and tokens each, audio
#: frames a second, tokens a page of a document.
TILE, TILE_TOKENS, FRAMES, PAGE_TOKENS = 336, 144, 25, 256

_escape = re.compile(r"([<\[])(?=\\|" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_unescape = re.compile(r"([<\[])\\")
_token = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return _escape.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As `escape`, and on one line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@dataclass
class Part:
    """kind: text, image, audio or document.  ref: where an attachment's data lie."""

    kind: str
    text: str | None = None
    ref: str | None = None
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0


@dataclass
class Attachment:
    number: int
    kind: str
    ref: str | None
    tokens: int


@dataclass
class Visitor:
    """Flattens parts into text with placeholders; keeps count over a conversation."""

    number: int = 0
    attachments: list[Attachment] = field(default_factory=list)

    def flatten(self, parts: list[Part]) -> str:
        """The parts in order; texts that meet are escaped as one."""
        runs: list[Part] = []
        for part in parts:
            if part.kind == "text" and runs and runs[-1].kind == "text":
                runs[-1] = Part("text", (runs[-1].text or "") + (part.text or ""))
            else:
                runs.append(part)
        return "".join(map(self.visit, runs))

    def visit(self, part: Part) -> str:
        method = getattr(self, f"visit_{part.kind}", None)
        if method is None:
            raise ValueError(f"unknown kind of content part: {part.kind!r}")
        return method(part)

    def visit_text(self, part: Part) -> str:
        return escape(part.text or "")

    def visit_image(self, part: Part) -> str:
        tiles = max(1, math.ceil(part.width / TILE)) * max(1, math.ceil(part.height / TILE))
        return self.attach(part, tiles * TILE_TOKENS)

    def visit_audio(self, part: Part) -> str:
        return self.attach(part, max(1, math.ceil(part.seconds * FRAMES)))

    def visit_document(self, part: Part) -> str:
        return self.attach(part, max(1, part.pages) * PAGE_TOKENS)

    def attach(self, part: Part, tokens: int) -> str:
        self.attachments.append(Attachment(self.number, part.kind, part.ref, tokens))
        self.number += 1
        return f"<|{part.kind}:{self.number - 1}|>"

    def taken(self) -> list[Attachment]:
        out, self.attachments = self.attachments, []
        return out


def turn_chunk(role: str, body: str) -> tuple[str, tuple[int, int] | None]:
    """A formatted turn, and the span in it that the loss mask covers: a learned turn's body."""
    head = f"{TURN}{escape_role(role)}\n"
    chunk = f"{head}{body}{END}\n"
    return chunk, (len(head), len(head) + len(body)) if role == LEARNED else None


_read = re.compile(r"<s>(.*?)\n(.*?)</s>\n", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and unescaped text of each turn of formatted text; placeholders stay."""
    at = 0
    while at < len(formatted):
        m = _read.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape_role(m[1]), unescape(m[2])
        at = m.end()


def placeholders(formatted: str) -> list[tuple[str, int]]:
    """Kind and number of the placeholders, in order."""
    return [(m[1], int(m[2])) for m in _token.finditer(formatted)]


PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_ATTACHMENTS = "array<struct<number:long,kind:string,ref:string,tokens:long>>"


def _formatted(parts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation's id
        visitor, place, at = Visitor(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != now:
                    now, visitor, place, at = conv, Visitor(), 0, 0
                pieces = [Part(**{k: v for k, v in p.items() if v is not None}) for p in content or ()] if parts else [Part("text", content)]
                chunk, span = turn_chunk(role or "", visitor.flatten(pieces))
                got = [vars(a) for a in visitor.taken()]
                out.append((conv, place, at, chunk, *(span or (None, None)), got, sum(a["tokens"] for a in got)))
                place, at = place + 1, at + len(chunk)
            names = ["conv_id", "place", "at", "chunk", "loss_start", "loss_end", "attachments", "expanded_tokens"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def ordered(turns: DataFrame, content: str, parts: bool) -> DataFrame:
    """conv_id, role, content with each conversation whole and in order in one partition."""
    tie = F.to_json(content) if parts else F.col(content)
    rows = turns.select("conv_id", F.col("role").alias("role"), F.col(content).alias("content"), F.col("turn").alias("o0"), tie.alias("o1"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "o0", "role", "o1").select("conv_id", "role", "content")


def format_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    """One row a turn: conv_id, place (its number in the conversation), at (code points of
    the conversation before it), chunk (its formatted text), loss_start and loss_end
    (code points of the chunk that the loss mask covers, else null), attachments and
    expanded_tokens.  A conversation's formatted text is its chunks in order.

    content: a column of texts, or of parts (`PART_TYPE`).
    """
    ship(turns.sparkSession)
    parts = turns.schema[content].dataType.typeName() == "array"
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, at long, chunk string, loss_start long, loss_end long, attachments {_ATTACHMENTS}, expanded_tokens long"
    return ordered(turns, content, parts).mapInArrow(_formatted(parts), schema)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, at: int, chunk: str, start: int | None, end: int | None) -> None:
        if at != self.formatted_chars:
            raise ValueError("a chunk is out of place")
        for role, text in read_turns(chunk):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if start is not None:
            learned = unescape(chunk[start:end])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.formatted_chars += len(chunk)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, digest, key = None, None, pa.int64()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * (len(kinds) + 1)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [key, *kinds], strict=True)], names)

    for batch in batches:
        rows, key = [], batch.schema.field(0).type
        columns = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "at", "chunk", "loss_start", "loss_end"))
        for conv, at, chunk, start, end in zip(*columns, strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    rows.append((now, *digest.row()))
                now, digest = conv, _Digest()
            digest.add(at, chunk, start, end)
        yield made(rows)
    if digest is not None:
        yield made([(now, *digest.row())])


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256 and formatted_chars.  It follows `format_turns` in the same
    tasks, whose rows are in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_turns(turns).mapInArrow(_digested, schema)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns with conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
