"""Chat formatting of typed content parts: a visitor flattens text, image, audio and document parts of each turn into
one marked string with ordered placeholders, and records attachment references, loss spans and expanded token counts.

A turn becomes ``<|turn|>role<|says|>content<|end|>``; attachments stand in the content as their placeholder.
Control strings, those of this template and of others, are escaped in roles and texts by a backslash behind their
first character; where backslashes already stand there, by one more. Dropping one reads them back, so every
text survives, and a formatted conversation holds control strings where the template put them and nowhere else.

Output is a row for each turn, in order, with the code point at which it starts, so that a conversation of any length
is never held whole; ``assemble`` joins the turns of conversations that fit a row.

Defined cases: a null text is empty, a null role the empty role; null parts are left out; unknown kinds of part become
``<|attachment|>``; turns are ordered by turn (nulls first), equal turns by their formatted text; repeated rows are
repeated turns; rows with a null conversation are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgraph.llm import bpe
from docgraph.llm.common import small_batches

#: The type of a content part; only ``kind`` and what its kind needs have to be filled.
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
#: Characters of formatted text in one batch handed on.
BATCH_CHARS = 4 << 20

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHMENT = pa.struct([("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_TURN_SCHEMA = "turn bigint, formatted string, n_chars bigint, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<kind:string,uri:string,at:bigint,tokens:bigint>>, expanded_tokens bigint"


@dataclass(frozen=True)
class Template:
    """Marks of a chat format. ``foreign`` are control strings of other formats, which are escaped too."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "attachment": "<|attachment|>"})
    foreign: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.controls()
        for a, b in itertools.product(marks, marks):
            for k in range(1, len(a)):
                if a[k] == b[0] and (a[k:].startswith(b) or b.startswith(a[k:])):
                    raise ValueError(f"control string {b!r} could begin inside {a!r}")
        if any("\\" in c or len(c) < 2 for c in marks):
            raise ValueError("control strings have two characters or more and no backslash")

    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.says, self.end, *self.placeholders.values(), *self.foreign)

    def patterns(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        """(where an escape goes, where one is, the template's own marks)."""
        firsts: dict[str, list[str]] = {}
        for c in sorted(set(self.controls())):
            firsts.setdefault(c[0], []).append(re.escape(c[1:]))
        heads = [(re.escape(first), "|".join(rests)) for first, rests in sorted(firsts.items())]
        put = "|".join(f"{first}\\\\*(?={rests})" for first, rests in heads)
        got = "|".join(f"{first}\\\\+(?={rests})" for first, rests in heads)
        own = "|".join(map(re.escape, sorted({self.turn, self.says, self.end, *self.placeholders.values()}, key=len, reverse=True)))
        return re.compile(put), re.compile(got), re.compile(f"({own})")


@dataclass(frozen=True)
class Sizes:
    """Tokens that a placeholder expands to: image patches, audio frames, document pages."""

    patch: int = 28
    image: int = 256
    per_second: float = 25.0
    per_page: int = 1024

    def tokens(self, kind: str, part: dict) -> int:
        if kind == "image":
            width, height = part.get("width"), part.get("height")
            return math.ceil(width / self.patch) * math.ceil(height / self.patch) if width and height else self.image
        if kind == "audio":
            return math.ceil((part.get("seconds") or 0.0) * self.per_second)
        if kind == "document":
            return (part.get("pages") or 1) * self.per_page
        return 1


class Flattener:
    """Visits the parts of one turn after another: ``text_part`` for text, ``attached`` for the other kinds."""

    def __init__(self, template: Template, sizes: Sizes) -> None:
        self.template, self.sizes = template, sizes
        self.put = template.patterns()[0]

    def escaped(self, text: str) -> str:
        return self.put.sub(lambda m: m[0] + "\\", text)

    def turn(self, role: str | None, parts: list[dict | None] | None) -> tuple[str, list[dict], list[dict]]:
        """(formatted, loss spans, attachments) of a turn; positions are code points of the formatted turn."""
        self.out, self.at, self.loss, self.found, self.texts = [], 0, [], [], []
        role = role or ""
        self.write(self.template.turn + self.escaped(role) + self.template.says)
        for part in parts or []:
            if part is not None:
                getattr(self, f"{part.get('kind')}_part", self.attached)(part, role)
        self.flush(role)
        self.write(self.template.end)
        return "".join(self.out), self.loss, self.found

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def text_part(self, part: dict, role: str) -> None:
        self.texts.append(part.get("text") or "")

    def flush(self, role: str) -> None:
        """Neighbouring texts are escaped as one, for a control string may lie across them."""
        text = self.escaped("".join(self.texts))
        self.texts = []
        if role in self.template.loss_roles and text:
            self.loss.append({"start": self.at, "end": self.at + len(text)})
        self.write(text)

    def attached(self, part: dict, role: str) -> None:
        self.flush(role)
        kind = part.get("kind") if part.get("kind") in self.template.placeholders else "attachment"
        self.found.append({"kind": part.get("kind"), "uri": part.get("uri"), "at": self.at, "tokens": self.sizes.tokens(kind, part)})
        self.write(self.template.placeholders[kind])


def text_parts(df: DataFrame, text_col: str = "text", to: str = "parts") -> DataFrame:
    """``df`` with its text as the only part of each row, in a column ``to``."""
    text = F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return df.withColumn(to, F.array(text).cast(PARTS))


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", template: Template = Template(), sizes: Sizes = Sizes(), tokenizer: str | None = None) -> DataFrame:
    """conv_id, seq (from 0), start, formatted, n_chars, loss, attachments (kind, uri, at, tokens) and expanded_tokens of
    every turn; start, loss and at are code points of the conversation's turns joined in order.

    expanded_tokens counts the attachments' tokens and, with the path of a ``tokenizer``, those of the texts between.
    """
    slim = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(parts_col).cast(PARTS).alias("parts"))
    kind = slim.schema["conv_id"].dataType.simpleString()
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(bpe.tokenizer(tokenizer)) if tokenizer else None

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = Flattener(template, sizes)
        own = template.patterns()[2]
        for batch in batches:
            a = 0
            rows: list[tuple] = []
            size = 0
            for i, (turn, role, parts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("turn", "role", "parts")))):
                text, loss, found = flat.turn(role, parts)
                tokens = sum(f["tokens"] for f in found)
                if sent is not None:
                    model = bpe.loaded(tokenizer, sent.value)
                    tokens += sum(g[1] for lists in model.chunks(own.split(text)[::2]) for got in lists for g in got)
                rows.append((turn, text, len(text), loss, found, tokens))
                size += len(text)
                if size > BATCH_CHARS or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.list_(_SPAN), pa.list_(_ATTACHMENT), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(a, i + 1 - a), *columns], names=["conv_id", "turn", "formatted", "n_chars", "loss", "attachments", "expanded_tokens"])
                    a, rows, size = i + 1, [], 0

    pieces = slim.mapInArrow(visit, f"conv_id {kind}, {_TURN_SCHEMA}")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "formatted")
    before = F.coalesce(F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("*", (F.row_number().over(order) - 1).cast("long").alias("seq"), before.alias("start"))
    loss = F.transform("loss", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    attachments = F.transform("attachments", lambda s: F.struct(s["kind"].alias("kind"), s["uri"].alias("uri"), (s["at"] + F.col("start")).alias("at"), s["tokens"].alias("tokens")))
    return placed.select("conv_id", "seq", "start", "formatted", "n_chars", loss.alias("loss"), attachments.alias("attachments"), "expanded_tokens")


class Reader:
    """Reads formatted turns back."""

    def __init__(self, template: Template) -> None:
        self.template = template
        _, self.got, self.own = template.patterns()

    def unescaped(self, text: str) -> str:
        return self.got.sub(lambda m: m[0][:-1], text)

    def turn(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn; placeholders are not part of the text."""
        pieces = self.own.split(formatted)
        marks, texts = pieces[1::2], pieces[::2]
        t = self.template
        if len(marks) < 3 or (marks[0], marks[1], marks[-1]) != (t.turn, t.says, t.end) or texts[0] or texts[-1] or not set(marks[2:-1]) <= set(t.placeholders.values()):
            raise ValueError("not one turn of this template")
        return self.unescaped(texts[1]), "".join(map(self.unescaped, texts[2:-1]))


def _by_conversation(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, seq, role, text, loss_text (what lies under the loss mask) and formatted_chars, read from the output
    of ``format_turns``. Rows stay in their partitions and order."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(template)
        for batch in batches:
            roles, texts, masked, chars = [], [], [], []
            for start, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("start", "formatted", "loss"))):
                role, text = reader.turn(formatted)
                roles.append(role)
                texts.append(text)
                masked.append("".join(reader.unescaped(formatted[s["start"] - start : s["end"] - start]) for s in loss))
                chars.append(len(formatted))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), *(pa.array(x, pa.string()) for x in (roles, texts, masked)), pa.array(chars, pa.int64())], names=["conv_id", "seq", "role", "text", "loss_text", "formatted_chars"])

    return turns.select("conv_id", "seq", "start", "formatted", "loss").mapInArrow(read, f"conv_id {kind}, seq bigint, role string, text string, loss_text string, formatted_chars bigint")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of the rows of ``read_back``.

    Turns stream through the hashes in order; no conversation is held whole.
    """
    kind = read.schema["conv_id"].dataType.simpleString()
    conv_type = to_arrow_type(read.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars"))))
        out = []

        def batch_of() -> pa.RecordBatch:
            conv, *rest = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=names)

        for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
            n, chars, masked = 0, 0, 0
            said, loss = hashlib.sha256(), hashlib.sha256()
            for _, role, text, loss_text, size in turns:
                n, chars, masked = n + 1, chars + size, masked + len(loss_text)
                said.update(f"{role}\n{text}\n".encode())
                loss.update(loss_text.encode())
            out.append((conv, n, said.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield batch_of()
                out.clear()
        if out:
            yield batch_of()

    return _by_conversation(read).mapInArrow(stream, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss, attachments and expanded_tokens: a row for each conversation, for those that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "formatted", "loss", "attachments")))
    got = turns.groupBy("conv_id").agg(ordered.alias("turns"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return got.select("conv_id", F.array_join("turns.formatted", "").alias("formatted"), F.flatten("turns.loss").alias("loss"), F.flatten("turns.attachments").alias("attachments"), "expanded_tokens")
