"""Chat formatting over typed content parts: placeholders, attachments, expanded token counts and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is HEAD role COLON body END. Inside texts and roles every character of CONTROL is preceded by a backslash.
HEAD, COLON, END = "### ", ": ", " </turn>\n"
CONTROL = "\\#<:"
ESCAPES = {ord(c): "\\" + c for c in CONTROL}
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
#: Tokens that a placeholder stands for: of an image patch of 28 x 28 pixels, of a second of sound, of a document's page.
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 512
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return text.translate(ESCAPES)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of a conversation in order and builds its output."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def turn(self, index: int, role: str | None, parts: list[dict]) -> None:
        self.put(f"{HEAD}{escape(role or '')}{COLON}")
        for part in parts:
            visit = getattr(self, f"visit_{part['kind']}", None)
            if visit is None:
                raise ValueError(f"unknown kind of content part: {part['kind']}")
            start = self.length
            visit(index, part)
            if role == "assistant" and part["kind"] == "text":
                self.spans.append((start, self.length))
        self.put(END)

    def visit_text(self, index: int, part: dict) -> None:
        self.put(escape(part["text"] or ""))

    def visit_image(self, index: int, part: dict) -> None:
        patches = math.ceil((part["width"] or 1) / PATCH) * math.ceil((part["height"] or 1) / PATCH)
        self.attach(index, part, patches)

    def visit_audio(self, index: int, part: dict) -> None:
        self.attach(index, part, max(1, math.ceil((part["seconds"] or 0) * TOKENS_A_SECOND)))

    def visit_document(self, index: int, part: dict) -> None:
        self.attach(index, part, max(1, part["pages"] or 1) * TOKENS_A_PAGE)

    def attach(self, index: int, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.put(f"<{part['kind']}:{n}>")
        self.attachments.append({"n": n, "turn": index, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation, placeholders left out of the text."""
    found, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        body = "".join(unescape(x) if i % 2 == 0 else "" for i, x in enumerate(split_placeholders(m[2])))
        found.append((unescape(m[1]), body))
        at = m.end()
    return found


def split_placeholders(body: str) -> list[str]:
    """Escaped text and placeholders in turn; a placeholder's bracket is never preceded by an escaping backslash."""
    out, last = [], 0
    for m in re.finditer(r"\\.|<(?:image|audio|document):\d+>", body, re.S):
        if m[0][0] == "<":
            out += [body[last : m.start()], m[0]]
            last = m.end()
    return [*out, body[last:]]


FORMATTED = (
    "conv_id long, n_turns long, formatted string, loss_spans array<struct<first:int,last:int>>, "
    "attachments array<struct<n:int,turn:int,kind:string,ref:string,tokens:int>>, attached_tokens long"
)
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))), ("attached_tokens", pa.int64()),
])


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Give each row a column `parts` that holds its text as the only part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text")).cast("struct<kind:string,text:string>")
    return turns.withColumn(
        "parts",
        F.array(F.struct(part["kind"].alias("kind"), part["text"].alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))),
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """One formatted conversation per conv_id from rows (conv_id, turn, role, parts).

    Turns are ordered by turn, then role and parts, so ties and repeated rows have one order; all are kept. Null turns
    come first; null roles and texts are empty; rows without conv_id are one conversation. loss_spans are code points of the
    output that hold the assistant's texts. A conversation is one output row, so it is gathered whole. Unknown kinds of
    parts raise an error. Other columns are dropped.
    """
    rows = turns.selectExpr("conv_id", "struct(turn, role, parts) t").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                f = Flattener()
                turns_of = batch.column("turns")[i].as_py()
                for index, t in enumerate(turns_of):
                    f.turn(index, t["role"], t["parts"] or [])
                found.append((len(turns_of), "".join(f.out), [{"first": a, "last": b} for a, b in f.spans], f.attachments, sum(a["tokens"] for a in f.attachments)))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), *(pa.array(c, k.type) for c, k in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return rows.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back and digest their turns and the text under the loss mask."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][s["first"] : s["last"]]) for s in r["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                found.append((r["conv_id"], len(turns), sha(said), len(loss), sha(loss), len(r["formatted"])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, DIGEST)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
