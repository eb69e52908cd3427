"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor walks over the parts in
order and flattens them into one text in which attachments are numbered placeholders; it records
what each placeholder refers to and how many tokens it stands for once expanded. The template
then marks the turns. Control strings that occur in texts are escaped by a backslash after their
first character, one more for each that is there already, so reading back gives every text exactly.

Formatting is row by row and not shuffled: a conversation is the sequence of its segments, each
with the span that the loss mask covers. Reading back streams the sorted segments of a partition
and holds one segment at a time, however long a conversation is. Only the digests of a
conversation, which are sequential by nature, see all of its segments in one task.

Null texts and roles are empty. Turns with one number are ordered by role and formatted text. A part
of a kind that is not known, or null, gives a placeholder of its own that stands for no tokens; its kind
and reference are recorded as they are. A null conversation id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that attachments stand for: a square of pixels, a second, a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 640

#: Marks of the template. A turn opens with its role's mark and ends with its closing one.
OPENING = {"user": "[INST] ", "assistant": "[OUT] ", "system": "[SYS] "}
CLOSING = {"user": " [/INST]", "assistant": " </s>", "system": " [/SYS]"}
OTHER, OTHER_END = "[ROLE] ", " [/ROLE]"
_NAMES = r"(?:/?s>|/?INST\]|/?OUT\]|/?SYS\]|/?ROLE\]|(?:IMG|AUD|DOC|ATT) [0-9]+\])"
_CONTROL = re.compile(r"([<\[])(\\*)(?=" + _NAMES + ")")
_ESCAPED = re.compile(r"([<\[]\\*)\\(?=" + _NAMES + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one message; attachments are numbered from 1."""

    def __init__(self):
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.pending: list[str] = []

    def visit(self, part: dict | None) -> None:
        part = part or {"kind": None, "ref": None}
        acts = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        acts.get(part["kind"], self.visit_other)(part)

    def flush(self) -> None:
        """Escape neighbouring texts together: a control string may begin in one and end in the next."""
        self.pieces.append(escape("".join(self.pending)))
        self.pending = []

    def visit_text(self, part: dict) -> None:
        self.pending.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part["width"] or PATCH) / PATCH) * math.ceil((part["height"] or PATCH) / PATCH)
        self._attach("IMG", part, tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("AUD", part, math.ceil((part["seconds"] or 0) * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("DOC", part, (part["pages"] or 1) * PER_PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach("ATT", part, 0)

    def _attach(self, mark: str, part: dict, tokens: int) -> None:
        self.flush()
        number = len(self.attachments) + 1
        self.pieces.append(f"[{mark} {number}]")
        self.attachments.append({"number": number, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})


def segment(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """A turn under the template, the span the loss mask covers (empty but for assistants), and its attachments."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    visitor.flush()
    body = "".join(visitor.pieces)
    head = OPENING.get(role)
    if head is None:
        head, tail = OTHER + escape(role) + OTHER_END, " </s>"
    else:
        tail = CLOSING[role]
    start = len(head)
    return head + body + tail, start, start + len(body) if role == "assistant" else start, visitor.attachments


def read_back(text: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders stay."""
    for role, head in OPENING.items():
        if text.startswith(head):
            return role, unescape(text[len(head) : -len(CLOSING[role])])
    role, _, body = text[len(OTHER) :].partition(OTHER_END)
    return unescape(role), unescape(body[: -len(" </s>")])


_SEGMENTS = (
    "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, "
    "attachments array<struct<number:int,kind:string,ref:string,tokens:int>>"
)


def formatted(messages: DataFrame) -> DataFrame:
    """Segments of messages (conv_id, turn, role, parts): the turn's text, loss span and attachments."""
    bounded_batches(messages.sparkSession)
    kind = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [segment(r, p) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role")),
                    pa.array([x[0] for x in made], pa.string()),
                    pa.array([x[1] for x in made], pa.int32()),
                    pa.array([x[2] for x in made], pa.int32()),
                    pa.array([x[3] for x in made], kind),
                ],
                ["conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments"],
            )

    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(PARTS)).alias("parts"),
    )
    return rows.mapInArrow(run, _SEGMENTS)


def text_messages(conversations: DataFrame) -> DataFrame:
    """Messages with one text part each, from rows of conv_id, turn, role and text."""
    part = F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
        )
    ).cast(PARTS)
    return conversations.select("conv_id", "turn", "role", part.alias("parts"))


def documents_of(segments: DataFrame) -> DataFrame:
    """Whole conversations as one text each, for tables whose conversations are known to be short."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "segment")))
    return segments.groupBy("conv_id").agg(F.concat(F.lit("<s>"), F.array_join(F.transform(ordered, lambda x: x["segment"]), "")).alias("text"))


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the segments: turns, texts under the loss mask, length and attachments."""
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.string() if "string" in x else pa.int64() for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def row() -> tuple:
            return (now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["length"], now["files"], now["tokens"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "attachments")]
            for conv, text, start, end, files in zip(*columns):
                if now is None or now["id"] != conv:
                    if now is not None:
                        done.append(row())
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": len("<s>"), "files": 0, "tokens": 0}
                role, said = read_back(text)
                now["turns"].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[start:end])
                now["loss"].update(masked.encode())
                now["n"] += 1
                now["chars"] += len(masked)
                now["length"] += len(text)
                now["files"] += len(files)
                now["tokens"] += sum(x["tokens"] for x in files)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), kinds)], names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end", "attachments").mapInArrow(run, fields)
