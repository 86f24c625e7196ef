r"""Chat formatting over typed content parts.

A message is a role and a list of parts: text, image, audio or document.  A
visitor walks the parts in order: text is escaped; every other part becomes a
numbered placeholder ``<kind:index>`` and leaves a reference with its place in
the formatted text and the number of tokens it will expand to.  A turn is

    ### role: content</turn>\n

Inside texts ``\``, ``#`` and ``<`` get a backslash (in roles also ``:``), so a
control string of the template can only come from the template, and taking the
backslashes away gives the text back.  The loss mask covers the content of
assistant turns.

Every turn is formatted on its own; a conversation is its turns in order.  To
read it back its turns are sorted by range, so a long conversation is spread over
tasks, which parse their turns and pass pieces of ready text and counts on; only
these run through the conversation's digests, in order and piece by piece.

Results: a null text is empty, a null role is the empty role; a null conv_id
is a conversation of its own; turns sort by number (null first), equal numbers
by their formatted text; repeated rows are turns of their own; a message
without parts has empty content; no rows give no conversations.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.llm.common import small_batches

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>\n))*)</turn>\n", re.S)
_PLACE = re.compile(r"\\(.)|<(image|audio|document):(\d+)>", re.S)


def escape(text: str, marks: str = r"\\#<") -> str:
    return re.sub(f"([{marks}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a part that is no text stands for."""

    image_patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 512

    def image(self, part: dict) -> int:
        w, h = part.get("width") or 0, part.get("height") or 0
        return -(-w // self.image_patch) * -(-h // self.image_patch)

    def audio(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0.0) * self.audio_rate)

    def document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.page_tokens


@dataclass
class Flattener:
    """Visitor over the parts of one message."""

    expansion: Expansion = field(default_factory=Expansion)
    out: list[str] = field(default_factory=list)
    size: int = 0
    references: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown kind of part: {kind}")
        getattr(self, f"visit_{kind}")(part)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict) -> None:
        index = len(self.references)
        self.references.append({"index": index, "kind": kind, "uri": part.get("uri"), "start": self.size,
                                "tokens": getattr(self.expansion, kind)(part)})
        self._put(f"<{kind}:{index}>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def format_turn(role: str | None, parts: list[dict], expansion: Expansion | None = None) -> tuple[str, list[dict], list[dict]]:
    """The formatted turn, its loss spans and its attachment references."""
    head = OPEN + escape(role or "", r"\\#<:") + MIDDLE
    f = Flattener(expansion or Expansion())
    for p in parts:
        f.visit(p)
    content = "".join(f.out)
    loss = [{"start": len(head), "end": len(head) + len(content)}] if role == ASSISTANT else []
    return head + content + CLOSE, loss, [{**r, "start": r["start"] + len(head)} for r in f.references]


def read_turns(formatted: str) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(role, text, placeholders) of each turn of a formatted text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        places = [(p.group(2), int(p.group(3))) for p in _PLACE.finditer(m.group(2)) if p.group(2)]
        text = _PLACE.sub(lambda p: p.group(1) or "", m.group(2))
        out.append((unescape(m.group(1)), text, places))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


_TURN_SCHEMA = ("segment string, loss array<struct<start:int,end:int>>, "
                "attachments array<struct<index:int,kind:string,uri:string,start:int,tokens:bigint>>")
_LOSS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_REF_TYPE = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("start", pa.int32()), ("tokens", pa.int64())]))


def format_turns(messages: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """conv_id, turn, segment, loss, attachments of each message.

    ``messages`` has conv_id, turn, role and either ``parts`` (structs of kind,
    text, uri, width, height, seconds, pages; any of them may be missing) or
    ``text``; a column ``parts`` of another type is none.  ``loss`` and ``attachments`` count characters from the start of
    the segment.
    """
    small_batches(messages.sparkSession)
    typed = "parts" in messages.columns and isinstance(messages.schema["parts"].dataType, T.ArrayType) and isinstance(messages.schema["parts"].dataType.elementType, T.StructType)
    source = F.col("parts") if typed else F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text")))
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                           F.col("role").cast("string").alias("role"), source.alias("parts"))

    def run(batches):
        for b in batches:
            done = [format_turn(role, parts or [], expansion) for role, parts in
                    zip(b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array([s for s, *_ in done], pa.string()),
                 pa.array([x for _, x, _ in done], _LOSS_TYPE), pa.array([x for *_, x in done], _REF_TYPE)],
                ["conv_id", "turn", "segment", "loss", "attachments"])

    return rows.mapInArrow(run, f"conv_id bigint, turn bigint, {_TURN_SCHEMA}")


#: Bytes of ready text that are passed on as one row.
_PIECE = 1 << 20
_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("n", pa.int64()), ("loss_n", pa.int64()), ("chars", pa.int64()),
                     ("tokens", pa.int64()), ("turns", pa.binary()), ("loss", pa.binary())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())])


def _pieces(batches):
    """Parsed turns of a partition sorted by (conv_id, turn), joined to pieces."""
    part, no, at, held = TaskContext.get().partitionId(), 0, None, None

    def row():
        return {"conv_id": at[0], "part": part, "no": no, **{k: b"".join(v) if isinstance(v, list) else v for k, v in held.items()}}

    for b in batches:
        done = []
        for conv, segment, loss, refs in zip(*[b.column(c) for c in ("conv_id", "segment", "loss", "attachments")], strict=True):
            conv, segment = (conv.as_py(),), segment.as_py()
            if conv != at or sum(map(len, held["turns"])) > _PIECE:
                if at is not None:
                    done.append(row())
                    no += 1
                at, held = conv, {"n": 0, "loss_n": 0, "chars": 0, "tokens": 0, "turns": [], "loss": []}
            for role, text, _ in read_turns(segment):
                held["n"] += 1
                held["turns"].append(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss.as_py():
                text = _PLACE.sub(lambda p: p.group(1) or "", segment[span["start"]:span["end"]])
                held["loss_n"] += len(text)
                held["loss"].append(text.encode("utf-8", "surrogatepass"))
            held["chars"] += len(segment)
            held["tokens"] += sum(r["tokens"] for r in refs.as_py())
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECES)
    if at is not None:
        yield pa.RecordBatch.from_pylist([row()], _PIECES)


def _digest(batches):
    """One row per conversation of a partition sorted by (conv_id, part, no)."""
    at, state = None, None

    def row():
        return {"conv_id": at[0], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_n"],
                "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"], "attachment_tokens": state["tokens"]}

    for b in batches:
        done = []
        for piece in b.to_pylist():
            if (piece["conv_id"],) != at:
                if at is not None:
                    done.append(row())
                at, state = (piece["conv_id"],), {"n": 0, "chars": 0, "loss_n": 0, "tokens": 0, "turns": sha256(), "loss": sha256()}
            for k in ("n", "chars", "loss_n", "tokens"):
                state[k] += piece[k]
            for k in ("turns", "loss"):
                state[k].update(piece[k])
        if done:
            yield pa.RecordBatch.from_pylist(done, _DIGESTS)
    if at is not None:
        yield pa.RecordBatch.from_pylist([row()], _DIGESTS)


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are parsed again: conv_id,
    n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (all text under the loss mask), formatted_chars,
    attachment_tokens."""
    rows = turns.select("conv_id", "turn", "segment", "loss", "attachments").withColumn("_salt", F.monotonically_increasing_id())  # equal turns are split too
    order = ["conv_id", "turn", "segment", "_salt"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(_pieces, "conv_id bigint, part int, no bigint, n bigint, loss_n bigint, chars bigint, tokens bigint, turns binary, loss binary")
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                                       "formatted_chars bigint, attachment_tokens bigint")
