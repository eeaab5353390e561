"""Chat formatting with typed content parts.

A visitor flattens a message's parts (text, image, audio, document) into text with ordered placeholders; it records each
attachment's reference, what it expands to in tokens, and where it stands. A formatted turn is

    <|turn|>role<|text|>part<|part|>part ...<|end|>

where a text part is its text and an attachment its placeholder with its caption or extract after it. Control strings inside
roles and texts are broken by a backslash after their first character and backslashes are doubled, so the marks are
unambiguous and reading back gives the very same parts (`read_parts`). The loss mask of an assistant turn is its text parts,
as spans; marks, placeholders and captions bear no loss. `expanded` says where a span lies once placeholders are expanded.

A conversation's turns are ordered by turn, role and text (nulls first). Null texts and roles count as empty, null parts as
none, and no part as one empty text; each row without an id is a conversation of its own; repeated rows are turns of their
own; parts of unknown type are flattened, and read back, as documents; an empty table gives no rows. Formatting works row by
row. Reading back streams the sorted turns of a partition and holds one turn and the running digests, however long a
conversation is.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy, written

TURN, TEXT, END, NEXT = "<|turn|>", "<|text|>", "<|end|>", "<|part|>"
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings of common templates, which must not appear in a text as such.
CONTROL = [TURN, TEXT, END, NEXT, *MARKS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
#: Tokens that an attachment expands to for each unit: an image's tile, a second of audio, a document's page.
RATES = {"image": 576.0, "audio": 25.0, "document": 700.0}
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_BACK = re.compile(r"\\(\\?)")
PART = "struct<type:string, text:string, ref:string, units:double>"
SPAN = "struct<start:long, length:long>"
ATTACHMENT = "struct<position:int, start:long, type:string, ref:string, tokens:long, tokens_before:long>"
TURN_SCHEMA = f"conv_id {{id}}, turn {{turn}}, role string, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>, attachment_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


class Flatten:
    """The visitor: `visit` takes a part; out, spans, attachments and tokens hold what it has seen, in order.

    Offsets count characters of what has been put out, from `start` on.
    """

    def __init__(self, start: int = 0):
        self.out, self.at, self.spans, self.attachments, self.tokens = [], start, [], [], 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict) -> None:
        if self.out:
            self.put(NEXT)
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        self.spans.append({"start": self.at, "length": len(text)})
        self.put(text)

    def visit_image(self, part: dict) -> None:
        self.attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part)

    def attach(self, kind: str, part: dict) -> None:
        units = part.get("units")
        tokens = math.ceil(RATES[kind] * (1.0 if units is None else max(0.0, units) if math.isfinite(units) else 0.0))
        self.attachments.append({"position": len(self.attachments), "start": self.at, "type": kind, "ref": part.get("ref"), "tokens": tokens, "tokens_before": self.tokens})
        self.tokens += tokens
        self.put(MARKS[kind])
        if part.get("text"):  # a caption or an extract stays with its placeholder
            self.put(escape(part["text"]))


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict], list[dict], int]:
    """Formatted turn, spans of its loss mask, attachments, and their tokens."""
    head = f"{TURN}{escape(role or '')}{TEXT}"
    v = Flatten(len(head))
    for p in parts or [{"type": "text"}]:
        v.visit(p)
    return head + "".join(v.out) + END, v.spans if role == "assistant" else [], v.attachments, v.tokens


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and body of a formatted turn; a body of several parts keeps their marks."""
    if not formatted.startswith(TURN) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(TURN) : -len(END)].partition(TEXT)
    return unescape(role), unescape(body)


def read_parts(formatted: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """Role and parts (type, text, ref, tokens) of a formatted turn: the texts from it, references and tokens from its record."""
    role, _ = read_turn(formatted)
    body, refs, parts = formatted[len(TURN) : -len(END)].partition(TEXT)[2], iter(attachments), []
    for x in body.split(NEXT):
        mark = next((m for m in MARKS.values() if x.startswith(m)), "")
        a = next(refs) if mark else {"type": "text", "ref": None, "tokens": 0}
        parts.append({"type": a["type"], "text": unescape(x[len(mark) :]), "ref": a["ref"], "tokens": a["tokens"]})
    return role, parts


def expanded(start: int, attachments: list[dict], mark_tokens: int = 1) -> int:
    """How much further along a character offset lies once the placeholders before it, mark_tokens each, are expanded: the
    tokens of the attachments that start before it, less their marks."""
    return sum(a["tokens"] - mark_tokens for a in attachments if a["start"] < start)


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str | None = None, text_col: str = "text") -> DataFrame:
    """One formatted row per turn. parts_col holds arrays of PART; without it the text column is the one text part."""
    kinds = {"id": turns.schema[id_col].dataType.simpleString(), "turn": turns.schema[turn_col].dataType.simpleString()}
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    attachment = pa.list_(pa.struct([("position", pa.int32()), ("start", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("tokens_before", pa.int64())]))

    def run(batches):
        for b in batches if parts_col else (part for whole in batches for part in slices(whole, 3)):
            given = b.column(3).to_pylist()
            got = [format_turn(r, [p for p in ps or [] if p is not None] if parts_col else [{"type": "text", "text": ps}]) for r, ps in zip(b.column(2).to_pylist(), given, strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), span, attachment, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "attachment_tokens"])

    rows = turns.select(turns[id_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[parts_col or text_col].alias("parts"))
    return rows.mapInArrow(tidy(run), TURN_SCHEMA.format(**kinds))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state, key, id_type = None, None, None

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        close = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for b in (part for whole in batches for part in slices(whole, 1)):
            id_type, out = b.schema.field(0).type, []
            for conv, text, loss in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or conv is None or conv != key:
                    if state is not None:
                        out.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    masked = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if out:
                yield batch(out)
        if state is not None:
            yield batch([close()])

    # rows without an id belong to no one task
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("formatted"))
    rows = formatted.repartition("conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted", "loss")
    return rows.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(written(format_turns(turns.unionByName(more)), "chat"))
