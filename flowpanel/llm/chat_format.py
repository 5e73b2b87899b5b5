"""Chat formatting with a grammar round trip.

Format: every turn is `### <role>: <text></turn>` and a newline; a conversation is its turns one after
another. Grammar of what stands between the marks:

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline
    role, text   := (plain character | "\\" control)*
    control      := "\\" | "### " | "</turn>", and ": " in a role

A backslash before a control string stands for that string; any other backslash is a plain character.
So a turn ends where its first bare `</turn>` stands, and turns can be read one after another.

A turn is rendered as it is first, parsed again and compared with its source. While they differ, more
of the conflicting content is escaped: the control strings, then the backslashes that stand before
one or at the end, then all backslashes. The last form is always read back as it was. Nothing else is
changed, so ordinary texts are not escaped at all.

Rows are dealt to tasks by ranges of (conversation, turn), a long conversation to several. A task
writes parts of PART_CHARS characters, at whole turns, with the spans of the loss mask, which covers
the texts of the assistant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, shuffle_partitions
from flowpanel.llm.ordering import BUCKET
from flowpanel.llm.prefix_trie import turn_digest

OPEN, COLON, CLOSE, END = "### ", ": ", "</turn>", "\n"
PART_CHARS = 1 << 16
LOSS_ROLES = ("assistant",)
LEVELS = 4

_ROLE = re.compile(r"\\(\\|### |</turn>|: )|(### |</turn>)|(: )")
_TEXT = re.compile(r"\\(\\|### |</turn>)|(### )|(</turn>)")


class Conflict(ValueError):
    """The rendered text does not follow the grammar."""


def _read(text: str, at: int, tokens: re.Pattern) -> tuple[str, int, int]:
    """(content, its end, end of the mark that closes it) from `at` on."""
    out, start = [], at
    for m in tokens.finditer(text, at):
        if m[1] is not None:
            out += (text[start : m.start()], m[1])
            start = m.end()
        elif m[2] is not None:
            raise Conflict(f"{m[2]!r} at {m.start()}")
        else:
            out.append(text[start : m.start()])
            return "".join(out), m.start(), m.end()
    raise Conflict(f"no end after {at}")


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, content, start and end of the content in `text`, end of the turn)."""
    if not text.startswith(OPEN, at):
        raise Conflict(f"no turn at {at}")
    role, _, start = _read(text, at + len(OPEN), _ROLE)
    content, end, after = _read(text, start, _TEXT)
    if not text.startswith(END, after):
        raise Conflict(f"no newline at {after}")
    return role, content, start, end, after + len(END)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        role, content, _, _, at = parse_turn(text, at)
        out.append((role, content))
    return out


def escaped(content: str, level: int, controls: str) -> str:
    """`content` with as much escaped as `level` asks for; `controls` is a pattern of control strings."""
    if level == 3:
        return re.sub(rf"(\\|{controls})", r"\\\1", content)
    if level == 2:
        content = re.sub(rf"(\\+)(?={controls}|\Z)", r"\1\1", content)
    return re.sub(rf"({controls})", r"\\\1", content) if level else content


def render_turn(role: str, content: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of its content), read back and escaped until it is the source."""
    for level in range(LEVELS):
        head = OPEN + escaped(role, level, "### |</turn>|: ") + COLON
        body = escaped(content, level, "### |</turn>")
        text = head + body + CLOSE + END
        try:
            found = parse_turn(text)
        except Conflict:
            continue
        if found[:2] == (role, content) and found[4] == len(text):
            return text, len(head), len(head) + len(body)
    raise Conflict("a turn cannot be read back")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(render_turn(*t)[0] for t in turns)


@dataclass
class _Part:
    key: int | None
    texts: list[str] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    size: int = 0

    def add(self, role: str, content: str, loss_roles: tuple[str, ...]) -> None:
        text, start, end = render_turn(role, content)
        if role in loss_roles:
            self.spans.append({"start": self.size + start, "end": self.size + end})
        self.texts.append(text)
        self.size += len(text)


PARTS = f"conv_id bigint, {BUCKET} int, seq bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), (BUCKET, pa.int32()), ("seq", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])


def format_conversations(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Parts of formatted conversations, written to the shared folder.

    A conversation is the concatenation of its parts in the order of (_bucket, seq); `loss` has the
    spans, in code points of the part, of the texts under the loss mask. Turns stand by number, null
    first, then by the digest of role and text; rows that repeat stand as often as they occur. Null
    roles and texts are empty. Rows without a conversation number make one conversation without a
    number. An empty table gives no parts. Other columns are ignored, whatever their names.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = convs.select(F.col(f"`{conv_col}`").cast("bigint").alias("c"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                        role.alias("role"), text.alias("text"), turn_digest(role, text).alias("x"))
    order = [F.col("c").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("x").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = None, 0

        def done() -> pa.RecordBatch:
            row = {"conv_id": part.key, BUCKET: bucket, "seq": seq, "n_turns": len(part.texts), "formatted": "".join(part.texts), "loss": part.spans}
            return pa.RecordBatch.from_pylist([row], schema=_PARTS)

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            for key, bucket, role, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part and (part.key != key or part.size >= PART_CHARS):
                    waiting.append(done())
                    part, seq = None, seq + 1
                    if len(waiting) >= 100:
                        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                        waiting = []
                part = part or _Part(key)
                part.add(role, content, loss_roles)
        if part:
            waiting.append(done())
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    n = shuffle_partitions(convs.sparkSession)
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col("_place").asc())
    sorted_rows = placed.sortWithinPartitions(*order).select("c", F.spark_partition_id().alias(BUCKET), "role", "text")
    return cut(sorted_rows.mapInArrow(run, PARTS), "formatted")


def read_back(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted parts.

    Every part is parsed and its masked spans unescaped where it lies; only then do the recovered
    turns of a conversation meet, packed, in the order of its parts, for the two running hashes.
    """
    def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(_read(text[s["start"] : s["end"]] + CLOSE, 0, _TEXT)[0] for s in spans)
                source = "".join(f"{role}\n{content}\n" for role, content in turns)
                out.append((len(turns), pack.compress(source.encode()), len(loss), pack.compress(loss.encode()), len(text)))
            values = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column(BUCKET), b.column("seq"), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))],
                names=["conv_id", BUCKET, "seq", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])

    packed = parts.mapInArrow(recover, f"conv_id bigint, {BUCKET} int, seq bigint, n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint")
    columns = ["conv_id", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"]
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        state: dict | None = None

        def row() -> dict:
            return state | {k: state[k].hexdigest() for k in ("turns_sha256", "loss_sha256")}

        for b in batches:
            out = []
            for key, n, turns, chars, loss, size in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if state is None or state["conv_id"] != key:
                    if state:
                        out.append(row())
                    state = {"conv_id": key, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                state["turns_sha256"].update(unpack.decompress(turns))
                state["loss_sha256"].update(unpack.decompress(loss))
                for k, v in (("n_turns", n), ("loss_chars", chars), ("formatted_chars", size)):
                    state[k] += v
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    n = shuffle_partitions(parts.sparkSession)
    rows = packed.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), BUCKET, "seq").select(*columns)
    return rows.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
