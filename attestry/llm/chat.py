"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

The template names for each role what goes before and after a text and whether the text is trained on; the machine
names the roles that may follow each state. Every turn gives its mark, its text and its end mark as segments; a turn
that the machine refuses is formatted too, and flagged. Control strings inside texts are escaped so that no text can
open or close a turn, and the reverse reading gives back the very text.

Turns are dealt by conversation and sorted; a task walks through them with the state of one conversation, one turn in
memory at a time, so the length of a conversation does not matter. A digest of a whole conversation is sequential by
its nature: its turns pass through one task as a stream.

Defined results: null text is empty; a null role is the role '' and never valid; turns of the same number are ordered
by role and text; a null conversation is a conversation of its own; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class Template:
    """before/after: the marks around a text, {role} being the role; trained: roles under the loss mask;
    follows: state -> roles that may come next; last: roles that may end a conversation."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    control: str = "<|"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace(self.control, f"{self.control[0]}\\{self.control[1:]}")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, turn long, ordinal long, segment int, text string, loss boolean, valid boolean"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
_NAMES = ["conv_id", "turn", "ordinal", "segment", "text", "loss", "valid"]


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2048, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    room = chars
    for r in rows:
        held.append(r)
        room -= sum(len(x) for x in r if isinstance(x, str))
        if len(held) == size or room < 0:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, room = [], chars
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Formatted segments: of each turn 0 the opening mark, 1 the escaped text, 2 the closing mark."""
    bounded_batches(turns.sparkSession)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        conv, state, ordinal, started = None, "", 0, False
        for b in batches:
            for c, t, role, text in zip(*(b[x].to_pylist() for x in ("conv_id", "turn", "role", "text")), strict=True):
                if c != conv or not started:
                    conv, state, ordinal, started = c, "", 0, True
                role = role or ""
                valid = role in template.follows.get(state, ())
                for k, (part, loss) in enumerate(((template.before.format(role=template.escape(role)), False), (template.escape(text or ""), role in template.trained), (template.after, False))):
                    yield c, t, ordinal, k, part, loss, valid
                state, ordinal = role, ordinal + 1

    got = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    got = got.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return got.mapInArrow(lambda bs: _batches(rows(bs), _NAMES, _TYPES), SEGMENTS)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read from its segments in order: turns, digests of turns and of trained text, lengths."""
    bounded_batches(formatted.sparkSession)
    head, tail = template.before.split("{role}")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        conv, role, sums = None, "", None

        def closed() -> tuple:
            return conv, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4], sums[5] and role in template.last

        for b in batches:
            for c, text, loss, valid in zip(*(b[x].to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if sums is None or c != conv:
                    if sums is not None:
                        yield closed()
                    conv, role, sums, opened = c, "", [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True], False
                sums[4] += len(text)
                sums[5] = sums[5] and valid
                if not opened:  # the control string can only be a mark: texts are escaped
                    if not (text.startswith(head) and text.endswith(tail)):
                        raise ValueError(f"conversation {c}: a turn does not open with its mark")
                    role, opened = template.unescape(text[len(head) : len(text) - len(tail)]), True
                    sums[0] += 1
                    sums[1].update(f"{role}\n".encode())
                elif text == template.after:
                    opened = False
                    sums[1].update(b"\n")
                else:
                    plain = template.unescape(text)
                    sums[1].update(plain.encode())
                    if loss:
                        sums[2] += len(plain)
                        sums[3].update(plain.encode())
        if sums is not None:
            yield closed()

    got = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal", "segment")
    return got.mapInArrow(lambda bs: _batches(rows(bs), names, types), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
