"""Chat formatting with a declarative template and a finite-state machine over roles.

A template gives each role an opening and a closing control string and says whether its
text bears loss. The machine walks a conversation's turns in order, reports whether the
order is allowed, and emits text segments with a loss flag each: control strings without
loss, texts with the role's flag. Characters that could start a control string are escaped
in texts, so reading the output back is unambiguous; ``read_back`` is that second machine.

Conversations are shuffled by id and sorted by turn; their rows stream through a task, so
a long conversation is never held whole.

Defined cases: a null text or role is empty; a role the template does not know gets a
generic opening that carries its name; turns in a forbidden order are formatted all the
same and flagged invalid; ties in turn go by role, then text; null turns come first; rows
without a conv_id form one conversation; repeated rows are turns of their own.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (opening, closing, bears loss); ``other``: opening, middle, closing.

    ``follows``: role -> roles that may come before it; None stands for the start.
    """
    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True)})
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    follows: dict = field(default_factory=lambda: {
        "system": (None,), "user": (None, "system", "assistant"), "assistant": ("user",)})
    escape: str = "\\"

    def controls(self):
        return sorted({c for o, e, _ in self.roles.values() for c in (o, e)} | set(self.other),
                      key=len, reverse=True)


class Codec:
    """Escaping for one template."""

    def __init__(self, template: Template):
        first = sorted({c[0] for c in template.controls()} | {template.escape})
        self.mark = template.escape
        self.special = re.compile("[" + re.escape("".join(first)) + "]")
        self.token = re.compile(re.escape(template.escape) + "(?s:.)|"
                                + "|".join(map(re.escape, template.controls())))
        self.escaped = re.compile(re.escape(template.escape) + "((?s:.))")

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: self.mark + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)


def format_turns(template: Template, codec: Codec, role: str, text: str):
    """Segments (text, loss) of one turn."""
    body = codec.escape(text)
    if role in template.roles:
        opening, closing, loss = template.roles[role]
    else:
        begin, middle, closing = template.other
        opening, loss = begin + codec.escape(role) + middle, False
    yield opening, False
    yield body, loss
    yield closing, False


SEGMENT = "segment long, text string, loss boolean, valid boolean"


def format_chat(turns: DataFrame, template=Template()) -> DataFrame:
    """``conv_id, segment, text, loss, valid``: the formatted text of every conversation in order.

    ``valid`` is false from the first turn on that breaks the allowed order. Rows of a
    conversation lie together and in order within a partition.
    """
    def run(batches):
        codec, now, before, number, valid = Codec(template), object(), None, 0, True  # no conversation yet
        for whole in batches:
            for start in range(0, max(1, len(whole)), 1024):
                b = whole.slice(start, 1024)
                take, cols = [], ([], [], [], [])
                for i, (conv, role, text) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
                    role, text = role or "", text or ""
                    if conv != now:
                        now, before, number, valid = conv, None, 0, True
                    valid = valid and before in template.follows.get(role, ())
                    before = role
                    for part, loss in format_turns(template, codec, role, text):
                        take.append(i)
                        for c, v in zip(cols, (number, part, loss, valid)):
                            c.append(v)
                        number += 1
                types = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(take, pa.int64())), *map(pa.array, cols, types)],
                    names=["conv_id", "segment", "text", "loss", "valid"])
    kind = turns.schema["conv_id"].dataType.simpleString()
    return (turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, f"conv_id {kind}, {SEGMENT}"))


class Reader:
    """Reads formatted segments back: turns, and the text under the loss mask."""

    def __init__(self, template: Template, codec: Codec):
        self.template, self.codec = template, codec
        self.opening = {o: r for r, (o, _, _) in template.roles.items()}
        self.closing = {c for _, c, _ in template.roles.values()} | {template.other[2]}
        self.turns, self.chars, self.loss_chars, self.valid = 0, 0, 0, True
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.role, self.state = [], "out"

    def feed(self, segment: str, loss: bool, valid: bool):
        self.chars += len(segment)
        self.valid &= valid
        if loss:
            plain = self.codec.unescape(segment)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode())
        at = 0
        for m in self.codec.token.finditer(segment):
            if m[0][0] == self.template.escape:
                continue
            self._text(segment[at:m.start()])
            self._control(m[0])
            at = m.end()
        self._text(segment[at:])

    def _text(self, raw):
        if self.state == "role":
            self.role.append(self.codec.unescape(raw))
        elif self.state == "text":
            self.sha.update(self.codec.unescape(raw).encode())

    def _control(self, token):
        if self.state == "out" and token in self.opening:
            self.sha.update((self.opening[token] + "\n").encode())
            self.state = "text"
        elif self.state == "out" and token == self.template.other[0]:
            self.state, self.role = "role", []
        elif self.state == "role" and token == self.template.other[1]:
            self.sha.update(("".join(self.role) + "\n").encode())
            self.state = "text"
        elif self.state == "text" and token in self.closing:
            self.sha.update(b"\n")
            self.turns += 1
            self.state = "out"
        else:
            raise ValueError(f"control {token!r} in state {self.state}")


DIGEST = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, valid boolean")


def read_back(segments: DataFrame, template=Template()) -> DataFrame:
    """One row per conversation, from the formatted segments alone (as ordered by ``format_chat``)."""
    def run(batches):
        codec = Codec(template)
        none = object()
        now, reader, kind = none, None, None
        done = []

        def finish():
            done.append((now, reader.turns, reader.sha.hexdigest(), reader.loss_chars,
                         reader.loss_sha.hexdigest(), reader.chars, reader.valid))

        def batch():
            cols = list(zip(*done)) or [[] for _ in range(7)]
            types = [kind or pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                       "formatted_chars", "valid"])
        for b in batches:
            kind = b.schema.field(0).type
            for conv, text, loss, valid in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is none or conv != now:
                    if reader:
                        finish()
                    now, reader = conv, Reader(template, codec)
                reader.feed(text, loss, valid)
            if len(done) >= 1024:
                yield batch()
                done.clear()
        if reader:
            finish()
        if done:
            yield batch()
    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInArrow(run, f"conv_id {kind}, {DIGEST}")


def op9_chat(spark, sf_dir) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).selectExpr("stack(2, -7L, 0L, 'user', '{0}', -7L, 1L, 'assistant', '{0}') "
                                      "as (conv_id, turn, role, text)".format(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(extra)))
