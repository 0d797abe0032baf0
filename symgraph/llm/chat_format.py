"""Chat formatting with layouts chosen by schema fingerprints.

A record's fingerprint is a hash of the nested field paths that it fills.  A table of
declared layouts, one entry for each set of paths that a layout allows, says for each
fingerprint how the record becomes canonical turns of a role and a text: rows of turns,
message lists, share lists, instructions, prompts with completions or responses, and
questions.  All of this is column expressions.

The template marks every turn; what looks like a mark within a role or a text gets one
backslash more, so formatting is reversible and no text can open or close a turn.  The
output is one piece a turn, with its place in the conversation's formatted text and the
span of assistant text that the loss counts, so a conversation of any length is never
one value.  Reading back runs over the pieces in order and holds one turn at a time.

Defined results: null texts and roles are empty.  Turns come in the order of their turn
number (nulls first), then role, then text; repeated rows are turns each.  Records of a
null conversation id make one conversation without an id.  Fields that no layout knows
do not count; a field whose type does not fit counts as absent.  Records whose
fingerprint no layout has are returned without a layout and are not formatted.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Fields that layouts know; a record may fill any of them.
KNOWN = (
    "turn long, role string, text string, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>, "
    "system string, instruction string, input string, output string, prompt string, completion string, response string, question string, answer string"
)
#: Role names of other layouts and what they are here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class Layout(NamedTuple):
    """Which paths a record fills, always and perhaps, and its turns as an array of (role, text)."""

    name: str
    always: tuple[str, ...]
    perhaps: tuple[str, ...]
    turns: Callable[[Column], Column]


def turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def listed(items: str, role: str, text: str) -> Callable[[Column], Column]:
    named = lambda c: F.coalesce(*(F.when(c == theirs, ours) for theirs, ours in ROLES.items()), c)
    return lambda r: with_system(r, F.transform(r[items], lambda x: turn(named(x[role]), x[text])))


def asked(question: Callable[[Column], Column], answer: str) -> Callable[[Column], Column]:
    return lambda r: with_system(r, F.filter(F.array(turn("user", question(r)), F.when(r[answer].isNotNull(), turn("assistant", r[answer]))), lambda x: x.isNotNull()))


def with_system(r: Column, turns: Column) -> Column:
    return F.when(r["system"].isNull(), turns).otherwise(F.concat(F.array(turn("system", r["system"])), turns))


def field(name: str) -> Callable[[Column], Column]:
    return lambda r: r[name]


LAYOUTS = [
    Layout("turn rows", ("role",), ("turn", "text"), lambda r: F.array(turn(r["role"], r["text"]))),
    Layout("turn rows without a role", ("turn",), ("text",), lambda r: F.array(turn(r["role"], r["text"]))),
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), listed("messages", "role", "content")),
    Layout("shares", ("conversations[].from",), ("conversations[].value", "system"), listed("conversations", "from", "value")),
    Layout("instruction", ("instruction",), ("input", "output", "system"), asked(lambda r: F.concat_ws("\n\n", r["instruction"], F.nullif(r["input"], F.lit(""))), "output")),
    Layout("completion", ("prompt",), ("completion", "system"), asked(field("prompt"), "completion")),
    Layout("response", ("prompt", "response"), ("system",), asked(field("prompt"), "response")),
    Layout("question", ("question",), ("answer", "system"), asked(field("question"), "answer")),
]


def digest(paths: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprints(layouts: list[Layout] = LAYOUTS) -> dict[str, int]:
    """Fingerprint and place of the layout, for each set of paths that a layout allows."""
    out: dict[str, int] = {}
    for i, x in enumerate(layouts):
        for k in range(len(x.perhaps) + 1):
            for some in combinations(x.perhaps, k):
                if out.setdefault(digest([*x.always, *some]), i) != i:
                    raise ValueError(f"layouts {layouts[out[digest([*x.always, *some])]].name} and {x.name} allow the same paths")
    return out


def has(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name].isNotNull()


def filled(kind: DataType, column: Column, path: str) -> list[Column]:
    """For each nested field its path where it is filled, else null."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in filled(f.dataType, column[f.name], f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return [F.when(F.exists(column, has(f.name)), f"{path}[].{f.name}") for f in kind.elementType.fields]
    return [F.when(column.isNotNull(), path)]


def fingerprint(record: Column, kind: StructType) -> Column:
    paths = F.array_sort(F.filter(F.array(*filled(kind, record, "")), lambda p: p.isNotNull()))
    return F.substring(F.sha2(F.array_join(paths, ","), 256), 1, 16)


def record(rows: DataFrame) -> Column:
    """The columns of rows that layouts know, as one struct; others, and those of another type, are null in it."""
    fields = []
    for f in StructType.fromDDL(KNOWN).fields:
        own = next((c for c in rows.schema.fields if c.name == f.name), None)
        fits = own is not None and (own.dataType.simpleString() == f.dataType.simpleString() or isinstance(f.dataType, AtomicType) and isinstance(own.dataType, AtomicType))
        fields.append((F.col(f"`{f.name}`").try_cast(f.dataType) if fits else F.lit(None).cast(f.dataType)).alias(f.name))
    return F.struct(*fields)


def canonical(rows: DataFrame, conv_id: Column, record_: Column | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, fingerprint, layout, turn, nth, role, text: the turns of every record, a row each.

    record_: the record as a struct (else the columns of rows), for JSON text see parsed().
    Records without a layout come as one row with null from layout on.
    """
    kind = StructType.fromDDL(KNOWN)
    d = rows.select(conv_id.cast("long").alias("conv_id"), (record(rows) if record_ is None else record_).alias("r"))
    d = d.withColumn("fingerprint", fingerprint(F.col("r"), kind))
    table = fingerprints(layouts)
    places: dict[int, list[str]] = {}
    for print_, i in table.items():
        places.setdefault(i, []).append(print_)
    chosen = F.coalesce(*(F.when(F.col("fingerprint").isin(prints), i) for i, prints in places.items()))
    d = d.withColumn("which", chosen)
    turns = F.coalesce(*(F.when(F.col("which") == i, x.turns(F.col("r"))) for i, x in enumerate(layouts)))
    names = F.coalesce(*(F.when(F.col("which") == i, x.name) for i, x in enumerate(layouts)))
    d = d.select("conv_id", "fingerprint", names.alias("layout"), F.col("r.turn").alias("turn"), F.posexplode_outer(turns).alias("nth", "t"))
    return d.select("conv_id", "fingerprint", "layout", "turn", "nth", "t.role", "t.text")


def parsed(text: Column) -> Column:
    """The record that a JSON object holds."""
    return F.from_json(text, KNOWN)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_escaped(role: Column) -> Column:
    """Roles stand in a line of their own, so line feeds are escaped too."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_unescaped(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


PIECES = ("conv_id", "position", "start", "piece", "loss_from", "loss_to")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, position, start, piece, loss_from, loss_to: the formatted text, a piece a turn.

    start is where the piece begins in the conversation's text; the loss counts from
    loss_from up to loss_to (code points, null where it counts nothing).
    """
    head = F.concat(F.lit(START), role_escaped(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    d = turns.filter("layout is not null AND role is not null").select("conv_id", "turn", "nth", "role", "text", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("_head"), F.length(body).alias("_body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "nth", "role", "text")
    d = d.withColumns({"position": F.row_number().over(order) - 1, "_to": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumn("start", F.col("_to") - F.length("piece"))
    mine = F.col("role") == LOSS_ROLE
    at = F.col("start") + F.col("_head")
    return d.withColumns({"loss_from": F.when(mine, at), "loss_to": F.when(mine, at + F.col("_body"))}).select(*PIECES)


class Reader:
    """Turns from formatted text, however it is cut into pieces, with what of each the loss counts."""

    def __init__(self) -> None:
        self.text, self.at, self.spans = "", 0, []

    def feed(self, piece: str, loss_from: int | None, loss_to: int | None) -> Iterator[tuple[str, str, str]]:
        """role, text and the text under the loss mask of the turns that end in the piece."""
        self.text += piece
        if loss_from is not None:
            self.spans.append((loss_from, loss_to))
        while (stop := self.text.find(END)) >= 0:
            if not self.text.startswith(START):
                raise ValueError(f"no turn begins at {self.at}")
            role_end = self.text.index("\n")
            body = role_end + 1
            counted = "".join(self.text[max(body, a - self.at) : min(stop, b - self.at)] for a, b in self.spans if a < self.at + stop and b > self.at + body)
            yield role_unescaped(self.text[len(START) : role_end]), unescaped(self.text[body:stop]), unescaped(counted)
            self.text, self.at = self.text[stop + len(END) :], self.at + stop + len(END)
            self.spans = [s for s in self.spans if s[1] > self.at]

    def end(self) -> int:
        """Code points read; the text must not end within a turn."""
        if self.text:
            raise ValueError(f"the turn at {self.at} does not end")
        return self.at


def in_order(pieces: DataFrame) -> DataFrame:
    return pieces.select("conv_id", "position", "piece", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "position")


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Reader, Iterator[tuple[str, str, str]], bool]]:
    """Of each piece in order: its conversation, that one's reader, the turns that end in it, and whether it is the first."""
    own, reader = None, None
    for b in batches:
        for i, _, *piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fresh = reader is None or i != own
            if fresh:
                if reader:
                    reader.end()
                own, reader = i, Reader()
            yield i, reader, reader.feed(*piece), fresh


def read(pieces: DataFrame) -> DataFrame:
    """conv_id, position, role, text, loss_text: the turns that the formatted text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for i, _, turns, fresh in conversations(batches):
            n = 0 if fresh else n
            for t in turns:
                out.append((i, n, *t))
                n += 1
            if len(out) >= 1000:
                yield packed(out, ["conv_id", "position", "role", "text", "loss_text"])
                out = []
        yield packed(out, ["conv_id", "position", "role", "text", "loss_text"])

    return in_order(pieces).mapInArrow(run, "conv_id long, position long, role string, text string, loss_text string")


def packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"role": pa.string(), "text": pa.string(), "loss_text": pa.string(), "turns_sha256": pa.string(), "loss_sha256": pa.string()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: list = []

        def close() -> None:
            if now:
                i, reader, n, turns, chars, loss = now
                out.append((i, n, turns.hexdigest(), chars, loss.hexdigest(), reader.end()))

        for i, reader, found, fresh in conversations(batches):
            if fresh:
                close()
                now = [i, reader, 0, hashlib.sha256(), 0, hashlib.sha256()]
                if len(out) >= 1000:
                    yield packed(out, names)
                    out = []
            for role, text, loss in found:
                now[2] += 1
                now[3].update(f"{role}\n{text}\n".encode())
                now[4] += len(loss)
                now[5].update(loss.encode())
        close()
        yield packed(out, names)

    return in_order(pieces).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
