"""Training examples from conversations by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable. Turns
after the last reply make one more example without a target, so that nothing of a conversation is lost.

Turns are formatted where they are read. They are then dealt and sorted by conversation and streamed, so that a task
holds the text of one example at a time, however many turns a conversation has. The examples of a conversation of n turns
are its n prefixes: what is written grows with them, which is the method; only the turns themselves are shuffled."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Marks of each role: before and after its text. Other roles are written out after the mark of OTHER.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<<ROLE>> ", " <</ROLE>>")
CONTROLS = [m.strip() for pair in (*MARKS.values(), OTHER) for m in pair]
#: A control string in a text gets a backslash after its first character, a backslash becomes two.
_CONTROL = "([<\\[])(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
#: A formatted turn, as a reader finds it again.
_TURN = re.compile("|".join(f"{re.escape(a)}(?P<{n}>.*?){re.escape(b)}" for n, (a, b) in MARKS.items()) + rf"|{re.escape(OTHER[0])}(?P<role>(?:\\.|[^\\\n])*)\n(?P<other>.*?){re.escape(OTHER[1])}", re.DOTALL)
#: Bytes of examples that are handed on at once; a single example may be longer.
BATCH = 4 << 20


def escaped(text: Column) -> Column:
    """The text without any control string; unescaped() gives it back."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    for m in _TURN.finditer(text):
        name = m.lastgroup
        yield (unescaped(m["role"]) if name == "other" else name), unescaped(m[name])


def _expander(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, done, prefix, turns = object(), 0, 0, "", 0
        out: list[tuple] = []
        size = 0

        def ready(row: tuple) -> None:
            nonlocal size
            out.append(row)
            size += 4 * len(row[3])

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            found = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
            return found

        for rows in batches:
            for c, turn, role, block, lead, length in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                if c != conv:
                    if turns > done:
                        ready((conv, seen, None, prefix, None, None))
                    conv, seen, done, prefix, turns = c, 0, 0, "", 0
                at, turns, prefix = len(prefix), turns + 1, prefix + block
                if role == "assistant":
                    ready((c, seen, turn, prefix, at + lead, at + lead + length))
                    seen, done = seen + 1, turns
                if size > BATCH:
                    yield batch()
        if turns > done:
            ready((conv, seen, None, prefix, None, None))
        if out:
            yield batch()

    return run


def prefix_target_examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, example, target_turn, text, loss_start, loss_end): an example for every assistant turn.

    text holds all turns up to the target; the loss mask is the code points from loss_start up to loss_end, the escaped
    text of the reply without its marks. An example whose target_turn and mask are null holds a conversation that goes on
    after its last reply, or has none. Turns are in order of turn_col, ties by role and text, null first. Null text and
    role are empty; an unknown role is written out. Rows with null ids are one conversation, repeated rows are repeated
    turns; empty in, empty out. A conversation's examples are in one partition, in order."""
    kind = conversations.schema[id_col].dataType.simpleString()
    turn_kind = conversations.schema[turn_col].dataType.simpleString()
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    body = escaped(F.col("said"))
    name = F.concat(F.lit(OTHER[0]), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    head, tail = name, F.lit(OTHER[1])
    for role, (before, after) in MARKS.items():
        head, tail = F.when(F.col("role") == role, F.lit(before)).otherwise(head), F.when(F.col("role") == role, F.lit(after)).otherwise(tail)
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "said")
    blocks = ordered.select("conv", "turn", "role", F.concat(head, body, tail).alias("block"), F.char_length(head).alias("lead"), F.char_length(body).alias("length"))
    found = f"{id_col} {kind}, example long, target_turn {turn_kind}, text string, loss_start long, loss_end long"
    return blocks.mapInArrow(_expander(to_arrow_schema(StructType.fromDDL(found))), found)


def _reader(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, text, chars, n_loss, loss = None, None, 0, 0, hashlib.sha256()

        def summary() -> tuple:
            turns, n = hashlib.sha256(), 0
            for role, said in read_turns(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            return conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars

        for rows in batches:
            out = []
            for c, example, _, t, start, end in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                if not example:
                    if text is not None:
                        out.append(summary())
                    conv, chars, n_loss, loss = c, 0, 0, hashlib.sha256()
                text, chars = t, chars + len(t)
                if start is not None:
                    said = unescaped(t[start:end])
                    n_loss += len(said)
                    loss.update(said.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if text is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(summary(), schema, strict=True)], schema=schema)

    return run


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of prefix_target_examples say: one row per conversation (its id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars).

    Turns are read from a conversation's last example, the reply of each from under its mask. formatted_chars counts the
    code points of all examples. Takes the partitions as they were made: in order, conversations whole."""
    kind = examples.schema[0].dataType.simpleString()
    found = f"{examples.columns[0]} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return examples.mapInArrow(_reader(to_arrow_schema(StructType.fromDDL(found))), found)
