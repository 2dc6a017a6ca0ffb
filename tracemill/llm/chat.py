"""Conversations as marked text with a loss mask, from a declarative template.

A template lists the parts of a turn with the roles whose part is learned, the strings that mark turns,
and a finite-state machine over roles: for each state, the roles that may come next and the states they
lead to. Inside texts every control string and every backslash gets a backslash before it, inside roles
every character but letters, digits, "_" and "-"; taking one backslash off each pair gives both back.

Turns are put in order by a range sort over (conversation, turn), so that a conversation of any length is
spread over tasks, and formatted where they are. The machine runs along each task's stretch. For the
conversation that a stretch begins with, which may have begun before, it runs from every state at once;
one row a stretch then tells in which state the next one begins.

Nulls: a null text is empty; a null role is apart from an empty one and may come nowhere; a null
conversation is one of its own; null turns come first. Turns of equal number are ordered by role, then by
the text's digest; repeated rows are turns of their own. A conversation is not valid from the first turn
whose role the machine does not expect, nor if it ends in a state that is not final; its turns are
formatted all the same, and marked. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.shared import partitions, written

WRONG = "wrong"


@dataclass(frozen=True)
class Part:
    """A piece of a turn: fixed text, "{role}" or "{text}", and the roles in whose turns it is learned."""

    text: str
    learned: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """A turn is name, a space and the role unless it is null, the rest of the parts; begin and end mark it."""

    begin: str = "<turn"
    end: str = "</turn>"
    parts: tuple[Part, ...] = (Part("{begin}"), Part("{role}"), Part(">\n"), Part("{text}", ("assistant",)), Part("{end}"), Part("\n"))
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def states(self) -> list[str]:
        """The start, the others, and the one that no turn leads out of."""
        named = [self.start, *self.turns, *(s for to in self.turns.values() for s in to.values()), WRONG]
        return list(dict.fromkeys(named))


DEFAULT = Template()


def escaped(template: Template, text: Column) -> Column:
    controls = "|".join(map(re.escape, ("\\", template.begin, template.end)))
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({controls})", r"\\$1")


def escaped_role(role: Column) -> Column:
    """A space and the role, or nothing for null."""
    return F.coalesce(F.concat(F.lit(" "), F.regexp_replace(role, "([^A-Za-z0-9_-])", r"\\$1")), F.lit(""))


def plain(text: str) -> str:
    """What was escaped."""
    return re.sub(r"(?s)\\(.)", r"\1", text)


def turn_pattern(template: Template) -> re.Pattern:
    """One formatted turn: group role (with its space, or nothing) and group text, both escaped."""
    first = re.escape(template.end[0])
    body = rf"(?P<text>(?:[^\\{first}]+|\\.|(?!{re.escape(template.end)}){first})*)"
    held = {"{begin}": re.escape(template.begin), "{end}": re.escape(template.end), "{role}": r"(?P<role>(?: (?:[A-Za-z0-9_-]|\\.)*)?)", "{text}": body}
    return re.compile("".join(held.get(p.text) or re.escape(p.text) for p in template.parts), re.DOTALL)


def parse(text: str, template: Template = DEFAULT) -> list[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted conversation, or of a part of one that holds whole turns."""
    turns, at, one = [], 0, turn_pattern(template)
    while at < len(text):
        found = one.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        role = found["role"]
        turns.append((plain(role[1:]) if role else None, plain(found["text"])))
        at = found.end()
    return turns


def _run_machine(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """after: the state each turn leads to, from the start; in a stretch's first conversation from each state."""
    states = template.states
    number = {s: k for k, s in enumerate(states)}
    step = {(number[s], role): number[to] for s, roles in template.turns.items() for role, to in roles.items()}
    wrong = number[WRONG]
    conversation, now = object(), None
    for batch in batches:
        after = []
        for key, role in zip(batch.column("conversation").to_pylist(), batch.column("role").to_pylist(), strict=True):
            if now is None or key != conversation:
                now = list(range(len(states))) if now is None else [0]
                conversation = key
            now = [step.get((s, role), wrong) for s in now]
            after.append(now)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.list_(pa.int32()))], names=[*batch.schema.names, "after"])


def formatted(rows: DataFrame, template: Template = DEFAULT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table with a row a turn: conversation, place (two numbers that order all turns), state after it, segments of (text, loss)."""
    spark = rows.sparkSession
    named = rows.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keys = [F.col("conversation").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), F.col("tie")]
    tied = named.withColumn("digest", F.sha2("text", 256)).withColumn("tie", F.monotonically_increasing_id())
    stretches = tied.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("conversation", "role", "text")
    ran = stretches.mapInArrow(lambda it: _run_machine(it, template), f"conversation {named.schema['conversation'].dataType.simpleString()}, role string, text string, after array<int>")
    held = {"{begin}": F.lit(template.begin), "{end}": F.lit(template.end), "{role}": escaped_role(F.col("role")), "{text}": escaped(template, F.col("text"))}
    parts = [F.struct(held.get(p.text, F.lit(p.text)).alias("text"), F.coalesce(F.col("role").isin(*p.learned) if p.learned else F.lit(False), F.lit(False)).alias("loss")) for p in template.parts]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = written(ran.select("conversation", F.spark_partition_id().alias("stretch"), within.alias("at"), "after", F.array(*parts).alias("segments")), "turns")
    # a row for each stretch, as many as the sort has partitions
    ends = table.groupBy("stretch").agg(F.min_by("conversation", "at").alias("first"), F.max_by(F.struct("conversation", "after"), "at").alias("last"))
    begun, conversation_, state = [], None, 0
    for row in ends.orderBy("stretch").collect():
        entry = state if begun and row["first"] == conversation_ else 0
        begun.append((row["stretch"], entry))
        after = row["last"]["after"]
        conversation_, state = row["last"]["conversation"], after[entry if len(after) > 1 else 0]
    entries = F.broadcast(spark.createDataFrame(begun, "stretch int, entry int"))
    state_ = F.get("after", F.when(F.size("after") > 1, F.col("entry")).otherwise(0))
    names = F.array(*map(F.lit, template.states))
    return table.join(entries, "stretch").select("conversation", "stretch", "at", F.get(names, state_).alias("state"), "segments")


def _read(batches: Iterator[pa.RecordBatch], template: Template, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, whose turns follow each other; only the running sums of one are held."""
    one, done, now, key = turn_pattern(template), [], None, None
    schema = pa.schema([("conversation", kind), *((c, pa.int64()) for c in ("n_turns", "loss_chars", "formatted_chars")), ("turns_sha256", pa.string()), ("loss_sha256", pa.string()), ("valid", pa.bool_()), ("first_wrong", pa.int64())])

    def close():
        if now is not None:
            done.append((key, now["n"], now["loss"], now["chars"], now["turns_sha"].hexdigest(), now["loss_sha"].hexdigest(), now["wrong"] is None and now["state"] in template.final, now["wrong"]))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        for k, state, segments in zip(*(batch.column(c).to_pylist() for c in ("conversation", "state", "segments")), strict=True):
            if now is None or k != key:
                close()
                key, now = k, {"n": 0, "loss": 0, "chars": 0, "turns_sha": sha256(), "loss_sha": sha256(), "wrong": None, "state": None}
            whole = "".join(s["text"] for s in segments)
            found = one.fullmatch(whole)
            if not found:
                raise ValueError("not one whole turn")
            now["turns_sha"].update(f"{plain(found['role'][1:])}\n{plain(found['text'])}\n".encode())
            learned = "".join(plain(s["text"]) for s in segments if s["loss"])
            now["loss_sha"].update(learned.encode())
            if state == WRONG and now["wrong"] is None:
                now["wrong"] = now["n"]
            now["n"] += 1
            now["loss"] += len(learned)
            now["chars"] += len(whole)
            now["state"] = state
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def read_back(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row a conversation: conversation, n_turns, loss_chars, formatted_chars, digests of its turns and of what is learned, valid, first_wrong.

    A digest needs a conversation's turns one after the other, so each is read by one task, as a stream.
    """
    field_ = turns.schema["conversation"]
    kind = pa.int64() if field_.dataType.simpleString() == "bigint" else pa.string()
    rows = turns if kind == pa.int64() else turns.withColumn("conversation", F.col("conversation").cast("string"))
    ordered = rows.repartition("conversation").sortWithinPartitions("conversation", "stretch", "at").select("conversation", "state", "segments")
    made = f"conversation {'long' if kind == pa.int64() else 'string'}, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, valid boolean, first_wrong long"
    return ordered.mapInArrow(lambda it: _read(it, template, kind), made)
