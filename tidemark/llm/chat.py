"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A ``Template`` is data: the marks around a turn, the escape character, the roles under the loss, and the machine's
transitions.  Rows are brought together by conversation and sorted by turn; each task walks its rows once, with one state
and a buffer of at most ``PART_CHARS`` characters (or one turn), however long a conversation is.  A conversation becomes one
row of segments, or several numbered parts cut between turns.  Concatenated segments are the formatted text.

Marks inside a text are escaped, so that the formatted text alone gives back roles and texts; ``read_turns`` does that and
knows nothing of the machine or the input.  Parts of whole conversations are read where they lie; only those of divided ones
are brought together again, in order, and are read as a stream.

A conversation that breaks the turn order is formatted all the same: ``valid`` is false and ``fault`` is the first turn that
the machine refuses (the number of turns if the order is right but the end is not accepted).  Null text and null role are
empty; an empty or unknown role has no transition.  Null conversation ids form one conversation.  Rows of one turn number are
ordered by role, then text; null turn numbers come first.  A digest over one conversation can't be split: all its rows pass
through one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parallelism, written
from tidemark.session import ship

PART_CHARS = 1 << 20
START = "start"


@dataclass(frozen=True)
class Template:
    """How a conversation is written.  States are names; ``moves`` maps (state, role) to a state."""

    opening: str = "### "
    naming: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    #: Strings that are escaped inside texts and roles, beside the escape character.
    marks: tuple[str, ...] = ("###", "</turn>", ":")
    trained: frozenset[str] = frozenset({"assistant"})
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "briefed",
            (START, "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepted: frozenset[str] = frozenset({"answered"})

    def __post_init__(self):
        if len(self.escape) != 1 or any(self.escape in x for x in (self.opening, self.naming, self.closing, *self.marks)):
            raise ValueError("the escape is one character, and part of no mark")
        if not all(any(m in x for m in self.marks) for x in (self.naming, self.closing)):
            raise ValueError("naming and closing must hold an escaped mark, or texts could imitate them")

    def escaped(self, text: str) -> str:
        return self._marks.sub(lambda m: self.escape + m.group(), text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + r"(.)", r"\1", text, flags=re.DOTALL)

    @property
    def _marks(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *sorted(self.marks, key=len, reverse=True)))))

    @property
    def turn(self) -> re.Pattern:
        """One formatted turn; groups: role, text."""
        plain = f"(?:[^{re.escape(self.escape)}]|{re.escape(self.escape)}.)*?"
        return re.compile(f"{re.escape(self.opening)}({plain}){re.escape(self.naming)}({plain}){re.escape(self.closing)}", re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's pieces and whether each is learnt: the text of a trained role, nothing else."""
        return [(f"{self.opening}{self.escaped(role)}{self.naming}", False), (self.escaped(text), role in self.trained), (self.closing, False)]


PLAIN = Template()
PARTS = "conv_id long, part int, last boolean, n_turns long, valid boolean, fault long, segments array<struct<text: string, loss: boolean>>"


class _Walk:
    """One conversation's way through the machine, and its segments that haven't been emitted."""

    def __init__(self, template: Template, conv):
        self.template, self.conv = template, conv
        self.state, self.turns, self.fault, self.part = START, 0, None, 0
        self.segments, self.chars = [], 0

    def add(self, role: str, text: str):
        """A full part, if the turn doesn't fit in with those before it; then takes the turn."""
        own = self.template.segments(role, text)
        size = sum(len(s) for s, _ in own)
        full = self.emit(False) if self.segments and self.chars + size > PART_CHARS else None
        after = self.template.moves.get((self.state, role))
        if after is None and self.fault is None:
            self.fault = self.turns
        self.state = after
        self.turns += 1
        self.segments += own
        self.chars += size
        return full

    def emit(self, last: bool) -> dict:
        if last and self.fault is None and self.state not in self.template.accepted:
            self.fault = self.turns
        row = {"conv_id": self.conv, "part": self.part, "last": last, "n_turns": self.turns if last else None}
        row |= {"valid": self.fault is None if last else None, "fault": self.fault if last else None, "segments": [{"text": s, "loss": x} for s, x in self.segments]}
        self.part, self.segments, self.chars = self.part + 1, [], 0
        return row


_STRUCT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("valid", pa.bool_()), ("fault", pa.int64()), ("segments", _STRUCT)])


def formatted(conversations: DataFrame, template: Template = PLAIN, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parts of formatted conversations: verdict of the machine and number of turns stand in the last part of each."""
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def work(batches):
        walk, out, chars = None, [], 0
        for batch in batches:
            for conv, who, said in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        out.append(walk.emit(True))
                    walk = _Walk(template, conv)
                full = walk.add(who, said)
                if full:
                    out.append(full)
                chars += len(said)
                if chars > 4 * PART_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, chars = [], 0
        if walk is not None:
            yield pa.RecordBatch.from_pylist([*out, walk.emit(True)], _ARROW)

    gathered = rows.repartition(parallelism(conversations), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return gathered.mapInArrow(work, PARTS)


class _Digest:
    """What is read back of one conversation, part after part."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss, self.valid, self.fault = hashlib.sha256(), hashlib.sha256(), None, None

    def add(self, row: dict, template: Template, turn: re.Pattern) -> None:
        whole = "".join(s["text"] for s in row["segments"])
        self.chars += len(whole)
        for role, text in read_turns(whole, template, turn):
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for s in row["segments"]:
            if s["loss"]:
                learnt = template.unescaped(s["text"])
                self.loss.update(learnt.encode())
                self.loss_chars += len(learnt)
        if row["last"]:
            if self.turns != row["n_turns"]:
                raise ValueError(f"conversation {self.conv}: {self.turns} turns read back of {row['n_turns']}")
            self.valid, self.fault = row["valid"], row["fault"]

    def row(self) -> dict:
        return {
            "conv_id": self.conv,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
            "valid": self.valid,
            "fault": self.fault,
        }


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault long"
_DIGESTS = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in DIGESTS.split(", "))])


def read_turns(whole: str, template: Template = PLAIN, turn: re.Pattern | None = None):
    """Roles and texts of formatted text; ValueError if anything is left between or after the turns."""
    at = 0
    for found in (turn or template.turn).finditer(whole):
        if found.start() != at:
            raise ValueError("text between turns")
        at = found.end()
        yield template.unescaped(found.group(1)), template.unescaped(found.group(2))
    if at != len(whole):
        raise ValueError("text after the last turn")


def digests(parts: DataFrame, template: Template = PLAIN) -> DataFrame:
    """A row for each conversation, computed from its formatted parts alone."""

    def work(batches):
        turn, own = template.turn, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    own = _Digest(row["conv_id"])
                own.add(row, template, turn)
                if row["last"]:
                    out.append(own.row())
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)

    whole = (F.col("part") == 0) & F.col("last")
    divided = parts.where(~whole)
    divided = divided.repartition(parallelism(parts), "conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where(whole).mapInArrow(work, DIGESTS).unionByName(divided.mapInArrow(work, DIGESTS))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one that imitates control strings, formatted, written, and read back."""
    ship(spark)
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return digests(written(formatted(given.unionByName(odd)), "chat"))
