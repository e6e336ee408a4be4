"""Chat formatting by incremental rendering of a template that is only called, never parsed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of a template that declares how far it looks back that are rendered together at most, and
#: how far ``marked`` does; a longer conversation goes on from its last turns.
BLOCK, CONTEXT = 32, 2
# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

#: Texts that share no character, for finding the place of a text.
PROBES = ("\ue0f0\ue0f1", "\ue0f2\ue0f3")

Message = tuple[str, str]
Template = Callable[[list[Message]], str]


def escape(text: str) -> str:
    """Text without ``<|``: one more backslash goes between each ``<`` and ``|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def marked(messages: list[Message]) -> str:
    """The template: role and text of each turn between control strings, both escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


#: Append-only: what a turn adds depends on no turn further back.
marked.context = CONTEXT


class Incremental:
    """What each turn adds to a template's output, found by rendering prefixes one after another.

    The output for turns 1..n must begin with that for 1..n-1; the rest is the turn's span. If it
    doesn't, the template has rewritten its history: the turn is flagged, its span begins where
    the outputs part, and ``revised`` is how many characters before it were taken back.

    A template is only called, so nothing but whole prefixes tells how far back it looks: each
    turn renders all turns so far, which are held. ``context`` (or an attribute of that name on the
    template) declares that the template only appends and looks at no more than so many last
    turns. Then, after ``block`` turns, rendering goes on from the last ``context`` turns, so a
    conversation of any length costs as many renderings as it has turns, each of at most
    ``block + context`` turns. At such a seam the context alone must render as it stood at the end
    of the output; else the block grows instead. That guards against a wrong declaration but
    doesn't prove a right one.
    """

    def __init__(self, template: Template, block: int = BLOCK, context: int | None = None, probe: bool = False):
        if context is None:
            context = getattr(template, "context", None)
        self.template, self.block, self.context = template, block, context
        self.turns: list[Message] = []
        self.output = template([])
        self.opening = self.output
        self.limit = None if context is None else block + context
        self.probe, self.content = probe, None

    def add(self, message: Message) -> tuple[str, int]:
        """(what the turn adds, characters of the output before it that were taken back)."""
        self.turns.append(message)
        after = self.template(self.turns)
        if after.startswith(self.output):
            added, revised = after[len(self.output) :], 0
        else:
            same = next((i for i, (a, b) in enumerate(zip(self.output, after)) if a != b), min(len(self.output), len(after)))
            added, revised = after[same:], len(self.output) - same
        self.output = after
        if self.probe:
            self.content = self._content(message[0], len(added))
        if self.limit is not None and len(self.turns) >= self.limit:
            self._seam()
        return added, revised

    def _content(self, role: str, size: int) -> tuple[int, int] | None:
        """Place of the last turn's text in what it adds (``probe``): the turn is rendered with two
        other texts, and what both outputs share at either end is not text. None where the template
        shows no text of the turn, or sets it within what stood there before."""
        first, second = (self.template([*self.turns[:-1], (role, x)]) for x in PROBES)
        if first == second:
            return None
        most = min(len(first), len(second))
        head = next((i for i in range(most) if first[i] != second[i]), most)
        tail = next((i for i in range(most - head) if first[-1 - i] != second[-1 - i]), most - head)
        whole, before = self.output, len(self.output) - size
        end = len(whole) - tail
        fits = head <= end and whole.startswith(first[:head]) and whole.endswith(first[len(first) - tail :])
        return (head - before, end - before) if fits and head >= before else None

    def _seam(self) -> None:
        tail = self.turns[-self.context :]
        alone = self.template(tail)
        body = alone[len(self.opening) :] if alone.startswith(self.opening) else None
        if body is not None and self.output.endswith(body):
            self.turns, self.output, self.limit = tail, alone, self.block + self.context
        else:
            self.limit *= 2


def content_of(added: str) -> tuple[int, int]:
    """(start, end) of the text within a turn of ``marked``."""
    return added.index("\n") + 1, len(added) - len(END) - 1


def read_turn(added: str) -> Message:
    """The role and text of a turn of ``marked``, escapes undone."""
    low, high = content_of(added)
    return unescape_role(added[len(START) : low - 1]), unescape(added[low:high])


TURN = "conv_id long, turn long, span string, start long, content_start long, content_end long, loss boolean, revised long"


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn; ties by role, then text; nulls first."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = marked, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: the span it adds, its place, its text's place in it, and the loss mask.

    ``conversations`` has conv_id, turn, role and text. ``start`` counts the code points of the
    conversation's output before the span; ``content_start`` and ``content_end`` are within the
    span, found by rendering the turn with two other texts, or null where the template shows none; ``loss`` marks turns of ``trained``
    roles; ``revised`` is above 0 where the template rewrote history. Tasks stream over sorted
    rows. With a template that declares its ``context`` (see ``Incremental``) they hold one block of
    turns, so a conversation may be of any length; with any other they hold a conversation and
    render it whole for each turn. Null texts and
    roles are empty, null ids are one conversation, repeated rows are turns of their own. An
    empty table gives no rows; other columns are not read.
    """

    def run(batches):
        current, state, length = object(), None, 0
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != current:
                    current, state = conv, Incremental(template, probe=template is not marked)
                    length = len(state.output)
                    opening = state.output
                else:
                    opening = ""
                added, revised = state.add((role, text))
                start = length - revised
                length = start + len(added)
                if opening:
                    added, start = opening + added, start - len(opening)
                low, high = content_of(added) if template is marked else state.content or (None, None)
                if template is not marked and low is not None:
                    low, high = low + len(opening), high + len(opening)
                rows.append((conv, turn, added, start, low, high, role in trained, revised))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in TURN.split(", ")])

    return ordered(conversations).mapInArrow(run, TURN)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, revised_turns long")


def read_back(turns: DataFrame) -> DataFrame:
    """A row per conversation, from its formatted turns alone, which stand together in order.

    Roles and texts are parsed from the spans; the loss text is what the mask covers, unescaped.
    A digest over a whole conversation has to pass its turns in order, so one task streams them;
    it holds the state of two hashes.
    """

    def run(batches):
        current, row = object(), None

        def closed():
            n, turns_hash, chars, loss_hash, size, revised = row
            return (current, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), size, revised)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            done = []
            for conv, span, start, low, high, loss, revised in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "span", "start", "content_start", "content_end", "loss", "revised"))):
                if conv != current:
                    if row is not None:
                        done.append(closed())
                    current, row = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read_turn(span)
                row[0] += 1
                row[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    covered = unescape(span[low:high])
                    row[2] += len(covered)
                    row[3].update(covered.encode("utf-8", "surrogatepass"))
                row[4] = start + len(span)
                row[5] += revised > 0
            if done:
                yield batch_of(done)
        if row is not None:
            yield batch_of([closed()])

    return turns.mapInArrow(run, DIGEST)
