"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. It is rendered for successive turn prefixes and
each output compared with the one before it: where it starts with that, the added part is the last turn's; where it does not,
the template rewrites history and the conversation is marked. Within its part a turn's text stands between what the
template put around the last text of that role; where the part does not read so, the same prefix is rendered with two other
texts, and what the two outputs share in front and behind is the template's own. Loss falls on the texts of assistant turns.

A template may look at the whole prefix, so whole prefixes are rendered: one rendering a turn, whose cost grows with the
prefix, and memory for one conversation. For a template that its caller declares local (a turn's part depends on nothing
but the first turn and the last ``window`` ones before it) the prefix is just those, which keeps the work linear and the
memory bounded. Each part is then rendered with half that window as well, and NotLocalError is raised where the two differ:
that finds most false declarations, not all, as a window can hide what it does not hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that mean something to a model; within texts they are broken up.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"
#: A window for local templates.
WINDOW = 16


def escape(text: str) -> str:
    """Backslashes doubled, and \\- put after the first character of each control string; unescape() undoes it."""
    text = text.replace("\\", "\\\\")
    while _BREAK.search(text):
        text = _BREAK.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"-": "", "n": "\n", "\\": "\\"}[m[1]], text) if "\\" in text else text


def instruct(turns: list[Turn]) -> str:
    """<s>, then for each turn [INST] role, line end, text, [/INST]; an assistant's text stands bare and ends with </s>."""
    out = ["<s>"]
    for role, text in turns:
        if role == LOSS_ROLE:
            out.append(f" {text} </s>")
        else:
            out.append("[INST] " + escape(role).replace("\n", "\\n") + f"\n{text} [/INST]")
    return "".join(out)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def probe_turn(template: Template, before: list[Turn], turn: Turn, prefix: str, whole: str) -> tuple[str, str, str] | None:
    """(front, text, back) of the part that a turn adds to prefix, the output of before; None if history is rewritten."""
    role = turn[0]
    one, two = template([*before, (role, "0")]), template([*before, (role, "1")])
    if not all(x.startswith(prefix) for x in (whole, one, two)):
        return None
    front = _common(one, two)
    back = len(one) - front - 1
    if whole[:front] != one[:front] or whole[len(whole) - back :] != one[len(one) - back :] or len(whole) < front + back:
        return None
    return whole[len(prefix) : front], whole[front : len(whole) - back], whole[len(whole) - back :]


class NotLocalError(ValueError):
    """A template that was declared local depends on turns outside the window."""


class Conversation:
    """Renders a conversation turn by turn; keeps its turns and output, or with a ``window`` at most one turn more than that."""

    def __init__(self, template: Template, window: int | None = None) -> None:
        self.template, self.window = template, window
        self.first: list[Turn] = []  # the first turn, where later ones have left the window
        self.turns: list[Turn] = []
        self.around: dict[str, tuple[str, str]] = {}  # what the template put in front of and behind the last text of a role
        self.output, self.n, self.at, self.rewrites = template([]), 0, 0, False

    def _part(self, before: list[Turn], turn: Turn, prefix: str, whole: str) -> tuple[str, str, str] | None:
        if not whole.startswith(prefix):
            return None
        front, back = self.around.get(turn[0], ("", ""))
        if turn[0] in self.around and whole[len(prefix) :] == front + turn[1] + back:
            return front, turn[1], back
        part = probe_turn(self.template, before, turn, prefix, whole)
        if part:
            self.around[turn[0]] = (part[0], part[2])
        return part

    def add(self, role: str, text: str) -> dict:
        turn, before = (role, escape(text)), [*self.first, *self.turns]
        prefix = self.output if self.window is None else self.template(before)
        whole = self.template([*before, turn])
        part = self._part(before, turn, prefix, whole)
        if self.first:
            fewer = [*self.first, *self.turns[self.window - self.window // 2 :]]
            if part != self._part(fewer, turn, self.template(fewer), self.template([*fewer, turn])):
                raise NotLocalError(f"turn {self.n}: the template is not local, so it takes no window")
        if part is None:
            self.rewrites = True
            part = ("", whole[len(prefix) :], "")
        front, body, back = part
        if self.n == 0:
            front = prefix + front
        start = self.at + len(front)
        self.at = start + len(body) + len(back)
        self.output = whole if self.window is None else ""
        self.turns.append(turn)
        if self.window is not None and len(self.turns) > self.window:
            gone = self.turns.pop(0)
            self.first = self.first or [gone]
        self.n += 1
        return {"role": role, "formatted": front + body + back, "text_start": start, "text_end": start + len(body), "loss": role == LOSS_ROLE and not self.rewrites, "rewrites_history": self.rewrites}


FORMATTED = "conv_id long, turn_no long, role string, formatted string, text_start long, text_end long, loss boolean, rewrites_history boolean"


def format_conversations(df: DataFrame, template: Template = instruct, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int | None = None) -> DataFrame:
    """A row for each turn: FORMATTED. ``formatted`` is the part that the turn adds, text_start and text_end (code points
    within the conversation's whole output) locate its escaped text, ``loss`` marks what is trained on.

    window: for templates that the caller declares local (see above); NotLocalError where a part shows that it is not.

    The rows of a conversation stand together and in order within a partition; they are streamed, never gathered, and a
    conversation's state is its turns (at most window + 1 of them with a window). Null roles and texts count as empty; a row
    without a conv_id is a conversation of its own; ties of a turn are ordered by role, then text. An empty table gives no rows.
    """
    own = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = own.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in FORMATTED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = (), None
        for batch in batches:
            rows = []
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (conv,) or conv is None:
                    current, state = (conv,), Conversation(template, window)
                got = state.add(role, text)
                rows.append((conv, state.n - 1, *(got[k] for k in names[2:])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)], names)

    return dealt.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"(?:<s>)?(?:\[INST\] ([^\n]*)\n(.*) \[/INST\]| (.*) </s>)", re.S)


def read_back(part: str) -> Turn:
    """Role and text of one turn's part in the instruct template, from the output alone."""
    m = _TURN.fullmatch(part)
    if not m:
        raise ValueError(f"not a turn: {part[:60]!r}")
    return (LOSS_ROLE, unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2]))


def digests(formatted: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read back from format_conversations()'s output (instruct template), streamed in its order."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = (), None, []

        def close() -> None:
            if state:
                out.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            table = batch.select(["conv_id", "turn_no", "formatted", "text_start", "text_end", "loss"])
            for conv, turn, part, start, end, loss in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if turn == 0:
                    close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(part)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    seen = unescape(part[start - state[4] : end - state[4]])
                    state[2] += len(seen)
                    state[3].update(seen.encode("utf-8", "surrogatepass"))
                state[4] += len(part)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(run, DIGESTS)
