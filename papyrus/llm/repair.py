"""Conversation structure repair by Four-Russians block tables.

Rows of a conversation, by turn, are edited until their roles read as an optional system row and pairs of user and assistant.
The initials of the kept roles run through an automaton of four states (start, after s, after u, after a). Of every row only
a symbol matters: its role's initial (s, u, a or another), and whether it must go, costs more to keep, or neither. From the end
of a conversation backwards, the costs to finish from each state form a vector; less its minimum it is one of a few dozen.
``Tables`` lists these and precomputes, for every vector and every block of ``BLOCK`` symbols, the vector in front of the block
and the cost that the minimum gained. A conversation's vectors are then looked up block by block, and the trace expands each
block backward, so that every step forward sees exact costs and takes the least letter of those that are still cheapest:
the audit is the ASCII-least of all the cheapest ones.

Per conversation a worker keeps one byte a row (its symbol) and its audit; texts are streamed. A row is dealt twice: without
its text, for the symbols, and with it. Rows with the same role and text are found by a join on counted classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

#: Symbols that a block table takes at once.
BLOCK = 4
# What the edits cost, what a kept truncated row costs besides.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: 0 start, 1 after s, 2 after u, 3 after a. Where a kept initial leads; the state and role that an inserted or re-roled row has.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
FINAL = (0, 2 * COSTS["I"], COSTS["I"], 0)
#: Symbols: 0 to 3 for a role's initial s, u, a or other; 4 to 7 the same, truncated; 8 for a row that must go.
MUST_GO, SYMBOLS = 8, 9

Vector = tuple[int, ...]


def symbol(role: str, fault: str) -> int:
    """Of a row; a role without one of the initials (an empty one included) cannot be kept as it is."""
    if fault in ("blank", "duplicate"):
        return MUST_GO
    return ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * (fault == "truncated")


def _before(after: Vector, sym: int) -> Vector:
    """Costs to finish from each state in front of a row, given those behind it."""
    cost = [COSTS["D"] + c for c in after]
    if sym != MUST_GO:
        more, initial = TRUNCATED_COST * (sym // 4), "sua?"[sym % 4]
        for q in range(4):
            cost[q] = min(cost[q], more + COSTS["R"] + after[MADE[q]], *([more + after[NEXT[q, initial]]] if (q, initial) in NEXT else []))
    for _ in range(3):  # inserted rows lead at most through three states
        cost = [min(c, COSTS["I"] + cost[MADE[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


class Tables:
    """Every normalised vector that can occur, and the transitions of one symbol and of blocks of ``block`` symbols."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.size = block, SYMBOLS**block
        low = min(FINAL)
        self.vectors: list[Vector] = [tuple(c - low for c in FINAL)]
        known, one, gain = {self.vectors[0]: 0}, [], []
        for v in self.vectors:  # grows while it is read
            row = [_before(v, s) for s in range(SYMBOLS)]
            gain.append([min(r) for r in row])
            row = [tuple(c - min(r) for c in r) for r in row]
            for r in row:
                if r not in known:
                    known[r] = len(self.vectors)
                    self.vectors.append(r)
            one.append([known[r] for r in row])
        self.one, self.gain = np.array(one), np.array(gain)
        front, cost = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), dtype=np.int64)
        for _ in range(block):  # a symbol in front of each block so far; a block's code has its first symbol as the highest digit
            cost = np.concatenate([cost + self.gain[front, s] for s in range(SYMBOLS)], axis=1)
            front = np.concatenate([self.one[front, s] for s in range(SYMBOLS)], axis=1)
        self.front, self.cost = front.tolist(), cost.tolist()
        self.one, self.gain = one, gain
        self.expanded: dict[tuple[int, int, bytes], tuple[str, int]] = {}

    def _trace(self, q: int, after: int, syms: bytes) -> tuple[str, int]:
        """The edits of a few symbols from state q on, given the vector behind them; and the state that they lead to."""
        vectors, gains = [after], []
        for s in reversed(syms):
            gains.append(self.gain[vectors[-1]][s])
            vectors.append(self.one[vectors[-1]][s])
        out = []
        for s, here, behind, gain in zip(syms, reversed(vectors[1:]), reversed(vectors[:-1]), reversed(gains), strict=True):
            here, behind = self.vectors[here], self.vectors[behind]
            more, initial = TRUNCATED_COST * (s // 4 if s != MUST_GO else 0), "sua?"[s % 4]
            while True:  # letters in ASCII order
                want = here[q] + gain
                if COSTS["D"] + behind[q] == want:
                    out.append("D")
                    break
                if COSTS["I"] + here[MADE[q]] == here[q]:
                    out.append("I")
                    q = MADE[q]
                    continue
                if (q, initial) in NEXT and s != MUST_GO and more + behind[NEXT[q, initial]] == want:
                    out.append("K")
                    q = NEXT[q, initial]
                else:
                    out.append("R")
                    q = MADE[q]
                break
        return "".join(out), q

    def audit(self, syms: bytes) -> tuple[int, str]:
        """The least cost and the ASCII-least of the cheapest audits of a conversation's symbols."""
        t, codes = self.block, np.frombuffer(syms, dtype=np.uint8).astype(np.int64)
        lead = len(syms) % t  # the blocks end with the conversation; what is left over stands in front
        blocks = (codes[lead:].reshape(-1, t) @ (SYMBOLS ** np.arange(t - 1, -1, -1))).tolist() if len(syms) >= t else []
        now, cost, after = 0, 0, []
        for code in reversed(blocks):
            after.append(now)
            cost += self.cost[now][code]
            now = self.front[now][code]
        first = now
        for s in reversed(syms[:lead]):
            cost += self.gain[now][s]
            now = self.one[now][s]
        cost += self.vectors[now][0]
        out, q = self._trace(0, first, syms[:lead])
        out = [out]
        for at, behind in zip(range(lead, len(syms), t), reversed(after), strict=True):
            key = (q, behind, syms[at : at + t])
            if key not in self.expanded:
                self.expanded[key] = self._trace(*key)
            edits, q = self.expanded[key]
            out.append(edits)
        while q not in (0, 3):
            out.append("I")
            q = MADE[q]
        return cost, "".join(out)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """One set for each worker: a few dozen vectors times SYMBOLS ** BLOCK."""
    return Tables()


REPAIRED = "conv_id long, place long, edit string, turn long, old_role string, fault string, role string, text string, cost long"
HEAD = 64


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    own = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return own.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", all_ids: DataFrame | None = None) -> DataFrame:
    """REPAIRED: a row for each edit of each conversation, in order: what became of a row (edit K, R or D with its turn, old role and
    fault) or that a row was put in (I); role and text are those of the repaired conversation (null for D). ``cost`` is the
    conversation's, on its first row. A conversation without edits (of ``all_ids``, conv_id) is one row without an edit.

    Rows of a conversation are taken by turn, nulls first, then role, then text (by its first HEAD characters and a hash). Null
    roles and texts count as one space; rows without a conv_id are one conversation; repeated rows are duplicates of each other.
    The rows of a conversation stand together and in order within a partition.
    """
    white = F.lit(WHITE)
    rows = _rows(df, conv_col, turn_col, role_col, text_col).withColumn("trimmed", F.rtrim("text", white))
    fault = F.when(F.col("trimmed") == "", "blank").when(~F.right("trimmed", F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    # Two hashes of 64 bits stand for a text; the second begins with another seed.
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    when = F.coalesce("turn", F.lit(-(1 << 63)))
    classes = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    later = F.coalesce(when > F.col("first"), F.lit(False))
    no_text = F.lit(None).cast("string").alias("text")
    order = ["conv_id", "kind", "turn", "role", "head", "h1", "h2"]
    symbols = rows.drop("text").join(classes, same, "left").select("conv_id", F.lit(0).alias("kind"), "turn", "role", "head", "h1", "h2", "fault", later.alias("later"), no_text)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "head", "h1", "h2", "fault", F.lit(False).alias("later"), "text")
    dealt = symbols.unionByName(texts)
    if all_ids is not None:
        null = {c: F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in order[2:] + ["fault", "later", "text"]}
        dealt = dealt.unionByName(all_ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(-1).alias("kind"), *null.values()))
    dealt = dealt.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "turn", "role", "h1", "h2", "fault", "later", "text")
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: object = run  # no conversation yet
        syms, faults, last, audit, at, place, q, cost = bytearray(), bytearray(), None, "", 0, 0, 0, 0

        def inserted() -> None:
            nonlocal at, place, q
            while audit and at < len(audit) and audit[at] == "I":
                q = MADE[q]
                out.append((conv, place, "I", None, None, None, ROLES[q], "", cost if place == 0 else None))
                at, place = at + 1, place + 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(names), types, strict=True)], names)
            out.clear()
            return batch

        def close() -> None:
            inserted()
            if conv is not run and place == 0:
                out.append((conv, 0, *[None] * 7))

        said = ("", "blank", "duplicate", "truncated")
        for batch in batches:
            for c, kind, turn, role, h1, h2, fault, later, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv is run or c != conv:
                    close()
                    conv, syms, faults, last, audit, at, place, q, cost = c, bytearray(), bytearray(), None, None, 0, 0, 0, 0
                if kind < 0:
                    continue
                if kind == 0:
                    this = (turn, role, h1, h2)
                    if fault != "blank" and (later or this == last):
                        fault = "duplicate"
                    last = this
                    faults.append(said.index(fault))
                    syms.append(symbol(role, fault))
                    continue
                if audit is None:
                    cost, audit = tables().audit(bytes(syms))
                    n = 0
                inserted()
                edit, fault = audit[at], said[faults[n]]
                n += 1
                new, kept = None, None
                if edit != "D":
                    new, kept = (role, text) if edit == "K" else (ROLES[MADE[q]], text)
                    q = NEXT[q, role[0]] if edit == "K" else MADE[q]
                out.append((conv, place, edit, turn, role, fault, new, kept, cost if place == 0 else None))
                at, place = at + 1, place + 1
                if len(out) >= 2000:
                    yield flush()
        close()
        if out:
            yield flush()

    return dealt.mapInArrow(run, REPAIRED)


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from repair()'s rows, streamed in its order."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, known, state = None, False, None

        def close() -> None:
            if known:
                span = state["hi"] - state["lo"] + 1 - state["turns"] if state["turns"] else 0
                out.append((conv, span, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest()))

        for batch in batches:
            for c, place, edit, turn, old, fault, role, text, cost in zip(*(batch.column(n).to_pylist() for n in [x.split()[0] for x in REPAIRED.split(", ")]), strict=True):
                if place == 0:
                    close()
                    conv, known = c, True
                    state = {"lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": cost or 0, "audit": [], "sha": hashlib.sha256(), "rows": 0, "last": None}
                if edit is None:
                    continue
                state["audit"].append(edit)
                if edit != "I":
                    if turn is not None and turn != state["hi"]:
                        state["lo"], state["hi"], state["turns"] = turn if state["lo"] is None else state["lo"], turn, state["turns"] + 1
                    if fault:
                        state[fault] += 1
                    if state["last"] is not None and state["last"] + old[:1] not in LEGAL:
                        state["illegal"] += 1
                    state["last"] = old[:1]
                if edit != "D":
                    state["sha"].update((("\n" if state["rows"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    state["rows"] += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return repaired.mapInArrow(run, DIGESTS)


def damage(df: DataFrame) -> DataFrame:
    """conversations with every row harmed by crc32("conv_id:turn") % 20: 0 gone, 1 text emptied, 2 without [.!?], 3 twice, 4 role user. Nulls count as one space (ids stay null)."""
    own = pick(df, conv_id="conv_id", turn="turn", role="role", text="text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key.cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    harmed = own.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"))
    return harmed.where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "again")
