"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

from papyrus.llm import repair
from papyrus.llm.queries import op13_turn_repair

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """rows: (role, fault). Least cost, least of the cheapest audits, and the kept rows as (role, its place or -1)."""
    n = len(rows)
    legal = re.compile(r"(s?(ua)+)?")

    @lru_cache(maxsize=None)
    def best(i: int, prefix: str, budget: int) -> tuple[int, str] | None:
        """prefix: what was kept so far, shortened to what matters."""
        found = []
        if i == n and legal.fullmatch(prefix):
            found.append((0, ""))
        moves = [("I", i, "u", 5), ("I", i, "a", 5)]
        if i < n:
            role, fault = rows[i]
            moves.append(("D", i + 1, None, 2))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                moves += [("K", i + 1, role[:1], more), ("R", i + 1, "u", 1 + more), ("R", i + 1, "a", 1 + more)]
        for letter, to, initial, cost in moves:
            if cost > budget or initial == "":
                continue
            longer = prefix if initial is None else prefix + initial
            if not any(legal.fullmatch(longer + end) for end in ("", "a", "ua")):
                continue
            while len(longer) > 3:
                longer = longer[:-4] + longer[-2:] if longer[-4:-2] == longer[-2:] else longer[:1] + longer[3:]
            rest = best(to, longer, budget - cost)
            if rest:
                found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=None)

    return best(0, "", 2 * n + 1)


def faults(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_digest(rows: list[tuple]) -> tuple:
    """rows of a conversation after damage: (turn, role, text), in order."""
    said = faults(rows)
    cost, audit = plain_repair([(r[1], f) for r, f in zip(rows, said)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    kept, at = [], iter(rows)
    for e in audit:
        row = None if e == "I" else next(at)
        if e == "D":
            continue
        turn_of = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
        kept.append((row[1], row[2]) if e == "K" else (turn_of, "" if e == "I" else row[2]))
    return (gaps, *(said.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode("utf-8", "surrogatepass")).hexdigest())


def damaged(rows: list[tuple]) -> dict:
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def test_tables_find_the_least_of_the_cheapest_audits():
    rng, t = random.Random(5), repair.Tables()
    assert len(t.vectors) < 200
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", " "]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 9))]
        assert t.audit(bytes(repair.symbol(*r) for r in rows)) == plain_repair(rows), rows


def test_blocks_of_any_length_agree():
    rng = random.Random(6)
    few, many = repair.Tables(1), repair.Tables(3)
    for n in (0, 1, 2, 3, 4, 5, 100, 5003):
        syms = bytes(rng.randrange(repair.SYMBOLS) for _ in range(n))
        assert few.audit(syms) == many.audit(syms) == repair.tables().audit(syms)


def _check(spark, df, rows, sf_rows=None):
    got = {r[0]: tuple(r)[1:] for r in sf_rows.collect()}
    want = {c: plain_digest(r) for c, r in damaged(rows).items()}
    assert got == want


def test_query_equals_plain_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op13_turn_repair(spark, sf_dir)
    assert found.columns == [x.split()[0] for x in repair.DIGESTS.split(", ")]
    _check(spark, None, rows, found)


def test_odd_conversations(spark):
    rng = random.Random(8)
    rows = [(None, 1, "user", "no id."), (None, None, "assistant", "x."), (1, None, "user", "a"), (1, None, None, None), (1, 5, "", "b."), (1, 5, "assistant", "\t \n"), (2, 1, "user", "w. " * 100_000), (2, 1, "user", "w. " * 100_000), (3, 9, "system", "é▁\x00?")]
    rows += [(c, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["fine.", "cut", "", None, "a?", "b!"])) for c in range(10, 60) for _ in range(rng.randint(1, 8))]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", kind string, head string")
    found = repair.digests(repair.repair(repair.damage(df), all_ids=df.select("conv_id")))
    _check(spark, df, rows, found)
    none = spark.createDataFrame([], schema)
    assert repair.digests(repair.repair(repair.damage(none), all_ids=none.select("conv_id"))).count() == 0


def test_long_conversation_is_streamed(spark):
    """A conversation with a third of all rows, many of them equal."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS conv_id", "id AS turn", "CASE id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' ELSE 'user' END AS role", "CASE WHEN id % 2 = 0 THEN concat('t', id % 9000, '.') ELSE 'cut' END AS text")
    rows = sorted([tuple(r) for r in df.where("conv_id = 7").collect()], key=lambda r: r[1])
    got = repair.digests(repair.repair(df)).where("conv_id = 7").collect()[0]
    said = faults([r[1:] for r in rows])
    assert [got["blank"], got["duplicate"], got["truncated"]] == [said.count(f) for f in ("blank", "duplicate", "truncated")]
    cost, audit = repair.Tables(1).audit(bytes(repair.symbol(r[2], f) for r, f in zip(rows, said)))
    assert (got["cost"], got["audit"]) == (cost, audit)


def test_rows_tell_what_became_of_each(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 2, "user", "And?"), (1, 3, "user", "cut")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(df).select("edit", "old_role", "fault", "role", "text", "cost").collect()] == [("R", "assistant", "", "user", "Hello.", 4), ("R", "user", "", "assistant", "And?", None), ("D", "user", "truncated", None, None, None)]
