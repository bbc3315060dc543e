"""Conversation repair against a plain search of all edits."""

import hashlib
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cellforge.llm import conversation_repair as repair
from cellforge.llm.common import table
from oracle import SMALL

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(cost, letters, repaired) by comparing whole suffixes; inserts up to two in a row."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))

    def reads(sofar, role):
        """The state after a role's initial, by the pattern itself."""
        s = {"": 0, "s": 1, "u": 2, "a": 3}[sofar]
        ok = {0: "su", 1: "u", 2: "a", 3: "u"}[s]
        return role[:1] if role[:1] and role[:1] in ok else None

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            for role in ("user", "assistant"):
                if (to := reads(state, role)) is not None:
                    c, s, t = best(i, to, inserts + 1)
                    found.append((5 + c, "I" + s, ((role, ""), *t)))
        if i < len(rows):
            role, text = rows[i]
            c, s, t = best(i + 1, state, 0)
            found.append((2 + c, "D" + s, t))
            if faults[i] in "-t":
                more = 5 if faults[i] == "t" else 0
                for letter, new, own in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (to := reads(state, new)) is not None:
                        c, s, t = best(i + 1, to, 0)
                        found.append((own + more + c, letter + s, ((new, text), *t)))
        return min(found, default=(10**6, "", ()))

    cost, letters, kept = best(0, "", 0)
    return cost, letters, "\n".join(f"{r}:{t}" for r, t in kept), faults


def expected(conversations):
    """The contract of op11 row by row."""
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for _, turn, role, text in sorted((r for r in conversations if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.md5((r[3] if r[3] is not None else " ").encode()).digest())):
            role, text = (" " if x is None else x for x in (role, text))
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if code == 1:
                text = ""
            elif code == 2:
                text = "".join(ch for ch in text if ch not in ".!?")
            elif code == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        known = [t for t, *_ in rows if t is not None]
        cost, letters, text, faults = plain(tuple((r, x) for _, r, x in rows))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_op11_equals_a_search_of_all_edits(spark):
    x = table(spark, SMALL, "conversations")
    rows = [tuple(r) for r in x.select("conv_id", "turn", "role", "text").collect()]
    rows += [(1000 + k, t, ("user", "assistant", "system", "tool")[(k * 7 + t * t) % 4], ("Yes.", "no", "So!", "", "Yes.")[(k + 3 * t) % 5]) for k in range(150) for t in range(k % 9)]
    # nulls in every column, a conversation that damage empties, repeats, ties, gaps, empty roles
    rows += [(None, None, None, None), (None, 3, "user", "a."), (None, 4, "assistant", "b."), (7000, None, "user", "x."), (7000, None, None, "x."), (7001, 1, "", "x."), (7001, 9, "user", None)]
    rows += [(5000 + k, 0, "user", "Hm.") for k in range(60)] + [(7002, 1, "user", "x.")] * 5 + [(7003, 2, "user", "é 🙂."), (7003, 2, "assistant", "é 🙂."), (7003, 2, "assistant", "y" * 20000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("k", F.lit(1)).withColumn("copies", F.lit(3)).withColumn("at", F.lit("q"))
    assert got(repair.op11_conversation_repair(df)) == expected(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in expected(rows).values())
    assert repair.op11_conversation_repair(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_of_any_size_give_the_same(spark, piece):
    rows = [(k % 3, t, ("user", "assistant", "system", "tool")[(k * 7 + t * t + t // 5) % 4], ("Yes.", "no", "So!", "", f"Yes {t}.")[(k + 3 * t + t // 7) % 5]) for k in range(3) for t in range(200)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    of = lambda **kw: sorted(tuple(r) for r in repair.repair(df, **kw).collect())
    assert of(piece=piece) == of()
    for k in range(3):
        mine = [(r, x) for c, _, r, x in rows if c == k]
        cost, letters, text, _ = plain(tuple(mine))
        edits = [r for r in of(piece=piece) if r[0] == f"={k}"]
        assert "".join(r[2] for r in edits) == letters and sum(r[-1] for r in edits) == cost
        assert "\n".join(f"{r[6]}:{r[7]}" for r in edits if r[2] != "D") == text


def test_checkpoints_lie_a_square_root_apart():
    n = 10_000
    rows = [repair.TABLE["usa"[(i * i) % 3], "-t"[i % 7 == 0]] for i in range(n)]
    calls = []
    real = repair.before
    repair.before = lambda row, v: calls.append(1) or real(row, v)
    try:
        state, letters = repair.walks(rows, repair.END, [0], True)[0]
    finally:
        repair.before = real
    assert state in (0, 3) and len(letters) >= n and len(calls) == 2 * n  # each vector twice: once backward, once in its block
