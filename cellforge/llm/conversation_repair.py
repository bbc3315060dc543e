"""Repair of conversations by the cheapest edits, with a checkpointed dynamic programme.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``: an optional system turn, then user and
assistant by turns. An automaton of four states reads them, so the cheapest way to finish from a row on is
a vector of four costs. Vectors are computed backward and kept at about every square root of the rows alone; the walk
forward computes a block's vectors anew from the checkpoint behind it and takes, of the edits that
keep the cost, the one whose letter comes first.

Rows without their texts are dealt out by ranges of (conversation, turn, role, text hash) and cut into pieces of
``PIECE`` rows, so a conversation of any length is many pieces. A piece that does not end its
conversation is summed up in a matrix of the costs from state to state; the matrices of a conversation, a
row for each of its pieces, give the vector behind every piece, and pieces then work alone. A piece that does not begin its conversation
is walked from each of the four states, and the one that the piece before it ends in is taken.
Texts move once, to be read in order beside the edits; a hash of a whole conversation is a sequence by nature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, stored

PIECE = 65536
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing read, a system turn, a user turn, an assistant turn. The first and the last may end.
STATES = 4
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that an edit can give in each state, and the state after it.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FAR = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
#: What is wrong with a row, as a letter: nothing, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, CUT = "-", "b", "d", "t"


def closed(v: Sequence[int]) -> tuple[int, int, int, int]:
    """``v`` with inserted turns before it where they are cheaper."""
    a, b, c, d = v
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


END = closed((0, FAR, FAR, 0))


def options(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of one row."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    to = NEXT.get(initial, (None,) * STATES)[state]
    if to is not None:
        yield "K", more, to
    yield "R", REROLE + more, GIVEN[state][1]


TABLE = {(i, f): [list(options(i, f, s)) for s in range(STATES)] for i in ("s", "u", "a", "") for f in (FINE, BLANK, DUPLICATE, CUT)}


def before(row: list, v: Sequence[int]) -> tuple[int, int, int, int]:
    """The costs before a row from those behind it."""
    return closed([min([cost + v[to] for _, cost, to in row[s]]) for s in range(STATES)])


def transfer(rows: Sequence[list]) -> list[int]:
    """Costs from each state before ``rows`` to each state behind them, a row of the matrix after the other."""
    columns = []
    for s in range(STATES):
        v = tuple(0 if t == s else FAR for t in range(STATES))
        for row in reversed(rows):
            v = before(row, v)
        columns.append(v)
    return [min(columns[t][s], FAR) for s in range(STATES) for t in range(STATES)]


def walks(rows: Sequence[list], behind: Sequence[int], entries: Sequence[int], last: bool) -> list[tuple[int, str]]:
    """(state after, letters) of the cheapest edits of ``rows`` from each of ``entries``, the first in ASCII order; ``behind`` are the costs behind them, ``last`` whether nothing follows.

    Vectors are kept at the bounds of blocks of about the square root of the rows, and computed again a block at a time.
    """
    n = len(rows)
    step = max(1, math.isqrt(max(0, n - 1)) + 1)
    kept, v = {n: tuple(behind)}, tuple(behind)
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % step == 0:
            kept[i] = v
    at, letters = list(entries), [[] for _ in entries]

    def insert(k: int, v: Sequence[int]) -> bool:
        """Whether the k-th walk puts in a turn where the costs are ``v``."""
        to = GIVEN[at[k]][1]
        if v[at[k]] != INSERT + v[to]:
            return False
        at[k] = to
        letters[k].append("I")
        return True

    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [kept[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(before(rows[i], block[-1]))
        block.reverse()
        for i in range(start, stop):
            here, after = block[i - start], block[i - start + 1]
            for k in range(len(at)):
                while True:  # D, I, K, R: in ASCII order
                    tight = {letter: to for letter, cost, to in rows[i][at[k]] if cost + after[to] == here[at[k]]}
                    if "D" in tight or not insert(k, here):
                        letter = min(tight)
                        letters[k].append(letter)
                        at[k] = tight[letter]
                        break
    if last:
        for k in range(len(at)):
            while behind[at[k]] and insert(k, behind):
                pass
    return [(s, "".join(x)) for s, x in zip(at, letters, strict=True)]


def prepared(turns: DataFrame) -> DataFrame:
    """(k, turn, role, h, copies, text) of ``turns``: k is the conversation as text, empty for a null one and else after a ``=``, h a hash of the text; nulls are one space. A column ``copies``, if there is one, says how often a row stands."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return turns.select(key.alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("h"), copies.alias("copies"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """(k, at, initial, fault) of ``prepared`` rows, each copy for itself: at numbers them in order of conversation, turn (null first), role and text hash, with gaps, and is the partition's number in its upper bits."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    marks = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    x = rows.where("copies > 0").select("k", "turn", "role", "h", "copies", marks.alias("fault"))
    x = x.repartitionByRange("k", "turn", "role", "h").sortWithinPartitions("k", "turn", "role", "h").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    x = stored(x.select("k", "role", "h", F.substring("role", 1, 1).alias("initial"), "fault", F.monotonically_increasing_id().alias("at")))
    seen = x.groupBy("k", "role", "h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("at") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    return x.join(stored(seen), ["k", "role", "h"], "left").select("k", "at", "initial", fault.alias("fault"))


def _runs(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """The conversations of a chunk in order."""
    rows = rows.sort_values("at", kind="stable")
    k = rows["k"].to_numpy(object)
    cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield k[a], rows.iloc[a:b]


def _edits_of(run: pd.DataFrame) -> list[list]:
    return [TABLE[i if i in NEXT else "", f] for i, f in zip(run["initial"], run["fault"], strict=True)]


def _matrices(rows: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a chunk's first and last conversation, which may go on in other chunks."""
    runs = list(_runs(rows))
    made = [(rows["chunk"].iloc[0], k, transfer(_edits_of(run))) for k, run in (runs if len(runs) == 1 else [runs[0], runs[-1]])]
    return pd.DataFrame(made, columns=["chunk", "k", "costs"])


def _behind(pieces: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each piece of one conversation, from the matrices of the pieces after it."""
    pieces = pieces.sort_values("chunk")
    v, made = END, []
    for j, (chunk, k, costs) in enumerate(zip(pieces["chunk"][::-1], pieces["k"][::-1], pieces["costs"][::-1], strict=True)):
        made.append((chunk, k, [int(x) for x in v], j == len(pieces) - 1, j == 0))
        v = tuple(min(int(costs[STATES * s + t]) + v[t] for t in range(STATES)) for s in range(STATES))
    return pd.DataFrame(made, columns=["chunk", "k", "behind", "first", "last"])


def _walked(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The edits of a chunk's conversations, or of the parts of them that lie in it."""
    made = []
    given = {k: (tuple(v), bool(first), bool(last)) for k, v, first, last in zip(known["k"], known["behind"], known["first"], known["last"], strict=True)}
    if len(rows):
        for k, run in _runs(rows):
            v, first, last = given.get(k, (END, True, True))
            entries = [0] if first else list(range(STATES))
            said = "".join(run["fault"])
            made += [(k, int(run["chunk"].iloc[0]), entry, state, letters, said) for entry, (state, letters) in zip(entries, walks(_edits_of(run), v, entries, last), strict=True)]
    return pd.DataFrame(made, columns=["k", "chunk", "entry", "exit", "letters", "faults"])


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k, chunk, entry, exit, letters, faults): edits of every piece of the conversations of ``faults`` rows, for each state that it may be entered in."""
    x = stored(rows.withColumn("chunk", F.expr(f"at DIV {int(piece)}")))  # at's upper bits tell the partition, so no chunk spans two
    ends = x.groupBy("chunk").applyInPandas(_matrices, "chunk long, k string, costs array<long>")
    known = ends.groupBy("k").applyInPandas(_behind, "chunk long, k string, behind array<long>, first boolean, last boolean")
    return x.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_walked, "k string, chunk long, entry int, exit int, letters string, faults string")


EDITS = "k string, place long, edit string, fault string, turn long, role_was string, role string, text string, cost int"
NAMES = [x.split()[0] for x in EDITS.split(", ")]


def _chained(found: list[tuple[int, int, int, str, str]]) -> tuple[str, str]:
    """Letters and faults of a whole conversation from its pieces in order, each taken from the state that the one before it ends in."""
    letters, said, state, done = [], [], 0, None
    for chunk, entry, leave, walked, marks in found:
        if entry == state and chunk != done:
            letters.append(walked)
            said.append(marks)
            state, done = leave, chunk
    return "".join(letters), "".join(said)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits as rows, from a partition's rows by conversation: first its pieces, then its turns in order."""
    out: dict[str, list] = {n: [] for n in NAMES}
    kinds = {"place": pa.int64(), "turn": pa.int64(), "cost": pa.int32()}
    held = size = 0
    key, found, letters, said, i, j, state = None, [], "", "", 0, 0, 0

    def put(edit, fault, turn, was, role, text, cost):
        nonlocal size, held
        for n, v in zip(NAMES, (key, i, edit, fault, turn, was, role, text, cost), strict=True):
            out[n].append(v)
        size += len(text or "") + 64
        held += 1

    def inserted():
        nonlocal i, state
        while i < len(letters) and letters[i] == "I":
            role, state = GIVEN[state]
            put("I", None, None, None, role, "", INSERT)
            i += 1

    def flushed():
        nonlocal held, size
        made = pa.RecordBatch.from_arrays([pa.array(out[n], kinds.get(n, pa.string())) for n in NAMES], NAMES)
        for n in NAMES:
            out[n].clear()
        held = size = 0
        return made

    for batch in slices(batches):
        for k, kind, chunk, entry, leave, walked, marks, turn, role, text, copies in zip(*(batch.column(n).to_pylist() for n in STREAM), strict=True):
            if k != key:
                key, found, i, j, state = k, [], 0, 0, 0
            if not kind:
                found.append((chunk, entry, leave, walked, marks))
                continue
            if found is not None:
                letters, said = _chained(found)
                found = None
            for _ in range(copies):
                inserted()
                edit, fault = letters[i], said[j]
                cost = {"D": DELETE, "K": 0, "R": REROLE}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
                if edit == "D":
                    put(edit, fault, turn, role, None, None, cost)
                else:
                    new, state = GIVEN[state] if edit == "R" else (role, NEXT[role[0]][state])
                    put(edit, fault, turn, role, new, text, cost)
                i, j = i + 1, j + 1
            if j == len(said):
                inserted()
            if size >= SLICE_BYTES:
                yield flushed()
    if held:
        yield flushed()


STREAM = ["k", "kind", "chunk", "entry", "exit", "letters", "faults", "turn", "role", "text", "copies"]


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k, place, edit, fault, turn, role_was, role, text, cost): the cheapest edits that make each conversation of ``turns`` (conv_id, turn, role, text) legal, in order; a conversation's edits come together and in order within a partition.

    Edits are K (keep), R (a role of user or assistant), D (delete; text and role are then null) and I (an empty
    turn that was not there: turn, role_was and fault are null). Of edits that cost the same the letters first in ASCII order are
    taken. Blank and duplicate rows are deleted, a truncated one that stays costs ``TRUNCATED``; see ``k`` in ``prepared``.

    Null turns come first; turns that are equal go by role, then by a hash of the text, so the order of the table does not matter.
    Null roles and texts are one space; a role with another initial than s, u or a cannot be kept. Repeated rows are duplicates. A conversation of any length is
    worked on in pieces; a text is held whole, once. An empty table gives no rows; other columns are not read.
    """
    rows = prepared(turns)
    none = lambda kind: F.lit(None).cast(kind)
    walked = pieces(faults(rows), piece).select("k", F.lit(0).alias("kind"), "chunk", "entry", "exit", "letters", "faults", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("h"), none("string").alias("text"), none("int").alias("copies"))
    read = rows.where("copies > 0").select("k", F.lit(1).alias("kind"), none("long").alias("chunk"), none("int").alias("entry"), none("int").alias("exit"), none("string").alias("letters"), none("string").alias("faults"), "turn", "role", "h", "text", "copies")
    x = walked.unionByName(read).repartition("k").sortWithinPartitions("k", "kind", "chunk", "entry", "turn", "role", "h").select(*STREAM)
    return x.mapInArrow(_applied, EDITS)


DIGEST = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of ``repair``'s rows, as they come."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    key = state = None

    def row():
        gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["turns"]
        return [key, gaps, state[BLANK], state[DUPLICATE], state[CUT], state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest()]

    for batch in batches:
        done = []
        for k, edit, fault, turn, was, role, text, cost in zip(*(batch.column(n).to_pylist() for n in ("k", "edit", "fault", "turn", "role_was", "role", "text", "cost")), strict=True):
            if k != key:
                if state:
                    done.append(row())
                key, state = k, {"least": None, "most": None, "turns": 0, BLANK: 0, DUPLICATE: 0, CUT: 0, FINE: 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None}
            state["cost"] += cost
            state["audit"].append(edit)
            if edit != "D":
                state["sha"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                state["any"] = True
            if edit == "I":
                continue
            state[fault] += 1
            if state["before"] is not None and state["before"] + was[:1] not in LEGAL:
                state["illegal"] += 1
            state["before"] = was[:1]
            if turn is not None:
                if turn != state["most"]:
                    state["turns"] += 1
                state["least"], state["most"] = turn if state["least"] is None else state["least"], turn
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], _SCHEMA)
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], _SCHEMA)


_SCHEMA = pa.schema([(n, pa.string() if n in ("k", "audit", "repaired_sha256") else pa.int64()) for n in (x.split()[0] for x in DIGEST.split(", "))])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): ``conversations`` with faults put in by a checksum of the ids: of 20 rows one goes (copies 0), one loses its text, one its full stops, one stands twice and one becomes a user's. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    """What ``repair`` does to the damaged ``conversations``, a row for each conv_id, the null one too; zeros, an empty audit and the hash of an empty string where damage left no row. Nulls, ties, repeats and long texts are as stated there."""
    done = repair(damaged(conversations)).mapInArrow(_digested, DIGEST)
    ids = conversations.select("conv_id").distinct().withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    nothing = hashlib.sha256(b"").hexdigest()
    x = ids.join(done, ids["__k"] == done["k"], "left")
    return x.select("conv_id", *(zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
