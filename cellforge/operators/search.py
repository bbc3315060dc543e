"""Calibration of all zones at once: the search's state is a table with a row for each zone.

A coarse cell is packed into one row of arrays, once; it is bounded, so a task works on a few at a
time. In each round every zone names its next tries, all of which change one coefficient. A task ranks a coarse cell
under the zone's kept coefficients, then, for each try, only the class that the try touches, and
gives the cells whose class differs from the kept map. As a blur is linear, the kept map's blurred differences
are made once for a block and a try changes them only around its cells. Sums by zone and try are the scores, and each zone's
row moves on by its own. Only the number of zones that are not done comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.storage import stored

from .allocate import COARSE, MULTIPLICATIVE
from .calibrate import SCALES
from .kernels import BLOCK, blur_weights

#: Tries of a zone that a round may score, and those whose changes one task holds beside a block.
TOGETHER, IN_TASK = 64, 32


@dataclass(frozen=True)
class Layers:
    """What the coefficients of a zone are for: every class's own additive and multiplicative layers, in a fixed order."""

    classes: tuple[int, ...]
    adds: tuple[str, ...]
    times: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, start: Mapping[int, Sequence[tuple[str, str, float]]]) -> Layers:
        kinds: dict[str, str] = {n: kind for rows in start.values() for n, kind, _ in rows}
        adds = tuple(n for n, kind in kinds.items() if kind != MULTIPLICATIVE)
        return cls(tuple(start), adds, tuple(n for n, kind in kinds.items() if kind == MULTIPLICATIVE), tuple(kinds.items()))

    def rows(self, start: Mapping[int, Sequence[tuple[str, str, float]]]) -> tuple[list[list[float]], list[list[float]]]:
        """Coefficients by class: of additive layers (0 where a class has none) and of multiplicative ones (1)."""
        own = {k: {n: float(b) for n, _, b in rows} for k, rows in start.items()}
        return [[own[k].get(n, 0.0) for n in self.adds] for k in self.classes], [[own[k].get(n, 1.0) for n in self.times] for k in self.classes]

    def moves(self, step: float) -> list[tuple[int, int, float]]:
        """(class, layer, step) of a generation's tries after the first, which changes nothing: each additive coefficient down and up, classes within layers."""
        return [(k, j, d) for j in range(len(self.adds)) for k in range(len(self.classes)) for d in (-step, step)]


def packed(cells: DataFrame, quotas: DataFrame, layers: Layers, observed: str, lulc: str = "lulc", zone: str = "zone") -> DataFrame:
    """A row for each coarse cell of a zone, of arrays over its cells and of its quotas: goals (class_id, goal) in hectares or, with from_class, to_class and n, cells from class to class. Stored.

    Cells without a class are kept but never taken. Coarse cells without a quota can't change and are packed as well, as their differences count.
    """
    listed = lambda names: F.array(*(F.col(n).cast("double") for n in names)) if names else F.array().cast("array<double>")
    one = F.struct("r", "c", F.col(lulc).cast("int").alias("was"), F.col(observed).cast("int").alias("seen"), F.col("ha").cast("double").alias("ha"), listed(layers.adds).alias("xa"), listed(layers.times).alias("xm"))
    x = cells.groupBy(F.col(zone).alias("zone"), *COARSE).agg(F.array_sort(F.collect_list(one)).alias("cells"))
    if "from_class" in quotas.columns:
        quota = F.struct(F.col("from_class").cast("int").alias("source"), F.col("to_class").cast("int").alias("class_id"), F.col("n").cast("double").alias("goal"))
    else:
        quota = F.struct(F.lit(None).cast("int").alias("source"), F.col("class_id").cast("int").alias("class_id"), F.col("goal").cast("double").alias("goal"))
    q = quotas.groupBy(*([F.col(zone).alias("zone")] if zone in quotas.columns else []), *COARSE).agg(F.collect_list(quota).alias("quotas"))
    x = x.join(q, ["zone", *COARSE] if zone in quotas.columns else COARSE, "left").withColumn("quotas", F.coalesce("quotas", F.array()))
    flat = [F.flatten(f"cells.{n}").alias(n) for n in ("xa", "xm")]
    x = x.repartition(2 * cells.sparkSession.sparkContext.defaultParallelism)  # few rows, much work for each
    return stored(x.select("zone", *COARSE, *(F.col(f"cells.{n}").alias(n) for n in ("r", "c", "was", "seen", "ha")), *flat, *(F.col(f"quotas.{n}").alias(n) for n in ("source", "class_id", "goal"))))


class Many:
    """Coarse cells side by side, padded to the largest of them, to be ranked under several coefficients."""

    def __init__(self, rows: pd.DataFrame, layers: Layers):
        self.layers = layers
        sizes = rows["r"].map(len).to_numpy()
        n, self.width = len(rows), int(sizes.max())
        self.real = np.arange(self.width) < sizes[:, None]
        self.zone = rows["zone"].to_numpy(object)
        self.r, self.c = (self._filled(rows[v], 0).astype(np.int64) for v in ("r", "c"))
        self.was, self.seen = (self._filled(rows[v], -1).astype(np.int64) for v in ("was", "seen"))
        self.ha = self._filled(rows["ha"], 0.0)
        self.xa, self.xm = (np.zeros((n, len(names), self.width)) for names in (layers.adds, layers.times))
        for x, name in ((self.xa, "xa"), (self.xm, "xm")):
            for i, v in enumerate(rows[name]):
                x[i, :, : sizes[i]] = np.array(v, float).reshape(sizes[i], -1).T  # a null is NaN
        self.b, self.m = (np.array(rows[v].tolist(), float).reshape(n, len(layers.classes), -1) for v in ("b", "m"))
        self.by_source = any(v is not None and v == v for x in rows["source"] for v in x)
        top = 1 + max(0, int(self.was.max()))
        self.goal = np.zeros((n, len(layers.classes), top if self.by_source else 1))
        place = {k: i for i, k in enumerate(layers.classes)}
        for i, (source, ids, goals) in enumerate(zip(rows["source"], rows["class_id"], rows["goal"], strict=True)):
            goals = np.asarray(goals, float)
            if not self.by_source and np.isnan(goals).any():
                continue  # nothing changes where a goal is NaN
            for f, k, g in zip(source, ids, goals, strict=True):
                at = int(f) if self.by_source else 0
                if g > 0 and int(k) in place and at < top and not (self.by_source and at == int(k)):
                    self.goal[i, place[int(k)], at] = max(g, self.goal[i, place[int(k)], at])

    def _filled(self, lists: pd.Series, default: float) -> np.ndarray:
        flat = np.concatenate([np.asarray(x, float) for x in lists])
        out = np.full(self.real.shape, float(default))
        out[self.real] = np.where(np.isnan(flat), default, flat)
        return out

    def ranks(self, cell: np.ndarray, i: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each coarse cell and class (its place ``i``) with additive coefficients ``b``: the turn in which the class takes each place, 0 where it doesn't. Layers that do not take part are not read."""
        k, m = np.array(self.layers.classes)[i][:, None], self.m[cell, i]
        total, factor = np.zeros((len(cell), self.width)), np.ones((len(cell), self.width))
        for j in range(b.shape[1]):
            total += np.where(b[:, j, None] != 0, b[:, j, None] * self.xa[cell, j], 0.0)
        for j in range(m.shape[1]):
            factor *= np.where(m[:, j, None] != 1, 1 - (1 - m[:, j, None]) * self.xm[cell, j], 1.0)
        s, was = total * factor, self.was[cell]
        with np.errstate(invalid="ignore"):
            good = (was != k) & (was >= 0) & (np.abs(s) >= 1e-14) & (s <= 9999999999999999.0) & (-s < 999999999.0)
        order = np.argsort(np.where(good, -s, np.inf), axis=1, kind="stable")  # cells stand in order of (r, c)
        place = np.arange(self.width)[None]
        if self.by_source:  # cells from class to class: ranked among those of the same source
            short = was.astype(np.int16) if was.max(initial=0) < 1 << 15 else was  # sorted by counting
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(short, order, 1), axis=1, kind="stable"), 1)
            source = np.take_along_axis(was, order, 1)
            first = np.maximum.accumulate(np.where(np.diff(source, axis=1, prepend=-2) != 0, place, 0), axis=1)
            rank = place - first + 1
            before, goal = rank - 1, np.take_along_axis(self.goal[cell, i], np.maximum(source, 0), 1)
        else:
            rank, ha = place + 1, np.take_along_axis(self.ha[cell], order, 1)
            before, goal = np.cumsum(ha, axis=1) - ha, self.goal[cell, i]
        taken = np.take_along_axis(good, order, 1) & ~(before >= goal)
        out = np.zeros(order.shape, np.int64)
        np.put_along_axis(out, order, np.where(taken, rank, 0), 1)
        return out

    def winners(self, ranks: np.ndarray, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(turn, class) of the places after each class (all but that at place ``leave``) took its cells: the last turn wins, in one turn the higher class."""
        turn, new = np.zeros(self.was.shape, np.int64), self.was.copy()
        for i, k in sorted(enumerate(self.layers.classes), key=lambda x: x[1]):
            if i != leave:
                late = (ranks[:, i] > 0) & (ranks[:, i] >= turn)
                turn, new = np.where(late, ranks[:, i], turn), np.where(late, k, new)
        return turn, new


CHANGES = "zone {zone}, try int, r int, c int, was int, old int, new int"
#: Numbers of layers that a task holds at a time while it ranks.
HELD = 1 << 21
#: Coarse cells that become arrays at a time.
SLICE = 256


def changes(joined: Iterator[pd.DataFrame], layers: Layers) -> Iterator[pd.DataFrame]:
    """Of packed rows with their zone's coefficients and tries, the cells whose class differs: for try -1 the kept map from the observed one (or from the start), for the others that of the try from the kept one."""
    for batch in joined:
        if not len(batch):
            continue
        each = (1 + batch["try_class"].map(len) + len(layers.classes)) * batch["r"].map(len).max() * (4 + len(layers.adds) + len(layers.times))
        for _, rows in batch.groupby((each.cumsum() // HELD).to_numpy()):  # few coarse cells at a time
            made = _changes(Many(rows, layers), rows, layers)
            if len(made):
                yield made


def changes_in_arrow(batches: Iterator[pa.RecordBatch], layers: Layers) -> Iterator[pa.RecordBatch]:
    """``changes``, of which only ``SLICE`` rows of a batch become arrays at a time."""
    for batch in batches:
        schema = pa.schema([("zone", batch.schema.field("zone").type), *((n.split()[0], pa.int32()) for n in CHANGES.split(", ")[1:])])
        for i in range(0, len(batch), SLICE):
            for made in changes(iter([batch.slice(i, SLICE).to_pandas()]), layers):
                yield pa.RecordBatch.from_pandas(made, schema, preserve_index=False)


def _changes(x: Many, rows: pd.DataFrame, layers: Layers) -> pd.DataFrame:
    n, k = len(rows), len(layers.classes)
    cell, i = np.divmod(np.arange(n * k), k)
    own = x.ranks(cell, i, x.b[cell, i]).reshape(n, k, -1)
    kept = x.winners(own)[1]
    at, place = np.nonzero(((kept != x.seen) | (kept != x.was)) & x.real)
    parts = [(at, np.full(len(at), -1), place, x.seen[at, place], kept[at, place])]
    counts = rows["try_class"].map(len).to_numpy()
    if counts.sum():
        cell = np.repeat(np.arange(n), counts)
        t = np.concatenate([np.arange(m) for m in counts])
        i, j, value = (np.concatenate([np.asarray(v) for v in rows[name]]) for name in ("try_class", "try_layer", "try_value"))
        some = x.goal[cell, i.astype(int)].any(axis=1)
        cell, t, i, j, value = cell[some], t[some], i[some].astype(int), j[some].astype(int), value[some]
        b = x.b[cell, i].copy()
        b[np.arange(len(b)), j] = value
        ranks = x.ranks(cell, i, b)
        others = [x.winners(own, leave) for leave in range(k)]
        turn, new = (np.stack([o[side] for o in others])[i, cell] for side in (0, 1))
        mine = np.array(layers.classes)[i][:, None]
        new = np.where((ranks > 0) & ((ranks > turn) | ((ranks == turn) & (mine > new))), mine, new)
        at, place = np.nonzero((new != kept[cell]) & x.real[cell])
        parts.append((cell[at], t[at], place, kept[cell[at], place], new[at, place]))
    at, t, place, old, new = (np.concatenate(v) for v in zip(*parts, strict=True))
    return pd.DataFrame({"zone": x.zone[at], "try": t, "r": x.r[at, place], "c": x.c[at, place], "was": x.was[at, place], "old": old, "new": new})


def _mirrored(start: int, side: int, n: int) -> np.ndarray:
    """Which place from 0 to n - 1 each of ``side`` places from ``start`` on takes its value from, the grid being mirrored at its edges."""
    i = np.mod(np.arange(start, start + side), 2 * n)
    return np.where(i >= n, 2 * n - 1 - i, i)


@dataclass
class Blur:
    """Blurred differences of a block and what a try changes in them."""

    block: int
    weights: np.ndarray
    layers: Layers

    def fields(self, r: np.ndarray, c: np.ndarray, was: np.ndarray, old: np.ndarray, new: np.ndarray) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of what a change from ``old`` to ``new`` adds for each class: to its expansions, or for cells that were of the class (True) to its contractions."""
        out = {}
        for k in self.layers.classes:
            at = np.flatnonzero((new == k) != (old == k))
            if not len(at):
                continue
            sign, mine = np.where(new[at] == k, 1.0, -1.0), was[at] == k
            for own in (False, True):
                some = mine == own
                if some.any():
                    out[k, own] = (r[at[some]], c[at[some]], -sign[some] if own else sign[some])
        return out

    def matrix(self, start: int, side: int, own: int, n: int) -> np.ndarray:
        """What each of a block's ``own`` places takes from each of ``side`` places from ``start`` on, the grid being mirrored."""
        source = _mirrored(start, side, n) - start
        out = np.zeros((own, side))
        for k, w in enumerate(self.weights):
            at = source[k : k + own]
            ok = (at >= 0) & (at < side)  # beyond, reach of no place of the block
            out[np.flatnonzero(ok), at[ok]] += w
        return out

    def losses(self, rows: pd.DataFrame, br: int, bc: int, n_rows: int, n_cols: int) -> dict[int, float]:
        """Loss of the kept map (-1) within a block, and what each try adds to it; places are counted from the zone's corner."""
        reach = len(self.weights) // 2
        r0, c0 = br * self.block - reach, bc * self.block - reach
        side = self.block + 2 * reach
        height, width = min(self.block, n_rows - r0 - reach), min(self.block, n_cols - c0 - reach)
        if height <= 0 or width <= 0 or r0 + reach < 0 or c0 + reach < 0:
            return {}
        order = np.argsort(rows["try"].to_numpy(), kind="stable")
        t, r, c, was, old, new = (rows[n].to_numpy()[order] for n in ("try", "r", "c", "was", "old", "new"))
        tries, first = np.unique(t, return_index=True)
        by = {int(k): tuple(v[a:b] for v in (r - r0, c - c0, was, old, new)) for k, a, b in zip(tries, first, [*first[1:], len(t)], strict=True)}
        along, over = (self.matrix(start, side, own, total) for start, own, total in ((r0, height, n_rows), (c0, width, n_cols)))

        def blurred(cells) -> tuple[slice, slice, np.ndarray] | None:
            ends = [(int(v.min()), int(v.max()) + 1) for v in cells[:2]]
            field = np.zeros([b - a for a, b in ends])
            np.add.at(field, tuple(v - a for v, (a, _) in zip(cells[:2], ends, strict=True)), cells[2])
            rows, cols = (x[:, a:b] for x, (a, b) in zip((along, over), ends, strict=True))
            spans = [np.flatnonzero(x.any(1)) for x in (rows, cols)]
            if not all(len(v) for v in spans):
                return None
            down, across = (slice(v[0], v[-1] + 1) for v in spans)
            return down, across, rows[down] @ field @ cols[across].T

        kept: dict[tuple[int, bool], np.ndarray] = {}
        out = {}
        if -1 in by:
            out[-1] = 0.0
            for name, cells in self.fields(*by[-1]).items():
                if (x := blurred(cells)) is not None:
                    kept[name] = np.zeros((height, width))
                    kept[name][x[0], x[1]] = x[2]
                    out[-1] += np.abs(x[2]).sum()
        for t, own in by.items():
            if t >= 0:
                out[t] = 0.0
                for name, cells in self.fields(*own).items():
                    if (x := blurred(cells)) is not None:
                        old = kept[name][x[0], x[1]] if name in kept else np.zeros(x[2].shape)
                        out[t] += np.abs(old + x[2]).sum() - np.abs(old).sum()
        return out


def sums(changed: DataFrame, extents: DataFrame, layers: Layers, sigma: float, zone_type: str, tries: int, block: int = BLOCK) -> DataFrame:
    """(zone, try, changed, loss) of ``changes``: for -1 the kept map's, for others what the try adds to it. A task holds a block with its halo, its kept changes and those of a few tries."""
    weights = blur_weights(sigma)
    reach = len(weights) // 2
    block = max(block, reach)
    blur = Blur(block, weights, layers)
    x = changed.join(extents, "zone").withColumn("r", F.col("r") - F.col("r0")).withColumn("c", F.col("c") - F.col("c0")).drop("r0", "c0")
    groups = max(1, -(-tries // IN_TASK))
    mine = F.when(F.col("try") >= 0, F.array(F.floor(F.col("try") / IN_TASK).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(groups - 1)))
    at = lambda v, d: F.least(F.greatest(F.floor((F.col(v) + d) / block), F.lit(0)), F.floor((F.col("n_rows" if v == "r" else "n_cols") - 1) / block)).cast("int")
    x = x.withColumn("group", F.explode(mine)).withColumn("br", F.explode(F.sequence(at("r", -reach), at("r", reach)))).withColumn("bc", F.explode(F.sequence(at("c", -reach), at("c", reach))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        zone, group, br, bc = key
        loss = blur.losses(rows, br, bc, int(rows["n_rows"].iloc[0]), int(rows["n_cols"].iloc[0]))
        r, c, t, was, old, new = (rows[n].to_numpy() for n in ("r", "c", "try", "was", "old", "new"))
        own = (r // block == br) & (c // block == bc)
        tries, at = np.unique(t[own], return_inverse=True)
        sums = np.bincount(at, ((new != was).astype(float) - ((t >= 0) & (old != was)))[own], len(tries))
        moved = dict(zip(tries.tolist(), sums.tolist(), strict=True))
        some = sorted({*loss, *moved})
        if group:
            some = [t for t in some if t >= 0]  # the kept map counts once
        return pd.DataFrame({"zone": pd.Series([zone] * len(some), dtype=object), "try": some, "changed": [int(moved.get(t, 0)) for t in some], "loss": [float(loss.get(t, 0.0)) for t in some]})

    made = x.groupBy("zone", "group", "br", "bc").applyInPandas(run, f"zone {zone_type}, try int, changed long, loss double")
    return made.groupBy("zone", "try").agg(F.sum("changed").alias("changed"), F.sum("loss").alias("loss"))


LOG = "generation int, step int, class_id int, layer string, beta double, score double"
STATE = "zone {zone}, phase string, generation int, start array<double>, b array<double>, m array<double>, scores array<double>, queue array<int>, at int, move int, top double, log array<struct<" + LOG.replace(" ", ":").replace(",:", ",") + ">>, try_class array<int>, try_layer array<int>, try_value array<double>"
#: A score counts as better if it is so by more than the last digits, in which sums of any order differ.
BETTER = 1 + 1e-12


@dataclass(frozen=True)
class Search:
    """How a zone's row moves on. Phases: "all" scores a generation's tries alone, "merge" scores the next of them, the best first, on top of what is kept, "scale" an accepted one's coefficient at several distances; then "done"."""

    layers: Layers
    step: float = 1.0
    scales: tuple[float, ...] = SCALES
    generations: int = 1
    together: int = TOGETHER

    def first(self, zone, b: Sequence[float], m: Sequence[float]) -> dict:
        s = {"zone": zone, "phase": "all", "generation": 0, "start": list(b), "b": list(b), "m": list(m), "scores": [], "queue": [], "at": 0, "move": -1, "top": None, "log": []}
        return self.asking(s)

    def asked(self, s: dict) -> list[tuple[int, int, float]]:
        """(class, layer, coefficient) of the tries that a zone's phase is to score; a try sets its coefficient to the generation's start and a step, whatever is kept."""
        moves, n = self.layers.moves(self.step), len(self.layers.adds)
        value = lambda i: s["start"][moves[i][0] * n + moves[i][1]] + moves[i][2]
        if s["phase"] == "scale":
            k, j, _ = moves[s["move"]]
            return [(k, j, value(s["move"]) + sign * self.step * x) for x in self.scales for sign in (-1, 1)]
        if s["phase"] == "done":
            return []
        some = range(len(moves)) if s["phase"] == "all" else s["queue"]
        return [(*moves[i][:2], value(i)) for i in some[s["at"] : s["at"] + self.together]]

    def asking(self, s: dict) -> dict:
        tries = self.asked(s)
        return s | {"try_class": [k for k, _, _ in tries], "try_layer": [j for _, j, _ in tries], "try_value": [v for _, _, v in tries]}

    def set(self, s: dict, k: int, j: int, v: float) -> None:
        s["b"][k * len(self.layers.adds) + j] = v

    def keep(self, s: dict, at: int, change: tuple[int, int, float], score: float) -> None:
        """Keeps the queue's try number ``at``."""
        self.set(s, *change)
        s |= {"top": score, "move": s["queue"][at], "at": at + 1, "phase": "scale" if self.scales else "merge"}
        s["log"].append({"generation": s["generation"], "step": len(s["log"]), "class_id": self.layers.classes[change[0]], "layer": self.layers.adds[change[1]], "beta": change[2], "score": score})

    def advanced(self, s: dict, kept: float, found: Sequence[float]) -> dict:
        """``s`` after its tries were scored, and what is kept."""
        tries = self.asked(s)
        if s["top"] is None:
            s["top"] = kept
            s["log"].append({"generation": 0, "step": 0, "class_id": None, "layer": None, "beta": None, "score": kept})
        if s["phase"] == "all":
            s["scores"] += found
            s["at"] += len(found)
            if s["at"] == len(self.layers.moves(self.step)):
                alone, queue = s["scores"], sorted(range(s["at"]), key=lambda i: (-s["scores"][i], i))
                s |= {"phase": "merge", "queue": queue, "at": 0, "scores": []}
                if queue and alone[queue[0]] > s["top"] * BETTER:  # nothing is kept yet, so its score is known
                    self.keep(s, 0, self.asked(s)[0], alone[queue[0]])
        elif s["phase"] == "merge":
            hit = next((i for i, v in enumerate(found) if v > s["top"] * BETTER), None)
            if hit is not None:
                self.keep(s, s["at"] + hit, tries[hit], found[hit])
            else:
                s["at"] += len(found)
        else:
            best = max(range(len(found)), key=lambda i: (found[i], -i))
            if found[best] > s["top"] * BETTER:
                self.set(s, *tries[best])
                s["top"] = found[best]
                s["log"][-1] |= {"beta": tries[best][2], "score": s["top"]}
            s["phase"] = "merge"
        if s["phase"] == "merge" and s["at"] == len(s["queue"]):
            s |= {"generation": s["generation"] + 1, "start": list(s["b"]), "at": 0, "queue": []}
            s["phase"] = "all" if s["generation"] < self.generations and self.layers.adds else "done"
        return self.asking(s)


def calibrate_zones(cells: DataFrame, start: Mapping[int, Sequence[tuple[str, str, float]]], quotas: DataFrame, observed: str, sigma: float, lulc: str = "lulc", zone: str = "zone", generations: int = 1, step: float = 1.0, scales: Sequence[float] = SCALES, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """(zone, top, b, m, log, ...): the state of every zone of ``cells`` (zone, r, c, cr, cc, ha, layers...) at the end of its own greedy search; see ``best_changes`` and ``best_coefficients``.

    All zones begin with ``start``. Their maps follow from ``quotas``, goals in hectares by class or cells from class to class, by coarse cell (and zone,
    if there is that column); a zone is a grid of its own, mirrored at the edges of its box. A generation scores every try alone, then
    takes them in order of their scores, the best first, and keeps what raises the score on top of the others;
    what is kept is tried at ``scales``. ``together`` tries of a zone share a round, which does not change the result: after a try that is kept,
    those behind it are scored anew. A null in a layer that takes part makes a cell unsuitable. A coarse cell must not span zones.
    """
    layers = Layers.of(start)
    search = Search(layers, step, tuple(scales), generations, together)
    cells_of = packed(cells, quotas, layers, observed, lulc, zone)
    spark, kind = cells.sparkSession, cells.schema[zone].dataType.simpleString()
    extents = stored(cells_of.select("zone", F.array_min("r").alias("r0"), F.array_max("r").alias("r1"), F.array_min("c").alias("c0"), F.array_max("c").alias("c1")).groupBy("zone").agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), (F.max("r1") - F.min("r0") + 1).alias("n_rows"), (F.max("c1") - F.min("c0") + 1).alias("n_cols")))
    b, m = layers.rows(start)
    b, m = [v for row in b for v in row], [v for row in m for v in row]
    state_type = STATE.replace("{zone}", kind)

    def begun(zones: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in zones:
            yield pd.DataFrame([search.first(z, b, m) for z in x["zone"]], columns=names)

    def moved(state: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in state.to_dict("records"):
            s = {n: _plain(v) for n, v in s.items()}
            s["top"] = None if s["top"] is None or s["top"] != s["top"] else s["top"]
            sums = {t: (n, x) for t, n, x in zip(got["try"], got["changed"], got["loss"], strict=True)}
            n0, x0 = sums.get(-1, (0, 0.0))
            score = lambda n, x: float((n0 + n) / (max(x0 + x, 0.0) + 1))  # noqa: E731, B023
            rows.append(search.advanced(s, score(0, 0.0), [score(*sums.get(t, (0, 0.0))) for t in range(len(s["try_class"]))]))
        return pd.DataFrame(rows, columns=names)

    names = [n.split(" ", 1)[0] for n in ("zone", "phase", "generation", "start", "b", "m", "scores", "queue", "at", "move", "top", "log", "try_class", "try_layer", "try_value")]
    state = stored(extents.select("zone").mapInPandas(begun, state_type))
    most = max(min(together, len(layers.moves(step))), 2 * len(scales))
    while True:
        asking = state.where("phase <> 'done'")
        joined = cells_of.join(asking.select("zone", "b", "m", "try_class", "try_layer", "try_value"), "zone")
        changed = joined.mapInArrow(lambda rows: changes_in_arrow(rows, layers), CHANGES.replace("{zone}", kind))
        found = sums(changed, extents, layers, sigma, kind, most, block)
        new = asking.groupBy("zone").cogroup(found.groupBy("zone")).applyInPandas(moved, state_type)
        state = stored(new.unionByName(state.where("phase = 'done'")))
        if state.where("phase <> 'done'").isEmpty():
            return state


def _plain(v):
    """Arrays and records of a frame as lists and dicts."""
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    return {n: None if isinstance(x, float) and x != x else x for n, x in v.items()} if isinstance(v, dict) else v


def best_changes(state: DataFrame) -> DataFrame:
    """(zone, generation, step, layer, class_id, beta, score): what each zone kept, in order, beginning with the score before any."""
    return state.select("zone", F.inline("log")).select("zone", "generation", "step", "layer", "class_id", "beta", "score")


def best_coefficients(state: DataFrame, start: Mapping[int, Sequence[tuple[str, str, float]]]) -> DataFrame:
    """(zone, layer, kind, class_id, beta): each zone's coefficients at the end."""
    layers = Layers.of(start)
    kinds = dict(layers.kinds)
    places = [(n, kinds[n], k, name, i * len(some) + j) for name, some in (("b", layers.adds), ("m", layers.times)) for i, k in enumerate(layers.classes) for j, n in enumerate(some) if any(n == x for x, _, _ in start[k])]
    rows = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(kind).alias("kind"), F.lit(k).alias("class_id"), F.get(name, F.lit(at)).alias("beta")) for n, kind, k, name, at in places))
    return state.select("zone", F.inline(rows))
