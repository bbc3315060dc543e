"""Approximate nearest neighbours by inner product, by counting collisions of single projections.

A block of candidates keeps ``PROJECTIONS`` sorted arrays, each of its vectors' projections on one random
direction. Around a query's own projection a window opens in each array; a vector's collisions are the windows that it
lies in, and a vector with enough of them is verified: its inner product is computed. Windows grow by
virtual rehashing, that is by a radius, and only what they newly cover is counted. A vector at a distance
of the radius or less has enough collisions with a probability of ``SUCCESS`` at least, so a query is done
when its k-th best verified vector lies within the radius. There is no bound on what is verified.

Distances are those between directions: a vector of a class of lengths that scores as much as a query's k-th best lies
within the angle that the class's longest would need. Blocks hold vectors of like length: queries first search the block
of the longest; the k-th best found there is a query's floor, and it goes on to the blocks that can reach it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .vector_blocks import QUERY_BLOCK, dealt, matrix, numbered, prefix, query_block, widest

K = 20
PROJECTIONS, SUCCESS, SEED = 64, 0.95, 12
#: Half a window's width in radii, the first radius, the factor by which it grows, and classes of lengths in a doubling.
WIDTH, FIRST, GROWTH, CLASSES = 1.0, 0.25, 1.25, 8
CANDIDATE_BLOCK, TOGETHER = 16384, 32
FOUND = "row long, query_id long, vec_id long, score double"


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, success: float = SUCCESS) -> int:
    """The most collisions that a vector at the radius has with a probability of ``success`` at least: its projection differs by a normal number of radii, each collision has the chance that this is below ``width``."""
    p = math.erf(width / math.sqrt(2))
    tail = 1.0
    for n in range(projections + 1):
        below = math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if tail - below < success:
            return n
        tail -= below
    return projections


def directions(dims: int, n: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """``n`` normal directions of ``dims`` dimensions (a column each); more dimensions leave the first ones as they are."""
    return np.stack([np.random.default_rng((seed, d)).standard_normal(n) for d in range(dims)])


def lengths_of(c: np.ndarray) -> np.ndarray:
    return np.sqrt((c * c).sum(0))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with the columns of ``c``, added up from the first component to the last."""
    total = np.zeros(c.shape[1])
    for x, row in zip(q, c, strict=True):
        total += x * row
    return total


class Index:
    """The sorted projections of the directions of vectors (a column each) of like length."""

    def __init__(self, c: np.ndarray, lengths: np.ndarray, n: int = PROJECTIONS, success: float = SUCCESS):
        self.rows, self.longest = np.ascontiguousarray(c.T), float(lengths.max())
        projected = (self.rows / lengths[:, None]) @ directions(len(c), n)
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(projected, axis=0).T)
        self.least = threshold(n, WIDTH, success)

    def radius(self, score: float, q_length: float) -> float:
        """The distance between directions within which all vectors that score so lie."""
        return math.sqrt(max(2 - 2 * score / self.longest / q_length, 0.0)) + 1e-6 if math.isfinite(score) else math.inf

    def search(self, q: np.ndarray, lengths: np.ndarray, at: np.ndarray, own: np.ndarray, scores: list[np.ndarray], k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the vectors that are verified for each query (a row of ``q``): ``at`` are its direction's projections, ``own`` its own place or -1, ``scores`` those it has from elsewhere; what scores below its floor does not matter."""
        total, n = len(self.rows), len(q)
        waiting, counts = np.ones((n, total), bool), np.zeros((n, total), np.int64)
        waiting[np.flatnonzero(own >= 0), own[own >= 0]] = False
        low = self._places(at)
        high = low.copy()
        places: list[list[np.ndarray]] = [[] for _ in range(n)]
        scores = list(scores)
        before = [len(s) for s in scores]

        def goal(i: int) -> float:
            best = scores[i]
            return self.radius(max(floors[i], np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else floors[i], lengths[i])

        reach = np.array([goal(i) for i in range(n)])
        radius = np.minimum(reach, np.maximum(FIRST, np.where(np.isfinite(reach), reach / GROWTH**2, 0.0)))
        active = np.flatnonzero(waiting.any(1))
        while len(active):
            a, b = (self._places(at[active] + side * WIDTH * radius[active, None]) for side in (-1, 1))
            for x, i in enumerate(active):
                fresh = [o[s:t] for o, *ends in zip(self.order, a[x], low[i], high[i], b[x], strict=True) for s, t in (ends[:2], ends[2:]) if s < t]
                if fresh:
                    counts[i] += np.bincount(np.concatenate(fresh), minlength=total)
                new = np.flatnonzero(waiting[i] & (counts[i] >= self.least))
                if len(new):
                    waiting[i, new] = False
                    places[i].append(new)
                    scores[i] = np.concatenate([scores[i], self.rows[new] @ q[i]])
                    reach[i] = min(reach[i], goal(i))
            low[active], high[active] = a, b
            active = active[(radius[active] < reach[active]) & waiting[active].any(1)]
            radius[active] = np.minimum(radius[active] * GROWTH, reach[active])
        return [(np.concatenate([np.zeros(0, np.int64), *p]), s[m:]) for p, s, m in zip(places, scores, before, strict=True)]

    def _places(self, values: np.ndarray) -> np.ndarray:
        """Where ``values`` (a column for each projection) fall in the sorted arrays."""
        return np.stack([s.searchsorted(v) for s, v in zip(self.sorted, values.T, strict=True)], axis=1)


class Block:
    """Vectors (a column each) of any lengths: an ``Index`` for each class of lengths, the longest first."""

    def __init__(self, c: np.ndarray, n: int = PROJECTIONS, success: float = SUCCESS):
        self.scale = np.abs(c).max(initial=0.0) or 1.0  # keeps squares within doubles
        c = c / self.scale
        self.lengths = lengths = np.maximum(lengths_of(c), 1e-300)
        classes = np.round(np.log2(lengths / lengths.max(initial=1e-300)) * CLASSES).astype(int)
        self.parts = [(own := np.flatnonzero(classes == x), Index(c[:, own], lengths[own], n, success)) for x in sorted(set(classes.tolist()), reverse=True)]
        self.directions = directions(len(c), n)

    def search(self, q: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int = K) -> list[tuple[np.ndarray, int]]:
        """(places of the vectors worth an exact score, number of those verified) for each query (a column)."""
        sizes = np.abs(q).max(axis=0)
        unit = (q / sizes).T
        lengths = lengths_of(unit.T)
        at = unit / lengths[:, None] @ self.directions
        floors = floors / self.scale / sizes
        places = [np.zeros(0, np.int64)] * len(unit)
        scores = [np.zeros(0)] * len(unit)
        for there, index in self.parts:
            here = np.full(len(self.lengths) + 1, -1)
            here[there] = np.arange(len(there))
            found = index.search(unit, lengths, at, here[own], scores, k, floors)
            places = [np.concatenate([p, there[x]]) for p, (x, _) in zip(places, found, strict=True)]
            scores = [np.concatenate([s, x]) for s, (_, x) in zip(scores, found, strict=True)]
        out = []
        for p, s, floor, length in zip(places, scores, floors, lengths, strict=True):
            best = max(floor, np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else floor
            # what the order of adding up may change stays until exact scores are there
            worth = s >= best - 1e-9 * length * self.lengths[p] if math.isfinite(best) else np.ones(len(s), bool)
            out.append((p[worth], len(s)))
        return out


def _pair(k: int, n: int, success: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            dims = widest(left["v"], right["c_v"])
            c, c_rows, c_ids = matrix(right["c_v"], dims, np.float64), right["c_row"].to_numpy(), right["c_id"].to_numpy()
            index = Block(c, n, success)
            place = {r: j for j, r in enumerate(c_rows.tolist())}
            for a in range(0, len(left), TOGETHER):
                some = left.iloc[a : a + TOGETHER]
                q, rows = matrix(some["v"], dims, np.float64), some["row"].to_numpy()
                own = np.array([place.get(r, -1) for r in rows.tolist()])
                found = index.search(q, own, some["least"].to_numpy(), k)
                for i, (places, _) in enumerate(found):
                    score = inner(q[:, i], c[:, places])
                    best = np.lexsort((c_rows[places], c_ids[places], -score))[:k]
                    parts.append(pd.DataFrame({"row": rows[i], "query_id": some["vec_id"].iloc[i], "vec_id": c_ids[places][best], "score": score[best]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) in doubles. Rows without an id or vector, or whose vector holds a null or non-finite component or none but zeros, are left out."""
    x = F.col(embedding)
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.where(x.isNotNull() & F.col(vec_id).isNotNull() & good).select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, projections: int = PROJECTIONS, success: float = SUCCESS, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of ``vectors`` (vec_id, v), the k nearest that are found for each row for which ``is_query`` holds, other than itself; scores are exact, ties go to the smaller id.

    Each true neighbour is found with a probability of about ``success`` or more, whatever the number of rows; where fewer than k vectors can be found, all are. A row that
    repeats an id is a candidate and a query of its own; its ranks start from 1 again. Shorter vectors count as if
    zeros followed. No rows give no rows. Scores beyond a double are infinite.

    A task holds one block of candidates and one of queries. A block of candidates is sent once for each block of queries that may find something in it, which is every
    one where all vectors are of like length: the stated query set meets all rows, in blocks.
    """
    x = numbered(vectors, F.coalesce(is_query, F.lit(False)).alias("asks"))
    n = x.agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("q")).first()
    n_q = max(1, -(-n["q"] // QUERY_BLOCK))
    blocks = dealt(x, n["c"], block, F.desc("norm"), "row")
    tops = blocks.groupBy("block").agg(F.max("norm").alias("top"))
    # One row, with a few bytes for each block of candidates.
    listed = tops.agg(F.array_sort(F.collect_list(F.struct("block", "top"))).alias("t")).select(F.transform("t", lambda t: t["block"]).alias("ids"), F.transform("t", lambda t: t["top"]).alias("tops"))
    asks = blocks.where("asks").select("row", "vec_id", "v", "norm", query_block("row", n_q).alias("qb")).crossJoin(F.broadcast(listed))
    candidates = blocks.select(F.col("row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.col("block").alias("c_block"))

    def pairs(queries: DataFrame) -> DataFrame:
        wanted = queries.select(F.col("qb").alias("c_qb"), F.col("block").alias("w_block")).distinct()
        right = candidates.join(wanted, F.col("c_block") == F.col("w_block"))
        return queries.groupBy("qb", "block").cogroup(right.groupBy("c_qb", "c_block")).applyInPandas(_pair(k, projections, success), FOUND)

    opening = asks.select("row", "vec_id", "v", F.lit(float("-inf")).alias("least"), "qb", F.get("ids", F.lit(0)).alias("block"))
    found = stored(pairs(opening))
    floors = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    further = asks.join(floors, "row", "left").withColumn("least", F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")))
    last = prefix(F.col("tops"), lambda top: (F.col("least") == float("-inf")) | (F.col("norm") * top * (1 + 1e-9) >= F.col("least")))
    further = further.withColumn("block", F.explode(F.expr("slice(ids, 2, 2147483647)") if n["c"] <= block else F.slice("ids", F.lit(2), F.greatest(last - 1, F.lit(0)))))
    found = found.unionByName(pairs(further.select("row", "vec_id", "v", "least", "qb", "block")))
    w = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_collision_search(vectors: DataFrame) -> DataFrame:
    """``nearest`` for the rows whose id is divisible by 20; nulls, zeros, ties and repeats as stated there and in ``usable``."""
    return nearest(usable(vectors), F.col("vec_id") % 20 == 0)
