"""Exact top-k search by branch and bound over vertical blocks.

Rows are cut into blocks by falling norm. Queries first search the block of the largest norms; the k-th
best score found there is a query's floor, and only blocks whose largest norm times the query's reaches
the floor are searched further. For a pair of blocks one task holds the candidates dimension by
dimension, adds up the products a few dimensions at a time, and after each step keeps only the
candidates whose upper bound (score so far plus the product of the remaining norms) reaches the floor.
The best of each pair are merged by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .vector_blocks import prefix

K = 20
SCALE = 64
STEP = 8
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
FOUND = "row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, more: Sequence[Column] = ()) -> DataFrame:
    """(vec_id, v, more...): each component as floor(scale * x), a long. Rows that are null, or hold null or non-finite components, are left out; an empty vector scores 0 with all. Components beyond a long end at its limits."""
    x = F.col(embedding)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = vectors.where(x.isNotNull() & F.col(vec_id).isNotNull() & finite)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("v"), *more)


def _matrix(values: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((dims, len(values)), np.int64)
    for k, v in enumerate(values):
        out[: len(v), k] = v
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products add up exactly: doubles where no sum can exceed 2**53, else longs, else Python's integers."""
    most = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(0)).max(initial=0.0))
    bound = most(q) * most(c) * 1.000001
    kind = np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**63 else object
    return q.astype(kind), c.astype(kind)


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    if score.dtype != object and len(score) > k:  # ties at the edge stay until ids decide
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    order = sorted(some.tolist(), key=lambda j: (-score[j], ids[j], rows[j])) if score.dtype == object else some[np.lexsort((rows[some], ids[some], -score[some]))]
    return np.asarray(order[:k], np.int64)


def search_blocks(q_rows: np.ndarray, q: np.ndarray, floors: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, step: int = STEP) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) of the k best candidates of each query by inner product that reach its floor, its own row left out, ties to the smaller id.

    ``q`` and ``c`` are vertical: a row for each dimension, of whole numbers.
    """
    q, c = _exact(q, c)
    if c.dtype == object:  # numbers beyond a long: no bounds, exact sums alone
        out = []
        for i, own in enumerate(q_rows):
            alive = np.flatnonzero(c_rows != own)
            score = q[:, i] @ c[:, alive]
            best = _best(score, c_ids[alive], c_rows[alive], k)
            out.append((i, c_ids[alive][best], score[best]))
        return out
    dims = len(c)
    order = np.argsort(-np.abs(c).sum(1, dtype=np.float64), kind="stable")  # heavy dimensions first: the bounds fall sooner
    q, c = q[order], c[order]
    cuts = list(range(0, dims, step)) + [dims]
    rest = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    q_rest, c_rest = rest(q), rest(c)
    norm = c_rest[0] if dims else np.zeros(c.shape[1])
    longest = norm.max(initial=0.0)
    by_norm = np.argsort(-norm, kind="stable")[: max(8 * k, 256)]
    blocks = [np.ascontiguousarray(c[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for i, own in enumerate(q_rows):
        seen = (q[:, i] @ c[:, by_norm])[c_rows[by_norm] != own]
        floor = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else -np.inf
        floor = max(float(floor), float(floors[i]))
        slack = 1e-6 * max(1.0, abs(floor)) + 1e-9 * longest * (q_rest[0, i] if dims else 0.0)
        alive = np.flatnonzero(c_rows != own)
        score = np.zeros(len(alive), c.dtype)
        for b in range(len(blocks)):
            if b:
                keep = score + q_rest[cuts[b], i] * c_rest[cuts[b]][alive] >= floor - slack
                alive, score = alive[keep], score[keep]
                score = score + q[cuts[b] : cuts[b + 1], i] @ blocks[b][:, alive]
            else:
                score = q[: cuts[1], i] @ blocks[0] if len(alive) == c.shape[1] else q[: cuts[1], i] @ blocks[0][:, alive]
            if len(score) >= k and b + 1 < len(blocks):
                low = score - q_rest[cuts[b + 1], i] * c_rest[cuts[b + 1]][alive]
                floor = max(floor, float(np.partition(low, len(low) - k)[len(low) - k]))
        reached = score >= floors[i]
        alive, score = alive[reached], score[reached]
        best = _best(score, c_ids[alive], c_rows[alive], k)
        out.append((i, c_ids[alive][best], score[best]))
    return out


def _pair(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({n: pd.Series(dtype="int64") for n in ("row", "query_id", "vec_id", "score")})
        if left.empty or right.empty:
            return empty
        dims = max(int(left["v"].map(len).max()), int(right["c_v"].map(len).max()))
        rows, ids = left["row"].to_numpy(), left["vec_id"].to_numpy()
        found = search_blocks(rows, _matrix(left["v"], dims), left["least"].to_numpy(), right["c_row"].to_numpy(), right["c_id"].to_numpy(), _matrix(right["c_v"], dims), k)
        parts = [pd.DataFrame({"row": rows[i], "query_id": ids[i], "vec_id": own, "score": np.array([int(x) for x in scores], np.int64)}) for i, own, scores in found if len(own)]
        return pd.concat(parts, ignore_index=True) if parts else empty

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The k best of ``vectors`` (vec_id, v) for each of its rows for which ``is_query`` holds, other than itself: (query_id, rank, vec_id, score).

    Equal scores go to the smaller id, at the k-th place too. A row that repeats an id is a candidate
    and a query of its own; its ranks start from 1 again. Shorter vectors count as if zeros followed. A
    score beyond a long fails with OverflowError. No rows give no rows; other columns are not read.

    The numbers of blocks follow from a count, so no task's share grows with the table. A block of
    candidates is sent once for each block of queries that may still find something in it.
    """
    x = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("norm"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    x = stored(x)  # rows keep their numbers
    n = x.agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("q")).first()
    n_q, n_c = max(1, -(-n["q"] // QUERY_BLOCK)), max(1, -(-n["c"] // CANDIDATE_BLOCK))
    dealt = stored(x.repartitionByRange(n_c, F.desc("norm"), "row").withColumn("part", F.spark_partition_id()))
    parts = (dealt.agg(F.max("part").alias("p")).first()["p"] or 0) + 1  # Spark may have taken more than asked for
    blocks = dealt.withColumn("block", F.floor(F.col("part") * n_c / parts).cast("int")).drop("part")
    asks = blocks.where("asks").select("row", "vec_id", "v", "norm", F.pmod(F.xxhash64("row"), F.lit(n_q)).cast("int").alias("qb"))
    pair = lambda a, b: a.groupBy("qb", "block").cogroup(b.groupBy("c_qb", "c_block")).applyInPandas(_pair(k), FOUND)
    tops = blocks.groupBy("block").agg(F.max("norm").alias("top"))
    # One row with a few bytes for each block of candidates, in falling order of norms.
    listed = tops.agg(F.array_sort(F.collect_list(F.struct("block", "top"))).alias("t")).select(F.col("t.block").alias("ids"), F.col("t.top").alias("tops"))
    asks = asks.crossJoin(F.broadcast(listed))

    candidates = blocks.select(F.col("row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.col("block").alias("c_block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    opening = asks.select("row", "vec_id", "v", F.lit(float("-inf")).alias("least"), "qb", F.get("ids", F.lit(0)).alias("block"))
    found = stored(pair(opening, candidates.join(F.broadcast(listed.select(F.get("ids", F.lit(0)).alias("w_block"))), F.col("c_block") == F.col("w_block"), "left_semi").withColumn("c_qb", every)))
    w = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    if n_c > 1:
        floors = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        further = asks.join(floors, "row", "left").withColumn("least", F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(float("-inf")))
        reaches = lambda top: (F.col("least") == float("-inf")) | ((F.col("norm") * (1 + 1e-9)) * top >= F.col("least") - F.abs("least") * 1e-9 - 1)
        # Blocks fall by norm, so those that may hold something are the first ones, and a query is sent to them alone.
        last = prefix(F.col("tops"), reaches)
        further = further.withColumn("block", F.explode(F.slice("ids", F.lit(2), F.greatest(last - 1, F.lit(0)))))
        further = further.select("row", "vec_id", "v", "least", "qb", "block")
        wanted = further.select(F.col("qb").alias("c_qb"), F.col("block").alias("w_block")).distinct()
        found = found.unionByName(pair(further, candidates.join(wanted, F.col("c_block") == F.col("w_block"))))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(vectors: DataFrame) -> DataFrame:
    """``top_k`` of the quantised vectors for the rows whose id is divisible by 20; nulls, repeats and ties as stated there and in ``quantised``."""
    return top_k(quantised(vectors), F.col("vec_id") % 20 == 0)


OP8_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
