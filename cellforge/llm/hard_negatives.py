"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. By the triangle inequality of angles, those of
an anchor and of a row bound the angle between them from both sides; cosines of these bounds times both
lengths bound the score, with room for rounding. Only rows whose bounds overlap what is looked for are scored, in whole
numbers: for positives what reaches the k-th best so far, for negatives a window of scores for each positive.

Rows and anchors lie in blocks by (label, angle to the first reference), and a block keeps the range of its angles and its
longest row, so the same bounds tell which blocks need not meet. Positives are looked for in the anchor's own block first, which gives a floor.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .topk import _best, _exact, quantised
from .vector_blocks import QUERY_BLOCK, dealt, matrix, numbered, widest

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Negatives score from LOW to HIGH hundredths of their positive.
LOW, HIGH = 30, 90
#: Reference directions, and the rows (those of the least hashes) of which they are chosen, each as far from the others as can be.
REFERENCES, SAMPLE = 16, 512
BLOCK, STEP = 8192, 1024
#: Room for rounding: of an angle, and of a score in shares of the lengths' product.
TURN, ROOM = 2e-6, 1e-9
FOUND = "row long, anchor_id long, label int, other long, vec_id long, score long"


def references(x: DataFrame, n: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Directions (a row each) of rows of ``x`` (row, v, norm); any set would do, as bounds hold for each direction. Reads the vectors of ``sample`` rows."""
    some = [r["v"] for r in x.where("norm > 0").orderBy(F.xxhash64("row"), "row").limit(sample).select("v").collect()]
    if not some:
        return np.zeros((0, 0))
    v = matrix(pd.Series(some), max(map(len, some)), np.float64).T
    v = v / np.sqrt((v * v).sum(1))[:, None]
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(n, len(v)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[chosen[-1]])
    return v[chosen]


def angles_to(refs: np.ndarray):
    """A function of (v, norm) that gives each row's angles to ``refs``."""

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series, norm: pd.Series) -> pd.Series:
        dims = max(widest(v), refs.shape[1])
        r = np.pad(refs, ((0, 0), (0, dims - refs.shape[1])))
        cos = r @ matrix(v, dims, np.float64) / np.maximum(norm.to_numpy(), 1e-300)
        return pd.Series(list(np.arccos(np.clip(cos, -1.0, 1.0)).T))

    return angles


def bounds(a: np.ndarray, a_norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that rows (a column of ``angles`` each) can score with an anchor of angles ``a``."""
    if len(a):
        least = np.abs(angles - a[:, None]).max(0)
        total = angles + a[:, None]
        most = np.minimum(total, 2 * np.pi - total).min(0)
    else:
        least, most = np.zeros(len(norms)), np.full(len(norms), np.pi)
    size = a_norm * norms
    room = ROOM * size + 1e-6
    return size * np.cos(np.minimum(most + TURN, np.pi)) - room, size * np.cos(np.maximum(least - TURN, 0.0)) + room


def best_first(q: np.ndarray, c: np.ndarray, some: np.ndarray, most: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of ``some`` columns of ``c`` with whole numbers, those that can score most first, until ``enough``(scores, the most that is left) says so."""
    some = some[np.argsort(-most[some], kind="stable")]
    scores = np.zeros(0, c.dtype)
    for a in range(0, len(some), STEP):
        if a and enough(scores, most[some[a]]):
            some = some[:a]
            break
        scores = np.concatenate([scores, q @ c[:, some[a : a + STEP]]])
    return some, scores


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th best score; the least number where there are fewer."""
    return float(np.sort(scores)[-k]) if len(scores) >= k else -np.inf


def _positives(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    def find(q, a, c, ids, rows, angles, norms):
        least, most = bounds(np.asarray(a.angles), a.norm, angles, norms)
        some = np.flatnonzero((most >= a.least) & (rows != a.row))
        # as many as k rows are known to score this much
        floor = max(a.least, kth(least[some], k))
        some = some[most[some] >= floor]
        places, scores = best_first(q, c, some, most, lambda s, rest: kth(s, k) > rest)
        order = _best(scores, ids[places], rows[places], k)
        return places[order], scores[order]

    return _searched(find, left, right)


def _negatives(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    def find(q, a, c, ids, rows, angles, norms):
        least, most = bounds(np.asarray(a.angles), a.norm, angles, norms)
        low, high = np.asarray(a.low, object), np.asarray(a.high, object)
        overlap = np.zeros(len(rows), bool)
        for x, y in zip(low, high, strict=True):
            overlap |= (most >= x) & (least <= y)

        def windows(scores):
            return [np.flatnonzero((scores >= x) & (scores <= y)) for x, y in zip(low, high, strict=True)]

        def enough(scores, rest):
            return all(kth(scores[w], k) > rest for w in windows(scores))

        places, scores = best_first(q, c, np.flatnonzero(overlap), most, enough)
        keep = {j for w in windows(scores) for j in w[_best(scores[w], ids[places[w]], rows[places[w]], k)].tolist()}
        keep = np.array(sorted(keep), int)
        return places[keep], scores[keep]

    return _searched(find, left, right)


def _searched(find, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """What ``find`` gives for each anchor of ``left`` among the rows of ``right``, one block."""
    parts = []
    if len(left) and len(right):
        dims = widest(left["v"], right["c_v"])
        q, c = _exact(matrix(left["v"], dims), matrix(right["c_v"], dims))
        ids, rows, norms = right["c_id"].to_numpy(), right["c_row"].to_numpy(), right["c_norm"].to_numpy()
        angles = np.stack(right["c_angles"].to_numpy()).T
        for i, a in enumerate(left.itertuples(index=False)):
            places, scores = find(q[:, i], a, c, ids, rows, angles, norms)
            if len(places):
                parts.append(pd.DataFrame({"row": a.row, "anchor_id": a.vec_id, "label": a.label, "other": rows[places], "vec_id": ids[places], "score": np.array([int(s) for s in scores], np.int64)}))
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({n: pd.Series(dtype="int32" if n == "label" else "int64") for n in ("row", "anchor_id", "label", "other", "vec_id", "score")})


def _most(a: Column, b: Column) -> Column:
    """The most that an anchor of one group and a row of another can score, from their ranges of angles and longest rows."""
    apart = lambda x, y: F.zip_with(x["low"], y["high"], lambda low, high: low - high)
    gap = F.greatest(F.array_max(F.concat(apart(a, b), apart(b, a), F.array(F.lit(TURN)))) - TURN, F.lit(0.0))
    size = a["longest"] * b["longest"]
    return size * F.cos(gap) + size * ROOM + 1e-6


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, v of whole numbers) for each row for which ``is_anchor`` holds.

    An anchor's positives are the rows of its label with the best inner products, its own row left out; a positive's
    negatives are the best rows of other labels whose score is ``low`` to ``high`` hundredths of its own, both included. Fewer are
    returned where there are fewer; a positive without any has no row. Equal scores go to the smaller id. A row that repeats an id is a row of its own, and an anchor of its own whose ranks start
    from 1 again. Rows without a label take no part. Shorter vectors count as if zeros followed; a vector of zeros scores 0. No rows give no rows.
    A score beyond a long fails with OverflowError.

    A task holds one block of rows and one of anchors. Anchors meet every block whose bounds reach their windows: the stated anchors against all rows, in blocks.
    """
    x = vectors.where("label IS NOT NULL")
    x = numbered(x, F.col("label").cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    n = x.agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("q")).first()
    n_q = max(1, -(-n["q"] // QUERY_BLOCK))
    refs = references(x)
    angled = x.withColumn("angles", angles_to(refs)("v", "norm") if len(refs) else F.array().cast("array<double>"))
    rows = dealt(angled, n["c"], block, "label", F.get("angles", F.lit(0)), "row")
    ranges = F.struct(*(F.array(*(f(F.get("angles", F.lit(j))) for j in range(len(refs)))).cast("array<double>").alias(name) for name, f in (("low", F.min), ("high", F.max))), F.max("norm").alias("longest"))
    known = stored(rows.groupBy("label", "block").agg(ranges.alias("ranges")))
    anchors = rows.where("asks").select("row", "vec_id", "label", "v", "norm", "angles", F.col("block").alias("home"))
    anchors = dealt(anchors, n["q"], QUERY_BLOCK, "label", F.get("angles", F.lit(0)), "row").withColumnRenamed("block", "qb")
    candidates = rows.select(F.col("row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.col("norm").alias("c_norm"), F.col("angles").alias("c_angles"), F.col("label").alias("c_label"), F.col("block").alias("c_block"))
    own = ["row", "vec_id", "label", "v", "norm", "angles", "qb", "least"]

    def met(queries: DataFrame, same: bool) -> DataFrame:
        """(qb, label, w_label, w_block): the blocks of the anchors' label, or of the others, that some anchor of a block of anchors may find something in."""
        groups = queries.groupBy("qb", "label").agg(ranges.alias("ranges"), F.min("least").alias("least"))
        # One row, with a few numbers for each label and 8,192 anchors.
        listed = groups.agg(F.collect_list(F.struct("qb", "label", "ranges", "least")).alias("askers"))
        x = known.withColumnsRenamed({"label": "w_label", "block": "w_block"}).crossJoin(F.broadcast(listed))
        some = F.filter("askers", lambda a: ((a["label"] == F.col("w_label")) == same) & (_most(a["ranges"], F.col("ranges")) >= a["least"]))
        return x.withColumn("a", F.explode(F.transform(some, lambda a: F.struct(a["qb"].alias("qb"), a["label"].alias("label"))))).select("a.qb", "a.label", "w_label", "w_block")

    def pairs(queries: DataFrame, run) -> DataFrame:
        """``run`` on each block of anchors and of rows that ``queries`` (qb, w_label, w_block) name."""
        wanted = queries.select(F.col("qb").alias("c_qb"), F.col("w_label").alias("c_label"), F.col("w_block").alias("c_block")).distinct()
        right = candidates.join(wanted, ["c_label", "c_block"])
        return queries.groupBy("qb", "w_label", "w_block").cogroup(right.groupBy("c_qb", "c_label", "c_block")).applyInPandas(run, FOUND)

    home = anchors.withColumn("least", F.lit(float("-inf"))).select(*own, F.col("label").alias("w_label"), F.col("home").alias("w_block"))
    found = stored(pairs(home, partial(_positives, positives)))
    floors = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    further = anchors.join(floors, "row", "left").withColumn("least", F.when(F.col("n") >= positives, F.col("s").cast("double")).otherwise(float("-inf")))
    further = further.join(met(further, True), ["qb", "label"]).where(F.col("w_block") != F.col("home")).select(*own, F.col("w_label"), "w_block")
    found = found.unionByName(pairs(further, partial(_positives, positives)))
    w = W.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    good = stored(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives).select("row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Windows of whole scores; a positive below 0 has none.
    hundredths = lambda f, share: F.expr(f"CAST({f}(CAST(positive_score AS DECIMAL(38,0)) * {int(share)} / 100) AS BIGINT)")
    ends = good.where("positive_score >= 0").groupBy("row").agg(F.collect_list(hundredths("ceil", low)).alias("low"), F.collect_list(hundredths("floor", high)).alias("high"))
    seeking = anchors.join(ends, "row").withColumn("least", F.array_min("low").cast("double"))
    seeking = seeking.join(met(seeking, False), ["qb", "label"]).select(*own, "low", "high", "w_label", "w_block")
    scored = pairs(seeking, partial(_negatives, negatives))
    w = W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "other")
    hundred = lambda c: F.col(c).cast("decimal(38,0)") * 100
    kept = scored.select("row", "anchor_id", "other", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, "row")
    share = F.col("positive_score").cast("decimal(38,0)")
    kept = kept.where((hundred("negative_score") >= share * low) & (hundred("negative_score") <= share * high))
    kept = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """``mine`` for the rows whose id is divisible by 100, after the label of each seventh id is put up by one (modulo 10); vectors are quantised by 256. Nulls, ties and repeats as stated there and in ``quantised``."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = quantised(vectors, scale=SCALE, more=[label.cast("int").alias("label")])
    return mine(x, F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT row, place, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT s.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM s JOIN p USING (row) WHERE NOT s.same AND 100 * s.score BETWEEN {LOW} * p.positive_score AND {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
