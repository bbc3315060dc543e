"""Neighbourhood operators: kernels, convolution, blur and distance transform.

Cells are sent to square blocks with a halo as wide as the operator reaches, one shuffle of about
(1 + 2 * reach / block) squared times the cells, and numpy works on a block at a time within tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellforge.functions.curves import at_distance, kernel_weight
from cellforge.storage import stored

from .remap import CELL

REACH = 9  # a kernel's radius in half-lives
#: Side of a block, rows of a band, and steps that the row pass of a distance transform takes before it goes by parabolas.
BLOCK, BAND, STEPS = 256, 32, 1024
#: Bands that go to a task together, and cells of them that it holds at a time, or those of one band.
BANDS, HELD = 16, 1 << 20


def sigmoid_kernel(spark: SparkSession, half_life: float, radius: int | None = None, start: float = 1.0) -> DataFrame:
    """(dr, dc, w): a square of 2 * radius offsets, from -radius to radius - 1."""
    radius = radius or int(REACH * half_life)
    side = spark.range(-radius, radius).withColumnRenamed("id", "dr")
    both = side.withColumn("dc", F.explode(F.sequence(F.lit(-radius), F.lit(radius - 1))))
    weight = at_distance(F.col("dr").cast("double"), F.col("dc").cast("double"), lambda d: kernel_weight(d, half_life, start))
    return both.select(F.col("dr").cast("int").alias("dr"), F.col("dc").cast("int").alias("dc"), weight.alias("w"))


def kernel_set(spark: SparkSession, half_lives: Sequence[float]) -> DataFrame:
    """All kernels in one table, by half_life."""
    out = None
    for h in half_lives:
        k = sigmoid_kernel(spark, h).select(F.lit(float(h)).alias("half_life"), "dr", "dc", "w")
        out = k if out is None else out.unionByName(k)
    return out


def kernel_array(half_life: float, radius: int | None = None) -> np.ndarray:
    radius = radius or int(REACH * half_life)
    d = np.arange(-radius, radius, dtype=float)
    return 1.0 / (1.0 + np.exp(4.0 / half_life * (np.hypot(d[:, None], d[None]) - half_life)))


def in_blocks(cells: DataFrame, values: Sequence[str], reach: int, block: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., br, bc, r, c, values...): each cell once for its own block and once for each whose halo it lies in."""
    at = lambda x, d: F.floor((F.col(x) + d) / block).cast("int")
    x = cells.select(*by, *CELL, *values)
    return x.withColumn("br", F.explode(F.sequence(at("r", -reach), at("r", reach)))).withColumn("bc", F.explode(F.sequence(at("c", -reach), at("c", reach))))


def _wide(block: int, reach: int) -> int:
    """A side with which each cell is sent about 2.3 times at most: four reaches or ``block``; a caller's smaller block holds down to one reach."""
    return max(block, 4 * reach) if block >= BLOCK else max(block, reach)


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def convolve(cells: DataFrame, value: str, weights: np.ndarray, radius: int, by: Sequence[str] = (), out: str = "value", block: int = BLOCK) -> DataFrame:
    """(by..., r, c, out): sum over offsets of weight * value at (r - dr, c - dc), 0 outside, for all cells of ``cells``. A task holds one block and its halo."""
    block = _wide(block, radius)
    x = in_blocks(cells.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), ["__v"], radius, block, by)
    side = block + 2 * radius
    size = -(-side // 32) * 32  # what wraps around stays within the halo

    made_once: list[np.ndarray] = []

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if not made_once:  # a task transforms the kernel for its first block
            made_once.append(np.fft.rfft2(weights, (size, size)))
        r0, c0 = int(key[-2]) * block - radius, int(key[-1]) * block - radius
        field = np.zeros((side, side))
        field[rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0] = rows["__v"].to_numpy()
        full = np.fft.irfft2(np.fft.rfft2(field, (size, size)) * made_once[0], (size, size))
        own = rows[(rows["r"] // block == key[-2]) & (rows["c"] // block == key[-1])]
        made = own[[*by, *CELL]].copy()
        made[out] = full[own["r"].to_numpy() - r0 + radius, own["c"].to_numpy() - c0 + radius]
        return made

    return x.groupBy(*by, "br", "bc").applyInPandas(run, _kinds(x, [*by, *CELL]) + f"{out} double")


def _even(n: int) -> int:
    """The least whole multiple of 32, from ``n`` on: a size that transforms take fast."""
    return -(-n // 32) * 32


def _around(weights: np.ndarray, size: Sequence[int], sides: Sequence[int]) -> np.ndarray:
    """A kernel's weights for offsets that two cells of a field of ``sides`` can have, its centre in the corner and offsets below 0 at the other end."""
    radius = len(weights) // 2
    out = np.zeros(size)
    offsets = [np.arange(-min(radius, n - 1), min(radius - 1, n - 1) + 1) for n in sides]
    out[np.ix_(*(d % n for d, n in zip(offsets, size, strict=True)))] = weights[np.ix_(*(d + radius for d in offsets))]
    return out


def class_convolutions(cells: DataFrame, classes: Sequence[int], half_lives: Sequence[float], value: str = "class_id", by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(by..., half_life, class_id, r, c, value) of the presence of each class under each kernel, in one pass over the cells.

    Cells carry their class, not a row for each class; a block is transformed once for each class that occurs in it.
    """
    radius = max(int(REACH * h) for h in half_lives)
    block = _wide(block, radius)
    tables = [kernel_array(h) for h in half_lives]
    x = in_blocks(cells.withColumn("__k", F.coalesce(F.col(value).cast("int"), F.lit(-1))), ["__k"], radius, block, by)
    spectra: dict[tuple[int, int], list[np.ndarray]] = {}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here = ((rows["r"] // block == key[-2]) & (rows["c"] // block == key[-1])).to_numpy()
        own = rows.loc[here, [*by, *CELL]]
        if not len(own):
            return own.assign(class_id=0, found=pd.Series([], dtype=object))
        place = [rows[n].to_numpy() - rows[n].min() for n in CELL]
        sides = [int(p.max()) + 1 for p in place]  # cells alone, not the empty parts of the block and its halo
        size = tuple(_even(max(n, n + min(n, radius) - p[here].min(), p[here].max() + 1 + min(n, radius), 2 * min(n, radius))) for n, p in zip(sides, place, strict=True))  # what wraps around misses the block's own cells
        if size not in spectra:  # a task transforms the kernels once for blocks of one size
            spectra.clear()
            spectra[size] = [np.fft.rfft2(_around(t, size, sides), size) for t in tables]
        k, at = rows["__k"].to_numpy(), tuple(p[here] for p in place)
        parts = []
        for cls in classes:
            found = np.zeros((len(own), len(tables)))
            if (k == cls).any():
                field = np.zeros(size)
                field[place[0][k == cls], place[1][k == cls]] = 1.0
                f = np.fft.rfft2(field)
                for j, s in enumerate(spectra[size]):
                    found[:, j] = np.fft.irfft2(f * s, size)[at]
            part = own.copy()
            part["class_id"], part["found"] = cls, pd.Series(list(found), part.index, object)
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    made = x.groupBy(*by, "br", "bc").applyInPandas(run, _kinds(x, [*by, *CELL]) + "class_id int, found array<double>")
    listed = F.arrays_zip(F.array(*(F.lit(float(h)) for h in half_lives)).alias("half_life"), F.col("found").alias("value"))
    return made.withColumn("__x", F.explode(listed)).select(*by, F.col("__x.half_life").alias("half_life"), "class_id", *CELL, F.col("__x.value").alias("value"))


def blur_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_blur(cells: DataFrame, values: Sequence[str], sigma: float, n_rows: int, n_cols: int, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Blurred columns, sparse: only cells that are not 0 are sent, and only cells in which some result is not 0 come back. Edges reflect (the edge cell is repeated); sigma's radius must not exceed the grid."""
    w = blur_weights(sigma)
    radius = len(w) // 2
    if radius > min(n_rows, n_cols):
        raise ValueError("the blur reaches beyond one reflection")
    block = max(radius, min(block, max(n_rows, n_cols)))
    some = cells.where(F.greatest(*(F.abs(F.coalesce(F.col(v).cast("double"), F.lit(0.0))) for v in values), F.lit(0.0)) > 0)
    x = in_blocks(some.select(*by, *CELL, *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values)), values, radius, block, by)
    side = block + 2 * radius

    def source(start: int, n: int) -> np.ndarray:
        """Which place of the field each place takes its value from."""
        i = np.arange(start, start + side)
        i = np.where(i < 0, -1 - i, np.where(i >= n, 2 * n - 1 - i, i)) - start
        return np.where((i >= 0) & (i < side), i, side)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[-2]) * block - radius, int(key[-1]) * block - radius
        at = (rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0)
        rs, cs = source(r0, n_rows), source(c0, n_cols)
        made = []
        for v in values:
            field = np.zeros((side + 1, side + 1))  # the last row and column stand for places off the grid
            field[at] = rows[v].to_numpy()
            field = field[rs][:, cs]
            down = sum(w[k] * field[k : k + block] for k in range(len(w)))
            made.append(sum(w[k] * down[:, k : k + block] for k in range(len(w))))
        height, width = min(block, n_rows - r0 - radius), min(block, n_cols - c0 - radius)
        if height <= 0 or width <= 0 or r0 + radius < 0 or c0 + radius < 0:
            r = c = np.zeros(0, int)
        else:
            r, c = np.nonzero(np.any([m[:height, :width] != 0 for m in made], axis=0))
        head = {b: [key[i]] * len(r) for i, b in enumerate(by)}
        return pd.DataFrame(head | {"r": r + r0 + radius, "c": c + c0 + radius} | {v: m[r, c] for v, m in zip(values, made, strict=True)})

    return x.groupBy(*by, "br", "bc").applyInPandas(run, _kinds(x, [*by, *CELL]) + ", ".join(f"`{v}` double" for v in values))


def _row_pass(g: np.ndarray) -> np.ndarray:
    """Of column distances (rows x columns, infinite where a column has no site), squared distances within each row.

    A cell's nearest site lies within its column distance, so few steps to both sides settle most cells;
    rows that are not settled by then go by the lower envelope of parabolas.
    """
    f = g * g
    d = f.copy()
    n = g.shape[1]
    live = np.flatnonzero(np.isfinite(f).any(axis=1))
    near = far = np.zeros((0, n))
    for step in range(1, min(STEPS, n - 1) + 1):
        if step % 16 == 1:  # rows that are settled are left alone
            if step > 1:
                d[live] = near
            live = live[(d[live] > step * step).any(axis=1)]
            near, far = d[live], f[live]
            if not len(live):
                return d
        np.minimum(near[:, step:], far[:, :-step] + step * step, out=near[:, step:])
        np.minimum(near[:, :-step], far[:, step:] + step * step, out=near[:, :-step])
    d[live] = near
    if n - 1 <= STEPS:
        return d
    x = np.arange(n, dtype=float)
    for i in np.flatnonzero((d > STEPS * STEPS).any(axis=1) & np.isfinite(f).any(axis=1)):
        ok = np.flatnonzero(np.isfinite(f[i])).tolist()
        height = (f[i] + x * x).tolist()
        hull, edges = [ok[0]], [-np.inf]
        for q in ok[1:]:
            while True:
                p = hull[-1]
                cross = (height[q] - height[p]) / (2 * (q - p))
                if cross > edges[-1]:
                    break
                hull.pop()
                edges.pop()
            hull.append(q)
            edges.append(cross)
        near = np.array(hull)[np.searchsorted(edges, x, side="left").clip(1) - 1]
        d[i] = (x - near) ** 2 + f[i][near]
    return d


def distances_sq(cells: DataFrame, sites: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c, sites...): for each name and boolean column of ``sites``, the squared distance of each cell to the nearest cell where it is true; NULL where there is none.

    First along columns with windows, then along rows, a band of rows in a task.
    """
    names = list(sites)
    w = W.partitionBy(*by, "c").rowsBetween(W.unboundedPreceding, 0)
    x = cells.select(*by, *CELL, *(F.when(F.col(s).cast("boolean"), F.col("r")).alias(n) for n, s in sites.items()))
    x = x.withColumns({f"__above_{n}": F.last(n, ignorenulls=True).over(w.orderBy("r")) for n in names})
    x = x.withColumns({f"__below_{n}": F.last(n, ignorenulls=True).over(w.orderBy(F.desc("r"))) for n in names})
    x = x.select(*by, *CELL, *(F.least(F.col("r") - F.col(f"__above_{n}"), F.col(f"__below_{n}") - F.col("r")).cast("double").alias(n) for n in names), F.floor(F.col("r") / BAND).cast("int").alias("__band"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = rows[[*by, *CELL]].copy()
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        r, c = r - r.min(), c - c.min()
        for n in names:
            g = np.full((r.max() + 1, c.max() + 1), np.inf)
            g[r, c] = rows[n].fillna(np.inf).to_numpy()
            made[n] = _row_pass(g)[r, c]
        return made

    d = x.groupBy(*by, "__band").applyInPandas(run, _kinds(x, [*by, *CELL]) + ", ".join(f"{n} double" for n in names))
    return d.select(*by, *CELL, *(F.when(F.col(n) < float("inf"), F.col(n)).alias(n) for n in names))


def nearest_sq(sites: DataFrame, targets: DataFrame, by: Sequence[str] = (), out: str = "d2") -> DataFrame:
    """(by..., r, c, out): the squared distance of each of ``targets`` (by..., r, c) to the nearest of ``sites`` (by..., r, c); NULL where there is none.

    As ``distances_sq``, from the cells of interest alone: a band of rows gets its own sites and, for each column that has sites, the last one before
    the band and the first one behind it, which the sites' own bands tell. So for every 32 cells of a band with targets one row moves, not every cell.
    """
    band = F.floor(F.col("r") / BAND).cast("int").alias("band")
    s, t = sites.select(*by, *CELL, band).distinct(), targets.select(*by, *CELL, band).distinct()
    ends = stored(s.groupBy(*by, "c", "band").agg(F.min("r").alias("low"), F.max("r").alias("high")))
    bands = t.select(*by, "band").distinct()
    columns = ends.select(*by, "c").distinct()
    none = F.lit(None).cast("int")
    asked = (columns.join(bands, list(by)) if by else columns.crossJoin(bands)).select(*by, "c", "band", none.alias("low"), none.alias("high"), F.lit(True).alias("asked"))
    x = asked.unionByName(ends.withColumn("asked", F.lit(False)))
    # Both ways from the first band on: a frame that ends with the last row is made anew for each row.
    before = lambda order: W.partitionBy(*by, "c").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    x = x.withColumns({"above": F.last("high", True).over(before(F.asc("band"))), "below": F.last("low", True).over(before(F.desc("band")))}).where("asked")
    far = x.select(*by, "band", none.alias("r"), "c", F.lit(False).alias("target"), "above", "below")
    own = s.join(bands, [*by, "band"], "left_semi").select(*by, "band", *CELL, F.lit(False).alias("target"), none.alias("above"), none.alias("below"))
    rows = t.select(*by, "band", *CELL, F.lit(True).alias("target"), none.alias("above"), none.alias("below")).unionByName(own).unionByName(far)

    def few(rows: pd.DataFrame) -> pd.DataFrame:
        bands, b = np.unique(rows["band"].to_numpy(), return_inverse=True)
        c0 = int(rows["c"].min())
        c = rows["c"].to_numpy() - c0
        g = np.full((len(bands), BAND, int(c.max()) + 1), np.inf)
        at = (bands[:, None] * BAND + np.arange(BAND)).astype(float)
        for side in ("above", "below"):
            some = rows[side].notna().to_numpy()
            g[b[some], :, c[some]] = np.minimum(g[b[some], :, c[some]], np.abs(at[b[some]] - rows[side].to_numpy(float)[some][:, None]))
        mine = rows["r"].notna().to_numpy()
        here, wanted = mine & ~rows["target"].to_numpy(bool), mine & rows["target"].to_numpy(bool)
        r = np.where(mine, rows["r"].to_numpy(float), 0).astype(int) - bands[b] * BAND
        g[b[here], r[here], c[here]] = 0.0
        for k in range(1, BAND):  # within the band, down and up
            g[:, k] = np.minimum(g[:, k], g[:, k - 1] + 1)
            g[:, -1 - k] = np.minimum(g[:, -1 - k], g[:, -k] + 1)
        made = rows.loc[wanted, [*by, *CELL]].copy()
        made["r"] = made["r"].astype(int)
        lines, line = np.unique(b[wanted] * BAND + r[wanted], return_inverse=True)  # rows without a target are not passed
        made[out] = _row_pass(g.reshape(-1, g.shape[2])[lines])[line, c[wanted]]
        return made

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["c"].max()) - int(rows["c"].min()) + 1
        part = (rows["band"] % BANDS) // max(1, HELD // (BAND * width))
        return pd.concat([few(x) for _, x in rows.groupby(part.to_numpy())], ignore_index=True)

    d = rows.groupBy(*by, F.floor(F.col("band") / BANDS).alias("bands")).applyInPandas(run, _kinds(t, [*by, *CELL]) + f"{out} double")
    return d.withColumn(out, F.when(F.col(out) < float("inf"), F.col(out)))


def distance_transform_sq(cells: DataFrame, site: str, by: Sequence[str] = (), out: str = "d2") -> DataFrame:
    """``distances_sq`` for one column."""
    return distances_sq(cells, {out: site}, by)


def distance_from_threshold(cells: DataFrame, value: str, sigma: float, threshold: float, decay: float, n_rows: int, n_cols: int) -> DataFrame:
    """(r, c, metric): how far a cell is from where the blurred layer reaches ``threshold``.

    Inside, the blur itself; outside, 1 / ((1 + decay) ** distance + 1 / threshold - 1), distance being that to
    the nearest cell inside. Near 0 and 1 it is 0 and 1; without any cell inside it is 0.
    """
    blurred = gaussian_blur(cells, [value], sigma, n_rows, n_cols).withColumnRenamed(value, "blur")
    x = cells.select(*CELL).join(blurred, CELL, "left").withColumn("blur", F.coalesce("blur", F.lit(0.0))).withColumn("inside", F.col("blur") >= threshold)
    d = distance_transform_sq(x, "inside")
    far = 1 / (F.pow(F.lit(1.0 + decay), F.sqrt("d2")) + F.lit(1.0 / threshold - 1.0))
    away = F.when(F.col("inside"), 1 - F.col("blur")).otherwise(1 - far)
    away = F.when(away > 0.9999999, 1.0).when(away < 1e-7, 0.0).otherwise(away)
    return x.join(d, CELL).select(*CELL, F.when(F.col("d2").isNull(), 0.0).otherwise(1 - away).alias("metric"))


def gaussian_kernel_cdf(spark: SparkSession, size: int, n_sigma: float) -> DataFrame:
    """(i, j, w): square roots of products of normal probabilities of equal steps, summing to 1. Made on the driver; ``size`` is small."""
    x = np.linspace(-n_sigma - (2 * n_sigma + 1.0) / size / 2, n_sigma + (2 * n_sigma + 1.0) / size / 2, size + 1)
    p = np.diff([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    return vector_to_kernel(spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "i int, v double"))


def vector_to_kernel(vector: DataFrame) -> DataFrame:
    """(i, j, w) = sqrt(v_i * v_j) / total of a vector (i, v) that is a kernel's side, so small."""
    other = vector.select(F.col("i").alias("j"), F.col("v").alias("u"))
    x = vector.crossJoin(other).select("i", "j", F.sqrt(F.col("v") * F.col("u")).alias("w"))
    return x.crossJoin(x.agg(F.sum("w").alias("t"))).select("i", "j", (F.col("w") / F.col("t")).alias("w"))
