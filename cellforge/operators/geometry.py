"""Polygons from tables: well-known binary, scanline rasterising, exact intersection.

A geometry becomes rows of edges (id, part, ring, seq, x0, y0, x1, y1), so that no task needs to hold a polygon of many
vertices whole: rasterising sorts an edge's crossings within a grid row, and intersecting adds up signed
areas of pairs of edges. Holes need no mark: a place is inside if it is so by an odd number of rings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellforge.storage import stored

EDGES = "part int, ring int, seq int, x0 double, y0 double, x1 double, y1 double"
# Kinds of geometries in well-known binary.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = 1, 2, 3, 4, 5, 6, 7
#: Side, in cells or units, of the squares by which polygons meet.
SQUARE = 64
#: Edges that one batch of a task holds, or those of one polygon.
ROWS = 1 << 15


class _Reader:
    """Reads well-known binary, plain or extended; heights and measures are passed over."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, order: str, kind: str, n: int = 1) -> tuple:
        out = struct.unpack_from(f"{order}{n}{kind}", self.data, self.at)
        self.at += struct.calcsize(f"{order}{n}{kind}")
        return out

    def head(self) -> tuple[str, int, int]:
        """(byte order, kind, numbers a point has)."""
        order = "<" if self.take("=", "B")[0] else ">"
        (code,) = self.take(order, "I")
        if code & 0x20000000:  # a reference system follows
            self.take(order, "I")
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        return order, code % 1000, size + (0, 1, 1, 2)[code // 1000 % 4]

    def polygons(self) -> Iterator[list[list[tuple[float, float]]]]:
        """The rings of each polygon; other kinds have none."""
        order, kind, size = self.head()
        if kind == POLYGON:
            rings = []
            for _ in range(self.take(order, "I")[0]):
                n = self.take(order, "I")[0]
                v = self.take(order, "d", n * size)
                rings.append(list(zip(v[::size], v[1::size], strict=True)))
            yield rings
        elif kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION):
            for _ in range(self.take(order, "I")[0]):
                yield from self.polygons()
        else:
            n = 1 if kind == POINT else self.take(order, "I")[0]
            self.take(order, "d", n * size)


def _edges(batches: Iterator[pa.RecordBatch], wkb: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(wkb)
        names = [n for n in batch.schema.names if n != wkb]
        own, rows = [], []
        for i, data in enumerate(batch.column(at)):
            for part, rings in enumerate(_Reader(data.as_py()).polygons() if data.is_valid and len(data.as_buffer()) else ()):
                for ring, points in enumerate(rings):
                    closed = points if len(points) < 2 or points[0] == points[-1] else [*points, points[0]]
                    rows += [(part, ring, k, *a, *b) for k, (a, b) in enumerate(zip(closed, closed[1:], strict=False))]
            own += [i] * (len(rows) - len(own))
            if rows and (len(rows) >= ROWS or i + 1 == len(batch)):
                kept = [batch.column(n).take(pa.array(own)) for n in names]
                made = [pa.array(c, pa.int32() if k < 3 else pa.float64()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*names, *(x.split()[0] for x in EDGES.split(", "))])
                own, rows = [], []


def edges_of_wkb(geometries: DataFrame, wkb: str = "wkb") -> DataFrame:
    """The columns of ``geometries`` but ``wkb``, and an edge of its polygons (part, ring, seq, x0, y0, x1, y1) a row.

    Multipolygons and collections are taken apart; points and lines, nulls and empty geometries have no edges. An open ring is closed. Both byte orders are read, as are
    heights, measures and reference systems, which are passed over.
    """
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in geometries.schema if f.name != wkb]
    return geometries.mapInArrow(lambda batches: _edges(batches, wkb), ", ".join([*keep, EDGES]))


def edges_of_rings(rings: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """As ``edges_of_wkb``, from rows with one ring each, arrays ``x`` and ``y``, closed or not. Other columns stay; a ring of less than two points has no edges."""
    n = F.size(x)
    at = lambda v, k: F.get(v, k)
    keep = [c for c in rings.columns if c not in (x, y)]
    seq = F.col("seq")
    after = F.when(seq + 1 < n, seq + 1).otherwise(0)
    e = rings.where(n >= 2).withColumn("seq", F.explode(F.sequence(F.lit(0), n - 1)))
    e = e.select(*keep, "seq", at(x, seq).alias("x0"), at(y, seq).alias("y0"), at(x, after).alias("x1"), at(y, after).alias("y1"))
    return e.where("x0 <> x1 OR y0 <> y1")


def _wkb(parts: pa.Array) -> pa.Array:
    def one(polygons) -> bytes | None:
        if polygons is None:
            return None
        out = [struct.pack("<BII", 1, MULTI_POLYGON, len(polygons))]
        for rings in polygons:
            out.append(struct.pack("<BII", 1, POLYGON, len(rings)))
            for ring in rings:
                flat = [v for p in ring for v in (p["x"], p["y"])]
                out.append(struct.pack(f"<I{len(flat)}d", len(ring), *flat))
        return b"".join(out)

    return pa.array([one(p) for p in parts.to_pylist()], pa.binary())


def wkb_of(polygons: Column) -> Column:
    """Well-known binary of a column of polygons as arrays of rings, rings being arrays of (x, y)."""
    return F.arrow_udf(_wkb, "binary")(polygons)


def scan_runs(edges: DataFrame, n_rows: int, n_cols: int, by: list[str], all_touched: bool = False) -> DataFrame:
    """(by..., r, c0, c1): runs of cells of a grid whose centres (c + 0.5, r + 0.5) lie in the polygons of ``edges``, from c0 to c1.

    An edge crosses the centre lines of the rows between its ends; the crossings of a row are sorted,
    and the cells between the first and the second, the third and the fourth and so on are inside. The cost is one row for
    each crossing and each run, whatever the number of cells. A centre on an edge belongs to the polygon to its right or below.
    With ``all_touched`` also the cells that an edge passes through; these runs may overlap the others.
    """
    clipped = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n))
    first = F.ceil(F.least("y0", "y1") - 0.5).cast("long")  # centres r + 0.5 with low <= r + 0.5 < high
    last = F.ceil(F.greatest("y0", "y1") - 0.5).cast("long") - 1
    e = edges.withColumns({"__a": F.greatest(first, F.lit(0)), "__b": F.least(last, F.lit(n_rows - 1))}).where("__a <= __b")
    e = e.withColumn("r", F.explode(F.sequence("__a", "__b")))
    e = e.select(*by, F.col("r").cast("int").alias("r"), (F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = W.partitionBy(*by, "r").orderBy("x")
    e = e.withColumns({"k": F.row_number().over(w), "end": F.lead("x").over(w)}).where("k % 2 = 1")
    c0, c1 = F.ceil(F.col("x") - 0.5), F.ceil(F.col("end") - 0.5) - 1  # centres with x <= c + 0.5 < end
    runs = e.select(*by, "r", clipped(c0, n_cols).cast("int").alias("c0"), F.least(c1, F.lit(n_cols - 1)).cast("int").alias("c1")).where("c0 <= c1")
    return runs.unionByName(touched_runs(edges, n_rows, n_cols, by)) if all_touched else runs


def touched_runs(edges: DataFrame, n_rows: int, n_cols: int, by: list[str]) -> DataFrame:
    """(by..., r, c0, c1): the cells whose inside an edge passes through, row by row; along a border is not through."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    flat = F.col("y0") == F.col("y1")
    first = F.floor(low).cast("long")
    last = F.when(flat, F.when(F.floor(low) == low, first - 1).otherwise(first)).otherwise(F.ceil(high).cast("long") - 1)
    e = edges.withColumns({"__a": F.greatest(first, F.lit(0)), "__b": F.least(last, F.lit(n_rows - 1))}).where("__a <= __b").withColumn("r", F.explode(F.sequence("__a", "__b")))
    x_at = lambda y: F.when(flat, F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    xa, xb = x_at(F.greatest(F.col("r").cast("double"), low)), F.when(flat, F.col("x1")).otherwise(x_at(F.least(F.col("r") + 1.0, high)))
    e = e.withColumns({"xl": F.least(xa, xb), "xh": F.greatest(xa, xb)})
    upright = F.col("xl") == F.col("xh")
    c0 = F.floor("xl")
    c1 = F.when(upright, F.when(F.floor("xl") == F.col("xl"), c0 - 1).otherwise(c0)).otherwise(F.ceil("xh") - 1)
    return e.select(*by, F.col("r").cast("int").alias("r"), F.greatest(c0, F.lit(0)).cast("int").alias("c0"), F.least(c1, F.lit(n_cols - 1)).cast("int").alias("c1")).where("c0 <= c1")


def rasterize_scanline(edges: DataFrame, n_rows: int, n_cols: int, by: list[str], all_touched: bool = False) -> DataFrame:
    """(by..., r, c): the cells of ``scan_runs``, each once. Runs are sent on, not cells, until the end."""
    cells = scan_runs(edges, n_rows, n_cols, by, all_touched).withColumn("c", F.explode(F.sequence("c0", "c1"))).select(*by, "r", "c")
    return cells.distinct() if all_touched else cells


def id_raster(edges: DataFrame, n_rows: int, n_cols: int, id_column: str = "id") -> DataFrame:
    """(r, c, id): one polygon for each covered cell, the one with the largest id where several lie."""
    return rasterize_scanline(edges, n_rows, n_cols, [id_column]).groupBy("r", "c").agg(F.max(id_column).alias(id_column))


def areas(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., area): of polygons whose rings don't cross; holes count off whichever way they run."""
    ring = edges.groupBy(*by, "part", "ring").agg(F.abs(F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2)).alias("a"))
    return ring.groupBy(*by).agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def in_strips(edges: DataFrame, height: float) -> DataFrame:
    """Edges cut at horizontal lines ``height`` apart, with ``strip``; level edges go, as no area depends on them."""
    e = edges.where("y0 <> y1").withColumns({"low": F.least("y0", "y1"), "high": F.greatest("y0", "y1")})
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("low") / height).cast("long"), (F.ceil(F.col("high") / height) - 1).cast("long"))))
    x_at = lambda y: F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    a, b = F.greatest("low", F.col("strip") * float(height)), F.least("high", (F.col("strip") + 1) * float(height))
    e = e.withColumns({"__a": a, "__b": b})
    return e.withColumns({"xa": x_at(F.col("__a")), "xb": x_at(F.col("__b"))}).withColumnsRenamed({"__a": "ya", "__b": "yb"}).where("ya < yb")


def _levels(x: pd.DataFrame) -> list[float]:
    """Heights between which no two edges cross."""
    xa, xb, ya, yb = (x[n].to_numpy(float) for n in ("xa", "xb", "ya", "yb"))
    slope = (xb - xa) / (yb - ya)
    found = [ya, yb]
    for i in range(0, len(x), 256):  # pairs of edges, a block of rows at a time
        j = slice(i, i + 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = ((xa[:, None] - slope[:, None] * ya[:, None]) - (xa - slope * ya)[None, j]) / (slope[None, j] - slope[:, None])
            hit = (y > np.maximum(ya[:, None], ya[None, j])) & (y < np.minimum(yb[:, None], yb[None, j]))
        found.append(y[hit])
    return np.unique(np.concatenate(found)).tolist()


PIECE = "y0 double, y1 double, left0 double, right0 double, left1 double, right1 double"


def _common(x: pd.DataFrame) -> list[tuple]:
    """Trapezoids (y0, y1, left and right at y0, left and right at y1) that both sides cover; ``side`` is 0 or 1."""
    xa, xb, ya, yb = (x[n].to_numpy(float) for n in ("xa", "xb", "ya", "yb"))
    side = x["side"].to_numpy()
    slope = (xb - xa) / (yb - ya)
    out = []
    levels = _levels(x)
    order = np.argsort(ya, kind="stable")
    starts = ya[order]
    active, at = np.zeros(0, int), 0
    for y0, y1 in zip(levels, levels[1:], strict=False):
        until = int(np.searchsorted(starts, y0, side="right"))
        active = np.concatenate([active, order[at:until]])
        at = until
        active = active[yb[active] >= y1]
        middle = (y0 + y1) / 2
        mine = active[np.argsort(xa[active] + (middle - ya[active]) * slope[active], kind="stable")]
        odd = [np.cumsum(side[mine] == s) % 2 == 1 for s in (0, 1)]
        for k in np.flatnonzero(odd[0] & odd[1]):
            a, b = mine[k], mine[k + 1]
            left, right = ((xa[e] + (y0 - ya[e]) * slope[e], xa[e] + (y1 - ya[e]) * slope[e]) for e in (a, b))
            out.append((y0, y1, float(left[0]), float(right[0]), float(left[1]), float(right[1])))
    return out


#: Pairs of edges, or of slabs and edges, that a task holds at a time; edges of a pair of polygons beyond which it is taken alone.
AT_ONCE, ALONE = 1 << 20, 1024


def _within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): each of the ``sizes`` places from each of ``starts`` on."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _chunks(costs: np.ndarray) -> list[slice]:
    """Stretches whose costs add up to about ``AT_ONCE`` at most."""
    ends = np.flatnonzero(np.diff((np.cumsum(costs) - costs) // AT_ONCE)) + 1
    edges = [0, *ends.tolist(), len(costs)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _common_of_many(x: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, pieces): ``_common`` of every group of rows at once; ``group`` rises."""
    xa, xb, ya, yb = (x[n].to_numpy(float) for n in ("xa", "xb", "ya", "yb"))
    order = np.lexsort((ya, group))
    xa, xb, ya, yb, side, group = (v[order] for v in (xa, xb, ya, yb, x["side"].to_numpy(), group))
    slope = (xb - xa) / (yb - ya)
    base = xa - slope * ya
    first, size = (v[1:] for v in np.unique(np.concatenate([[-1], group]), return_index=True, return_counts=True)[1:])
    first = first - 1
    found, pieces = [], []
    for part in _chunks(size * size):
        rows = slice(first[part][0], first[part][-1] + size[part][-1])
        many = np.repeat(size[part], size[part])
        i, j = _within(np.repeat(first[part], size[part]), many)
        i = i + rows.start
        i, j = i[i < j], j[i < j]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base[i] - base[j]) / (slope[j] - slope[i])
            hit = (y > np.maximum(ya[i], ya[j])) & (y < np.minimum(yb[i], yb[j]))
        g, level = np.concatenate([group[rows], group[rows], group[i[hit]]]), np.concatenate([ya[rows], yb[rows], y[hit]])
        by = np.lexsort((level, g))
        g, level = g[by], level[by]
        slab = np.flatnonzero((g[1:] == g[:-1]) & (level[1:] > level[:-1]))
        g, y0, y1 = g[slab], level[slab], level[slab + 1]
        at = np.searchsorted(group[first], g)
        for some in _chunks(size[at]):
            k, e = _within(first[at[some]], size[at[some]])
            k = k + some.start
            on = (ya[e] <= y0[k]) & (yb[e] >= y1[k])
            k, e = k[on], e[on]
            by = np.lexsort((xa[e] + ((y0[k] + y1[k]) / 2 - ya[e]) * slope[e], k))
            k, e = k[by], e[by]
            start = np.searchsorted(k, k)
            inside = np.ones(len(k), bool)
            for s in (0, 1):
                seen = np.concatenate([[0], np.cumsum(side[e] == s)])
                inside &= (seen[1:] - seen[start]) % 2 == 1
            a = np.flatnonzero(inside[:-1] & (k[1:] == k[:-1]))
            low, high, ea, eb = y0[k[a]], y1[k[a]], e[a], e[a + 1]
            at_y = lambda v, y: xa[v] + (y - ya[v]) * slope[v]
            found.append(g[k[a]])
            pieces.append(np.column_stack([low, high, at_y(ea, low), at_y(eb, low), at_y(ea, high), at_y(eb, high)]))
    return (np.concatenate(found), np.concatenate(pieces)) if found else (np.zeros(0, int), np.zeros((0, 6)))


def classes_of_shapes(edges: DataFrame, by: str) -> DataFrame:
    """(by, rep): each polygon with the least id of those that have the same edges. Stored."""
    points = F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).cast("string")
    shapes = edges.where(F.col(by).isNotNull()).groupBy(by).agg(F.sha2(points, 256).alias("__shape"))
    return stored(shapes.join(shapes.groupBy("__shape").agg(F.min(by).alias("rep")), "__shape").select(by, "rep"))


def _met(left: DataFrame, right: DataFrame, left_id: str, right_id: str, height: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces (__id0, __id1, y0...) of the classes of equal polygons, and each side's (id, rep)."""
    left, right = (stored(e.select(i, "x0", "y0", "x1", "y1")) for e, i in ((left, left_id), (right, right_id)))
    known = [classes_of_shapes(e, i) for e, i in ((left, left_id), (right, right_id))]
    sides = []
    for k, (e, i) in enumerate(((left, left_id), (right, right_id))):
        reps = known[k].where(F.col(i) == F.col("rep")).select(i)
        sides.append(stored(in_strips(e.join(reps, i, "left_semi").withColumnRenamed(i, f"__id{k}"), height).select(f"__id{k}", "strip", "xa", "ya", "xb", "yb")))
    kinds = [e.schema[i].dataType.simpleString() for e, i in ((left, left_id), (right, right_id))]
    spans = []
    for k, e in enumerate(sides):
        reach = e.groupBy(f"__id{k}", "strip").agg(F.min(F.least("xa", "xb")).alias("x0"), F.max(F.greatest("xa", "xb")).alias("x1"))
        first, last = F.floor(F.col("x0") / height).cast("long"), F.floor(F.col("x1") / height).cast("long")
        spans.append(reach.select(f"__id{k}", "strip", first.alias(f"first{k}"), F.col("x0").alias(f"from{k}"), F.col("x1").alias(f"to{k}"), F.explode(F.sequence(first, last)).alias("square")))
    met = spans[0].join(spans[1], ["strip", "square"]).where("square = greatest(first0, first1) AND from0 < to1 AND from1 < to0").select("__id0", "__id1", "strip")
    n = _tasks(left)
    met = stored(met.repartition(n, "__id0", "__id1", "strip"))  # few bytes, much work
    parts = [met.join(e, [f"__id{k}", "strip"]).select("__id0", "__id1", "strip", F.lit(k).alias("side"), "xa", "ya", "xb", "yb") for k, e in enumerate(sides)]
    key, names = ["__id0", "__id1", "strip"], [x.split()[0] for x in PIECE.split(", ")]

    def cut(x: pd.DataFrame) -> pd.DataFrame:
        group = (x[key] != x[key].shift()).any(axis=1).to_numpy().cumsum() - 1
        heads = x[key[:2]].to_numpy(object)[np.flatnonzero(np.diff(group, prepend=-1))]
        large = np.bincount(group)[group] > ALONE
        g, made = _common_of_many(x[~large], group[~large])
        for one in np.unique(group[large]):
            alone = np.array(_common(x[group == one]), float).reshape(-1, len(names))
            g, made = np.concatenate([g, np.full(len(alone), one)]), np.concatenate([made, alone])
        out = pd.DataFrame(made, columns=names)
        for i in (0, 1):
            out[key[i]] = pd.Series(heads[g, i] if len(g) else [], dtype=object)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in batches:
            if not len(x):
                continue
            last = (x[key] == x[key].iloc[-1]).all(axis=1).to_numpy()
            begin = len(x) - int(np.argmin(last[::-1])) if not last.all() else 0  # of the last pair, which may go on
            if begin or (held and not (held[-1][key].iloc[-1] == x[key].iloc[0]).all()):
                yield cut(pd.concat([*held, x.iloc[:begin]], ignore_index=True))
                held = []
            held.append(x.iloc[begin:])
        if held:
            yield cut(pd.concat(held, ignore_index=True))

    rows = parts[0].unionByName(parts[1]).repartition(n, *key).sortWithinPartitions(*key)
    return rows.mapInPandas(run, f"{PIECE}, __id0 {kinds[0]}, __id1 {kinds[1]}"), known


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _to_all(found: DataFrame, known: list[DataFrame], left_id: str, right_id: str) -> DataFrame:
    """Rows of classes of equal polygons (__id0, __id1, ...) repeated for all their members."""
    out = found
    for k, (e, i) in enumerate(zip(known, (left_id, right_id), strict=True)):
        out = out.join(e.select(F.col(i).alias(f"__own{k}"), F.col("rep").alias(f"__id{k}")), f"__id{k}").drop(f"__id{k}")
        if not k:
            out = out.repartition(_tasks(found), "__own0", "__id1")  # each row may stand for many
    return out.select(F.col("__own0").alias(left_id), F.col("__own1").alias(right_id), *(n for n in found.columns if n not in ("__id0", "__id1")))


def intersections(left: DataFrame, right: DataFrame, left_id: str, right_id: str, height: float = SQUARE) -> DataFrame:
    """(left_id, right_id, y0, y1, left0, right0, left1, right1): the intersection of every two polygons of two tables of edges, as trapezoids between the heights y0 and y1, each reported once.

    Polygons may be concave, have holes and several parts, and cross themselves; what is inside by an odd number of rings counts. Two
    polygons meet where they share a square: a polygon covers, in a strip, the squares between its outermost edges, and a pair that
    shares several is kept in the first of them alone. Polygons that only touch have no piece. Polygons with the same edges are cut once, and the pieces repeated.
    """
    found, known = _met(left, right, left_id, right_id, height)
    return _to_all(found, known, left_id, right_id)


def shared_areas(left: DataFrame, right: DataFrame, left_id: str, right_id: str, height: float = SQUARE) -> DataFrame:
    """(left_id, right_id, area): ``intersection_areas`` of ``intersections``; areas are added up before they are repeated for equal polygons."""
    found, known = _met(left, right, left_id, right_id, height)
    return _to_all(intersection_areas(found, ["__id0", "__id1"]), known, left_id, right_id)


def intersection_areas(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by..., area) of the pieces of ``intersections``."""
    area = (F.col("y1") - F.col("y0")) * (F.col("right0") - F.col("left0") + F.col("right1") - F.col("left1")) / 2
    return pieces.groupBy(*by).agg(F.sum(area).alias("area")).where("area > 0")
