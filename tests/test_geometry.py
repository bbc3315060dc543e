"""Polygons against brute force: even-odd tests of cells, signed triangles."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.operators import geometry


def star(rng, cx, cy, n, low, high, turn=0.0):
    a = (np.arange(n) + rng.uniform(0, 0.8, n)) * 2 * math.pi / n + turn  # without wide gaps, so rings stay apart
    r = rng.uniform(low, high, n)
    return list(zip((cx + r * np.cos(a)).tolist(), (cy + r * np.sin(a)).tolist(), strict=True))


def wkb(polygons, order="<", extended=False):
    """Multipolygon of [[ring, ...], ...], each ring closed."""
    code = 6 | (0xA0000000 if extended else 0)
    out = struct.pack(f"{order}BI", order == "<", code) + (struct.pack(f"{order}I", 4326) if extended else b"") + struct.pack(f"{order}I", len(polygons))
    for rings in polygons:
        out += struct.pack(f"{order}BII", order == "<", 3 | (0x80000000 if extended else 0), len(rings))
        for ring in rings:
            points = [*ring, ring[0]]
            out += struct.pack(f"{order}I", len(points)) + b"".join(struct.pack(f"{order}{2 + extended}d", *p, *([7.0] if extended else [])) for p in points)
    return out


def odd(px, py, polygons):
    n = 0
    for rings in polygons:
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if (y0 <= py) != (y1 <= py) and x0 + (py - y0) * (x1 - x0) / (y1 - y0) <= px:
                    n += 1
    return n % 2 == 1


def shapes(rng, n=12):
    out = {}
    for k in range(n):
        cx, cy = rng.uniform(0, 60), rng.uniform(0, 40)
        outer = star(rng, cx, cy, int(rng.integers(9, 30)), 7, 15)
        hole = star(rng, cx, cy, 7, 1, 3)
        out[k] = [[outer, hole]] if k % 3 else [[outer, hole], [star(rng, cx + 30, cy, 6, 2, 4)]]
    return out


def test_wkb_and_scanline_equal_even_odd(spark):
    given = shapes(np.random.default_rng(1))
    rows = [(k, wkb(p, "<>"[k % 2], k % 4 == 3), "x") for k, p in given.items()]
    rows += [(100, None, "x"), (101, struct.pack("<BII", 1, 6, 0), "x"), (102, struct.pack("<BIdd", 1, 1, 1.0, 2.0), "x"), (103, struct.pack("<BII", 1, 7, 1) + wkb([[[(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)]]]), "x")]
    edges = geometry.edges_of_wkb(spark.createDataFrame(rows, "id int, wkb binary, name string"))
    assert edges.columns[:2] == ["id", "name"]
    given[103] = [[[(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)]]]
    got = {(r["id"], r["r"], r["c"]) for r in geometry.rasterize_scanline(edges, 40, 60, ["id"]).collect()}
    want = {(k, r, c) for k, p in given.items() for r in range(40) for c in range(60) if odd(c + 0.5, r + 0.5, p)}
    assert got == want and len(want) > 1000
    one = {(r["r"], r["c"]): r["id"] for r in geometry.id_raster(edges, 40, 60).collect()}
    assert one == {(r, c): max(k for k, a, b in want if (a, b) == (r, c)) for _, r, c in want}
    area = {r["id"]: r["area"] for r in geometry.areas(edges, ["id"]).collect()}
    assert abs(area[103] - 12) < 1e-9


def test_ring_edges_and_touched_cells(spark):
    rng = np.random.default_rng(2)
    rings = {k: star(rng, rng.uniform(5, 30), rng.uniform(5, 20), 9, 2, 9) for k in range(6)}
    rings[10] = [(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0), (2.0, 2.0)]  # closed, along the borders of cells
    rings[11] = [(1.5, 7.5), (9.5, 7.5)]
    df = spark.createDataFrame([(k, [p[0] for p in v], [p[1] for p in v]) for k, v in rings.items()] + [(12, [1.0], [1.0]), (13, None, None)], "id int, x array<double>, y array<double>")
    edges = geometry.edges_of_rings(df)
    got = {(r["id"], r["r"], r["c"]) for r in geometry.rasterize_scanline(edges, 25, 35, ["id"], all_touched=True).collect()}

    def through(px, py, ring):
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            dx, dy = x1 - x0, y1 - y0
            if (dx or dy) and min(x0, x1) < px + 0.5 and max(x0, x1) > px - 0.5 and min(y0, y1) < py + 0.5 and max(y0, y1) > py - 0.5 and abs(dx * (py - y0) - dy * (px - x0)) < 0.5 * (abs(dx) + abs(dy)):
                return True
        return False

    want = {(k, r, c) for k, v in rings.items() for r in range(25) for c in range(35) if odd(c + 0.5, r + 0.5, [[v]]) or through(c + 0.5, r + 0.5, v)}
    assert got == want


def test_scanline_takes_many_vertices(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("k"), (F.lit(2 * math.pi / n) * F.col("id")).alias("a")).withColumn("d", 300 + 100 * F.sin(F.col("a") * 40))
    v = ring.select("k", (500 + F.col("d") * F.cos("a")).alias("x"), (500 + F.col("d") * F.sin("a")).alias("y"))
    after = v.select(((F.col("k") + n - 1) % n).alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    edges = v.join(after, "k").select(F.lit(1).alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    runs = geometry.scan_runs(edges, 1000, 1000, ["id"])
    cells = runs.agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"), F.count(F.lit(1)).alias("runs")).first()
    exact = math.pi * 300**2 + math.pi * 100**2 / 2
    assert abs(cells["n"] - exact) < 2000 and cells["runs"] < 20_000
    places = {(r, c) for r in range(0, 1000, 50) for c in range(0, 1000, 50)}
    got = {(r["r"], k) for r in runs.collect() for k in range(r["c0"], r["c1"] + 1) if (r["r"], k) in places}
    far = lambda r, c: math.hypot(c - 499.5, r - 499.5) - 300 - 100 * math.sin(40 * math.atan2(r - 499.5, c - 499.5))
    assert all(((r, c) in got) == (far(r, c) < 0) for r, c in places if abs(far(r, c)) > 0.5)


def clip(subject, triangle):
    """A convex part of ``subject`` within a triangle that runs anticlockwise."""
    for (ax, ay), (bx, by) in zip(triangle, [*triangle[1:], triangle[0]], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        out = []
        for i, p in enumerate(subject):
            q, s, t = subject[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        subject = out
    return subject


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2 if ring else 0.0


def fan(polygons):
    """(sign, triangle) whose signed sum is the polygons'; holes run the other way round."""
    for rings in polygons:
        for k, ring in enumerate(rings):
            turn = (1 if area(ring) > 0 else -1) * (-1 if k else 1)
            for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
                t = [(0.0, 0.0), p, q]
                s = area(t)
                if s:
                    yield (1 if s > 0 else -1) * turn, t if s > 0 else t[::-1]


@pytest.mark.parametrize("height", [64, 5.0])
def test_intersections_equal_signed_triangles(spark, height):
    left, right = shapes(np.random.default_rng(3), 7), shapes(np.random.default_rng(4), 6)
    left[90] = [[[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]]]
    right[91] = [[[(8.0, 0.0), (16.0, 0.0), (16.0, 8.0), (8.0, 8.0)]]]  # touches 90 along a side
    right[92] = [[[(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]]  # lies within 90
    tables = [geometry.edges_of_wkb(spark.createDataFrame([(k, wkb(p)) for k, p in x.items()], "id int, wkb binary")).withColumnRenamed("id", n) for x, n in ((left, "a"), (right, "b"))]
    pieces = geometry.intersections(*tables, "a", "b", height)
    got = {(r["a"], r["b"]): r["area"] for r in geometry.intersection_areas(pieces, ["a", "b"]).collect()}
    pairs = 0
    for a, p in left.items():
        for b, q in right.items():
            want = sum(s * t * area(clip(x, y)) for s, x in fan(p) for t, y in fan(q))
            assert abs(got.get((a, b), 0.0) - want) < 1e-6, (a, b)
            pairs += want > 1e-6
    assert pairs > 15 and (90, 91) not in got and abs(got[90, 92] - 4) < 1e-9
    rows = pieces.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    for r in rows[::7]:  # the middle of a piece lies in both
        x, y = (r["left0"] + r["right0"] + r["left1"] + r["right1"]) / 4, (r["y0"] + r["y1"]) / 2
        if r["y1"] - r["y0"] > 1e-6 and r["right0"] + r["right1"] - r["left0"] - r["left1"] > 1e-6:
            assert odd(x, y, left[r["a"]]) and odd(x, y, right[r["b"]])


def test_wkb_round_trip(spark):
    df = spark.createDataFrame([(1, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]]]), (2, None)], "id int, p array<array<array<struct<x:double,y:double>>>>")
    e = geometry.edges_of_wkb(df.select("id", geometry.wkb_of(F.col("p")).alias("wkb")))
    assert [tuple(r) for r in e.orderBy("seq").collect()] == [(1, 0, 0, 0, 0.0, 0.0, 4.0, 0.0), (1, 0, 0, 1, 4.0, 0.0, 4.0, 3.0), (1, 0, 0, 2, 4.0, 3.0, 0.0, 0.0)]


def test_equal_polygons_are_cut_once_and_large_ones_alone(spark, monkeypatch):
    left, right = shapes(np.random.default_rng(3), 5), shapes(np.random.default_rng(4), 5)
    frames = [spark.createDataFrame([(f"{k}-{copy}", wkb(p)) for k, p in x.items() for copy in range(3)], "id string, wkb binary") for x in (left, right)]
    tables = [geometry.edges_of_wkb(f).withColumnRenamed("id", n) for f, n in zip(frames, "ab", strict=True)]
    assert geometry.classes_of_shapes(tables[0], "a").select("rep").distinct().count() == len(left)
    got = {(r["a"], r["b"]): r["area"] for r in geometry.shared_areas(*tables, "a", "b").collect()}
    for a, p in left.items():
        for b, q in right.items():
            want = sum(s * t * area(clip(x, y)) for s, x in fan(p) for t, y in fan(q))
            assert all(abs(got.get((f"{a}-{i}", f"{b}-{j}"), 0.0) - want) < 1e-6 for i in range(3) for j in range(3))
    rows = np.random.default_rng(5)
    x = {n: rows.integers(0, 40, 600).astype(float) for n in ("xa", "xb")} | {"ya": rows.integers(0, 9, 600).astype(float), "side": np.arange(600) % 4 // 2}
    for n in ("ya", "side"):
        x[n][1::2] = x[n][::2]
    frame = geometry.pd.DataFrame(x | {"yb": 10.0})
    group = np.sort(np.arange(600) // 2 % 10)
    monkeypatch.setattr(geometry, "AT_ONCE", 5000)
    g, pieces = geometry._common_of_many(frame, group)
    for k in range(10):
        want = geometry._common(frame[group == k])
        assert abs(sum((p[1] - p[0]) * (p[3] - p[2] + p[5] - p[4]) for p in want) - sum((p[1] - p[0]) * (p[3] - p[2] + p[5] - p[4]) for p in pieces[g == k])) < 1e-6
