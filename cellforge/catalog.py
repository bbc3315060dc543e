"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

``orders`` serves as a fine grid of 100 columns, ``lineitem`` as coarse states, ``part`` as a list of
files and ``nation`` as areas of interest. Layers are multiples of 1/8 and hectares are whole, so
sums are exact and ranks agree between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.config import CHANGEABLE, CLASSES, HALF_LIVES, RECLASS, RESTORE, STATES
from cellforge.functions import curves
from cellforge.operators import allocate, calibrate, coarse, fit, geometry, grid, kernels, pyramid, remap, search, vector
from cellforge.plans import pipeline, zones

COLS, RATIO = 100, 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CODES = sorted(RECLASS)
G = f"""g AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, CAST(o_orderkey // 1000 AS INTEGER) AS cr, CAST((o_orderkey % 100) // 10 AS INTEGER) AS cc,
  CAST(1 + o_orderkey % 4 AS INTEGER) AS ha,
  CAST((o_orderkey // 700 + ((o_orderkey % 100) // 9) * 5 + o_custkey % 3) % 7 + 1 AS INTEGER) AS t1,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey % 5 + 1 ELSE (o_orderkey // 700 + ((o_orderkey % 100) // 9) * 5 + o_custkey % 3) % 7 + 1 END AS INTEGER) AS t2,
  (o_custkey % 16) / CAST(8 AS DOUBLE) AS x1, floor(o_totalprice / 1000) / CAST(8 AS DOUBLE) AS x2, o_totalprice AS v,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % {len(CODES)} AS INTEGER) END AS ci FROM orders)"""
CODE = "[" + ", ".join(map(str, CODES)) + "]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    t1 = (F.floor(k / 700) + F.floor(k % 100 / 9) * 5 + n % 3) % 7 + 1
    return load(spark, sf_dir, "orders").select(
        F.floor(k / 100).cast("int").alias("r"), (k % 100).cast("int").alias("c"), F.floor(k / 1000).cast("int").alias("cr"), F.floor(k % 100 / 10).cast("int").alias("cc"),
        (1 + k % 4).cast("int").alias("ha"), t1.cast("int").alias("t1"), F.when(F.col("o_orderpriority") == "1-URGENT", n % 5 + 1).otherwise(t1).cast("int").alias("t2"),
        (n % 16 / 8.0).cast("double").alias("x1"), (F.floor(F.col("o_totalprice") / 1000) / 8.0).cast("double").alias("x2"), F.col("o_totalprice").alias("v"),
        F.when(n % 11 != 0, (n % len(CODES)).cast("int")).alias("ci"),
    )


def detailed(spark, sf_dir):
    """The grid with a detailed land-cover code, some of it missing."""
    codes = F.array(*(F.lit(c) for c in CODES))
    return cells(spark, sf_dir).withColumn("code", F.try_element_at(codes, F.col("ci") + 1))


def n_rows(df: DataFrame) -> int:
    return (df.agg(F.max("r").alias("m")).first()["m"] or 0) + 1


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{G}", G).replace("{CODE}", CODE)
        return f

    return keep


def values(pairs) -> str:
    return ", ".join(f"({', '.join(repr(x) if not isinstance(x, str) else chr(39) + x + chr(39) for x in p)})" for p in pairs)


# ---- per cell
RC = f"rc(code, k) AS (VALUES {values(RECLASS.items())})"
RS = f"rs(k, code) AS (VALUES {values(RESTORE.items())})"


@query(f"WITH {{G}}, {RC}, d AS (SELECT r, c, {{CODE}}[ci + 1] AS code FROM g) SELECT r, c, CAST(rc.k AS INTEGER) AS class_id FROM d LEFT JOIN rc USING (code)")
def reclassify(spark, sf_dir):
    return remap.reclassify(detailed(spark, sf_dir), RECLASS, "code").select("r", "c", "class_id")


@query(f"WITH {{G}}, {RC}, d AS (SELECT r, c, {{CODE}}[ci + 1] AS code FROM g) SELECT r, c, CAST(rc.k AS INTEGER) AS class_id FROM d LEFT JOIN rc USING (code)")
def reclassify_by_table(spark, sf_dir):
    table = spark.createDataFrame(list(RECLASS.items()), "code int, class_id int")
    return remap.reclassify_by(detailed(spark, sf_dir), table, "code", "code", "class_id").select("r", "c", "class_id")


@query("WITH {G} SELECT r, c, " + ", ".join(f"CAST(t1 = {k} AS INTEGER) AS is_{k}" for k in CLASSES) + " FROM g")
def class_binaries(spark, sf_dir):
    return remap.class_binaries(cells(spark, sf_dir), list(CLASSES), "t1")


@query("WITH {G} SELECT r, c, CAST(k AS INTEGER) AS class_id, CAST(t1 = k AS INTEGER) AS present FROM g, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k)")
def class_binaries_long(spark, sf_dir):
    return remap.class_binaries_long(cells(spark, sf_dir), list(CLASSES), "t1")


@query("WITH {G} SELECT r, c, CAST(ci IS NOT NULL AS INTEGER) AS valid FROM g")
def valid_mask(spark, sf_dir):
    return detailed(spark, sf_dir).select("r", "c", remap.valid_mask(F.col("code")).alias("valid"))


@query("WITH {G} SELECT r, c, CASE WHEN t1 = t2 THEN {CODE}[ci + 1] ELSE t2 END AS code FROM g")
def fill_where_not_changed(spark, sf_dir):
    return detailed(spark, sf_dir).select("r", "c", remap.fill_where_not_changed(F.col("t2"), F.col("t1"), F.col("code")).alias("code"))


@query(f"WITH {{G}}, {RS}, f AS (SELECT r, c, CASE WHEN t1 = t2 THEN {{CODE}}[ci + 1] ELSE t2 END AS k FROM g) SELECT r, c, coalesce(rs.code, f.k) AS code FROM f LEFT JOIN rs USING (k)")
def restore_detailed(spark, sf_dir):
    filled = remap.fill_where_not_changed(F.col("t2"), F.col("t1"), F.col("code"))
    return detailed(spark, sf_dir).select("r", "c", remap.restore_detailed(filled, RESTORE).alias("code"))


PROJECTED = "(t2 + ha) % 7 + 1"


@query(f"""WITH {{G}}, m AS (SELECT r, c, t1 AS b, t2 AS o, {PROJECTED} AS p FROM g)
SELECT r, c, CAST(k AS INTEGER) AS class_id, CAST(CASE WHEN b = k THEN 1 WHEN o = k AND p = k THEN 4 WHEN p = k THEN 3 WHEN o = k THEN 2 ELSE 0 END AS INTEGER) AS category FROM m, (SELECT unnest([1, 2, 3, 4, 5]) AS k)""")
def transition_category(spark, sf_dir):
    x = cells(spark, sf_dir).withColumn("k", F.explode(F.array(*(F.lit(k) for k in CHANGEABLE))))
    return x.select("r", "c", F.col("k").alias("class_id"), remap.transition_category(F.col("t1"), F.col("t2"), F.expr(PROJECTED), F.col("k")).alias("category"))


@query("""WITH {G} SELECT r, c, CAST(k AS INTEGER) AS class_id, CAST(CASE WHEN t2 = k AND t1 <> k THEN 1 WHEN t2 = k THEN 2 WHEN t1 = k THEN 3 END AS INTEGER) AS shown,
CAST(CASE WHEN t2 = k AND t1 <> k THEN 1 WHEN t2 <> k AND t1 = k THEN 2 END AS INTEGER) AS changed FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS k)""")
def expansion_contraction(spark, sf_dir):
    x = cells(spark, sf_dir).withColumn("k", F.explode(F.array(*(F.lit(k) for k in CHANGEABLE))))
    k = F.col("k")
    return x.select("r", "c", k.alias("class_id"), remap.expansion_contraction(F.col("t1"), F.col("t2"), k).alias("shown"), remap.expansion_or_contraction(F.col("t1"), F.col("t2"), k).alias("changed"))


@query("WITH {G} SELECT r, c, CASE WHEN ci IS NOT NULL THEN x2 - x1 END AS change, CASE WHEN ci IS NOT NULL THEN x1 * ha END AS hectares, x1 <> 0 AND ci IS NOT NULL AS changes FROM g")
def null_safe_difference(spark, sf_dir):
    base = F.when(F.col("ci").isNotNull(), F.col("x1"))
    return cells(spark, sf_dir).select(
        "r", "c", remap.null_safe_difference(base, F.col("x2")).alias("change"), remap.share_to_hectares(base, F.col("x1"), F.col("ha")).alias("hectares"), remap.change_present(base).alias("changes")
    )


# ---- geometry
@query("WITH {G} SELECT r, c, t1 FROM g WHERE r BETWEEN 3 AND 12 AND c BETWEEN 20 AND 69")
def clip_bbox(spark, sf_dir):
    return grid.bbox_window(cells(spark, sf_dir), (20.0, 77.0, 70.0, 87.0), 1.0, top=90.0, left=0.0).select("r", "c", "t1")


@query("WITH s AS (SELECT DISTINCT CAST(o_orderkey // 1000 AS INTEGER) AS cr, CAST((o_orderkey % 100) // 10 AS INTEGER) AS cc FROM orders) SELECT cr, cc, CAST(cr * 10 + i AS INTEGER) AS r, CAST(cc * 10 + j AS INTEGER) AS c FROM s, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j)")
def naive_upsample(spark, sf_dir):
    return grid.upsample(cells(spark, sf_dir).select("cr", "cc").distinct(), RATIO)


@query("WITH {G}, s AS (SELECT cr, cc, sum(ha) AS total FROM g GROUP BY cr, cc) SELECT r, c, CAST(total AS BIGINT) AS total, CAST((SELECT max(r) FROM g) - r AS INTEGER) AS flipped FROM g JOIN s USING (cr, cc)")
def fine_to_coarse(spark, sf_dir):
    x = cells(spark, sf_dir)
    totals = x.groupBy("cr", "cc").agg(F.sum("ha").alias("total"))
    joined = grid.join_coarse(x.select("r", "c"), totals, RATIO).withColumn("own", F.col("r"))
    return grid.flip_vertical(joined, n_rows(x)).select(F.col("own").alias("r"), "c", "total", F.col("r").alias("flipped"))


@query("WITH {G} SELECT a.r, a.c, a.t1, b.x1 FROM g a JOIN g b USING (r, c)")
def cell_align(spark, sf_dir):
    x = cells(spark, sf_dir)
    return grid.align(x.select("r", "c", "t1"), x.select("r", "c", "x1"))


@query("""WITH {G}, n AS (SELECT r // 4 AS r, c // 4 AS c, t1, count(*) AS n FROM g GROUP BY ALL)
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, t1 FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, t1) AS k FROM n) WHERE k = 1""")
def overview(spark, sf_dir):
    return grid.overview(cells(spark, sf_dir), 4, "t1")


@query("WITH {G} SELECT a.r, a.c, coalesce(b.t2, a.t1) AS t FROM g a LEFT JOIN (SELECT r, c, t2 FROM g WHERE cc BETWEEN 2 AND 5 AND ci IS NOT NULL) b USING (r, c)")
def stitch_overlay(spark, sf_dir):
    x = cells(spark, sf_dir).where("ci IS NOT NULL")
    tiles = grid.stitch([x.where(F.col("cc") == k).select("r", "c", F.col("t2").alias("t")) for k in (2, 3, 4, 5)])
    return grid.overlay(cells(spark, sf_dir).select("r", "c", F.col("t1").alias("t")), tiles, "t")


@query("SELECT n_nationkey, n_name FROM nation WHERE right(n_name, 3) = 'N_7'")
def aoi_filter(spark, sf_dir):
    x = load(spark, sf_dir, "nation").withColumn("iso3", F.expr("right(n_name, 3)"))
    return grid.aoi(x, "n_7").select("n_nationkey", "n_name")


@query("WITH {G} SELECT min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1, count(*) AS n FROM g")
def grid_extent(spark, sf_dir):
    return grid.extent(cells(spark, sf_dir))


# ---- coarse cells
MATRIX = "m AS (SELECT cr, cc, t1 AS from_class, t2 AS to_class, count(*) AS n FROM g WHERE t1 <= 5 AND t2 <= 5 GROUP BY ALL)"
NET = "net AS (SELECT cr, cc, class_id, CAST(sum(d) AS BIGINT) AS n FROM (SELECT cr, cc, to_class AS class_id, n AS d FROM m WHERE from_class <> to_class UNION ALL SELECT cr, cc, from_class, -n FROM m WHERE from_class <> to_class) GROUP BY ALL)"


def matrix_of(spark, sf_dir):
    return coarse.change_matrix(cells(spark, sf_dir), "t1", "t2", CHANGEABLE)


@query(f"WITH {{G}}, {MATRIX} SELECT * FROM m")
def change_matrix(spark, sf_dir):
    return matrix_of(spark, sf_dir)


@query(f"""WITH {{G}}, {MATRIX}, k AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS k), f AS (SELECT x.cr, x.cc, a.k AS from_class, b.k AS to_class FROM (SELECT DISTINCT cr, cc FROM m) x CROSS JOIN k a CROSS JOIN k b)
SELECT cr, cc, from_class, to_class, coalesce(n, 0) AS n FROM f LEFT JOIN m USING (cr, cc, from_class, to_class)""")
def change_matrix_dense(spark, sf_dir):
    return coarse.dense_change_matrix(matrix_of(spark, sf_dir), CHANGEABLE)


@query(f"WITH {{G}}, {MATRIX} SELECT * FROM m WHERE from_class <> to_class")
def change_matrix_no_diagonal(spark, sf_dir):
    return coarse.change_matrix(cells(spark, sf_dir), "t1", "t2", CHANGEABLE, diagonal=False)


@query(f"WITH {{G}}, {MATRIX}, {NET} SELECT * FROM net")
def net_change_vector(spark, sf_dir):
    return coarse.net_change(matrix_of(spark, sf_dir))


@query(f"WITH {{G}}, {MATRIX}, {NET}, a AS (SELECT cr, cc, sum(ha) AS ha FROM g GROUP BY cr, cc) SELECT cr, cc, class_id, n * ha / CAST(100 AS DOUBLE) AS ha FROM net JOIN a USING (cr, cc)")
def net_change_hectares(spark, sf_dir):
    area = cells(spark, sf_dir).groupBy("cr", "cc").agg(F.sum("ha").alias("ha"))
    return coarse.net_change_hectares(coarse.net_change(matrix_of(spark, sf_dir)), area, RATIO)


@query("WITH {G} SELECT cr, cc, t1 AS class_id, count(*) / CAST(100 AS DOUBLE) AS share FROM g GROUP BY ALL")
def coarse_state_stack(spark, sf_dir):
    return coarse.state_stack(cells(spark, sf_dir), "t1", RATIO)


@query(f"WITH {{G}}, {MATRIX} SELECT CAST(cr * 5 + from_class - 1 AS INTEGER) AS r, CAST(cc * 5 + to_class - 1 AS INTEGER) AS c, n FROM m")
def dense_block_mosaic(spark, sf_dir):
    return coarse.mosaic(coarse.from_mosaic(coarse.mosaic(matrix_of(spark, sf_dir), 5), 5), 5)


@query("""WITH {G}, a AS (SELECT t1 AS class_id, count(*) AS n1 FROM g GROUP BY 1), b AS (SELECT t2 AS class_id, count(*) AS n2 FROM g GROUP BY 1)
SELECT class_id, round((n1 / (SELECT CAST(sum(n1) AS BIGINT) FROM a)) * ((coalesce(n2, 0) - n1) / n1), 9) AS rate FROM a LEFT JOIN b USING (class_id)""")
def class_net_change_rate(spark, sf_dir):
    return coarse.class_rates(cells(spark, sf_dir), "t1", "t2").withColumn("rate", F.round("rate", 9))


@query("WITH {G} SELECT t1, count(*) AS n FROM g GROUP BY t1")
def value_counts(spark, sf_dir):
    return coarse.value_counts(cells(spark, sf_dir), "t1")


@query("WITH {G} SELECT count(*) FILTER (WHERE t1 <> t2) AS n FROM g")
def changed_cell_count(spark, sf_dir):
    return coarse.changed_cells(cells(spark, sf_dir), "t1", "t2")


@query("WITH {G} SELECT min(x1) AS least, max(x1) AS most, sum(x1) AS total, count(*) FILTER (WHERE x1 <> 0) AS nonzero, count(DISTINCT x1) AS n_distinct, max(abs(x1)) AS symmetric FROM g")
def layer_statistics(spark, sf_dir):
    return coarse.layer_statistics(cells(spark, sf_dir), "x1")


@query("WITH {G} SELECT -max(abs(x1 - 1)) * CAST(1.5 AS DOUBLE) AS low, max(abs(x1 - 1)) * CAST(1.5 AS DOUBLE) AS high FROM g WHERE ci IS NOT NULL")
def symmetric_range(spark, sf_dir):
    x = cells(spark, sf_dir).select(F.when(F.col("ci").isNotNull(), F.col("x1") - 1).otherwise(-9999.0).alias("d"))
    return curves.symmetric_range(x, "d")


STATE_NAMES = sorted(STATES) + ["secma", "secmb"]
ST = f"""st AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, [{', '.join(repr(s) for s in STATE_NAMES)}][CAST(l_partkey % 14 AS INTEGER) + 1] AS state, CAST(l_suppkey // 10 AS INTEGER) AS cr, CAST(l_suppkey % 10 AS INTEGER) AS cc, sum(floor(l_quantity)) / CAST(1024 AS DOUBLE) AS share
  FROM lineitem GROUP BY ALL)"""
SC = f"sc(state, class) AS (VALUES {values(STATES.items())})"
CLS = "cls AS (SELECT year, cr, cc, class, sum(share) AS total FROM st JOIN sc USING (state) GROUP BY ALL)"


def states(spark, sf_dir):
    names = F.array(*(F.lit(s) for s in STATE_NAMES))
    x = load(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.element_at(names, (F.col("l_partkey") % 14 + 1).cast("int")).alias("state"), F.floor(F.col("l_suppkey") / 10).cast("int").alias("cr"), (F.col("l_suppkey") % 10).cast("int").alias("cc"), F.floor("l_quantity").alias("q")
    )
    return x.groupBy("year", "state", "cr", "cc").agg((F.sum("q") / 1024.0).alias("share"))


def coarse_area(df: DataFrame) -> DataFrame:
    return df.select("cr", "cc").distinct().withColumn("ha", (F.col("cr") % 4 + 1).cast("double"))


@query(f"WITH {ST} SELECT year, state, cr, cc, share FROM st WHERE year = 1995")
def state_year_slice(spark, sf_dir):
    from cellforge.sources.grids import year_slice

    return year_slice(states(spark, sf_dir), 1995)


@query(f"WITH {ST}, {SC}, {CLS} SELECT year, cr, cc, class, total * (cr % 4 + 1) AS value FROM cls")
def state_to_class_hectares(spark, sf_dir):
    s = states(spark, sf_dir)
    return coarse.states_to_classes(s, STATES, coarse_area(s), by=["year", "cr", "cc"])


@query(f"WITH {ST} SELECT a.state, a.cr, a.cc, b.share - a.share AS change FROM st a JOIN st b USING (state, cr, cc) WHERE a.year = 1995 AND b.year = 1996")
def state_difference(spark, sf_dir):
    s = states(spark, sf_dir)
    return coarse.difference(s.where("year = 1995"), s.where("year = 1996"), ["state", "cr", "cc"], "share")


@query(f"WITH {ST}, {SC}, {CLS}, h AS (SELECT year, cr, cc, class, total * (cr % 4 + 1) AS value FROM cls) SELECT a.cr, a.cc, a.class, b.value - a.value AS change FROM h a JOIN h b USING (cr, cc, class) WHERE a.year = 1995 AND b.year = 1996")
def class_difference(spark, sf_dir):
    s = states(spark, sf_dir)
    h = coarse.states_to_classes(s.where("year IN (1995, 1996)"), STATES, coarse_area(s), by=["year", "cr", "cc"])
    return coarse.difference(h.where("year = 1995"), h.where("year = 1996"), ["cr", "cc", "class"])


@query(f"WITH {ST} SELECT a.state, a.cr, a.cc, (b.share - a.share) * (a.cr % 4 + 1) AS change FROM st a JOIN st b USING (state, cr, cc) WHERE a.year = 1995 AND b.year = 1996")
def map_state_difference(spark, sf_dir):
    s = states(spark, sf_dir)
    area = s.select("cr").distinct().withColumn("ha", F.col("cr") % 4 + 1)
    return coarse.row_area_difference(s.where("year = 1995"), s.where("year = 1996"), area, ["state", "cr", "cc"])


@query(f"WITH {{G}}, {ST}, {SC}, {CLS}, names(class, class_id) AS (VALUES {', '.join(f"('{CLASSES[k]}', {k})" for k in CHANGEABLE)}), o AS (SELECT cr, cc, t1 AS class_id, count(*) / CAST(100 AS DOUBLE) AS share FROM g GROUP BY ALL) SELECT cls.cr, cls.cc, names.class_id, (total - coalesce(o.share, 0)) * (cls.cr % 4 + 1) AS change FROM cls JOIN names USING (class) LEFT JOIN o ON o.cr = cls.cr AND o.cc = cls.cc AND o.class_id = names.class_id WHERE year = 1996")
def difference_from_observed(spark, sf_dir):
    """A scenario's states less the observed map's."""
    s = states(spark, sf_dir).where("year = 1996")
    x = coarse.states_to_classes(s, STATES).select("cr", "cc", pipeline.remap_class({CLASSES[k]: k for k in CHANGEABLE}).alias("class_id"), F.col("value").alias("share"))
    area = s.select("cr").distinct().withColumn("ha", F.col("cr") % 4 + 1)
    return coarse.difference_from_observed(coarse.state_stack(cells(spark, sf_dir), "t1", RATIO), x, area, ["cr", "cc", "class_id"])


@query(f"WITH {SC} SELECT class, string_agg(state, ',' ORDER BY state) AS states FROM sc WHERE (SELECT count(*) FROM region) > 0 GROUP BY class")
def class_members(spark, sf_dir):
    known = states(spark, sf_dir).select("state").distinct()
    table = spark.createDataFrame(list(STATES.items()), "state string, class string")
    return zones.class_inverse(known.join(table, "state")).withColumn("states", F.array_join("states", ","))


# ---- goals and allocation
ADD1, ADD2 = {1: 1.0, 2: 2.0, 3: 0.5, 4: 1.0, 5: 0.25}, {1: 0.5, 2: 0.25, 3: 1.0, 4: 0.5, 5: 1.0}
COEFFICIENTS = {
    k: [("x1", allocate.ADDITIVE, ADD1[k]), ("x2", allocate.ADDITIVE, ADD2[k]), *((f"is_{j}", allocate.MULTIPLICATIVE, 0.0 if j in (k, 6, 7) else 1.0) for j in CLASSES)] for k in CHANGEABLE
}
CO = f"co(class_id, b1, b2) AS (VALUES {', '.join(f'({k}, CAST({ADD1[k]} AS DOUBLE), CAST({ADD2[k]} AS DOUBLE))' for k in CHANGEABLE)})"
SU = "su AS (SELECT r, c, cr, cc, t1, ha, class_id, b1 * x1 + b2 * x2 AS s FROM g, co WHERE t1 <> class_id AND t1 <= 5 AND b1 * x1 + b2 * x2 <> 0)"
GO = """go AS (SELECT cr, cc, class_id, CAST(sum(d) AS BIGINT) AS goal FROM (SELECT cr, cc, t2 AS class_id, ha AS d FROM g WHERE t1 <> t2 UNION ALL SELECT cr, cc, t1, -ha FROM g WHERE t1 <> t2) WHERE class_id <= 5 GROUP BY ALL)"""
CL = """cl AS (SELECT r, c, class_id, rn FROM (
  SELECT r, c, class_id, goal, row_number() OVER w AS rn, coalesce(sum(ha) OVER (PARTITION BY cr, cc, class_id ORDER BY s DESC, r, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM su JOIN go USING (cr, cc, class_id) WHERE goal > 0 WINDOW w AS (PARTITION BY cr, cc, class_id ORDER BY s DESC, r, c)) WHERE prior < goal)"""
WI = "wi AS (SELECT r, c, class_id AS new FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY rn DESC, class_id DESC) AS k FROM cl) WHERE k = 1)"
DONE = "SELECT r, c, CAST(coalesce(new, t1) AS INTEGER) AS lulc FROM g LEFT JOIN wi USING (r, c)"


def layered(spark, sf_dir):
    return cells(spark, sf_dir).withColumns({f"is_{k}": (F.col("t1") == k).cast("double") for k in CLASSES})


def goals_of(spark, sf_dir):
    return coarse.goals(cells(spark, sf_dir), "t1", "t2", "ha", CHANGEABLE)


@query(f"WITH {{G}}, {GO} SELECT * FROM go")
def change_goals(spark, sf_dir):
    return goals_of(spark, sf_dir)


@query(f"WITH {{G}}, {GO}, v AS (SELECT cr, cc, avg(CAST(ci IS NOT NULL AS DOUBLE)) AS valid FROM g GROUP BY cr, cc) SELECT cr, cc, class_id, round(goal * valid, 9) AS goal FROM go JOIN v USING (cr, cc)")
def scaled_change(spark, sf_dir):
    x = coarse.scaled_change(goals_of(spark, sf_dir), coarse.valid_share(cells(spark, sf_dir), "ci"))
    return x.select("cr", "cc", "class_id", F.round("goal", 9).alias("goal"))


@query(f"WITH {{G}}, {CO}, {SU} SELECT r, c, CAST(class_id AS INTEGER) AS class_id, s FROM su")
def suitability(spark, sf_dir):
    return allocate.suitability(layered(spark, sf_dir), COEFFICIENTS, "t1").select("r", "c", "class_id", "s")


@query(f"WITH {{G}}, {CO}, {SU} SELECT r, c, CAST(class_id AS INTEGER) AS class_id, s FROM su")
def suitability_long(spark, sf_dir):
    x = layered(spark, sf_dir)
    names = ["x1", "x2", *(f"is_{k}" for k in CLASSES)]
    long = x.unpivot(["r", "c", "t1"], names, "layer_id", "x")
    table = spark.createDataFrame([(n, k, kind, float(b)) for k, rows in COEFFICIENTS.items() for n, kind, b in rows], "layer_id string, class_id int, kind string, beta double")
    s = allocate.suitability_long(long, table, ["r", "c", "t1"])
    return s.where((F.col("t1") != F.col("class_id")) & allocate.allocatable(F.col("s"))).select("r", "c", "class_id", "s")


@query(f"WITH {{G}}, {CO}, {SU} SELECT r, c, CAST(class_id AS INTEGER) AS class_id, row_number() OVER (PARTITION BY cr, cc, class_id ORDER BY s DESC, r, c) - 1 AS rank FROM su")
def rank_cells(spark, sf_dir):
    return allocate.rank_output(allocate.suitability(layered(spark, sf_dir), COEFFICIENTS, "t1")).select("r", "c", "class_id", "rank")


@query(f"WITH {{G}}, {CO}, {SU}, {GO}, {CL}, {WI} {DONE}")
def allocate_gridded(spark, sf_dir):
    return allocate.allocate_gridded(layered(spark, sf_dir), COEFFICIENTS, goals_of(spark, sf_dir), "t1")


VECTOR = {1: 300.0, 2: 200.0, 3: 100.0, 4: -50.0, 5: 250.0}


@query(f"WITH {{G}}, {CO}, {SU.replace('r, c, cr, cc,', 'r, c, 0 AS cr, 0 AS cc,')}, go(cr, cc, class_id, goal) AS (VALUES {values((0, 0, k, int(v)) for k, v in VECTOR.items())}), {CL}, {WI} {DONE}")
def allocate_vector(spark, sf_dir):
    return allocate.allocate_vector(layered(spark, sf_dir), COEFFICIENTS, VECTOR, "t1")


@query(f"WITH {{G}}, {CO}, {GO}, {SU.replace('FROM g, co WHERE', 'FROM g, co WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.cr = g.cr AND go.cc = g.cc AND go.class_id = g.t1 AND goal > 0) AND')}, {CL}, {WI} {DONE}")
def allocate_exclusive(spark, sf_dir):
    return allocate.allocate_exclusive(layered(spark, sf_dir), COEFFICIENTS, goals_of(spark, sf_dir), "t1")


@query(f"""WITH {{G}}, {CO}, {SU}, {MATRIX},
cl AS (SELECT r, c, class_id, rn FROM (SELECT su.*, n, row_number() OVER (PARTITION BY su.cr, su.cc, t1, class_id ORDER BY s DESC, r, c) AS rn FROM su JOIN m ON m.cr = su.cr AND m.cc = su.cc AND from_class = t1 AND to_class = class_id WHERE from_class <> to_class) WHERE rn <= n), {WI} {DONE}""")
def allocate_from_matrix(spark, sf_dir):
    return allocate.allocate_from_matrix(layered(spark, sf_dir), COEFFICIENTS, matrix_of(spark, sf_dir), "t1")


# ---- kernels
@query("""WITH {G} SELECT r, c, round(1 / (CAST(1 AS DOUBLE) + exp(CAST(1 AS DOUBLE) * (x1 - 5))), 9) AS one,
round(-1 / (1 + exp(x1 - 5)) + 1 / (1 + exp(x1 - 15)), 9) AS two, round(1 / (1 + exp(x1 - 5)) - 1 / (1 + exp(x1 - 15)) + 1 / (1 + exp(x1 - 25)), 9) AS three,
round(1 / (1 + exp(CAST(4 AS DOUBLE) / 3 * (x1 - 3))), 9) AS weight, round(1 / (1 + exp(CAST(4 AS DOUBLE) / 3 * (sqrt(x1 * x1 + x2 * x2) - 3))), 9) AS at FROM g""")
def sigmoid_families(spark, sf_dir):
    x, far = F.col("x1"), curves.at_distance(F.col("x1"), F.col("x2"), lambda d: curves.kernel_weight(d, 3.0))
    named = {"one": curves.first_order(x), "two": curves.second_order(x), "three": curves.third_order(x), "weight": curves.kernel_weight(x, 3.0), "at": far}
    return cells(spark, sf_dir).select("r", "c", *(F.round(v, 9).alias(k) for k, v in named.items()))


@query("""WITH {G}, a AS (SELECT min(v) AS a, max(v) AS b FROM g) SELECT r, c, round((v - a) / (b - a) * CAST(1 AS DOUBLE), 9) AS normal, round(ln(v - a + 1) * 2 / ln(b - a + 1), 9) AS logged FROM g, a""")
def normalize_log(spark, sf_dir):
    x = curves.normalise(cells(spark, sf_dir).select("r", "c", "v"), "v")
    x = curves.normalise(x, "v", -1.0, 1.0, log=True, out="logged")
    return x.select("r", "c", F.round("normal", 9).alias("normal"), F.round("logged", 9).alias("logged"))


def kernel_sql(h: int, name: str = "k") -> str:
    r = 9 * h
    return f"""{name} AS (SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, 1 / (1 + exp(CAST(4 AS DOUBLE) / {h} * (sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) - {h}))) AS w
  FROM (SELECT unnest(range(-{r}, {r})) AS dr), (SELECT unnest(range(-{r}, {r})) AS dc))"""


@query(f"WITH {{G}}, {kernel_sql(1)} SELECT g.r, g.c, round(coalesce(sum(i.x1 * w), 0), 6) AS value FROM g CROSS JOIN k LEFT JOIN g i ON i.r = g.r - dr AND i.c = g.c - dc GROUP BY g.r, g.c")
def convolve_h1(spark, sf_dir):
    return kernels.convolve(cells(spark, sf_dir), "x1", kernels.kernel_array(1.0), 9).withColumn("value", F.round("value", 6))


def class_convolution_sql(h: int) -> str:
    return f"""SELECT CAST({h} AS DOUBLE) AS half_life, CAST(class_id AS INTEGER) AS class_id, f.r, f.c, round(coalesce(n.value, 0), 6) AS value FROM (SELECT r, c, class_id FROM g, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS class_id)) f
LEFT JOIN (SELECT i.r + dr AS r, i.c + dc AS c, i.t1 AS class_id, sum(w) AS value FROM g i, k{h} GROUP BY ALL) n USING (r, c, class_id)"""


@query(f"WITH {{G}}, {kernel_sql(1, 'k1')}, {kernel_sql(5, 'k5')} {class_convolution_sql(1)} UNION ALL {class_convolution_sql(5)}")
def class_convolutions(spark, sf_dir):
    x = kernels.class_convolutions(cells(spark, sf_dir), list(CLASSES), (1.0, 5.0), "t1")
    return x.select("half_life", "class_id", "r", "c", F.round("value", 6).alias("value"))


@query()
def class_convolutions_all(spark, sf_dir):
    """Every class under all ten half-lives; SQL would need half a million products a cell, so a test holds the operator against brute force."""
    return kernels.class_convolutions(cells(spark, sf_dir), list(CLASSES), HALF_LIVES, "t1")


@query(f"WITH {{G}}, {kernel_sql(5)} SELECT g.r, g.c, round(coalesce(n.value, 0), 6) AS value FROM g LEFT JOIN (SELECT i.r + dr AS r, i.c + dc AS c, sum(i.x1 * w) AS value FROM g i, k GROUP BY ALL) n USING (r, c)")
def convolve_h5_blocks(spark, sf_dir):
    return kernels.convolve(cells(spark, sf_dir), "x1", kernels.kernel_array(5.0), 45, block=100).withColumn("value", F.round("value", 6))


HALF_LIFE = "CASE WHEN r_regionkey = 0 THEN 1 ELSE 2 END"


@query(f"WITH h AS (SELECT DISTINCT CAST({HALF_LIFE} AS INTEGER) AS h FROM region), {kernel_sql(1, 'k1')}, {kernel_sql(2, 'k2')} SELECT CAST(h AS DOUBLE) AS half_life, dr, dc, round(w, 9) AS w FROM h, k1 WHERE h = 1 UNION ALL SELECT h, dr, dc, round(w, 9) FROM h, k2 WHERE h = 2")
def kernel_tables(spark, sf_dir):
    """Kernels of the half-lives that a table asks for."""
    wanted = load(spark, sf_dir, "region").select(F.expr(HALF_LIFE).cast("double").alias("half_life")).distinct()
    return wanted.join(kernels.kernel_set(spark, [1, 2, 3]), "half_life").select("half_life", "dr", "dc", F.round("w", 9).alias("w"))


SIGMA = 3


def blur_sql(source: str, value: str, sigma: int = SIGMA, name: str = "blur", by: str = "") -> str:
    r = int(4 * sigma + 0.5)
    key = f"{by}, " if by else ""
    return f"""{name}_w AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT CAST(d AS INTEGER) AS d, exp(-CAST(d * d AS DOUBLE) / {2 * sigma * sigma}) AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS d))),
{name}_n AS (SELECT max(r) + 1 AS nr FROM g),
{name}_1 AS (SELECT {key}o.r, s.c, sum(s.{value} * w) AS x FROM (SELECT r, d, w, CASE WHEN r + d < 0 THEN -(r + d) - 1 WHEN r + d >= nr THEN 2 * nr - 1 - (r + d) ELSE r + d END AS q FROM (SELECT DISTINCT r FROM g), {name}_w, {name}_n) o JOIN {source} s ON s.r = o.q GROUP BY ALL),
{name} AS (SELECT {key}s.r, o.c, sum(s.x * w) AS x FROM (SELECT c, d, w, CASE WHEN c + d < 0 THEN -(c + d) - 1 WHEN c + d >= 100 THEN 199 - (c + d) ELSE c + d END AS q FROM (SELECT DISTINCT c FROM g), {name}_w) o JOIN {name}_1 s ON s.c = o.q GROUP BY ALL)"""


@query(f"WITH {{G}}, {blur_sql('g', 'x1')} SELECT r, c, round(x, 6) AS x1 FROM blur")
def gaussian_blur(spark, sf_dir):
    x = cells(spark, sf_dir)
    return kernels.gaussian_blur(x, ["x1"], SIGMA, n_rows(x), COLS).select("r", "c", F.round("x1", 6).alias("x1"))


SITES = "si AS (SELECT r, c FROM g WHERE t1 = 2 AND ha = 1)"


@query(f"WITH {{G}}, {SITES}, near AS (SELECT g.r, g.c, min((g.r - si.r) * (g.r - si.r)) AS g2 FROM g JOIN si USING (c) GROUP BY ALL) SELECT g.r, g.c, CAST(min(g2 + (g.c - near.c) * (g.c - near.c)) AS DOUBLE) AS d2 FROM g JOIN near ON near.r = g.r GROUP BY ALL")
def distance_transform_sq(spark, sf_dir):
    x = cells(spark, sf_dir).withColumn("site", (F.col("t1") == 2) & (F.col("ha") == 1))
    return kernels.distance_transform_sq(x, "site")


@query(f"""WITH {{G}}, u AS (SELECT r, c, CAST(t1 = 1 AS INTEGER) AS x1 FROM g), {blur_sql('u', 'x1')}, b AS (SELECT r, c, coalesce(x, 0) AS x FROM g LEFT JOIN blur USING (r, c)),
si AS (SELECT r, c FROM b WHERE x >= CAST(0.25 AS DOUBLE)), near AS (SELECT g.r, g.c, min((g.r - si.r) * (g.r - si.r)) AS g2 FROM g JOIN si USING (c) GROUP BY ALL),
d AS (SELECT g.r, g.c, CAST(min(g2 + (g.c - near.c) * (g.c - near.c)) AS DOUBLE) AS d2 FROM g JOIN near ON near.r = g.r GROUP BY ALL),
a AS (SELECT r, c, d2, CASE WHEN x >= CAST(0.25 AS DOUBLE) THEN 1 - x ELSE 1 - 1 / (pow(CAST(1.5 AS DOUBLE), sqrt(d2)) + CAST(3 AS DOUBLE)) END AS m FROM b LEFT JOIN d USING (r, c))
SELECT r, c, round(CASE WHEN d2 IS NULL THEN 0 ELSE 1 - (CASE WHEN m > CAST(0.9999999 AS DOUBLE) THEN 1 WHEN m < CAST(0.0000001 AS DOUBLE) THEN 0 ELSE m END) END, 6) AS metric FROM a""")
def distance_from_threshold(spark, sf_dir):
    x = cells(spark, sf_dir)
    u = x.select("r", "c", (F.col("t1") == 1).cast("int").alias("u"))
    return kernels.distance_from_threshold(u, "u", SIGMA, 0.25, 0.5, n_rows(x), COLS).withColumn("metric", F.round("metric", 6))


# ---- fit
MAPS = f"mp AS (SELECT r, c, t1 AS b, {PROJECTED} AS p, t2 AS o FROM g)"
DIFF = """df AS (SELECT r, c, CAST(k AS INTEGER) AS class_id, CAST(p = k AND b <> k AS INTEGER) - CAST(o = k AND b <> k AS INTEGER) AS more, CAST(b = k AND p <> k AS INTEGER) - CAST(b = k AND o <> k AS INTEGER) AS less FROM mp, (SELECT unnest([1, 2, 3, 4, 5]) AS k))"""
LOSS = f"{MAPS}, {DIFF}, {blur_sql('df', 'more', name='ex', by='class_id')}, {blur_sql('df', 'less', name='ct', by='class_id')}, loss AS (SELECT class_id, sum(abs(ex.x) + abs(ct.x)) AS loss FROM ex JOIN ct USING (class_id, r, c) GROUP BY class_id)"


def maps_of(spark, sf_dir):
    return cells(spark, sf_dir).select("r", "c", F.col("t1").alias("baseline"), F.expr(PROJECTED).alias("projected"), F.col("t2").alias("observed"))


@query(f"WITH {{G}}, {LOSS} SELECT class_id, round(sum(loss), 5) AS loss FROM loss GROUP BY ROLLUP (class_id)")
def fit_loss(spark, sf_dir):
    m = maps_of(spark, sf_dir)
    return fit.overall_loss(fit.fit_loss(m, CHANGEABLE, SIGMA, n_rows(m), COLS)).withColumn("loss", F.round("loss", 5))


@query(f"WITH {{G}}, {LOSS}, t AS (SELECT sum(loss) AS loss FROM loss), n AS (SELECT count(*) FILTER (WHERE b <> p) AS changed FROM mp) SELECT changed, round(loss, 5) AS loss, round(changed / (loss + 1), 6) AS score FROM n, t")
def weighted_score(spark, sf_dir):
    m = maps_of(spark, sf_dir)
    s = fit.weighted_score(m, fit.fit_loss(m, CHANGEABLE, SIGMA, n_rows(m), COLS))
    return s.select("changed", F.round("loss", 5).alias("loss"), F.round("score", 6).alias("score"))


def _side(name: str, test: str, source: str = "se") -> str:
    return f"""{name}_near AS (SELECT g.r, g.c, min((g.r - s.r) * (g.r - s.r)) AS g2 FROM g JOIN (SELECT r, c FROM {source} WHERE {test}) s USING (c) GROUP BY ALL),
{name} AS (SELECT g.r, g.c, min(g2 + (g.c - n.c) * (g.c - n.c)) AS d FROM g JOIN {name}_near n ON n.r = g.r GROUP BY ALL)"""


@query(f"""WITH {{G}}, se AS (SELECT r, c, t2 = 3 AND t1 <> 3 AS a, {PROJECTED} = 3 AND t1 <> 3 AS b FROM g), {_side('da', 'a AND NOT b')}, {_side('db', 'b AND NOT a')}
SELECT coalesce(sum(CASE WHEN b THEN da.d END), 0) + coalesce(sum(CASE WHEN a THEN db.d END), 0) + CAST(0 AS DOUBLE) AS metric, count(*) FILTER (WHERE b AND da.d <> 0) + count(*) FILTER (WHERE a AND db.d <> 0) AS predicted FROM se LEFT JOIN da USING (r, c) LEFT JOIN db USING (r, c)""")
def distance_similarity(spark, sf_dir):
    m = maps_of(spark, sf_dir)
    x = m.select("r", "c", F.expr("observed = 3 AND baseline <> 3").alias("o"), F.expr("projected = 3 AND baseline <> 3").alias("p"))
    return fit.distance_similarity(x, "o", "p")


def _fit_sql(classes=CHANGEABLE) -> str:
    parts, rows = [], []
    for k in classes:
        for side in ("to", "from"):
            change = {x: f"t1 <> {k} AND {x} = {k}" if side == "to" else f"t1 = {k} AND {x} <> {k}" for x in ("t2", "p")}
            n = f"{side}{k}"
            se = f"{n}_se AS (SELECT r, c, {change['t2']} AS a, {change['p']} AS b FROM m)"
            parts += [se, _side(f"{n}_a", "a AND NOT b", f"{n}_se"), _side(f"{n}_b", "b AND NOT a", f"{n}_se")]
            rows.append(f"""SELECT {k} AS class_id, '{side}' AS side, coalesce(sum(CASE WHEN b THEN x.d END), 0) + coalesce(sum(CASE WHEN a THEN y.d END), 0) + CAST(0 AS DOUBLE) AS metric,
count(*) FILTER (WHERE b AND x.d <> 0) + count(*) FILTER (WHERE a AND y.d <> 0) AS predicted FROM {n}_se LEFT JOIN {n}_a x USING (r, c) LEFT JOIN {n}_b y USING (r, c) WHERE a OR b HAVING count(*) > 0""")
    return f"WITH {{G}}, m AS (SELECT r, c, t1, t2, {PROJECTED} AS p FROM g), {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_fit_sql())
def fit_distance(spark, sf_dir):
    return fit.fit_distance(maps_of(spark, sf_dir), CHANGEABLE)


@query(_fit_sql(CLASSES))
def fit_distance_all_classes(spark, sf_dir):
    """As ``fit_distance``, over every class that some of the three maps has."""
    return fit.fit_distance(maps_of(spark, sf_dir))


@query(f"SELECT sum(metric) / sum(predicted) AS distance FROM ({_fit_sql()})")
def overall_distance(spark, sf_dir):
    return fit.overall_distance(fit.fit_distance(maps_of(spark, sf_dir), CHANGEABLE))


@query(f"WITH {{G}}, {MAPS} SELECT CAST(sum(abs(o - p)) FILTER (WHERE o = 3 OR p = 3) AS DOUBLE) / count(*) FILTER (WHERE p = 3 AND b <> 3) AS similarity FROM mp")
def class_similarity(spark, sf_dir):
    m = maps_of(spark, sf_dir)
    return fit.class_similarity(m.where("observed = 3 OR projected = 3").select(F.abs(F.col("observed") - F.col("projected")).alias("d")), m, 3)


# ---- calibration
def present(spark, sf_dir):
    """Classes that occur in the map."""
    return {r["t1"]: CLASSES[r["t1"]] for r in cells(spark, sf_dir).select("t1").distinct().orderBy("t1").collect()}


@query("""WITH {G}, k AS (SELECT DISTINCT t1 AS s, ['urban', 'cropland', 'grassland', 'forest', 'nonforestnatural', 'water', 'barren_and_other'][t1] AS name FROM g), t AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS class_id),
st AS (SELECT unnest(['altitude', 'sand', 'clay']) AS layer)
SELECT name || '_constraint' AS layer, 'multiplicative' AS kind, class_id, CASE WHEN s = class_id OR s IN (1, 6, 7) THEN CAST(0 AS DOUBLE) ELSE 1 END AS beta FROM k, t
UNION ALL SELECT name || '_presence', 'additive', class_id, 0 FROM k, t
UNION ALL SELECT name || '_gaussian_' || z, 'gaussian_' || z, class_id, (CASE WHEN s = class_id THEN 10 WHEN s = 1 AND class_id = 2 THEN 5 ELSE 1 END) / CAST(z AS DOUBLE) FROM k, t, (SELECT unnest([1, 5]) AS z)
UNION ALL SELECT layer, 'additive', class_id, 1 FROM st, t""")
def starting_coefficients(spark, sf_dir):
    return calibrate.starting_coefficients(spark, present(spark, sf_dir), CHANGEABLE, (1, 5), ("altitude", "sand", "clay"))


@query("""WITH {G}, k AS (SELECT DISTINCT t1 AS s, ['urban', 'cropland', 'grassland', 'forest', 'nonforestnatural', 'water', 'barren_and_other'][t1] AS name FROM g), t AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS class_id),
st AS (SELECT unnest(['altitude', 'sand', 'clay']) AS layer)
SELECT name || '_presence_constraint' AS layer, 'multiplicative' AS kind, class_id, CASE WHEN s = class_id OR s IN (6, 7) THEN CAST(0 AS DOUBLE) ELSE 1 END AS beta FROM k, t
UNION ALL SELECT name || '_presence', 'additive', class_id, 0 FROM k, t
UNION ALL SELECT name || '_gaussian_' || z, 'additive', class_id, CAST(z = 5 AND s = class_id AS DOUBLE) FROM k, t, (SELECT unnest([1, 5]) AS z)
UNION ALL SELECT layer, 'additive', class_id, CAST(layer = 'sand' AS DOUBLE) FROM st, t""")
def sparse_starting_coefficients(spark, sf_dir):
    return calibrate.sparse_starting_coefficients(spark, present(spark, sf_dir), CHANGEABLE, ("altitude", "sand", "clay"), ("sand",))


@query("""WITH {G}, k AS (SELECT DISTINCT t1 AS s, ['urban', 'cropland', 'grassland', 'forest', 'nonforestnatural', 'water', 'barren_and_other'][t1] AS name FROM g), t AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS class_id),
l AS (SELECT name || '_presence' AS layer, class_id FROM k, t UNION ALL SELECT name || '_gaussian_1', class_id FROM k, t UNION ALL SELECT 'sand', class_id FROM t),
x AS (SELECT row_number() OVER (ORDER BY layer, class_id, d) AS try_id, layer, class_id, d AS delta FROM l, (SELECT CAST(unnest([-1, 1]) AS DOUBLE) AS d))
SELECT * FROM x UNION ALL SELECT 0, NULL, NULL, 0""")
def candidate_tries(spark, sf_dir):
    return calibrate.candidate_tries(calibrate.starting_coefficients(spark, present(spark, sf_dir), CHANGEABLE, (1,), ("sand",)))


@query()
def greedy_calibration(spark, sf_dir):
    """The whole search over all classes and layers, the grid being one zone; a test holds it against a plain search."""
    x = layered(spark, sf_dir).withColumn("zone", F.lit(0))
    state = search.calibrate_zones(x, COEFFICIENTS, goals_of(spark, sf_dir), "t2", SIGMA, "t1")
    return search.best_changes(state).select("step", "layer", "class_id", F.round("beta", 9).alias("beta"), F.round("score", 6).alias("score"))


def zoned(spark, sf_dir):
    return layered(spark, sf_dir).withColumn("zone", F.floor(F.col("cr") / 5).cast("int"))


@query()
def zone_calibration(spark, sf_dir):
    """What each zone keeps, by quotas from class to class and over two generations: all zones search at once, each for itself."""
    state = search.calibrate_zones(zoned(spark, sf_dir), COEFFICIENTS, coarse.change_matrix(cells(spark, sf_dir), "t1", "t2", CHANGEABLE), "t2", SIGMA, "t1", generations=2, scales=(0.1, 0.5, 2.0, 10.0))
    return search.best_changes(state).withColumns({"beta": F.round("beta", 9), "score": F.round("score", 6)})


@query()
def zone_trained_coefficients(spark, sf_dir):
    """Each zone's whole coefficient table after its search."""
    state = search.calibrate_zones(zoned(spark, sf_dir), COEFFICIENTS, goals_of(spark, sf_dir), "t2", SIGMA, "t1", scales=())
    return search.best_coefficients(state, COEFFICIENTS).withColumn("beta", F.round("beta", 9))


# ---- plans
@query("SELECT a.r_name AS scenario, CAST(b.y AS INTEGER) AS year, c.p AS policy FROM region a, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) b, (SELECT DISTINCT o_orderpriority AS p FROM orders) c")
def scenario_product(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return zones.scenario_product(load(spark, sf_dir, "region").select(F.col("r_name").alias("scenario")), o.select(F.year("o_orderdate").alias("year")).distinct(), o.select(F.col("o_orderpriority").alias("policy")).distinct())


@query("WITH {G} SELECT DISTINCT cr, cc FROM g WHERE EXISTS (SELECT 1 FROM g h WHERE h.cr = g.cr AND h.cc = g.cc AND h.t1 <> h.t2 AND h.ha = 4 AND h.x1 > CAST(1.5 AS DOUBLE))")
def prune_unchanged(spark, sf_dir):
    x = cells(spark, sf_dir)
    change = x.select("cr", "cc", F.expr("CAST(t1 <> t2 AND ha = 4 AND x1 > CAST(1.5 AS DOUBLE) AS DOUBLE)").alias("change"))
    return zones.prune_unchanged(x.select("cr", "cc").distinct(), change, ["cr", "cc"])


@query("WITH {G} SELECT cr, cc, bool_or(t1 <> t2 AND ha = 4 AND x1 > CAST(1.5 AS DOUBLE)) AS any_change FROM g GROUP BY cr, cc")
def any_change(spark, sf_dir):
    change = cells(spark, sf_dir).select("cr", "cc", F.expr("CAST(t1 <> t2 AND ha = 4 AND x1 > CAST(1.5 AS DOUBLE) AS DOUBLE)").alias("change"))
    return zones.any_change(change, ["cr", "cc"])


@query(f"WITH {{G}}, z AS (SELECT DISTINCT CAST(cr // 3 AS INTEGER) AS zone FROM g), k(class_id, b1, b2) AS (VALUES {', '.join(f'({k}, CAST({ADD1[k]} AS DOUBLE), CAST({ADD2[k]} AS DOUBLE))' for k in CHANGEABLE)}) SELECT zone, CAST(class_id AS INTEGER) AS class_id, l AS layer, CASE WHEN l = 'x1' THEN b1 ELSE b2 END + zone % 3 AS beta FROM z, k, (SELECT unnest(['x1', 'x2']) AS l)")
def zone_coefficients(spark, sf_dir):
    """Each zone with the coefficients trained for its kind."""
    z = cells(spark, sf_dir).select(F.floor(F.col("cr") / 3).cast("int").alias("zone")).distinct().withColumn("kind", F.col("zone") % 3)
    table = spark.createDataFrame([(t, k, n, b[k] + t) for t in range(3) for k in CHANGEABLE for n, b in (("x1", ADD1), ("x2", ADD2))], "kind int, class_id int, layer string, beta double")
    return zones.coefficients_for(z, table, ["kind"]).drop("kind")


END_GOALS = f"""h AS (SELECT year, cr, cc, class, total * (cr % 4 + 1) AS value FROM cls), names(class, class_id) AS (VALUES {', '.join(f"('{CLASSES[k]}', {k})" for k in CHANGEABLE)}),
go AS (SELECT a.cr, a.cc, class_id, b.value - a.value AS goal FROM h a JOIN h b USING (cr, cc, class) JOIN names USING (class) WHERE a.year = 1995 AND b.year = 1996)"""


def end_goals(spark, sf_dir):
    s = states(spark, sf_dir)
    return pipeline.class_goals(s, coarse_area(s), 1995, 1996, {CLASSES[k]: k for k in CHANGEABLE})


@query(f"WITH {{G}}, {ST}, {SC}, {CLS}, {END_GOALS}, {CO}, {SU}, {CL}, {WI} {DONE}")
def end_to_end(spark, sf_dir):
    """From coarse states to the projected map in one plan."""
    return pipeline.project(layered(spark, sf_dir), COEFFICIENTS, end_goals(spark, sf_dir), "t1")


@query(f"WITH {{G}}, {ST}, {SC}, {CLS}, {END_GOALS}, {CO}, {SU.replace('FROM g, co WHERE', 'FROM g, co WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.cr = g.cr AND go.cc = g.cc AND go.class_id = g.t1 AND goal > 0) AND')}, {CL}, {WI} {DONE}")
def end_to_end_exclusive(spark, sf_dir):
    """The same, but cells of classes that grow are not taken."""
    return pipeline.project(layered(spark, sf_dir), COEFFICIENTS, end_goals(spark, sf_dir), "t1", "exclusive")


@query(f"""WITH {{G}}, {CO}, {SU}, {MATRIX},
cl AS (SELECT r, c, class_id, rn FROM (SELECT su.*, n, row_number() OVER (PARTITION BY su.cr, su.cc, t1, class_id ORDER BY s DESC, r, c) AS rn FROM su JOIN m ON m.cr = su.cr AND m.cc = su.cc AND from_class = t1 AND to_class = class_id WHERE from_class <> to_class) WHERE rn <= n), {WI}, {RS},
n AS (SELECT g.r, g.c, t1, ci, coalesce(new, t1) AS k FROM g LEFT JOIN wi USING (r, c)), f AS (SELECT r, c, CASE WHEN k = t1 THEN {{CODE}}[ci + 1] ELSE k END AS k FROM n) SELECT r, c, coalesce(rs.code, f.k) AS code FROM f LEFT JOIN rs USING (k)""")
def restored_map_from_matrix(spark, sf_dir):
    """The map that a change matrix leads to, in detailed codes."""
    new = pipeline.project(layered(spark, sf_dir), COEFFICIENTS, matrix_of(spark, sf_dir), "t1", "matrix")
    return pipeline.restored_map(detailed(spark, sf_dir).withColumnRenamed("t1", "lulc"), new)


@query(f"""WITH {{G}}, {ST}, {SC}, {CLS}, {END_GOALS}, {CO}, {SU}, {CL}, {WI}, {RS}, n AS (SELECT g.r, g.c, t1, ci, coalesce(new, t1) AS k FROM g LEFT JOIN wi USING (r, c)), f AS (SELECT r, c, CASE WHEN k = t1 THEN {{CODE}}[ci + 1] ELSE k END AS k FROM n)
SELECT r, c, coalesce(rs.code, f.k) AS code FROM f LEFT JOIN rs USING (k)""")
def restored_map(spark, sf_dir):
    """The projected map over the base map, in detailed codes."""
    new = pipeline.project(layered(spark, sf_dir), COEFFICIENTS, end_goals(spark, sf_dir), "t1")
    return pipeline.restored_map(detailed(spark, sf_dir).withColumnRenamed("t1", "lulc"), new)


@query(f"WITH {{G}}, {CO}, {SU}, {GO}, {CL} SELECT r, c, CAST(class_id AS INTEGER) AS class_id FROM cl")
def allocated_cells(spark, sf_dir):
    """Each class's cells, one of the diagnostics of an allocation."""
    return allocate.diagnostics(layered(spark, sf_dir), COEFFICIENTS, goals_of(spark, sf_dir), "t1", level=5)["allocation"]


@query(f"WITH {{G}}, {CO}, {SU}, {GO}, {CL}, {WI}, d AS ({DONE}) SELECT 'projected' AS output, lulc AS class_id, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT x, CAST(class_id AS INTEGER), count(*) FROM su, (SELECT unnest(['suitability', 'rank']) AS x) GROUP BY ALL UNION ALL SELECT 'allocation', CAST(class_id AS INTEGER), count(*) FROM cl GROUP BY ALL")
def diagnostic_outputs(spark, sf_dir):
    """Rows by class of every output of the most telling level."""
    found = allocate.diagnostics(layered(spark, sf_dir), COEFFICIENTS, goals_of(spark, sf_dir), "t1", level=11)
    each = [x.select(F.lit(name).alias("output"), F.col("lulc" if name == "projected" else "class_id").cast("int").alias("class_id")) for name, x in found.items()]
    return grid.stitch(each).groupBy("output", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45)")
def skip_completed(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return zones.skip_completed(load(spark, sf_dir, "part").select("p_partkey"), done, ["p_partkey"])


@query("""WITH q AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'use_generated' ELSE '/d/base_data/' || p_brand || '/' || p_partkey || '.tif' END AS path FROM part), e AS (SELECT path FROM q WHERE path LIKE '%1.tif')
SELECT path, 'base_data/' || split_part(path, 'base_data/', 2) AS source FROM q WHERE path <> 'use_generated' AND path NOT IN (SELECT path FROM e)""")
def missing_inputs(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    path = F.when(F.col("p_size") % 7 == 0, "use_generated").otherwise(F.concat(F.lit("/d/base_data/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tif")))
    required = p.select(path.alias("path"))
    return zones.missing_inputs(required, required.where(F.col("path").endswith("1.tif")))


@query("WITH {G}, a AS (SELECT cr, cc, min(t1) AS m FROM g GROUP BY ALL), b AS (SELECT cr, cc, max(t2) AS m FROM g WHERE ha = 2 AND x1 > 1 AND cc < 6 GROUP BY ALL) SELECT cr, cc, coalesce(b.m, a.m) AS m FROM a LEFT JOIN b USING (cr, cc)")
def coalesce_source(spark, sf_dir):
    x = cells(spark, sf_dir)
    return zones.coalesce_source(x.where("ha = 2 AND x1 > 1 AND cc < 6").groupBy("cr", "cc").agg(F.max("t2").alias("m")), x.groupBy("cr", "cc").agg(F.min("t1").alias("m")), ["cr", "cc"], "m")


@query("WITH {G}, l AS (SELECT r, c, cr, cc FROM g WHERE c >= 30), e AS (SELECT min(r), min(c), max(r), max(c) FROM g), le AS (SELECT min(r), min(c), max(r), max(c) FROM l) SELECT DISTINCT cr, cc FROM g WHERE (SELECT count(*) FROM (FROM e INTERSECT FROM le)) = 1 UNION SELECT DISTINCT cr, cc FROM l WHERE (SELECT count(*) FROM (FROM e INTERSECT FROM le)) = 0")
def blocks_for_extent(spark, sf_dir):
    x = cells(spark, sf_dir)
    part = x.where("c >= 30")
    return zones.blocks_for(grid.extent(part), grid.extent(x), x.select("cr", "cc").distinct(), part.select("cr", "cc").distinct())


@query("WITH {G}, b AS (SELECT DISTINCT cr // 3 AS zone, cr, cc FROM g) SELECT CAST(zone AS INTEGER) AS zone, cr, cc FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY cr, cc) AS i, count(*) OVER (PARTITION BY zone) AS n FROM b) WHERE i = n // 2 + 1")
def zone_representative(spark, sf_dir):
    b = cells(spark, sf_dir).select(F.floor(F.col("cr") / 3).cast("int").alias("zone"), "cr", "cc").distinct()
    return zones.zone_representative(b, "zone", ["cr", "cc"])


@query("WITH {G}, b AS (SELECT DISTINCT cr, cc FROM g) SELECT cr, cc, CAST(k AS INTEGER) AS position FROM (SELECT *, row_number() OVER (ORDER BY cr, cc) - 1 AS k FROM b) WHERE k IN (0, 2, 5)")
def subset_by_position(spark, sf_dir):
    b = cells(spark, sf_dir).select("cr", "cc").distinct()
    return grid.subset_by_position(b, ["cr", "cc"], [0, 2, 5])


# ---- polygons
POLYGONS = [(1, [10.0, 60.0, 35.0], [2.0, 5.0, 14.0]), (2, [30.0, 90.0, 90.0, 30.0], [0.0, 0.0, 9.0, 9.0])]


def halfplanes(k: int, x: list[float], y: list[float]) -> str:
    n = len(x)
    tests = [f"({x[(i + 1) % n] - x[i]}) * (r + 0.5 - ({y[i]})) - ({y[(i + 1) % n] - y[i]}) * (c + 0.5 - ({x[i]})) > 0" for i in range(n)]
    return f"SELECT r, c, {k} AS id FROM g WHERE {' AND '.join(tests)}"


PO = "po AS (" + " UNION ALL ".join(halfplanes(*p) for p in POLYGONS) + ")"


def polygons(spark):
    return spark.createDataFrame(POLYGONS, "id int, x array<double>, y array<double>")


@query(f"WITH {{G}}, {PO} SELECT r, c, id FROM po")
def polygon_rasterize(spark, sf_dir):
    return vector.rasterize(cells(spark, sf_dir), polygons(spark))


def edges(k: int, x: list[float], y: list[float]) -> str:
    n = len(x)
    return ", ".join(f"({k}, {x[i]}, {y[i]}, {x[(i + 1) % n]}, {y[(i + 1) % n]})" for i in range(n))


@query(f"""WITH {{G}}, {PO}, v(id, a, b, d, e) AS (VALUES {', '.join(edges(*p) for p in POLYGONS)}), ed AS (SELECT id, CAST(a AS DOUBLE) AS xa, CAST(b AS DOUBLE) AS ya, CAST(d AS DOUBLE) AS xb, CAST(e AS DOUBLE) AS yb FROM v)
SELECT r, c, id FROM po UNION SELECT r, c, id FROM g, ed WHERE least(xa, xb) < c + 1 AND greatest(xa, xb) > c AND least(ya, yb) < r + 1 AND greatest(ya, yb) > r
AND abs((xb - xa) * (r + 0.5 - ya) - (yb - ya) * (c + 0.5 - xa)) < 0.5 * (abs(xb - xa) + abs(yb - ya))""")
def polygon_touched(spark, sf_dir):
    return vector.rasterize(cells(spark, sf_dir), polygons(spark), all_touched=True)


@query(f"WITH {{G}}, {PO} SELECT a.id AS id, b.id AS other, count(*) AS n FROM po a JOIN po b USING (r, c) GROUP BY ALL")
def zone_overlay(spark, sf_dir):
    x = vector.rasterize(cells(spark, sf_dir), polygons(spark))
    return vector.cell_overlay(x, x.withColumnRenamed("id", "other"), "id", "other")


# ---- polygons from tables
STAR = [(0, 0, i, dx, dy, "o") for i, (dx, dy) in enumerate([(1.0, 0.0), (0.75, 0.75), (0.0, 1.0), (-0.75, 0.75), (-1.0, 0.0), (-0.75, -0.75), (0.0, -1.0), (0.75, -0.75)])]
STAR += [(part, ring, i, dx, dy, kind) for part, ring, kind in ((0, 1, "h"), (1, 0, "p")) for i, (dx, dy) in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)])]
#: A supplier's polygon: a star of eight points with a hole, and for one in four a second part beside it; a nation's star has longer points.
SHAPES = {"supplier": ("s_suppkey", 37, 7, 6), "nation": ("n_nationkey", 53, 11, 9)}


def star_sql(table: str, name: str) -> str:
    """Edges of the polygons of a table."""
    key, a, b, reach = SHAPES[table]
    return f"""{name}_v(part, ring, i, dx, dy, kind) AS (VALUES {', '.join(f"({p}, {q}, {i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), '{k}')" for p, q, i, x, y, k in STAR)}),
{name}_p AS (SELECT {key} AS id, part, ring, i, ({key} * {a}) % 100 + CAST(0.25 AS DOUBLE) + CASE kind WHEN 'p' THEN 20 ELSE 0 END + dx * m AS x, ({key} * {b}) % 15 + 15 * ({key} // 10 % 10) + CAST(0.25 AS DOUBLE) + dy * m AS y
  FROM (SELECT *, CASE kind WHEN 'o' THEN CASE WHEN i % 2 = 0 THEN CAST({reach} + {key} % 3 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END WHEN 'h' THEN CAST(1 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS m FROM {table}, {name}_v WHERE kind <> 'p' OR {key} % 4 = 0)),
{name} AS (SELECT p.id, p.part, p.ring, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM {name}_p p JOIN {name}_p q ON p.id = q.id AND p.part = q.part AND p.ring = q.ring AND q.i = (p.i + 1) % CASE WHEN p.part = 0 AND p.ring = 0 THEN 8 ELSE 4 END)"""


def stars(spark, sf_dir, table: str = "supplier") -> DataFrame:
    """(id, wkb) of a table's multipolygons."""
    name, a, b, reach = SHAPES[table]
    key = F.col(name)

    def ring(part: int, hole: int):
        points = []
        for p, q, i, dx, dy, kind in STAR:
            if (p, q) == (part, hole):
                far = (F.lit(reach) + key % 3).cast("double") if kind == "o" and i % 2 == 0 else F.lit({"o": 2.5, "h": 1.0, "p": 3.0}[kind])
                x = key * a % 100 + F.lit(0.25) + F.lit(20 if kind == "p" else 0) + dx * far
                y = key * b % 15 + 15 * (F.floor(key / 10) % 10) + F.lit(0.25) + dy * far
                points.append(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
        return F.array(*points, points[0])

    one, two = F.array(ring(0, 0), ring(0, 1)), F.array(ring(1, 0))
    polygons = F.when(key % 4 == 0, F.array(one, two)).otherwise(F.array(one))
    return load(spark, sf_dir, table).select(key.cast("long").alias("id"), geometry.wkb_of(polygons).alias("wkb"))


INSIDE = "SELECT g.r, g.c, e.id FROM g JOIN st e ON (e.y0 <= g.r + CAST(0.5 AS DOUBLE)) <> (e.y1 <= g.r + CAST(0.5 AS DOUBLE)) AND e.x0 + (g.r + CAST(0.5 AS DOUBLE) - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) <= g.c + CAST(0.5 AS DOUBLE) GROUP BY ALL HAVING count(*) % 2 = 1"


@query(f"WITH {{G}}, {star_sql('supplier', 'st')} {INSIDE}")
def star_rasterize(spark, sf_dir):
    """Cells of the suppliers' multipolygons, by scanlines."""
    return geometry.rasterize_scanline(geometry.edges_of_wkb(stars(spark, sf_dir)), n_rows(cells(spark, sf_dir)), COLS, ["id"])


@query(f"WITH {{G}}, {star_sql('supplier', 'st')}, i AS ({INSIDE}) SELECT r, c, max(id) AS id FROM i GROUP BY r, c")
def star_id_raster(spark, sf_dir):
    """One supplier for each covered cell."""
    return geometry.id_raster(geometry.edges_of_wkb(stars(spark, sf_dir)), n_rows(cells(spark, sf_dir)), COLS)


@query(f"WITH {star_sql('supplier', 'st')}, a AS (SELECT id, part, ring, abs(sum((x0 * y1 - x1 * y0) / 2)) AS a FROM st GROUP BY ALL) SELECT id, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END), 6) AS area FROM a GROUP BY id")
def star_areas(spark, sf_dir):
    return geometry.areas(geometry.edges_of_wkb(stars(spark, sf_dir)), ["id"]).select("id", F.round("area", 6).alias("area"))


@query()
def star_intersections(spark, sf_dir):
    """Areas that suppliers' and nations' multipolygons share; tests hold the operator against signed triangles."""
    left, right = (geometry.edges_of_wkb(stars(spark, sf_dir, t)).withColumnRenamed("id", n) for t, n in (("supplier", "supplier"), ("nation", "nation")))
    return geometry.shared_areas(left, right, "supplier", "nation").withColumn("area", F.round("area", 6))


BOXES = "b AS (SELECT c_custkey AS id, c_custkey % 10 AS k, CAST(c_custkey * 37 % 400 AS DOUBLE) AS x, CAST(c_custkey * 91 % 300 AS DOUBLE) / 2 AS y, CAST(3 + c_custkey % 7 AS DOUBLE) AS w, CAST(2 + c_custkey % 5 AS DOUBLE) AS h FROM customer)"


@query(f"WITH {BOXES} SELECT p.id AS a, q.id AS b, (least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * (least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS area FROM b p JOIN b q ON p.k = 0 AND q.k <> 0 AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.h AND q.y < p.y + p.h")
def box_intersections(spark, sf_dir):
    """Areas that one customer in ten's rectangle shares with those of the others."""
    k = F.col("c_custkey")
    x, y = (k * 37 % 400).cast("double"), (k * 91 % 300).cast("double") / 2
    w, h = (3 + k % 7).cast("double"), (2 + k % 5).cast("double")
    rings = load(spark, sf_dir, "customer").select(k.cast("long").alias("id"), F.array(x, x + w, x + w, x).alias("x"), F.array(y, y, y + h, y + h).alias("y"))
    left, right = (geometry.edges_of_rings(rings.where(test)).withColumnRenamed("id", n) for test, n in (("id % 10 = 0", "a"), ("id % 10 <> 0", "b")))
    return geometry.shared_areas(left, right, "a", "b", 16.0)


# ---- all scenarios at once
KINDS = {"x1": allocate.ADDITIVE, "x2": allocate.ADDITIVE} | {f"is_{j}": allocate.MULTIPLICATIVE for j in CLASSES}
KEYED_SU = "su AS (SELECT g.r, g.c, g.cr, g.cc, t1, ha, k.scenario, k.policy, k.class_id, (b1 + zone) * x1 + b2 * x2 AS s FROM g JOIN k ON k.zone = g.cr // 3 % 3 WHERE t1 <> k.class_id AND t1 <= 5)"


@query(f"""WITH {{G}}, {CO}, {GO.replace('go AS', 'go1 AS')}, k AS (SELECT r_regionkey AS scenario, p AS policy, z AS zone, class_id, b1, b2 + r_regionkey / CAST(4 AS DOUBLE) AS b2 FROM co, region, (SELECT unnest([0, 1]) AS p), (SELECT unnest([0, 1, 2]) AS z)),
go AS (SELECT scenario, policy, cr, cc, class_id, goal * (1 + policy) AS goal FROM go1, (SELECT DISTINCT scenario, policy FROM k)), {KEYED_SU},
cl AS (SELECT scenario, policy, r, c, class_id, rn FROM (
  SELECT scenario, policy, r, c, class_id, goal, row_number() OVER w AS rn, coalesce(sum(ha) OVER (PARTITION BY scenario, policy, cr, cc, class_id ORDER BY s DESC, r, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM su JOIN go USING (scenario, policy, cr, cc, class_id) WHERE goal > 0 AND s <> 0 WINDOW w AS (PARTITION BY scenario, policy, cr, cc, class_id ORDER BY s DESC, r, c)) WHERE prior < goal),
wi AS (SELECT scenario, policy, r, c, class_id AS new FROM (SELECT *, row_number() OVER (PARTITION BY scenario, policy, r, c ORDER BY rn DESC, class_id DESC) AS k FROM cl) WHERE k = 1)
SELECT scenario, policy, r, c, CAST(coalesce(new, t1) AS INTEGER) AS lulc FROM g CROSS JOIN (SELECT DISTINCT scenario, policy FROM k) LEFT JOIN wi USING (scenario, policy, r, c)""")
def allocate_scenarios(spark, sf_dir):
    """Maps of every scenario and policy in one plan, each zone with the coefficients trained for it."""
    x = layered(spark, sf_dir).withColumn("zone", (F.floor(F.col("cr") / 3) % 3).cast("int"))
    start = spark.createDataFrame([(z, n, k, float(b) + (z if n == "x1" else 0)) for z in range(3) for k, rows in COEFFICIENTS.items() for n, _, b in rows], "zone int, layer string, class_id int, beta double")
    plans = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("scenario")).withColumn("policy", F.explode(F.array(F.lit(0), F.lit(1))))
    table = plans.crossJoin(start).withColumn("beta", F.when(F.col("layer") == "x2", F.col("beta") + F.col("scenario") / 4).otherwise(F.col("beta")))  # scenarios are few
    goals = goals_of(spark, sf_dir).crossJoin(F.broadcast(plans)).withColumn("goal", F.col("goal") * (1 + F.col("policy")))
    return allocate.allocate_keyed(x, table, goals, ["scenario", "policy"], ["zone"], KINDS, "t1")


# ---- all levels of a map
@query("WITH {G}, l AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS level), n AS (SELECT level, r // (1 << level) AS r, c // (1 << level) AS c, t1, count(*) AS n FROM g, l GROUP BY ALL) SELECT level, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, t1 FROM (SELECT *, row_number() OVER (PARTITION BY level, r, c ORDER BY n DESC, t1) AS k FROM n) WHERE k = 1")
def overview_pyramid(spark, sf_dir):
    return pyramid.pyramid(cells(spark, sf_dir), "t1", 5).drop("key")


@query("WITH {G}, l AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS level) SELECT level, CAST(r // (1 << level) AS INTEGER) AS r, CAST(c // (1 << level) AS INTEGER) AS c, t1, count(*) AS n FROM g, l GROUP BY ALL")
def pyramid_histograms(spark, sf_dir):
    return pyramid.histograms(cells(spark, sf_dir), "t1", 5)


@query("WITH {G} SELECT r, c, CAST(list_sum([((r >> i) & 1) * (1 << (2 * i + 1)) + ((c >> i) & 1) * (1 << (2 * i)) for i in range(12)]) AS BIGINT) AS key FROM g")
def morton_keys(spark, sf_dir):
    return cells(spark, sf_dir).select("r", "c", pyramid.morton().alias("key"))
