"""Suitability of cells for classes, and allocation of goals to the best cells.

A coarse cell's classes take cells in turns, each its next best, until its goal in hectares is
met. As each class takes one cell a turn, the turn of its n-th cell is n, and whether it gets there
depends only on the hectares of its better cells; so ranks and running sums give the result, and a
cell that several classes take goes to the last of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellforge.storage import stored

from .remap import CELL

COARSE = ["cr", "cc"]
ADDITIVE, MULTIPLICATIVE = "additive", "multiplicative"

#: Rows of cells, or of cells and keys, that are dealt to one task, so that what it holds does not grow with the table.
TASK_ROWS = 1 << 19
#: Layers up to which a sum by key is written out as one expression; a longer one would no longer be compiled.
WRITTEN_OUT = 24


def suitability_column(coefficients: Sequence[tuple[Column, str, float]]) -> Column:
    """Sum of beta * x over additive layers times the product of 1 - (1 - beta) * x over multiplicative ones.

    Layers with beta 0 (additive) or 1 (multiplicative) do not take part, so they are never read. A
    NULL in a layer that takes part makes the cell unsuitable (NULL).
    """
    total, factor = None, None
    for x, kind, beta in coefficients:
        if kind == MULTIPLICATIVE:
            if beta != 1:
                term = F.lit(1.0) - F.lit(1.0 - beta) * x
                factor = term if factor is None else factor * term
        elif beta != 0:
            term = F.lit(float(beta)) * x
            total = term if total is None else total + term
    if total is None:
        return F.lit(0.0)
    return total if factor is None else total * factor


def suitability(cells: DataFrame, coefficients: Mapping[int, Sequence[tuple[str, str, float]]], lulc: str = "lulc", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., r, c, cr, cc, lulc, ha, class_id, s) for each class other than the cell's own, from wide layers.

    ``coefficients`` has (layer, kind, beta) by class. Only allocatable rows remain, see ``allocatable``.
    """
    each = [F.struct(F.lit(k).alias("class_id"), suitability_column([(F.col(n), kind, b) for n, kind, b in c]).cast("double").alias("s")) for k, c in coefficients.items()]
    x = cells.select(*keep, *CELL, *COARSE, lulc, "ha", F.explode(F.array(*each)).alias("x"))
    x = x.select(*keep, *CELL, *COARSE, lulc, "ha", "x.class_id", "x.s")
    return x.where((F.col(lulc) != F.col("class_id")) & allocatable(F.col("s")))


def suitability_long(layers: DataFrame, coefficients: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """(by..., class_id, s) from long layers (by..., layer_id, x) and a table (layer_id, class_id, kind, beta), which is small and broadcast, so that a cell's layers stay together and are added up before they move."""
    x = layers.join(F.broadcast(coefficients), "layer_id")
    add, times = F.col("kind") != MULTIPLICATIVE, F.col("kind") == MULTIPLICATIVE
    lacking = F.count_if(F.col("x").isNull() & ~((add & (F.col("beta") == 0)) | (times & (F.col("beta") == 1))))
    total = F.coalesce(F.sum(F.when(add, F.col("beta") * F.col("x"))), F.lit(0.0))
    factor = F.coalesce(F.product(F.when(times, 1 - (1 - F.col("beta")) * F.col("x"))), F.lit(1.0))
    return x.groupBy(*by, "class_id").agg(F.when(lacking == 0, total * factor).alias("s"))


def allocatable(s: Column) -> Column:
    """Neither 0 nor next to it, nor beyond what the ranking takes; negative values rank behind all positive ones."""
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) >= 1e-14) & (s <= 9999999999999999.0) & (-s < 999999999.0)


def rank_cells(scored: DataFrame, by: Sequence[str] = (*COARSE, "class_id")) -> DataFrame:
    """Ranks from 1, the best first, equal ones by place."""
    return scored.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("s"), *CELL)).cast("long"))


def rank_output(scored: DataFrame, by: Sequence[str] = (*COARSE, "class_id")) -> DataFrame:
    """Ranks from 0 as a layer; beyond 999,999, 0."""
    return rank_cells(scored, by).withColumn("rank", F.when(F.col("rn") - 1 <= 999999, F.col("rn") - 1).otherwise(0)).drop("rn")


def live_goals(goals: DataFrame, by: Sequence[str] = COARSE) -> DataFrame:
    """Goals above 0 of coarse cells in which no goal is NaN."""
    bad = goals.where(F.isnan(F.col("goal").cast("double"))).select(*by, F.lit(1).alias("__bad")).distinct()
    return (goals.join(bad, list(by), "left_anti") if by else goals.join(bad, F.lit(True), "left_anti")).where("goal > 0")


def claims(scored: DataFrame, goals: DataFrame, by: Sequence[str] = COARSE) -> DataFrame:
    """Cells that each class takes: those before which it has taken less than its goal. The goals prune before the sort."""
    return _taken(scored.join(live_goals(goals, by), [*by, "class_id"]), by)


def _taken(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of scored cells beside their class's goal, those before which it is not met."""
    w = W.partitionBy(*by, "class_id").orderBy(F.desc("s"), *CELL)
    x = x.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("prior", F.coalesce(F.sum("ha").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return x.where(F.col("prior") < F.col("goal")).drop("prior", "goal")


def winners(taken: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., r, c, new): of the classes that took a cell the one that did so last, the higher class in the same turn."""
    return taken.groupBy(*keep, *CELL).agg(F.max_by("class_id", F.struct("rn", "class_id")).alias("new"))


def apply(cells: DataFrame, won: DataFrame, lulc: str = "lulc", keep: Sequence[str] = ()) -> DataFrame:
    return cells.select(*keep, *CELL, lulc).join(won, [*keep, *CELL], "left").select(*keep, *CELL, F.coalesce("new", lulc).alias("lulc"))


def allocate_gridded(cells: DataFrame, coefficients, goals: DataFrame, lulc: str = "lulc") -> DataFrame:
    """(r, c, lulc) after each coarse cell's goals (cr, cc, class_id, goal) are met as far as suitable cells go."""
    kept = _kept(cells, coefficients, lulc)
    n = tasks_for(kept, len(coefficients))
    return _onto(kept, _claims_of(kept, coefficients, goals, lulc, n), lulc, n)


def tasks_for(kept: DataFrame, times: int = 1) -> int:
    """Partitions in which no task has much more than ``TASK_ROWS`` rows, if each of ``kept``, a stored table, becomes ``times``."""
    return max(kept.sparkSession.sparkContext.defaultParallelism, -(-kept.count() * times // TASK_ROWS))


def _kept(cells: DataFrame, coefficients, lulc: str, more: Sequence[str] = ()) -> DataFrame:
    """The columns that an allocation reads, stored, as they are read more than once and their rows counted."""
    layers = [name for rows in coefficients.values() for name, kind, beta in rows if beta != (1 if kind == MULTIPLICATIVE else 0)]
    return stored(cells.select(*dict.fromkeys([*CELL, *COARSE, lulc, "ha", *more, *layers])))


def _goals_in_rows(goals: DataFrame, place: Sequence[str], keys: Sequence[str], n: int) -> DataFrame:
    """(place..., __g): ``live_goals`` of a coarse cell as an array of (keys..., class_id, goal), dealt by ``place`` into n tasks."""
    each = F.struct(*keys, "class_id", "goal")
    x = goals.where("goal > 0").repartition(n, *place).groupBy(*place, *keys)  # NaN is above 0
    x = x.agg(F.collect_list(each).alias("__g"), F.max(F.isnan(F.col("goal").cast("double"))).alias("__bad")).where("NOT __bad")
    return x.groupBy(*place).agg(F.flatten(F.collect_list("__g")).alias("__g"))


def _claims_of(cells: DataFrame, coefficients, goals: DataFrame, lulc: str, n: int) -> DataFrame:
    """``claims`` of ``suitability`` in one sort of n tasks: a cell meets its coarse cell's goals in one row and is scored only for classes that grow."""
    x = cells.repartition(n, *COARSE).join(_goals_in_rows(goals, COARSE, [], n).hint("merge"), COARSE).withColumn("__g", F.explode("__g"))
    x = x.where(F.col(lulc) != F.col("__g.class_id"))
    s = F.lit(None).cast("double")
    for k, c in coefficients.items():
        s = F.when(F.col("__g.class_id") == k, suitability_column([(F.col(name), kind, b) for name, kind, b in c]).cast("double")).otherwise(s)
    x = x.select(*CELL, *COARSE, "ha", "__g.class_id", "__g.goal", F.explode(F.array(s)).alias("s"))  # see _packed_sum
    return _taken(x.where(allocatable(F.col("s"))), COARSE)


def _onto(kept: DataFrame, taken: DataFrame, lulc: str, n: int) -> DataFrame:
    return apply(kept.select(*CELL, lulc).repartition(n, *CELL), winners(taken.repartition(n, *CELL)), lulc)


def claims_by_range(scored: DataFrame, goals: DataFrame) -> DataFrame:
    """As ``claims`` for one zone, (class_id, goal) over all cells, of any size.

    Cells are dealt out by ranges of (class, suitability) and stored; the hectares and cells of each range are summed, and
    a range's running sums begin where those before it end. Ranges beyond the goal are left out before any window.
    """
    x = scored.join(F.broadcast(live_goals(goals, [])), "class_id")  # a row for each class, by which no cell must move
    x = stored(x.repartitionByRange("class_id", F.desc("s"), *CELL).withColumn("part", F.spark_partition_id()))
    sums = x.groupBy("class_id", "part").agg(F.sum("ha").alias("ha"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("class_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a class
    before = sums.select("class_id", "part", F.coalesce(F.sum("ha").over(w), F.lit(0)).alias("ha0"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"))
    live = x.join(stored(before), ["class_id", "part"]).where("ha0 < goal")
    w = W.partitionBy("class_id", "part").orderBy(F.desc("s"), *CELL)
    live = live.withColumn("rn", F.col("n0") + F.row_number().over(w)).withColumn("prior", F.col("ha0") + F.coalesce(F.sum("ha").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return live.where("prior < goal").drop("prior", "goal", "part", "ha0", "n0")


def allocate_vector(cells: DataFrame, coefficients, goal_of: Mapping[int, float], lulc: str = "lulc") -> DataFrame:
    """One goal for each class over all of ``cells``, which is one zone: the ranking is by ranges, see ``claims_by_range``."""
    whole = cells.withColumns({"cr": F.lit(0), "cc": F.lit(0)})
    goals = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in goal_of.items()], "class_id int, goal double")
    return apply(cells, winners(claims_by_range(suitability(whole, coefficients, lulc), goals)), lulc)


def allocate_exclusive(cells: DataFrame, coefficients, goals: DataFrame, lulc: str = "lulc", presence: str | None = None) -> DataFrame:
    """As ``allocate_gridded``, but a cell whose class (in ``presence``, by default the map itself) has a goal above 0 in its coarse cell is not taken."""
    expanding = live_goals(goals).select(*COARSE, F.col("class_id").alias("__k")).distinct()
    own = F.col(presence or lulc)
    kept = _kept(cells, coefficients, lulc, [presence] if presence else [])
    n = tasks_for(kept, len(coefficients))
    free = kept.withColumn("__k", own.cast("int")).join(expanding, [*COARSE, "__k"], "left_anti").drop("__k")
    return _onto(kept, _claims_of(free, coefficients, goals, lulc, n), lulc, n)


def allocate_from_matrix(cells: DataFrame, coefficients, matrix: DataFrame, lulc: str = "lulc") -> DataFrame:
    """Quotas in cells from class to class (cr, cc, from_class, to_class, n): the best cells now of ``from_class`` go to ``to_class``."""
    s = suitability(cells, coefficients, lulc).withColumnRenamed(lulc, "from_class").withColumnRenamed("class_id", "to_class")
    x = s.join(matrix.where("from_class <> to_class AND n > 0"), [*COARSE, "from_class", "to_class"])
    w = W.partitionBy(*COARSE, "from_class", "to_class").orderBy(F.desc("s"), *CELL)
    taken = x.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= n").withColumnRenamed("to_class", "class_id")
    return apply(cells, winners(taken), lulc)


def diagnostics(cells: DataFrame, coefficients, goals: DataFrame, lulc: str = "lulc", level: int = 0) -> dict[str, DataFrame]:
    """Extra outputs of the same plan: the map from 4, suitability and each class's cells from 5, ranks from 11."""
    out: dict[str, DataFrame] = {}
    if level < 4:
        return out
    kept = _kept(cells, coefficients, lulc)
    n = tasks_for(kept, len(coefficients))
    taken = _claims_of(kept, coefficients, goals, lulc, n)
    if level >= 5:
        taken = stored(taken)
        out["suitability"] = suitability(kept, coefficients, lulc)
        out["allocation"] = taken.select(*CELL, "class_id")
    out["projected"] = _onto(kept, taken, lulc, n)
    if level >= 11:
        out["rank"] = rank_output(suitability(kept.repartition(n, *COARSE), coefficients, lulc))
    return out


def packed_coefficients(table: DataFrame, by: Sequence[str], layers: Mapping[str, str]) -> DataFrame:
    """(by..., class_id, __b, __m) from (by..., layer, class_id, beta): coefficients of the additive and the multiplicative ``layers`` (name: kind) in their order; those that are lacking are 0 and 1."""
    own = F.map_from_entries(F.collect_list(F.struct("layer", F.col("beta").cast("double"))))
    listed = lambda names, default: F.array(*(F.coalesce(F.try_element_at("own", F.lit(n)), F.lit(default)) for n in names)) if names else F.array().cast("array<double>")
    adds, times = _by_kind(layers)
    return table.groupBy(*by, "class_id").agg(own.alias("own")).select(*by, "class_id", listed(adds, 0.0).alias("__b"), listed(times, 1.0).alias("__m"))


def _by_kind(layers: Mapping[str, str]) -> tuple[list[str], list[str]]:
    return [n for n, kind in layers.items() if kind != MULTIPLICATIVE], [n for n, kind in layers.items() if kind == MULTIPLICATIVE]


def _packed_sum(layers: Mapping[str, str]) -> Column:
    """``suitability_column`` with the coefficients of ``packed_coefficients`` that stand in the row.

    Those who test the sum take it out of an array by ``explode``: Spark would else push the test below it and write the sum out once more for each comparison.
    """
    adds, times = _by_kind(layers)
    term = lambda b, v: F.when(b == 0, 0.0).otherwise(b * v)
    part = lambda m, v: F.when(m == 1, 1.0).otherwise(1 - (1 - m) * v)
    if len(layers) > WRITTEN_OUT:
        listed = lambda names: F.array(*(F.col(n).cast("double") for n in names)) if names else F.array().cast("array<double>")
        return F.aggregate(F.zip_with("__b", listed(adds), term), F.lit(0.0), lambda s, v: s + v) * F.aggregate(F.zip_with("__m", listed(times), part), F.lit(1.0), lambda s, v: s * v)
    total, factor = F.lit(0.0), F.lit(1.0)
    for i, n in enumerate(adds):
        total = total + term(F.col("__b")[i], F.col(n).cast("double"))
    for i, n in enumerate(times):
        factor = factor * part(F.col("__m")[i], F.col(n).cast("double"))
    return total * factor


def suitability_keyed(cells: DataFrame, table: DataFrame, keys: Sequence[str], match: Sequence[str], layers: Mapping[str, str], lulc: str = "lulc") -> DataFrame:
    """(keys..., r, c, cr, cc, lulc, ha, class_id, s): ``suitability`` of every cell under each key's own coefficients, in one plan.

    ``table`` has (match..., the ``keys`` that cells don't have, layer, class_id, beta), such as a table trained for each zone, scenario, year and policy. Cells
    meet it by ``match``, columns of theirs such as the zone. Its rows of arrays are stored, so that Spark knows their size and broadcasts them if they are small.
    """
    own = stored(packed_coefficients(table, list(dict.fromkeys([*match, *keys])), layers))
    x = cells.join(own, list(match)).where(F.col(lulc) != F.col("class_id"))
    x = x.select(*keys, *CELL, *COARSE, lulc, "ha", "class_id", F.explode(F.array(_packed_sum(layers))).alias("s"))
    return x.where(allocatable(F.col("s")))


def allocate_keyed(cells: DataFrame, table: DataFrame, goals: DataFrame, keys: Sequence[str], match: Sequence[str], layers: Mapping[str, str], lulc: str = "lulc") -> DataFrame:
    """(keys..., r, c, lulc): ``allocate_gridded`` for every key of ``goals`` (keys..., cr, cc, class_id, goal) at once, coefficients being joined by key; see ``suitability_keyed``.

    The cells of a key are kept apart from those of others in every join and window, so the result is that of separate runs. A key without goals leaves its map as it is,
    if ``table`` has it. Cells and goals move once, by coarse cell, before there is a row for each key: a cell meets the goals of all keys in one row, is
    scored only for classes that grow, and takes back the keys under which it was won in one row.
    """
    own = stored(packed_coefficients(table, list(dict.fromkeys([*match, *keys])), layers))
    known = own.select(*dict.fromkeys([*match, *keys])).distinct()
    seen = [k for k in keys if k in cells.columns]
    kept = stored(cells.select(*dict.fromkeys([*match, *seen, *CELL, *COARSE, lulc, "ha", *layers])))
    n = tasks_for(kept, known.groupBy(*match).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0])
    place, at = [*COARSE, *seen], [*CELL, *seen]
    other = [k for k in keys if k not in seen]
    x = kept.repartition(n, *place).join(_goals_in_rows(goals, place, other, n).hint("merge"), place).withColumn("__g", F.explode("__g")).where(F.col(lulc) != F.col("__g.class_id"))
    x = x.select(*kept.columns, *(F.col(f"__g.{k}") for k in [*other, "class_id", "goal"])).join(own, list(dict.fromkeys([*match, *keys, "class_id"])))
    x = x.select(*keys, *CELL, *COARSE, "ha", "class_id", "goal", F.explode(F.array(_packed_sum(layers))).alias("s")).where(allocatable(F.col("s")))
    key = F.struct(*keys) if keys else F.lit(0)
    won = winners(_taken(x, [*COARSE, *keys]).repartition(n, *at), keep=keys).groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), "new"))).alias("__won"))
    each = kept.select(*dict.fromkeys([*match, *at, lulc])).repartition(n, *at).join(won, at, "left").join(known, list(match))
    return each.select(*keys, *CELL, F.coalesce(F.try_element_at("__won", key), lulc).alias("lulc"))
