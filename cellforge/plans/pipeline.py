"""The allocation model from maps and coarse states to a restored map, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.config import RESTORE, STATES
from cellforge.operators import allocate, coarse, grid, remap


def class_goals(states: DataFrame, hectares: DataFrame, base_year: int, year: int, classes: Mapping[str, int], table: Mapping[str, str] = STATES) -> DataFrame:
    """(cr, cc, class_id, goal) from coarse states (year, state, cr, cc, share): shares to classes to hectares to differences."""
    named = lambda y: coarse.states_to_classes(states.where(F.col("year") == y), table, hectares)
    x = coarse.difference(named(base_year), named(year), ["cr", "cc", "class"])
    return x.select("cr", "cc", remap_class(classes).alias("class_id"), F.col("change").alias("goal")).where("class_id IS NOT NULL")


def remap_class(classes: Mapping[str, int]):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in classes.items() for x in kv)), F.col("class"))


def project(cells: DataFrame, coefficients: Mapping[int, Sequence[tuple[str, str, float]]], goals: DataFrame, lulc: str = "lulc", method: str = "gridded") -> DataFrame:
    """(r, c, lulc) by one of the allocation methods."""
    run = {"gridded": allocate.allocate_gridded, "exclusive": allocate.allocate_exclusive, "matrix": allocate.allocate_from_matrix}[method]
    return run(cells, coefficients, goals, lulc)


def restored_map(base: DataFrame, projected: DataFrame, lulc: str = "lulc", detailed: str = "code", table: Mapping[int, int] = RESTORE) -> DataFrame:
    """(r, c, code): projected classes over the base map, with detailed codes where nothing changed."""
    top = grid.overlay(base.select("r", "c", lulc), projected.select("r", "c", F.col("lulc").alias(lulc)), lulc).withColumnRenamed(lulc, "__new")
    x = base.join(top, ["r", "c"])
    filled = remap.fill_where_not_changed(F.col("__new"), F.col(lulc), F.col(detailed))
    return x.select("r", "c", remap.restore_detailed(filled, table).alias("code"))
