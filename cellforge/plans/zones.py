"""Scenarios, zones and what is left to do: the plans around the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellforge.operators.remap import change_present


def scenario_product(scenarios: DataFrame, years: DataFrame, policies: DataFrame) -> DataFrame:
    """Every scenario, year and policy; the lists are short by their nature."""
    return scenarios.crossJoin(years).crossJoin(policies)


def flatten_paths(spark: SparkSession, tree: dict, names: Sequence[str]) -> DataFrame:
    """A nested dictionary's leaves as rows, one column for each level and ``path``."""

    def walk(node, head):
        for k, v in node.items():
            yield from walk(v, [*head, str(k)]) if isinstance(v, dict) else [(*head, str(k), str(v))]

    return spark.createDataFrame(list(walk(tree, [])), ", ".join(f"`{n}` string" for n in [*names, "path"]))


def prune_unchanged(zones: DataFrame, changes: DataFrame, key: Sequence[str], value: str = "change") -> DataFrame:
    """Zones in which some class changes."""
    return zones.join(changes.where(change_present(F.col(value))), list(key), "left_semi")


def any_change(changes: DataFrame, key: Sequence[str], value: str = "change") -> DataFrame:
    return changes.groupBy(*key).agg(F.bool_or(change_present(F.col(value))).alias("any_change"))


def skip_completed(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    return todo.join(done, list(key), "left_anti")


def missing_inputs(required: DataFrame, existing: DataFrame, path: str = "path", prefix: str = "base_data") -> DataFrame:
    """(path, source): required paths that neither exist nor are generated, with their place below ``prefix``."""
    x = required.where(F.col(path) != "use_generated").join(existing.select(path), path, "left_anti")
    tail = F.element_at(F.split(F.col(path), f"{prefix}/"), -1)
    return x.select(path, F.concat_ws("/", F.lit(prefix), tail).alias("source"))


def coalesce_source(preferred: DataFrame, fallback: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The fallback's rows with the preferred value where there is one."""
    p = preferred.select(*key, F.col(value).alias("__p"))
    return fallback.join(p, list(key), "left").withColumn(value, F.coalesce("__p", value)).drop("__p")


def blocks_for(layer: DataFrame, whole: DataFrame, global_blocks: DataFrame, local_blocks: DataFrame) -> DataFrame:
    """The list of blocks that suits a layer: the global one where its extent is the whole grid's, else its own. Extents are single rows (r0, c0, r1, c1)."""
    corners = ["r0", "c0", "r1", "c1"]
    return global_blocks if layer.select(*corners).first() == whole.select(*corners).first() else local_blocks


def zone_representative(blocks: DataFrame, zone: str, order: Sequence[str]) -> DataFrame:
    """The block in the middle of each zone's list."""
    w = W.partitionBy(zone)
    x = blocks.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)))
    return x.where(F.col("__i") == F.floor(F.col("__n") / 2) + 1).drop("__n", "__i")


def coefficients_for(zones: DataFrame, tables: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each zone (or scenario, year, policy) with its trained coefficients."""
    return zones.join(tables, list(key))


def check_layers(states: DataFrame, expected: int = 14, state: str = "state") -> None:
    """Fails unless an extract has exactly ``expected`` layers."""
    n = states.agg(F.count_distinct(state).alias("n")).first()["n"]
    if n != expected:
        raise ValueError(f"{n} layers, not {expected}")


def class_inverse(table: DataFrame, state: str = "state", cls: str = "class") -> DataFrame:
    """(class, states): the members of each class."""
    return table.groupBy(cls).agg(F.sort_array(F.collect_list(state)).alias("states"))
