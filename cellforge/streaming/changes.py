"""Maps that arrive as files: running change matrices over a stream of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cellforge.operators.coarse import change_matrix


def stream_cells(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_change_matrix(cells: DataFrame, before: str, after: str, classes: Sequence[int], by: Sequence[str] = ("cr", "cc")) -> DataFrame:
    """The change matrix so far; its state is bounded by coarse cells times pairs of classes. Write in update or complete mode."""
    return change_matrix(cells, before, after, classes, by=by)
