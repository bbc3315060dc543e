"""Reading and writing grids: partitioned Parquet, text grids, arrays and tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.operators.pyramid import morton
from cellforge.storage import stored


def read_grid(spark: SparkSession, path: str, nodata: float | None = None, value: str | None = None) -> DataFrame:
    """A cell table; the no-data mark of ``value`` becomes NULL."""
    df = spark.read.parquet(path)
    if value is not None and nodata is not None:
        df = df.withColumn(value, F.when((F.col(value) != nodata) & ~F.isnan(F.col(value).cast("double")), F.col(value)))
    return df


def write_grid(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "ignore", nodata: float | None = None, value: str | None = None) -> None:
    """Parquet partitioned ``by`` scenario, year, zone...; an existing output is kept unless ``mode`` says otherwise."""
    if value is not None and nodata is not None:
        df = df.withColumn(value, F.coalesce(F.col(value), F.lit(nodata).cast(df.schema[value].dataType)))
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def year_slice(states: DataFrame, year: int) -> DataFrame:
    """One year of a table of coarse states; the filter reaches the scan."""
    return states.where(F.col("year") == year)


def _ascii_rows(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            lines = io.StringIO(content.decode())
            head = {}
            for _ in range(6):
                at = lines.tell()
                parts = lines.readline().split()
                if len(parts) == 2 and parts[0][0].isalpha():
                    head[parts[0].lower()] = float(parts[1])
                else:
                    lines.seek(at)
                    break
            nodata = head.get("nodata_value")
            for r, line in enumerate(lines):
                v = np.array(line.split(), float)
                mask = np.zeros(len(v), bool) if nodata is None else v == nodata
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.full(len(v), r, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v, mask=mask)], ["path", "r", "c", "value"])


def read_ascii_grid(spark: SparkSession, path: str, glob: str = "*.asc") -> DataFrame:
    """(path, r, c, value) of text grids with an optional header of up to six lines; a task holds one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_ascii_rows, "path string, r int, c int, value double")


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) by Spark's own listing, so any store works."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).drop("content")


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(layer, location, kind, class_label, beta) from a CSV whose columns from the fourth on are classes."""
    wide = spark.read.csv(path, header=True)
    names = wide.columns
    x = wide.select(F.col(names[0]).alias("layer"), F.col(names[1]).alias("location"), F.col(names[2]).alias("kind"), *(F.col(n).cast("double").alias(n) for n in names[3:]))
    return x.unpivot(["layer", "location", "kind"], names[3:], "class_label", "beta")


def write_coefficients(df: DataFrame, path: str, classes: list[str]) -> None:
    """(layer, location, kind, class_label, beta) as one CSV row for each layer."""
    df.groupBy("layer", "location", "kind").pivot("class_label", classes).agg(F.first("beta")).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a small table


def write_blocks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def read_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema)


def write_zone_lookup(df: DataFrame, path: str, zone: str = "zone_id", r: str = "r", c: str = "c") -> None:
    """Lines of zone,r_c."""
    df.select(F.concat_ws(",", F.col(zone), F.concat_ws("_", r, c))).write.mode("overwrite").text(path)


def write_clustered(df: DataFrame, path: str, files: int, by: tuple[str, ...] = (), group_bytes: int = 8 << 20, mode: str = "ignore") -> None:
    """Cells as about ``files`` Parquet files, each a stretch of the Z-shaped curve and sorted along it, in row groups of about ``group_bytes``; partitioned ``by`` further columns, whose cells then share files.

    Row groups hold compact areas, so the bounds of a window on r and c, which Parquet keeps for each group, rule out all groups that lie elsewhere.
    A partition is in as few files as its stretches need, not in one a task. Rows and columns may not be below 0.
    """
    key = free(df, "key")
    x = df.withColumn(key, morton()).repartitionByRange(files, *by, key).sortWithinPartitions(*by, key).drop(key)
    w = x.write.mode(mode).option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 20000)
    (w.partitionBy(*by) if by else w).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def committed(spark: SparkSession, path: str, by: list[str]) -> DataFrame | None:
    """(by..., n, checksum): the zones that ``commit_zones`` has finished under ``path``; None before the first."""
    try:
        return spark.read.parquet(f"{path}/manifest").select(*by, "n", "checksum")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit_zones(df: DataFrame, path: str, by: list[str], together: int | None = None) -> int:
    """Writes the zones of ``df`` that are not yet in the manifest, and enters them there; gives their number. A run that was killed is run again with the same arguments.

    Zones are written in batches of about ``together`` (all at once by default), each with dynamic partition overwrite: a zone that a killed run has left without an entry is
    replaced as a whole, never added to. A batch is entered, with each zone's number of rows and a checksum that does not depend on their order, after its files
    stand, from what was written. Zones that are entered are neither read from ``df`` nor written again, and a zone without rows is none.
    """
    spark, done = df.sparkSession, committed(df.sparkSession, path, by)
    zones = df.select(*by).distinct()
    todo = zones if done is None else zones.join(done, by, "left_anti")
    todo = stored(todo)
    n = todo.count()
    if not n:
        return 0
    batches = 1 if together is None else -(-n // together)
    for k in range(batches):
        mine = todo.where(F.pmod(F.xxhash64(*by), F.lit(batches)) == k)
        rows = df.join(mine, by, "left_semi").repartition(*by)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/cells")
        there = spark.read.schema(df.schema).parquet(f"{path}/cells").join(mine, by, "left_semi")
        rest = [c for c in df.columns if c not in by]
        there.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias("checksum")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return n
