"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a fresh local folder if Spark runs in one process, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage is cut."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, as a Parquet table in that folder: smaller, and columns can be read apart."""
    path = f"{_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``__row``, beside which helper columns may have any name."""
    return F.struct(*(docs[f"`{c.replace('`', '``')}`"] for c in docs.columns)).alias("__row")


def from_row(names: Iterable[str], **changed: Column) -> list[Column]:
    """The columns that ``as_row`` took in, as they were but for those in ``changed``, which replace columns of their name or follow."""
    names, new = list(names), {k.lower(): v.alias(k) for k, v in changed.items()}
    kept = [new.pop(n.lower(), F.col("__row").getField(n).alias(n)) for n in names]
    return [*kept, *new.values()]


def released() -> None:
    """Gives memory that Arrow and the allocator keep for later back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches between rows so that each piece holds about ``max_bytes`` of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    released()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ascii_lowered(texts: pa.Array) -> pa.Array:
    """``texts`` with A-Z as a-z and null as empty; all other bytes stay."""
    x = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = x.buffers()
    ends = np.frombuffer(ends, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    low = LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else LOWER[:0]
    return pa.LargeStringArray.from_buffers(len(x), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(low.tobytes()))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space of every text (null: none).

    Returns the bounds of each text in the flat word list, the flat codes and the distinct words
    that the codes point to.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = np.asarray(words.offsets).astype(np.int64)
    flat = words.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    kept = np.concatenate([[0], np.cumsum(full)])
    return kept[bounds], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())
