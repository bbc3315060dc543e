"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variable says whose mean is its source's repetition
rate; the variable is the inverse distribution function at a uniform number hashed from the seed and
the document's id. The copies are then dealt out at random over all partitions and sorted by a random
key within each, a global shuffle that follows from the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

SEED = 17
#: A target weight goes as this power of the source's size; 1 keeps the mix, 0 makes all sources equal.
TEMPERATURE = 0.5
#: Mean documents out for each document in.
EPOCHS = 1.0
#: Means above this are split into several Poisson variables, as exp(-mean) must not vanish.
MOST_MEAN = 64.0
UNIFORM = 1 << 52


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    key = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(UNIFORM))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, source: str = "source") -> DataFrame:
    """(source, n, rate): the mean repetitions that bring each source to its share of ``epochs`` times the rows.

    ``weights`` gives relative target weights by source (a source without one is left out); by
    default a weight is the source's count to the power ``temperature``. Null is a source like others.
    """
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        w = n.join(given, n["source"].eqNullSafe(given["source"]), "left").select(n["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = w.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return w.crossJoin(F.broadcast(total)).select("source", "n", (share * F.col("all_n") * F.lit(float(epochs)) / F.col("n")).alias("rate"))


def _poisson(rate: Column, key: Column, seed: int) -> Column:
    """Smallest k whose distribution function exceeds the uniform number, summed over equal parts of the mean."""
    parts = F.greatest(F.ceil(rate / F.lit(MOST_MEAN)), F.lit(1)).cast("int")
    mean = rate / parts

    def one(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, j.cast("string"))
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))
        # 12 standard deviations and 40 more: beyond, the function equals 1 in double precision.
        most = (mean + 12 * F.sqrt(mean) + 40).cast("int")
        end = F.aggregate(
            F.sequence(F.lit(1), most),
            start,
            lambda s, k: F.when(u < s["cdf"], s).otherwise(F.struct(k.alias("k"), (s["p"] * mean / k).alias("p"), (s["cdf"] + s["p"] * mean / k).alias("cdf"))),
        )
        return end["k"]

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, j: s + one(j))).otherwise(0)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, seed: int = SEED, key: str = "doc_id", source: str = "source", partitions: int | None = None, out: tuple[str, str] = ("copy", "shuffle_key")) -> DataFrame:
    """``docs`` repeated and shuffled, with the columns ``out`` added: the number of the copy (from 1) and the key of the shuffle (long). Columns of those names are replaced, others stay whatever their names.

    Rows with equal keys are repeated alike. A null key counts as a key of its own. The table of rates has one row per
    source; it is stored first, so Spark knows its size and broadcasts it only while that allows. No rows give no rows.
    """
    copy, order = out
    x = docs.drop(*out)
    own, rate, n = (free_name(x, name) for name in ("__source", "__rate", "__n"))
    r = stored(rates(docs, weights, epochs, temperature, source).select(F.col("source").alias(own), F.col("rate").alias(rate)))
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    x = x.join(r, F.col(source).eqNullSafe(F.col(own)), "inner")
    x = x.withColumn(n, _poisson(F.col(rate), id_text, seed)).where(F.col(n) > 0)
    x = x.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    x = x.withColumn(order, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), id_text, F.col(copy).cast("string"))), 1, 13), 16, 10).cast("long"))
    x = x.drop(n, own, rate)
    x = x.repartition(partitions, order) if partitions else x.repartition(order)
    return x.sortWithinPartitions(order, key, copy)


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` repeated and shuffled as ``mix`` does, with its own columns alone."""
    return mix(docs, out=(free_name(docs, "copy"), free_name(docs, "shuffle_key"))).select(*docs.columns)


def op4_source_mix(docs: DataFrame) -> DataFrame:
    """Every copy with its place in the shuffle and its whole text. A null id, source or text stays null; repeated rows are repeated alike."""
    x = mix(docs.select("doc_id", "source", "text"))
    return x.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP4_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(CAST(n AS DOUBLE), CAST({TEMPERATURE} AS DOUBLE)) AS w FROM n),
r AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () * CAST({EPOCHS} AS DOUBLE) / n AS rate FROM w),
d AS (
  SELECT doc_id, documents.source, text, greatest(CAST(ceil(rate / {MOST_MEAN}) AS INTEGER), 1) AS parts, rate
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source WHERE rate > 0),
u AS (
  SELECT doc_id, source, text, rate / parts AS mean, unnest(generate_series(1, parts)) AS j FROM d),
k AS (
  SELECT doc_id, source, text, mean,
    CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13) AS BIGINT) / CAST({UNIFORM} AS DOUBLE) AS u
  FROM u),
c AS (
  SELECT doc_id, source, text, CAST(sum((
    SELECT list_reduce(list_prepend({{'k': 0, 'p': exp(-mean), 'cdf': exp(-mean)}},
      list_transform(generate_series(1, CAST(floor(mean + 12 * sqrt(mean) + 40) AS BIGINT)), lambda i: {{'k': CAST(i AS INTEGER), 'p': CAST(0 AS DOUBLE), 'cdf': CAST(0 AS DOUBLE)}})),
      lambda s, x: CASE WHEN u < s.cdf THEN s ELSE {{'k': x.k, 'p': s.p * mean / x.k, 'cdf': s.cdf + s.p * mean / x.k}} END).k)) AS BIGINT) AS n
  FROM k GROUP BY doc_id, source, text),
e AS (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS copy FROM c WHERE n > 0)
SELECT doc_id, source, CAST(copy AS BIGINT) AS copy,
  CAST('0x' || substr(md5('{SEED}:order:' || doc_id || ':' || copy), 1, 13) AS BIGINT) AS shuffle_key,
  CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
FROM e
"""
