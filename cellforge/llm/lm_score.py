"""Document scores by masked pseudo-likelihood under a bidirectional window network.

The vocabulary comes from word counts over the whole corpus: the most frequent words have entries of
their own, the others share hashed ones. The network sees the embeddings of the words around a masked
place, weighted by their distance and side, and predicts the word in up to three steps: its class, the
entry within the class, and for a shared entry the word within the entry, by its share of the entry's
words in the corpus. So every word of the corpus has a probability of its own, and a prediction costs a
few hundred multiplications. Tasks train by SGD in numpy on their own documents from common starting
weights, and the weights are averaged, ROUNDS times; every document is trained on in one of the rounds.
A document's score is the sum of the log-probabilities of all its words, each given both sides.

The shares are a table as long as the corpus has words. Scoring meets them by joins: a slice of
documents keeps each word of shared entries once, by its hash, and the documents' places in that list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, stored, word_codes

CLASSES = 48
WORDS, SHARED = CLASSES * CLASSES - 256, 256
DIMS, WINDOW, RATE, BATCH = 16, 3, 0.08, 2048
#: Rounds of training; each takes its part of the documents, by a hash of the text, and together they take all.
ROUNDS = 2
GROUPS = 16


@dataclass
class Model:
    words: list[str]
    inputs: np.ndarray  # entry x DIMS
    sides: np.ndarray  # place x DIMS
    classes: np.ndarray  # DIMS + 1 x CLASSES
    within: np.ndarray  # CLASSES x (DIMS + 1) x CLASSES


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words between white space, lower-cased, over all of ``docs``; counted within each batch before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, codes, words = word_codes(pc.utf8_lower(batch.column(text)))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_shares(counts: DataFrame, words: Sequence[str]) -> DataFrame:
    """(hash, entry, n, log_share) of each of ``counts`` but ``words``: its shared entry, and the log of its part of that entry's words.

    Words of one 64-bit hash would be mistaken for each other.
    """
    own = counts.sparkSession.createDataFrame([(w,) for w in words], "word string")  # WORDS rows at most
    rest = counts.join(F.broadcast(own), "word", "left_anti").select(F.xxhash64("word").alias("hash"), "n")
    rest = rest.withColumn("entry", WORDS + F.pmod("hash", F.lit(SHARED)).cast("int"))
    totals = rest.groupBy("entry").agg(F.sum("n").alias("total"))  # SHARED rows at most
    return rest.join(F.broadcast(totals), "entry").select("hash", "entry", "n", F.log(F.col("n") / F.col("total")).alias("log_share"))


def start(vocabulary: list[tuple[str, int]], shared: np.ndarray, seed: int = 3) -> Model:
    """Weights before training: small random inputs, and biases that give each entry its share of the corpus, of which ``shared`` entries hold so many words.

    Entries go to classes by frequency in turn, so all classes carry like shares.
    """
    rng = np.random.default_rng(seed)
    entries = CLASSES * CLASSES
    n = np.full(entries, 1.0)
    n[: len(vocabulary)] += [c for _, c in vocabulary]
    n[WORDS:] += shared
    table = n.reshape(CLASSES, CLASSES).T  # entry e: class e % CLASSES, place e // CLASSES
    classes, within = np.zeros((DIMS + 1, CLASSES)), np.zeros((CLASSES, DIMS + 1, CLASSES))
    classes[-1] = np.log(table.sum(1) / n.sum())
    within[:, -1] = np.log(table / table.sum(1, keepdims=True))
    sides = np.repeat(1.0 / (np.abs(np.r_[-WINDOW:0, 1 : WINDOW + 1]))[:, None], DIMS, axis=1) / 2
    return Model([w for w, _ in vocabulary], rng.normal(0, 0.1, (entries + 1, DIMS)).astype(np.float32), sides.astype(np.float32), classes.astype(np.float32), within.astype(np.float32))


@dataclass
class Coded:
    """Texts as vocabulary entries, flat, with the bounds of each text."""

    entries: np.ndarray
    bounds: np.ndarray
    rare: np.ndarray  # for each word of a shared entry, its place in ``hashes``; else -1
    hashes: np.ndarray  # of the distinct words of shared entries


def coded(texts: pa.Array, known: pa.Array) -> Coded:
    bounds, codes, words = word_codes(pc.utf8_lower(texts))
    own = pc.fill_null(pc.index_in(words, known.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rest = own < 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.filter(pa.array(rest)).to_pylist()), np.uint64, int(rest.sum())).view(np.int64)  # as Spark hashes
    own[rest] = WORDS + hashes % SHARED
    place = np.where(rest, np.cumsum(rest) - 1, -1).astype(np.int32)
    return Coded(own[codes], bounds, place[codes], hashes)


def _small(n: int) -> type:
    """An integer type for numbers below ``n``; the smallest ones are sorted by their digits."""
    return np.uint16 if n < 1 << 16 else np.int64


def surroundings(entries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Entries at the 2 * WINDOW places around each word, a row for each place; beyond its text, the empty entry."""
    n, empty = len(entries), CLASSES * CLASSES
    own, text = entries.astype(_small(empty + 1)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((2 * WINDOW, n), empty, own.dtype)
    for d in range(1, min(WINDOW, n - 1) + 1):
        same = text[d:] == text[:-d]
        np.copyto(out[WINDOW - d, d:], own[:-d], where=same)
        np.copyto(out[WINDOW + d - 1, :-d], own[d:], where=same)
    return out


def _log_chance(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of entry y in each column."""
    z -= z.max(0)
    own = z[y, np.arange(z.shape[1])].astype(np.float64)
    return own - np.log(np.exp(z, out=z).sum(0))


def hidden(m: Model, around: np.ndarray) -> np.ndarray:
    """DIMS + 1 x words."""
    x = np.zeros((around.shape[1], DIMS), np.float32)
    for k in range(2 * WINDOW):
        x += (m.inputs * m.sides[k]).take(around[k], axis=0)
    h = np.ones((DIMS + 1, len(x)), np.float32)
    np.tanh(x.T, out=h[:DIMS])
    return h


def _by_class(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """The order by class, classes and places in that order, and where each class lies in it."""
    c = entries % CLASSES
    order = np.argsort(c.astype(_small(CLASSES)), kind="stable")
    c = c[order]
    cuts = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    return order, c, entries[order] // CLASSES, [(k, slice(i, j)) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]


def _within(m: Model, h: np.ndarray, own: list[tuple[int, slice]]) -> np.ndarray:
    z = np.empty((CLASSES, h.shape[1]), np.float32)
    for k, at in own:
        np.matmul(m.within[k].T, h[:, at], out=z[:, at])
    return z


def log_probabilities(m: Model, entries: np.ndarray, bounds: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Of each word's entry, masked, given the words on both sides; ``block`` words at a time, which stay in the cache."""
    around = surroundings(entries, bounds)
    out = np.empty(len(entries))
    for a in range(0, len(entries), block):
        order, c, p, own = _by_class(entries[a : a + block])
        h = hidden(m, around[:, a : a + block][:, order])
        out[a + order] = _log_chance(m.classes.T @ h, c) + _log_chance(_within(m, h, own), p)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def train_on(m: Model, entries: np.ndarray, bounds: np.ndarray) -> None:
    """One pass of SGD over all words, in place."""
    around, places, all_entries = surroundings(entries, bounds), 2 * WINDOW, CLASSES * CLASSES + 1
    first_keys = (np.arange(places) * all_entries).astype(_small(places * all_entries))[:, None]
    for a in range(0, len(entries), BATCH):
        order, c, p, own = _by_class(entries[a : a + BATCH])
        near, at = around[:, a : a + BATCH][:, order], np.arange(len(c))
        h = hidden(m, near)
        g = _softmax(m.classes.T @ h)
        g[c, at] -= 1
        d_h = m.classes @ g
        d_classes = h @ g.T
        g = _softmax(_within(m, h, own))
        g[p, at] -= 1
        back, d_within = np.empty_like(d_h), np.zeros_like(m.within)
        for k, rows in own:
            np.matmul(m.within[k], g[:, rows], out=back[:, rows])
            np.matmul(h[:, rows], g[:, rows].T, out=d_within[k])
        d_h += back
        d_within *= (RATE / np.sqrt(8 * np.maximum(np.bincount(c, minlength=CLASSES), 1))).astype(np.float32)[:, None, None]
        m.within -= d_within
        m.classes -= d_classes * (RATE / math.sqrt(len(c) * 8))
        d_x = np.ascontiguousarray((d_h * (1 - h * h))[:DIMS].T)
        # gather the gradients of each place's equal entries before they are taken off
        keys = (near + first_keys).reshape(-1)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        place, e = np.divmod(keys[first].astype(np.int64), all_entries)
        gathered = np.add.reduceat(d_x.take(order % len(c), axis=0).view(np.complex64), first, axis=0).view(np.float32)  # two at a time
        rate = (RATE / np.sqrt(np.diff(np.append(first, len(keys))))).astype(np.float32)
        cuts = np.searchsorted(place, np.arange(places + 1))
        d_sides = np.add.reduceat(m.inputs[e] * gathered, cuts[:-1], axis=0)
        gathered *= m.sides[place]
        gathered *= rate[:, None]
        for i, j in zip(cuts, cuts[1:], strict=False):
            m.inputs[e[i:j]] -= gathered[i:j]
        m.sides -= d_sides * (0.1 * RATE / math.sqrt(len(c) * 8))


ARRAYS = ("inputs", "sides", "classes", "within")


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([getattr(m, n).reshape(-1) for n in ARRAYS])


def _unflat(m: Model, flat: np.ndarray) -> Model:
    at, made = 0, {}
    for n in ARRAYS:
        a = getattr(m, n)
        made[n] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
        at += a.size
    return Model(m.words, **made)


def _round(docs: DataFrame, m: Model, part: int, parts: int, text: str) -> Model:
    """Weights after training on the ``part``-th of ``parts`` of the documents, averaged over the tasks by their words."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**{k: v.copy() for k, v in asdict(m).items()})
        known, n = pa.array(own.words, pa.string()), 0
        for batch in slices(batches, text, 1 << 20):
            x = coded(batch.column(text), known)
            if len(x.entries):
                train_on(own, x.entries, x.bounds)
                n += len(x.entries)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_flat(own).astype(np.float32)], pa.list_(pa.float32()))], ["n", "weights"])

    def averaged(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].sum()
        total = sum(w * (k / n) for w, k in zip(rows["weights"], rows["n"], strict=True))
        return pd.DataFrame({"n": [n], "weights": [np.asarray(total, np.float32)]})

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(parts)) == part).select(text)
    each = some.mapInArrow(local, "n bigint, weights array<float>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    rows = each.groupBy("g").applyInPandas(lambda x: averaged(x.drop(columns="g")), "n bigint, weights array<float>").collect()  # GROUPS rows at most
    if not rows:
        return m
    rows.sort(key=lambda r: (r["n"], r["weights"][:4]))
    n = sum(r["n"] for r in rows)
    return _unflat(m, sum(np.asarray(r["weights"], np.float64) * (r["n"] / n) for r in rows))


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model of ``docs`` and its ``word_shares``: vocabulary, biases and shares from counts over all words, weights from all documents, dealt over the ``rounds``."""
    counts = stored(word_counts(docs, text))
    rows = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()  # WORDS rows at most
    shares = stored(word_shares(counts, [r["word"] for r in rows]))
    shared = np.zeros(SHARED)
    for r in shares.groupBy("entry").agg(F.sum("n").alias("n")).collect():  # SHARED rows at most
        shared[r["entry"] - WORDS] = r["n"]
    m = start([(r["word"], r["n"]) for r in rows], shared)
    for k in range(rounds):
        m = _round(docs.where(F.col(text).isNotNull()), m, k, rounds, text)
    return m, shares


def score(docs: DataFrame, m: Model, shares: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``n_tokens``, ``log_prob`` (the sum over all words) and ``mean_log_prob``; columns of those names are replaced.

    A text without words (null, empty) has 0 tokens, the sum 0 and no mean. A word that the corpus of
    ``shares`` lacks has its entry's probability.
    """
    made = ("n_tokens", "log_prob", "mean_log_prob")
    kept = [c for c in keep or docs.columns if c not in made]
    x = docs.select(*{text: None, **dict.fromkeys(kept)})
    piece, rare, hashes = (free_name(x, n) for n in ("piece", "rare", "hashes"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in x.select(*kept).schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = pa.array(m.words, pa.string()), TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, text)):
            x = coded(batch.column(text), known)
            total = np.concatenate([[0.0], np.cumsum(log_probabilities(m, x.entries, x.bounds))])
            n, s = np.diff(x.bounds), total[x.bounds[1:]] - total[x.bounds[:-1]]
            some = np.concatenate([[0], np.cumsum(x.rare >= 0)])[x.bounds]
            places = pa.ListArray.from_arrays(pa.array(some, pa.int32()), pa.array(x.rare[x.rare >= 0], pa.int32()))
            once = np.full(len(n) + 1, len(x.hashes), np.int32)  # the slice's list goes with its first row
            once[0] = 0
            lists = pa.ListArray.from_arrays(pa.array(once), pa.array(x.hashes, pa.int64()))
            own = [pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(np.full(len(n), task + k), pa.int64()), places, lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own], [*kept, "n_tokens", "log_prob", piece, rare, hashes])

    def summed(rows: pa.Table, words: pa.Table) -> pa.Table:
        own = np.zeros(words.num_rows and int(pc.max(words.column("place")).as_py()) + 1)
        own[words.column("place").to_numpy()] = words.column("log_share").to_numpy()
        lists, n = rows.column(rare).combine_chunks(), rows.column("n_tokens").to_numpy()
        places = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        own = np.append(own, np.zeros(max(0, places.max(initial=-1) + 1 - len(own))))
        at = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        s = rows.column("log_prob").to_numpy() + np.bincount(at, own[places], len(n))
        mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return rows.select([*kept, "n_tokens"]).append_column("log_prob", pa.array(s)).append_column("mean_log_prob", mean)

    rows = stored(x.mapInArrow(scored, fields + f"n_tokens bigint, log_prob double, `{piece}` bigint, `{rare}` array<int>, `{hashes}` array<bigint>"))
    words = rows.where(F.size(hashes) > 0).select(F.col(piece).alias("piece"), F.posexplode(hashes).alias("place", "hash"))
    words = words.join(shares.select("hash", "log_share"), "hash").select("piece", "place", "log_share")
    pieces = rows.drop(hashes).groupBy(piece).cogroup(words.groupBy("piece"))  # a slice each
    return pieces.applyInArrow(summed, fields + "n_tokens bigint, log_prob double, mean_log_prob double")


def op10_lm_score(docs: DataFrame) -> DataFrame:
    """Scores of each row, as ``score`` gives them, under a model of all rows. Repeated rows count and are scored each for itself; other columns are not read; no rows give no rows."""
    few = docs.select("doc_id", "text")
    return score(few, *fit(few), keep=["doc_id"])
