"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt by a hash into shards of about
SHARD pieces; for each shard several islands evolve packings on their own, their elites migrate, and
a last round crosses the elites and keeps the best. A crossover injects well-filled bins of one
parent whole, removes the receiver's bins that hold their pieces twice, and best-fits the displaced.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, word_codes

CAPACITY = 2048
SHARD, ISLANDS, POPULATION, GENERATIONS = 8192, 2, 4, 4
#: Words whose ids a Python worker keeps.
CACHE = 400_000
END = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TAIL = ".,;:!?"
#: Words with a letter whose lower case may depend on more than the letter stay whole; so does what may be a special token.
WHOLE = "[^\x00-\u012f\u0131-\u024f]|<\\|"


def word_parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as two parts whose ids are their own, one after the other: lower-cased, and the marks at the end (or "").

    Pieces never span letters and marks, and the tokenizer lower-cases each letter by itself.
    """
    whole = pc.match_substring_regex(words, WHOLE)
    core = pc.utf8_rtrim(words, characters=TAIL)
    apart = pc.and_(pc.match_substring_regex(core, r"\pL$"), pc.invert(whole))
    heads = pc.if_else(whole, words, pc.utf8_lower(pc.if_else(apart, core, words)))
    return heads, pc.if_else(apart, pc.replace_substring_regex(words, f"^.*[^{TAIL}]", ""), "")


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Token ids of texts. The tokenizer drops white space and no token spans it, so each distinct word is encoded once.

    Known words and their ids are kept as flat arrays, of some 20 bytes a word. Beyond CACHE words only
    those of the slice at hand stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pool, self.bounds = pa.array([""], pa.large_string()), np.zeros(0, np.uint32), np.zeros(2, np.int64)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a piece
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def of_worker(path: str) -> Encoder:
        """The one that this Python worker used in its tasks before, if any."""
        kept = sys.modules.setdefault("cellforge_worker", types.ModuleType("cellforge_worker")).__dict__
        if kept.get("encoder_path") != path:
            kept |= {"encoder": Encoder(path), "encoder_path": path}
        return kept["encoder"]

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.pool = np.concatenate([self.pool, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def _encode(self, fresh: pa.Array) -> None:
        # Words of letters alone are one piece each, so many go as one text, and their last ids tell them apart.
        alone = pc.utf8_is_alpha(fresh)
        plain, rest = fresh.filter(alone).to_pylist(), fresh.filter(pc.invert(alone)).to_pylist()
        for a in range(0, len(plain), 10_000):
            some = plain[a : a + 10_000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self._add(some, ids, np.diff(cuts, prepend=0))
            else:
                rest += some
        for a in range(0, len(rest), 10_000):
            some = rest[a : a + 10_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where each of the distinct ``parts`` is among the known words; those that are not known are learnt."""
        at = pc.index_in(parts, value_set=self.words)
        if at.null_count:
            if len(self.words) > CACHE:
                hit = np.union1d([0], at.drop_null().to_numpy())
                sizes = np.diff(self.bounds)[hit]
                self.words, self.pool = self.words.take(pa.array(hit)), _gather(self.pool, self.bounds[hit], sizes)
                self.bounds = np.concatenate([[0], np.cumsum(sizes)])
            self._encode(parts.filter(pc.is_null(at)))
            at = pc.index_in(parts, value_set=self.words)
        return at.to_numpy().astype(np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the bounds of each text, each text closed by END."""
        bounds, codes, words = word_codes(texts)
        if not len(codes):
            return np.zeros(len(bounds) - 1, np.uint32), np.arange(len(bounds))
        parts = pa.concat_arrays([x.cast(pa.large_string()) for x in word_parts(words)]).dictionary_encode()
        at = self.places(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T.reshape(-1)  # a word's two parts side by side
        sizes = np.diff(self.bounds)[at]
        pool = _gather(self.pool, self.bounds[at], sizes)  # ids of the distinct words
        sizes = sizes.reshape(-1, 2).sum(1)
        n = sizes[codes]
        flat = _gather(pool, (np.cumsum(sizes) - sizes)[codes], n)
        ends = np.concatenate([[0], np.cumsum(n)])[bounds]
        return np.insert(flat, ends[1:], END), ends + np.arange(len(ends))


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = Encoder.of_worker(path)
    for batch in slices(batches):
        ids, bounds = encode(batch.column("text"))
        rows = []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for k, s in enumerate(range(a, b, CAPACITY)):
                e = min(b, s + CAPACITY)
                rows.append((doc, k, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes())))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null or empty text is one piece of one token."""
    path = path or vocabulary_path()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda b: _pieces(b, path), PIECES)


class Bins:
    """Bins by what room they have; the tightest that takes a piece is found with one shift of a bit set."""

    def __init__(self, weight: list[int], bins: list[list[int]]):
        self.weight, self.bins, self.by_room, self.mask = weight, bins, [[] for _ in range(CAPACITY + 1)], 0
        for b, items in enumerate(bins):
            self._file(b, CAPACITY - sum(weight[i] for i in items))

    def _file(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def add(self, items) -> None:
        for i in items:
            w = self.weight[i]
            fits = self.mask >> w
            if fits:
                room = w + (fits & -fits).bit_length() - 1
                b = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.mask ^= 1 << room
                self.bins[b].append(i)
            else:
                room, b = CAPACITY, len(self.bins)
                self.bins.append([i])
            self._file(b, room - w)


def best_fit(weight: list[int], order, bins: list[list[int]] | None = None) -> list[list[int]]:
    out = Bins(weight, bins if bins is not None else [])
    out.add(order)
    return out.bins


def fitness(weight: list[int], bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins, then fuller ones; smaller is better."""
    return len(bins), -sum((sum(weight[i] for i in b) / CAPACITY) ** 2 for b in bins)


def cross(weight: list[int], receiver: list[list[int]], giver: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """``receiver`` with some well-filled bins of ``giver`` put in whole."""
    fill = np.array([sum(weight[i] for i in b) for b in giver])
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(good, size=max(1, len(good) // 3), replace=False)
    taken = {i for b in chosen for i in giver[b]}
    kept, loose = [], []
    for b in receiver:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    loose.sort(key=lambda i: -weight[i])
    return best_fit(weight, loose, kept + [list(giver[b]) for b in chosen])


def evolve(weight: list[int], population: list[list[list[int]]], rng: np.random.Generator, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The population after some generations, best first; ends early where the bins are as few as the tokens allow."""
    least = -(-sum(weight) // CAPACITY)
    ranked = sorted(((fitness(weight, p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    made = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        for _ in range(len(ranked)):
            a, b = rng.choice(len(ranked), 2, replace=False)
            child = cross(weight, ranked[a][2], ranked[b][2], rng)
            made += 1
            ranked.append((fitness(weight, child), made, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[: len(population)]
    return [p for _, _, p in ranked]


def _numbers(n: int, bins: list[list[int]]) -> np.ndarray:
    out = np.empty(n, np.int64)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _lists(numbers: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1)]
    for i, b in enumerate(numbers.tolist()):
        bins[b].append(i)
    return [b for b in bins if b]


def _island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    shard, island = int(key[0]), int(key[1])
    rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
    weight, rng = rows["length"].tolist(), np.random.default_rng([shard, island])
    w = rows["length"].to_numpy()
    population = [best_fit(weight, np.argsort(-w, kind="stable").tolist())] if island == 0 else []
    least = -(-int(w.sum()) // CAPACITY)
    while len(population) < POPULATION and not (population and len(population[0]) <= least):
        population.append(best_fit(weight, np.argsort(-(w * rng.uniform(0.9, 1.1, len(w))), kind="stable").tolist()))
    elites = evolve(weight, population, rng)[:2]
    rows["elites"] = list(np.stack([_numbers(len(rows), e) for e in elites], axis=1))
    return rows


def _last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    shard = int(key[0])
    rows = rows.sort_values(["island", "doc_id", "piece", "ids_crc32"], kind="stable")
    parts = [g.reset_index(drop=True) for _, g in rows.groupby("island", sort=True)]
    weight = parts[0]["length"].tolist()
    elites = [_lists(e) for g in parts for e in np.stack(g["elites"].to_list()).T]
    best = evolve(weight, elites, np.random.default_rng([shard, ISLANDS]))[0]
    out, at = parts[0].drop(columns=["elites", "island", "shard"]), np.empty(len(weight), np.int64)
    for items in best:
        used = 0
        for i in items:
            at[i] = used
            used += weight[i]
    out["sequence_id"] = (shard << 32) + _numbers(len(weight), best)
    out["offset"] = at
    return out


def pack(pieces: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """``pieces`` (see ``cut``) with ``sequence_id`` and ``offset``; sequences hold CAPACITY tokens at most, gapless from 0.

    Repeated pieces are packed each for itself. The number of shards follows from a count, so a
    task's share does not grow; a full piece fills a sequence by itself.
    """
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.count() // shard_size))
    x = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    x = checkpointed(x).withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    x = x.groupBy("shard", "island").applyInPandas(_island, f"{PIECES}, shard int, island int, elites array<bigint>")
    return x.groupBy("shard").applyInPandas(_last, f"{PIECES}, sequence_id bigint, offset bigint")


def op9_best_fit_packing(docs: DataFrame) -> DataFrame:
    """Every piece of every row of ``docs`` with its place. A null or empty text is a piece of one token; repeated rows are packed each for itself; no rows give no pieces; other columns are not read."""
    return pack(cut(docs.select("doc_id", "text")))
