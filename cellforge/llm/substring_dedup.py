"""Removal of repeated 200-byte passages by sampled windows, in place of an external suffix sort.

A suffix sort of all positions needs many times the text's size on disk, so this is not one: no
suffixes are ordered and no common-prefix values kept. As in induced sorting only a sample of the
suffixes is looked at and the rest follows from it, but equal bytes are brought together by 64-bit hashes:

1. Sampled suffixes: in each run of W grams of GRAM bytes the one with the smallest hash (the
   leftmost, if equal) is taken, as a local minimum. A window of LENGTH bytes holds exactly one run,
   so two equal windows sample at the same place, and each window belongs to one sampled suffix.
2. Grams are counted. One met once has no long common prefix with any other suffix, and ends
   here with all windows that belong to it.
3. What is left is named by a hash of all bytes that its windows cover. Where such
   a block is met twice, all its windows repeat; one of equal
   blocks stands for them in the next step. Blocks are counted by partial sums, so a group of copies is
   never gathered.
4. The other blocks carry their bytes. Within a gram, hashes of LENGTH bytes at each distance from the
   sampled place are compared; windows met twice repeat. A gram with more than SPLIT blocks is dealt out
   over several tasks, whose distinct windows meet in a last step, dealt by window over as many parts as
   there are SPLITs of blocks, so that no part grows with the gram.
5. The runs of repeated windows go back to their documents, are merged there, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix64, slices, stored

LENGTH, GRAM = 200, 32
W = LENGTH - GRAM + 1
SPLIT = 256
BASE = np.uint64(0x5851F42D4C957F2D | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on, equal for equal bytes at any place."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n))])
    return mix64((total[width:] - total[:-width]) * _powers(INVERSE, n - width + 1))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` values in a row, the leftmost if equal."""
    n = len(x) - width + 1
    at = np.arange(len(x))
    size = -(-len(x) // width) * width
    value = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    value[: len(x)] = x
    rows = value.reshape(-1, width)
    places = np.arange(size).reshape(-1, width)

    def running(v: np.ndarray, p: np.ndarray, keep_first: bool) -> np.ndarray:
        low = np.minimum.accumulate(v, axis=1)
        fresh = np.ones(v.shape, bool)
        fresh[:, 1:] = v[:, 1:] < low[:, :-1] if keep_first else v[:, 1:] <= low[:, :-1]
        step = np.where(fresh, np.arange(v.shape[1])[None], 0)
        return np.take_along_axis(p, np.maximum.accumulate(step, axis=1), axis=1)

    before = running(rows, places, True).reshape(-1)  # from the start of the block to here
    after = running(rows[:, ::-1], places[:, ::-1], False)[:, ::-1].reshape(-1)  # from here to its end
    a, b = after[:n], before[width - 1 : width - 1 + n]
    return np.where(value[a] <= value[b], a, b) if len(at) else at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches with the texts' ends, cut at about SLICE_BYTES / 4, for the sake of the arrays made from them."""
    yield from ((b, b.column("text").to_pylist()) for b in slices(batches, max_bytes=SLICE_BYTES // 4))


def sampled(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts that begin at ``start`` in ``data`` (the last bound is its end): for each sampled suffix its gram's hash, the hash of its block, its text, and the first and last window that belong to it (places in ``data``)."""
    grams = window_hashes(data, GRAM)
    sizes = np.diff(start)
    n = np.maximum(sizes - LENGTH + 1, 0)  # windows of each text
    if not n.sum():
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    at = sliding_minimum(grams, W)
    owner = np.repeat(np.arange(len(n)), n)
    window = np.repeat(start[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    place = at[window]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(window)] - 1
    a, b, p = window[first], window[last], place[first]
    # Of the block data[a : b + LENGTH], its own hash, and how far its windows lie from the sampled place.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)))])
    block = (total[b + LENGTH] - total[a]) * _powers(INVERSE, len(data))[a]
    block = mix64(mix64(block) + (p - a).astype(np.uint64) * np.uint64(1 << 20) + (b - a).astype(np.uint64))
    return grams[p], block, owner[first], a, b


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _chunks(batches):
        data, start = _joined(texts)
        gram, block, owner, a, b = sampled(data, start)
        if len(gram):
            base = start[owner]
            row = batch.column("row").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([_signed(gram), _signed(block), _signed(row), pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], ["gram", "block", "row", "a", "b"])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tuple of a text (list ``s`` of gram, salt, parts, a and b) with the bytes of its block."""
    for batch in slices(batches):
        items, texts, rows = batch.column("s"), batch.column("text").to_pylist(), batch.column("row").to_numpy()
        n = np.diff(items.offsets.to_numpy())
        gram, salt, parts, a, b = (items.flatten().field(c) for c in ("gram", "salt", "parts", "a", "b"))
        body, at = [], 0
        starts, ends = a.to_pylist(), b.to_pylist()
        for text, k in zip(texts, n.tolist(), strict=True):
            data = text.encode()
            body += [data[x : y + LENGTH] for x, y in zip(starts[at : at + k], ends[at : at + k], strict=True)]
            at += k
        yield pa.RecordBatch.from_arrays([gram, salt, parts, pa.array(np.repeat(rows, n)), a, pa.array(body, pa.binary())], ["gram", "salt", "parts", "row", "a", "body"])


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows in a row: (row, first, last)."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.zeros(0, int)
    last = np.r_[first[1:], len(row)] - 1 if len(row) else first
    return row[first], at[first], at[last]


def _windows(gram: np.ndarray, row: np.ndarray, a: np.ndarray, body: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash (with the gram), owner and place of all windows of the blocks."""
    data, start = _joined([]) if not body else (np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int64))
    n = np.diff(start) - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = window_hashes(data, LENGTH)[start[:-1][owner] + off] ^ mix64(gram.view(np.uint64))[owner]
    return h, row[owner], a[owner] + off, owner


def _group_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tuples sorted by gram and salt: runs of windows met twice within the group; of split grams also the distinct windows that may be met in other groups, in lists by parts of their hash."""

    def work(gram, salt, parts, row, a, body):
        cut = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])
        ends = np.r_[cut[1:], len(gram)]
        at = 0
        while at < len(cut):  # whole groups of about 4,096 blocks at a time
            stop = at + 1
            while stop < len(cut) and ends[stop] - cut[at] <= 4096:
                stop += 1
            lo, hi = cut[at], ends[stop - 1]
            at = stop
            split = salt[lo:hi] >= 0
            h, r, w, owner = _windows(gram[lo:hi], row[lo:hi], a[lo:hi], body[lo:hi])
            h = h ^ mix64((salt[lo:hi].astype(np.int64) + 1).view(np.uint64))[owner]
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            rr, f, e = _runs(r[again], w[again])
            none = pa.nulls(len(rr), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([_signed(rr), _signed(f), _signed(e), pa.nulls(len(rr), pa.int64()), pa.nulls(len(rr), pa.int32()), none, none, none], NAMES)
            if split.any():
                one = np.unique(inverse, return_index=True)[1]  # one of each distinct window
                one = one[split[owner[one]]]
                plain = h[one] ^ mix64((salt[lo:hi].astype(np.int64) + 1).view(np.uint64))[owner[one]]
                g, part = gram[lo:hi][owner[one]], (mix64(plain) % parts[lo:hi][owner[one]].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((part, g))
                one, plain, g, part = one[order], plain[order], g[order], part[order]
                c = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])])
                offs = pa.array(np.r_[c, len(g)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, _signed(v)) for v in (plain, r[one], w[one])]
                empty = pa.nulls(len(c), pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.array(g[c], pa.int64()), pa.array(part[c], pa.int32()), *lists], NAMES)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "salt", "parts", "row", "a")] + [batch.column("body").to_pylist()]
        if held:
            now = [np.concatenate([x, y]) for x, y in zip(held[:5], now[:5], strict=True)] + [held[5] + now[5]]
        gram, salt = now[0], now[1]
        last = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])[-1]
        yield from work(*(x[:last] for x in now)) if last else ()
        held = [x[last:] for x in now]
    if held:
        yield from work(*held)


NAMES = ["row", "first", "last", "gram", "part", "hashes", "rows", "places"]
FOUND = "row bigint, first bigint, last bigint, gram bigint, part int, hashes array<bigint>, rows array<bigint>, places array<bigint>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of split grams, sorted by gram and part: runs of those that are in two groups."""

    def work(parts):
        h, r, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        rr, f, e = _runs(r[again], w[again])
        return pa.RecordBatch.from_arrays([_signed(rr), _signed(f), _signed(e)], ["row", "first", "last"])

    key, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            own = (batch.column("gram")[k].as_py(), batch.column("part")[k].as_py())
            if held and own != key:
                yield work(held)
                held = []
            key = own
            held.append([batch.column(c)[k].values.to_numpy() for c in ("hashes", "rows", "places")])
    if held:
        yield work(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        texts, lists = batch.column("text").to_pylist(), batch.column("runs").to_pylist()
        for text, runs in zip(texts, lists, strict=True):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for x in sorted((x["first"], x["last"]) for x in runs or ()):
                a, b = x[0], x[1] + LENGTH
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), len(spans), kept))
        keep = [i for i, c in enumerate(batch.schema.names) if c not in ("text", "runs", "row")]
        made = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_out(batches):
        sums = pa.array([hashlib.sha256(k).hexdigest() for k in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sums], [*batch.schema.names[:-1], "kept_sha256"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row, first, last): runs of starts, in bytes, of windows of LENGTH bytes that also start elsewhere; ``docs`` has (row, doc_id, text), row being unique."""
    tuples = docs.select("row", "text").mapInArrow(_sample, "gram bigint, block bigint, row bigint, a int, b int")
    # Sums are stored before they are joined back: a join that also ends a sum could not be split where a key is hot.
    grams = stored(tuples.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("least"), F.max("block").alias("most")).where("n > 1").drop("n"))
    left = stored(tuples.join(grams, "gram").select("gram", "block", "row", "a", "b", (F.col("least") == F.col("most")).alias("alone")))
    several = left.where("NOT alone")
    # A row for each distinct block of a gram that has several, with its first place.
    pairs = stored(several.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "a", "b")).alias("own")))
    blocks = stored(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("blocks")))
    copied = several.join(pairs.where("n > 1").select("gram", "block"), ["gram", "block"], "left_semi")
    span = ("row", F.col("a").cast("long").alias("first"), F.col("b").cast("long").alias("last"))
    whole = left.where("alone").select(*span).unionByName(copied.select(*span))
    groups = F.ceil(F.col("blocks") / SPLIT).cast("int")
    salt = F.when(F.col("blocks") > SPLIT, F.pmod(F.xxhash64("own"), groups)).otherwise(-1).cast("int")
    apart = pairs.join(blocks, "gram")
    wanted = apart.groupBy(F.col("own.row").alias("row")).agg(F.collect_list(F.struct("gram", salt.alias("salt"), groups.alias("parts"), F.col("own.a").alias("a"), F.col("own.b").alias("b"))).alias("s"))
    carried = docs.join(wanted, "row").mapInArrow(_carry, "gram bigint, salt int, parts int, row bigint, a int, body binary")
    found = carried.repartition("gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(_group_windows, FOUND)
    found = stored(found)
    split = found.where("gram IS NOT NULL").select("gram", "part", "hashes", "rows", "places").repartition("gram", "part").sortWithinPartitions("gram", "part")
    met = split.mapInArrow(_meet, "row bigint, first bigint, last bigint")
    return whole.unionByName(found.where("gram IS NULL").select("row", "first", "last")).unionByName(met)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and the kept bytes (binary ``kept``, or their SHA-256 as ``kept_sha256``) of each row of ``docs``.

    A null text is empty; texts of less than LENGTH bytes keep all. Repeated rows are documents of
    their own, so they remove one another. Matches never cross documents.
    """
    # Stored, as ids made anew by each job would change with the way in which files are split.
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    runs = repeated_runs(rows)
    merged = runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    x = rows.join(merged, "row", "left").select("doc_id", "text", "runs")
    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
    return x.mapInArrow(_digested, fields + "kept_sha256 string") if digest else x.mapInArrow(_cut_out, fields + "kept binary")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` of each row, with a digest of the kept bytes; nulls, short texts and repeated rows as stated there, other columns are not read, no rows give no rows."""
    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), digest=True)
