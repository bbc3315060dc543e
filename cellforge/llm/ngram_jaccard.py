"""Exact Jaccard join of word n-gram sets: size-banded tiles with bitmap signatures.

1. Every text becomes a sorted array of 64-bit hashes of its shingles; texts with equal arrays are one
   class, named by a hash of the array, and go on as one.
2. Candidates. Only shingles whose hash is in the lowest SHARE of the range are looked at. A partner
   lacks at most a quarter of a set's shingles, so it shares at least ``need`` = (shingles in the
   range) - (a quarter of all) of them; a set whose ``need`` is below 1 looks at all its shingles.
   Shingles of a single class cannot be shared. Of the shared ones a set may leave out its ``need`` - 1
   most frequent: the least frequent shared one always stays on both sides. Sets with fewer than
   ``need`` shared shingles have no partner, so common passages fall away without any cap. A task sends
   the shingles of a class once, not for each copy that it meets.
3. Classes that remain and share a shingle are joined into clusters. Short sets have few shingles in
   the low range, so common passages chain them into clusters that grow with the corpus; classes of
   clusters larger than a tile do step 2 again among themselves, over all their shingles, of which a
   set needs three quarters. What is left is cut into tiles by bands of set size. Two tiles are compared only if their bands touch. Within a pair of tiles,
   bit counts of hashed bitmaps bound the overlap from above, and pairs that pass are intersected
   exactly. A task returns, per class, its number of links and one link of a spanning forest, never
   pairs.
4. The forest's components are named by their smallest document.

Sums are stored before they are joined back, so that Spark can split a join where a key is hot.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lowered, free_name, mix64, slices, stored, word_codes, word_hashes
from .components import components

WORDS = 5
SIMILARITY = 75  # of 100
SHARE = 1 / 3
TILE, TILE_SHINGLES, BAG_SHINGLES = 1024, 2_000_000, 250_000
#: Classes that a task remembers having sent.
MET = 200_000
KEPT = "__kept_id"
BITS = 2048
#: Groups up to this are told apart by size when the most frequent shingles are left out.
FREQUENT = 1 << 16
#: Places of the marks by which documents are picked out before they move.
MARKS = 1 << 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    bounds, codes, distinct = word_codes(ascii_lowered(texts))
    w = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = mix64(h * MULTIPLIER + w[k : k + n] + np.uint64(1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix64(x * MULTIPLIER + w[k : k + 1] + np.uint64(2))
            out.append(x)
        else:
            out.append(w[:0])
    return out


def class_id(s: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.md5(s.tobytes()).digest()[:8])[0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "rid"])


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, rid, need): the shingles in the low range of each class that the task has not just met."""
    edge, met = np.uint64(int(SHARE * 2**64)), set()
    for batch in slices(batches):
        need, rids, low = [], [], []
        for s in shingle_sets(batch.column("text")):
            rid = class_id(s) if len(s) else None
            if rid is None or rid in met:
                continue
            if len(met) >= MET:
                met.clear()
            met.add(rid)
            few = s[: np.searchsorted(s, edge)]
            k = len(few) - len(s) * (100 - SIMILARITY) // 100
            rids.append(rid)
            need.append(max(k, 1))
            low.append(few if k >= 1 else s)
        n = [len(x) for x in low]
        if rids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low).view(np.int64)), pa.array(np.repeat(np.array(rids, np.int64), n)), pa.array(np.repeat(np.array(need, np.int32), n))], ["token", "rid", "need"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class, once each, those whose token has others, with its frequency (FREQUENT: that or more)."""

    def out(token, rid, need, df):
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(rid), pa.array(need), pa.array(df)], ["token", "rid", "need", "df"])

    token, rid, need = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    hot, latest = None, None  # a token that has shown FREQUENT rows and may go on; the row before the batch
    for batch in batches:
        t, r, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "rid", "need"))
        if not len(t):
            continue
        fresh = np.r_[(t[0], r[0]) != latest, (t[1:] != t[:-1]) | (r[1:] != r[:-1])]
        latest = (t[-1], r[-1])
        token, rid, need = np.concatenate([token, t[fresh]]), np.concatenate([rid, r[fresh]]), np.concatenate([need, q[fresh]])
        if not len(token):
            continue
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        last = first[-1]  # the group that may go on
        sizes = np.diff(np.r_[first, len(token)])
        df = sizes.copy()
        df[0] += FREQUENT * (token[0] == hot)
        df = np.repeat(np.minimum(df, FREQUENT), sizes).astype(np.int32)
        if len(token) - last >= FREQUENT or token[-1] == hot:
            hot, last = token[-1], len(token)
        ok = np.flatnonzero(df[:last] > 1)
        if len(ok):
            yield out(token[ok], rid[ok], need[ok], df[ok])
        token, rid, need = token[last:], rid[last:], need[last:]
    if len(token) > 1:
        yield out(token, rid, need, np.full(len(token), min(len(token), FREQUENT), np.int32))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, BITS bits; bit k is set if the set has a shingle whose hash falls on k."""
    out = np.zeros((len(sets), BITS), np.uint8)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out[owner, (flat % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of ``left`` x ``right`` (or within ``left``) that link.

    A shingle of one set whose bit the other lacks is not in it, so |A and B| <= |A| - bits(A) that B lacks.
    """
    maps, n = bitmaps(sets), np.array([len(s) for s in sets])
    found = []
    for k, a in enumerate(left.tolist()):
        b = left[k + 1 :] if right is None else right
        b = b[(np.minimum(n[b], n[a]) * 100 >= SIMILARITY * np.maximum(n[b], n[a]))]
        if not len(b):
            continue
        lacks_b = np.bitwise_count(maps[a] & ~maps[b]).sum(1)
        lacks_a = np.bitwise_count(~maps[a] & maps[b]).sum(1)
        most = np.minimum(n[a] - lacks_b, n[b] - lacks_a)
        b = b[100 * most >= SIMILARITY * (n[a] + n[b] - most)]
        for x in b.tolist():
            at = np.searchsorted(sets[x], sets[a])
            both = int((sets[x][np.minimum(at, len(sets[x]) - 1)] == sets[a]).sum())
            if 100 * both >= SIMILARITY * (n[a] + n[x] - both):
                found.append((a, x))
    return found


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one tile, of a pair of tiles, or of each of several small clusters."""
    out = []
    for _, part in rows.groupby("cluster", sort=False):
        part = part.drop_duplicates(["rid", "side"]).reset_index(drop=True)
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in part["tokens"]]
        side, rid, copies = part["side"].to_numpy(), part["rid"].to_numpy(), part["copies"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = links(sets, left, right if len(right) or side.max() else None)
        if not pairs:
            continue
        count, root = np.zeros(len(part), np.int64), list(range(len(part)))

        def top(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in pairs:
            count[a] += copies[b]
            count[b] += copies[a]
            root[max(top(a), top(b))] = min(top(a), top(b))
        hit = np.flatnonzero(count)
        out.append(pd.DataFrame({"rid": rid[hit], "links": count[hit], "root": rid[[top(i) for i in hit.tolist()]]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("rid", "links", "root")})


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"))
        same = pa.array([len(s) > 0 and class_id(s) == r for s, r in zip(sets, batch.column("rid").to_pylist(), strict=True)])
        keep = [i for i, c in enumerate(batch.schema.names) if c not in ("text", "doc_id")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), _lists(sets)], [*(batch.schema.names[i] for i in keep), "tokens"]).filter(same)


def _clusters(tokens: DataFrame) -> DataFrame:
    """(node, label): classes that share one of the shingles (token, rid, need) which they may not leave out, joined; label is the smallest of a cluster."""
    shared = tokens.repartition("token").sortWithinPartitions("token", "rid").mapInArrow(_shared, "token bigint, rid bigint, need int, df int")
    own = shared.groupBy("rid").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    kept = stored(own.where(F.size("t") >= F.col("need")).select("rid", F.explode(F.expr("slice(t, 1, size(t) - need + 1).token")).alias("token")))
    least = stored(kept.groupBy("token").agg(F.min("rid").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    return components(kept.join(least, "token").select(F.col("rid").alias("u"), "v"))


def _cuts(member: DataFrame) -> DataFrame:
    """(cluster, mass, big, cut): whether a cluster is more than one tile, and as JSON how many tiles each band has. A tile holds TILE classes and about TILE_SHINGLES shingles at most, or one class."""
    sizes = member.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"), F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.max("n"))))).cast("int").alias("k"))
    cut = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("band").cast("string"), "k")))).alias("cut")
    return sizes.groupBy("cluster").agg(F.sum("mass").alias("mass"), ((F.sum("m") > TILE) | (F.sum("mass") > TILE_SHINGLES)).alias("big"), cut)


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of the documents that ``ids`` (doc_id) doesn't have, told by a bit for each hash: MARKS bits at any size, so nothing that grows is broadcast. All that it has are kept."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marks = ids.select(F.bitmap_bucket_number(place).alias("__at"), F.bitmap_bit_position(place).alias("__bit")).groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__marks"))
    byte = F.conv(F.hex(F.expr("substring(__marks, CAST(__bit div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    x = docs.withColumns({"__at": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)}).join(F.broadcast(stored(marks)), "__at")
    return x.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).select(docs.columns)


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text; other columns are not read).

    ``n_links`` counts the other documents that a document links with, copies included. A text
    without words (null, empty) is linked with nothing. Rows that repeat an id are documents of their own
    with the same number; rows without an id are linked with nothing but their copies. No rows give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(source.mapInArrow(_classes, "doc_id bigint, n_shingles bigint, rid bigint"))
    classes = sets.where("rid IS NOT NULL").groupBy("rid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    classes = stored(classes)

    chained = _clusters(source.select("text").mapInArrow(_low, "token bigint, rid bigint, need int"))
    member = chained.join(classes, chained["node"] == classes["rid"]).select("rid", F.col("label").alias("cluster"), F.col("rep").alias("doc_id"), "copies", "n")
    member = stored(member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / SIMILARITY)) + 1e-9).cast("int")))
    wanted = member.join(stored(_cuts(member).select("cluster", "big")), "cluster")
    # Kept, as arrays are looked at twice and texts are not to move again; by a merge at every size, as they grow with the documents.
    arrays = stored(_picked(source, member.select("doc_id")).join(wanted.hint("merge"), "doc_id").mapInArrow(_tokens, "cluster bigint, rid bigint, copies bigint, n bigint, band int, big boolean, tokens array<bigint>"))

    # Of large clusters, most hold together by common passages alone; their classes look at all their shingles.
    whole = arrays.where("big").select(F.explode("tokens").alias("token"), "rid", (F.col("n") - F.expr(f"n * {100 - SIMILARITY} div 100")).cast("int").alias("need"))
    close = _clusters(whole).withColumnRenamed("node", "rid").withColumnRenamed("label", "cluster")
    again = stored(member.drop("cluster").join(close, "rid"))
    cuts = stored(_cuts(again))
    columns = ["rid", "cluster", "copies", "band", "big", "cut", "tokens"]
    large = arrays.where("big").drop("cluster", "big").join(again.select("rid", "cluster").join(cuts, "cluster").hint("merge"), "rid")
    texts = arrays.where("NOT big").withColumn("cut", F.lit(None).cast("string")).select(columns).unionByName(large.select(columns))
    few = (arrays.where("NOT big").agg(F.sum("n").alias("n")).first()["n"] or 0) + (cuts.where("NOT big").agg(F.sum("mass").alias("n")).first()["n"] or 0)
    bags = max(1, few // BAG_SHINGLES)
    cut = F.from_json("cut", "map<string,int>")
    small = texts.where("NOT big").select("rid", "cluster", "copies", "tokens", F.lit(0).alias("side"), F.concat(F.lit("bag:"), F.pmod(F.xxhash64("cluster"), F.lit(bags))).alias("tile"))
    # A row of tile i of a band meets the tiles j > i of its band, those of the band above, and its own tile.
    big = texts.where("big").withColumn("cut", cut).withColumn("i", F.pmod(F.xxhash64("rid"), F.expr("cut[CAST(band AS string)]")))
    name = lambda lo, i, hi, j: F.concat_ws(":", F.col("cluster").cast("string"), lo, i, hi, j)
    band, up, down, i = F.col("band"), F.col("band") + 1, F.col("band") - 1, F.col("i")
    among = lambda b: F.sequence(F.lit(0), F.coalesce(F.try_element_at("cut", b.cast("string")), F.lit(0)) - 1)
    has = lambda b: F.coalesce(F.try_element_at("cut", b.cast("string")), F.lit(0)) > 0
    none = F.expr("CAST(array() AS array<struct<tile:string,side:int>>)")
    pair = lambda tile, side: F.struct(tile.alias("tile"), side.alias("side"))
    places = F.concat(
        F.transform(among(band), lambda j: pair(name(band, F.least(i, j), band, F.greatest(i, j)), F.when(j < i, 1).otherwise(0))),
        F.when(has(up), F.transform(among(up), lambda j: pair(name(band, i, up, j), F.lit(0)))).otherwise(none),
        F.when(has(down), F.transform(among(down), lambda j: pair(name(down, j, band, i), F.lit(1)))).otherwise(none),
    )
    big = big.withColumn("p", F.explode(places)).select("rid", "cluster", "copies", "tokens", "p.side", "p.tile")
    found = stored(small.unionByName(big).groupBy("tile").applyInPandas(_tile, "rid bigint, links bigint, root bigint"))

    n_links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    named = stored(linked.join(classes, linked["node"] == classes["rid"]).select("rid", "label", "rep"))
    smallest = stored(named.groupBy("label").agg(F.min("rep").alias("component_id")))
    extra = named.join(smallest, "label").select("rid", "component_id").join(n_links, "rid", "left")
    about = stored(classes.select("rid", "rep", "copies").join(extra, "rid", "left"))
    return (
        sets.join(about, "rid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    )


def op3_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """``jaccard_classes``: a null or empty text, a repeated id and an empty table are treated as stated there."""
    return jaccard_classes(docs)


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < {WORDS} THEN w ELSE w[i + 1:i + {WORDS}] END, ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {WORDS - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {SIMILARITY} * (x.n + y.n - k)),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS least FROM r GROUP BY u), l AS (SELECT u, count(*) AS links FROM e GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, coalesce(l.links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id LEFT JOIN l ON l.u = d.doc_id
"""


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Columns stay as they are, whatever their names.

    Rows that share an id stay or go together: they stay if one of them is its group's smallest. Rows
    without an id are no document's copy and stay; so do texts without words.
    """
    kept = free_name(docs, KEPT)
    found = jaccard_classes(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept)).distinct()
    # By a merge at every size: the ids grow with the documents.
    return docs.join(found.hint("merge"), F.col("doc_id").cast("long") == F.col(kept), "left_semi").unionByName(docs.where("doc_id IS NULL"))
