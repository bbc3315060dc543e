"""Language ID by averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A word's vector is the mean of the embeddings of its hashed letter n-grams, a text's the mean of its
words'. As the softmax is linear, each distinct word of a batch is scored once and a text's logits
are the mean of its words' logits, so whole texts cost one gather.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, released, slices, word_codes

#: Rows that the classifier is fitted on at most, taken by a hash of the id; their whole texts are used.
TRAIN_ROWS = 1000
BUCKETS, DIMS, EPOCHS, RATE = 1 << 15, 16, 6, 0.2
#: Rejection starts at this part of the score that all but this share of the validation texts reach that are classified right.
MARGIN, LOW = 0.9, 0.01
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams (1 to 4 letters, with marks for the ends) of each word, flat; how many each word has; and whether it has a letter.

    Only letters count; a word without any has no n-grams.
    """
    letters = ["".join(c for c in w if c.isalpha()).lower() if not w.isalpha() else w.lower() for w in words]
    marked = [f"<{w}>" if w else "" for w in letters]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # letters from here to the end of the word
    grams, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, 5):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] if n > 1 else flat + np.uint64(7)
        ok = left[: len(h)] >= n
        grams.append(mix64(h[ok] + np.uint64(n)) % np.uint64(BUCKETS))
        owners.append(owner[: len(h)][ok])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order].astype(np.int32), np.bincount(owners, minlength=len(words)), sizes > 0


def _segment_mean(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_logits(texts: pa.Array, model: Model, bucket_logits: np.ndarray | None = None, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each text and how many of its words have letters; n-grams are held for ``block`` distinct words at a time."""
    if bucket_logits is None:
        bucket_logits = model.embeddings @ model.weights
    bounds, codes, words = word_codes(texts)
    per_word, lettered = np.zeros((len(words), len(model.labels))), np.zeros(len(words), bool)
    for a in range(0, len(words), block):
        grams, counts, ok = subwords(words.slice(a, block).to_pylist())
        lettered[a : a + block] = ok
        if len(grams):
            per_word[a : a + block] = _segment_mean(bucket_logits[grams], counts)
    ok = lettered[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(ok)])[bounds]
    n = np.diff(kept)
    return _segment_mean(per_word[codes[ok]], n) + model.bias, n


def bag(bounds: np.ndarray, codes: np.ndarray, words: pa.Array, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, the words ``codes[bounds[0]:bounds[1]]`` of ``words``, and their weights: the mean over its words of the means over their n-grams."""
    seen, n = np.unique(codes[bounds[0] : bounds[1]], return_counts=True)
    total, lettered = np.zeros(BUCKETS), 0
    for a in range(0, len(seen), block):
        grams, counts, ok = subwords(words.take(pa.array(seen[a : a + block])).to_pylist())
        lettered += n[a : a + block][ok].sum()
        total += np.bincount(grams, np.repeat(n[a : a + block] / np.maximum(counts, 1), counts), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), (total[at] / max(lettered, 1)).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 5) -> Model:
    """A model of texts as ``bag`` gives them; a fifth of them, held back, sets the temperature and the rejection threshold."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = Model(labels, rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32), np.zeros((DIMS, len(labels))), np.zeros(len(labels)))
    if not labels:
        return model
    y = np.array([labels.index(x) for x in langs])
    full = np.array([len(b) > 0 for b, _ in bags])
    held = (np.arange(len(y)) % 5 == 4) & (len(y) >= 10)
    rows = np.flatnonzero(~held & full)
    g_e, g_w = np.full(BUCKETS, 1e-6, np.float32), np.full((DIMS, len(labels)), 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for i in rows:
            at, w = bags[i]
            x = w @ model.embeddings[at]
            p = _softmax((x @ model.weights + model.bias)[None])[0]
            p[y[i]] -= 1
            d_x, d_w = model.weights @ p, np.outer(x, p)
            g_e[at] += w * w * np.float32((d_x * d_x).mean())
            g_w += d_w * d_w
            model.embeddings[at] -= (w / np.sqrt(g_e[at]))[:, None] * (RATE * d_x).astype(np.float32)
            model.weights -= RATE * d_w / np.sqrt(g_w)
            model.bias -= 0.01 * p
    test = np.flatnonzero(held & full)
    if len(test):
        z = np.stack([bags[i][1] @ model.embeddings[bags[i][0]] for i in test]) @ model.weights + model.bias
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[test]] + 1e-300).mean()
        model.temperature = float(min((1.0, 1.4, 2.0, 3.0, 4.0, 6.0), key=loss))  # never surer than trained, however few texts there are
        p = _softmax(z / model.temperature)
        right = p.argmax(1) == y[test]
        # Never above the chance of a coin: a text that the model is surer of than that is not rejected.
        model.threshold = float(min(0.5, MARGIN * np.quantile(p[right].max(1), LOW))) if right.any() else 0.0
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t", 1 << 20):
        bounds, codes, words = word_codes(batch.column("t"))
        made = [bag(bounds[i : i + 2], codes, words) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("l"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary())], ["k", "l", "at", "w"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on at most TRAIN_ROWS rows of ``docs`` with an id, a text and a language, taken by a hash of the id, and on their whole texts.

    Tasks turn each text into its bag, of BUCKETS entries at most however long the text is; only bags come to the driver.
    """
    good = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    key = F.md5(F.col(doc_id).cast("string"))
    ids = good.select(F.col(doc_id).alias("id")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(TRAIN_ROWS)
    few = F.broadcast(ids.distinct())  # TRAIN_ROWS ids at most
    some = good.join(few, F.col(doc_id) == F.col("id"), "left_semi").select(key.alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = some.mapInArrow(_bags, "k string, l string, at binary, w binary").orderBy("k", "at", "w", "l").limit(TRAIN_ROWS).collect()
    model = fit([(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["w"], np.float32)) for r in rows], [r["l"] for r in rows])
    del rows
    released()
    return model


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, text: str, out: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    bucket_logits = model.embeddings @ model.weights
    for batch in slices(batches, text):
        known = bool(model.labels)
        z, n = text_logits(batch.column(text), model, bucket_logits) if known else (np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, int))
        p = _softmax(z / model.temperature)
        best, ok = p.argmax(1), n > 0
        labels = [model.labels[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
        score = np.where(ok, p.max(1), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(~ok | (score < model.threshold))], [*batch.schema.names, *out])


def predict(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the columns ``out``: the language, its score (0 to 1) and whether the model rejects the text; columns of those names are replaced.

    A null text, or one without a letter, is ``und`` with the score 0 and rejected. Only ``text``
    decides, so repeated rows get equal values. Without any labelled row all is ``und``.
    """
    x = docs.drop(*out)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in x.schema)
    return x.mapInArrow(lambda b: _predicted(b, model, text, out), fields + "{} string, {} double, {} boolean".format(*out))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of ``docs``.

    A null or letterless text is ``und`` with the score 0; a null id or language keeps a row from the
    fitting, not from a prediction; an empty table gives no rows; other columns are not read.
    """
    model = train(docs.where(~held_out()))
    x = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return x.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model does not reject, with their columns as they are, whatever their names."""
    model = train(docs.where(~held_out()))
    out = tuple(free_name(docs, n) for n in ("lang_pred", "score", "rejected"))
    return predict(docs, model, out=out).where(~F.col(out[2])).drop(*out)
