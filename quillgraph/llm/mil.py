"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, its label that of the bag.
Every passage of the whole text is encoded: shares of character classes, word length
and repetition, and signed-free hashed word counts.  A passage vector is turned into
``h = tanh(W x + b)``; gated attention weighs it by
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the document, and a logistic unit
scores the weighted sum.  The parameters are learned from document labels only, with
Adam on the whole (bounded) sample; all seeds are fixed.

The sample is at most ``TRAIN_DOCS`` labelled documents, those with the smallest
hash of their id.  Everything else covers every document, in Arrow batches that are
cut into chunks of ``CHUNK`` bytes, so a batch of long texts needs no more memory.

Defined results: null and blank texts are one passage without words and get a score;
labels other than 0 and 1, or null, are left out; several labels of one id give the
smallest; rows that repeat get equal scores; without both labels in the sample the
score is 0.5 or the one label's share everywhere; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

PASSAGE = 64
BUCKETS = 64
TRAIN_DOCS = 3000
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 160, 0.03, 1e-4
THRESHOLD = 0.3
CHUNK = 1 << 18

_SPACE, _LOWER, _UPPER, _DIGIT, _PUNCT, _SYMBOL, _WIDE = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[97:123], out[65:91], out[48:58], out[128:] = _LOWER, _UPPER, _DIGIT, _WIDE
    out[[ord(c) for c in ".,;:'\"()-?"]] = _PUNCT
    return out


_CLASS = _classes()
_POWERS = np.random.default_rng(17).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
N_SHAPE = 12
WIDTH = N_SHAPE + BUCKETS


def _encode_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    kind = _CLASS[data]
    solid = kind != _SPACE
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    n_passages = np.maximum(1, (n_words + PASSAGE - 1) // PASSAGE)
    base = np.concatenate(([0], np.cumsum(n_passages)))
    total = int(base[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return out, n_passages
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    rank = np.arange(len(starts)) - first[doc]
    passage = base[doc] + rank // PASSAGE
    length = ends - starts
    word_of = np.repeat(np.arange(len(starts)), length)
    place = np.flatnonzero(solid)
    inside = np.minimum(place - starts[word_of], 63)
    letters = np.where(kind[place] == _UPPER, data[place] | 32, data[place]).astype(np.uint64)
    hashes = np.add.reduceat((letters + np.uint64(1)) * _POWERS[inside], starts - np.concatenate(([0], np.cumsum(starts[1:] - ends[:-1]))) - starts[0])
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    count = np.bincount(passage, minlength=total).astype(np.float64)
    words = np.maximum(count, 1)
    by_class = np.bincount(passage[word_of] * 8 + kind[place], minlength=total * 8).reshape(total, 8)
    chars = np.maximum(by_class.sum(axis=1), 1)
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=total)
    again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])))
    last = kind[ends - 1]
    of_words = lambda mask: np.bincount(passage[mask], minlength=total) / words
    for i in range(1, 7):
        out[:, i - 1] = by_class[:, i] / chars
    out[:, 6] = np.log1p(count) / 4
    out[:, 7] = np.bincount(passage, weights=np.minimum(length, 40), minlength=total) / words / 10
    out[:, 8] = distinct / words
    out[:, 9] = of_words(again)
    out[:, 10] = of_words(last == _SYMBOL)
    out[:, 11] = of_words((length == 1) & (last >= _PUNCT))
    buckets = np.bincount(passage * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS)
    out[:, N_SHAPE:] = np.sqrt(buckets.reshape(total, BUCKETS) / words[:, None])
    return out, n_passages


def encode(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passage vectors and passages a document, for chunks of documents in order."""
    chunk, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        chunk.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield _encode_chunk(chunk)
            chunk, size = [], 0
    if chunk:
        yield _encode_chunk(chunk)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, heads = self.p, np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        of = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(a - np.maximum.reduceat(a, heads)[of])
        a = e / np.add.reduceat(e, heads)[of]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "heads": heads, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(x, counts)["y"]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self._forward(x, counts)["a"]


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """Fit the model to bags (passages in a row, ``counts`` a bag) and their labels."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    share = float(labels.mean())
    p = {
        "W": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.25, (HIDDEN, GATE)), "U": rng.normal(0, 0.25, (HIDDEN, GATE)), "w": rng.normal(0, 0.25, GATE),
        "c": rng.normal(0, 0.25, HIDDEN), "c0": np.array(np.log((share + 1e-3) / (1 - share + 1e-3))),
    }
    model = Model(mean, scale, p)
    if share in (0.0, 1.0):
        p["c"][:] = 0
        return model
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, STEPS + 1):
        f = model._forward(x, counts)
        dy = (f["y"] - labels) / len(labels)
        dz = dy[:, None] * p["c"]
        dzr = dz[f["of"]]
        da = (dzr * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["heads"])[f["of"]])
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grad = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]) * ds[:, None]).sum(axis=0), "c": f["z"].T @ dy, "c0": dy.sum()}
        for k in p:
            g = grad[k] + DECAY * p[k] * (k not in ("b", "c0"))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``train_docs`` labelled documents that are not held out.

    Twice as many labels as wanted documents are drawn by a hash of the id, as some
    documents may be gone; this list is the only thing broadcast, and its bound is
    the parameter.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    # The list is drawn once: its bound holds for what is broadcast, and every task sees the same.
    wanted = spark.createDataFrame(wanted.orderBy(F.xxhash64("id"), "id").limit(2 * train_docs).toArrow())
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(encode(batch.column(1).to_pylist()))
            if not parts:
                continue
            counts = np.concatenate([c for _, c in parts])
            rows = np.split(np.concatenate([x for x, _ in parts]), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "x"])

    got = chosen.select("id", "text", "label").mapInArrow(run, "id long, label int, x binary").orderBy(F.xxhash64("id"), "id", F.xxhash64("x")).limit(train_docs).toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got.column("x").to_pylist()]
    if not bags:
        bags, y = [np.zeros((1, WIDTH), np.float32)] * 2, np.array([0.0, 1.0])
    else:
        y = np.array(got.column("label").to_pylist(), float)
    return train(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1."""
    common.bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x, c) for x, c in encode(batch.column(at).to_pylist())]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, schema)
