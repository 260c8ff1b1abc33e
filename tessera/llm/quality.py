"""Quality classifier: attention-based multiple-instance learning over passages.

Every text is cut into passages of PASSAGE words.  Each passage is encoded (shares
of kinds of bytes, hashed byte pairs, repeats, lengths; then a learned layer), gated
attention weighs the passages, and the weighted representation is scored.  Encoder,
attention and score are learned together from document labels, by gradient descent
on the driver over a bounded sample: at most SAMPLE labelled documents of each
label, taken by the hash of doc_id, and of each at most BAG passages, spread evenly over its
whole text, so that what the driver gets is bounded in bytes too.  Scoring runs over all documents, each task by
itself, without a shuffle.

labels, lang, source and doc_id are never inputs of a score.  Rows whose crc32(doc_id
as text) mod 4 is 2 are held out and not learned from.

Defined cases: a null or empty text is one passage without content and gets a score; a
long text has all its passages weighed in its score; documents labelled twice with different
qualities are not learned from; with labels of one kind only, or none, every score is
that share of label 1 (none: 0.5); repeated rows get equal scores, and of rows with one doc_id one is learned from; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import table
from tessera.llm.words import NOT_SPACE, chunks, words

PASSAGE = 64
#: Labelled documents of each label to learn from, at most.
SAMPLE = 2000
#: Passages of a document to learn from, at most (scores weigh all of them): 44 KB a document, 180 MB of the whole sample.
BAG = 256
#: Score from which a document counts as good.
THRESHOLD = 0.7

_PAIRS = 64
_KINDS = np.full(256, 15, np.int32)
for _kind, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" ", b"\n\r", b".", b",", b"!?", b"%", b"#", b"$", b"&", b"*", b"|", range(0x80, 0x100))):
    _KINDS[list(_bytes)] = _kind
WIDTH = 16 + _PAIRS + 6


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and for each text the place of its first passage."""
    found = words(texts, NOT_SPACE, False)
    sizes = np.diff(found.first)
    per_text = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(per_text) - per_text
    total = int(per_text.sum())
    of_word = first[found.row] + (np.arange(len(found.row)) - found.first[found.row]) // PASSAGE
    out = np.zeros((total, WIDTH), np.float32)
    n = len(found.hash)
    if not n:
        return out, first
    raw = np.frombuffer(found.data, np.uint8)
    # a passage's bytes go from its first word to the next passage's
    head = np.flatnonzero(np.concatenate([[True], of_word[1:] != of_word[:-1]]))
    begin = found.start[head]
    of_byte = np.repeat(of_word[head].astype(np.int32), np.diff(np.concatenate([begin, [len(raw)]])))
    raw = raw[begin[0] :]
    kinds = np.bincount(of_byte * 16 + _KINDS[raw], minlength=total * 16).reshape(total, 16)
    wide = raw.astype(np.int32)
    pair = ((wide[:-1] * 0x9E37 + wide[1:] * 0x79B9) >> 5) % _PAIRS
    pairs = np.bincount(of_byte[:-1] * _PAIRS + pair, minlength=total * _PAIRS).reshape(total, _PAIRS)
    size = np.maximum(1, kinds.sum(1, keepdims=True))
    count = np.maximum(1, np.bincount(of_word, minlength=total))
    same = np.zeros((2, n))
    for lag in (1, 2):
        same[lag - 1, lag:] = (found.hash[lag:] == found.hash[:-lag]) & (of_word[lag:] == of_word[:-lag])
    length = found.end - found.start
    by = lambda weights: np.bincount(of_word, weights, total) / count
    mean = by(length.astype(float))
    out[:, :16] = np.sqrt(kinds / size)
    out[:, 16 : 16 + _PAIRS] = np.sqrt(pairs / size)
    out[:, 16 + _PAIRS :] = np.stack([by(same[0]), by(same[1]), np.log1p(mean), np.sqrt(np.maximum(0, by(length.astype(float) ** 2) - mean**2)) / (1 + mean), np.log1p(count), np.log1p(np.repeat(per_text, per_text))], 1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """The learned weights; base alone (a share of label 1) when there was nothing to learn."""

    base: float
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        sizes = np.diff(np.concatenate([first, [len(x)]]))
        z = np.clip((x - w["mean"]) / w["scale"], -6, 6)
        h = np.tanh(z @ w["encode"] + w["encode_0"])
        t, s = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        e = (t * s) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        bag = np.add.reduceat(a[:, None] * h, first)
        return {"sizes": sizes, "z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "logit": bag @ w["score"] + w["score_0"]}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        return _sigmoid(self.forward(*features(texts))["logit"].astype(float))


def learn(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, width: int = 24, gates: int = 12, steps: int = 400, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """A model from the passages of each document (rows of features), its label and its weight, by Adam."""
    rng = np.random.default_rng(7)
    every = np.concatenate(bags)
    scale = every.std(0) + 1e-3
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"encode": draw(every.shape[1], width), "encode_0": np.zeros(width, np.float32), "value": draw(width, gates), "gate": draw(width, gates), "attend": draw(gates), "score": draw(width), "score_0": np.zeros(1, np.float32)}
    model = Model(float(np.average(labels, weights=weight)), w | {"mean": every.mean(0), "scale": scale})
    held = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(bags), min(batch, len(bags)), replace=False)
        x = np.concatenate([bags[i] for i in pick])
        first = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
        m = model.weights
        f = model.forward(x, first)
        d = ((_sigmoid(f["logit"]) - labels[pick]) * weight[pick] / weight[pick].sum()).astype(np.float32)
        each = np.repeat(d, f["sizes"])[:, None] * m["score"]
        da = (each * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
        inner = de[:, None] * m["attend"]
        dt, ds = inner * f["s"] * (1 - f["t"] ** 2), inner * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * each + dt @ m["value"].T + ds @ m["gate"].T
        dz = dh * (1 - f["h"] ** 2)
        grads = {"encode": f["z"].T @ dz, "encode_0": dz.sum(0), "value": f["h"].T @ dt, "gate": f["h"].T @ ds, "attend": (f["t"] * f["s"]).T @ de, "score": f["bag"].T @ d, "score_0": d.sum(keepdims=True)}
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g + decay * m[k]
            held[k] = (0.9 * held[k][0] + 0.1 * g, 0.99 * held[k][1] + 0.01 * g * g)
            m[k] = (m[k] - now * (held[k][0] / (1 - 0.9**step)) / (np.sqrt(held[k][1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def spread(bag: np.ndarray, most: int) -> np.ndarray:
    """The bag, or as many of its rows as are allowed, the first, the last and evenly between."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).round().astype(int)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BAG) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, quality): sample documents of each label and most passages of each."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model(1.0 if counts.get(1) else 0.0 if counts else 0.5)
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            x, first = features(texts)
            packed = [spread(p, most).astype(np.float16).tobytes() for p in np.split(x, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "quality", "bag"])

    made = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, bag binary")
    # one row of a doc_id, however many there are
    rows = made.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: r.doc_id)
    quality = np.array([r.quality for r in rows], np.float32)
    if len(set(quality.tolist())) < 2:
        return Model(counts[1] / (counts[0] + counts[1]))
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    # the sample has as many of each label as it can; weights give each its share of all labels
    share = {q: counts[q] / max(1, int((quality == q).sum())) for q in (0, 1)}
    weight = np.array([share[int(q)] for q in quality], np.float32)
    return learn(bags, quality, weight / weight.mean())


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array(shared.value.score(texts) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
