"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are trigrams of byte classes (letters, capitals, digits, kinds of punctuation, line ends, words that repeat
the word before). Their Hellinger-scaled, idf-weighted counts of a bounded sample of labelled training documents give a
truncated SVD; every document is projected into it, exact cosines with all labelled vectors are computed block by
block, and the ``neighbours`` most similar ones vote with weights that grow with their similarity.

Only the labelled sample is collected (at most ``sample`` documents, ``SAMPLE`` by default, the ones with the least hash
of their id): it is what the model is fitted on and what is broadcast, and it does not grow with the corpus.

Defined cases: a text without terms (null, empty, one or two bytes) gets the share of label 1 in the sample; labels
that are null are not learned from; without any label all scores are 0.5; repeated rows are scored alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm import common

SAMPLE = 4096
TERMS = 4096
PIECE = 1 << 18

# Classes of bytes.
_CLASS = np.full(256, 0, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[ord(".")] = 5
_CLASS[ord(",")] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~+="]] = 8
_CLASS[ord("|")] = 9
_CLASS[[ord(c) for c in "()[]{}<>\"'`"]] = 10
_CLASS[[ord(c) for c in "/:;-_\\"]] = 11
_CLASS[[*range(9), *range(14, 32), 127]] = 12
_REPEAT = 13


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of class trigrams, one row per text."""
    shape = _CLASS[data]
    start, end, first = common.words(data, offsets)
    if len(start) > 1:
        hashed = common.span_hash(common.prefix_hash(data), start, end)
        again = np.flatnonzero(hashed[1:] == hashed[:-1]) + 1
        again = again[~np.isin(again, first)]
        if len(again):
            size = end[again] - start[again]
            shape[np.repeat(start[again], size) + common.sequences(size)] = _REPEAT
    rows = len(offsets) - 1
    wide = shape.astype(np.int64)
    tri = wide[:-2] * 256 + wide[1:-1] * 16 + wide[2:] if len(wide) > 2 else np.zeros(0, np.int64)
    n = np.maximum(np.diff(offsets) - 2, 0)
    row = np.repeat(np.arange(rows), n)
    at = np.repeat(offsets[:-1], n) + common.sequences(n)
    return np.bincount(row * TERMS + tri[at], minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)


def _hellinger(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class NeighbourVote:
    """Latent vectors of the labelled sample and the projection that leads to them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 25, power: float = 16.0):
        self.neighbours, self.power = neighbours, power
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.used = np.flatnonzero((counts > 0).sum(0) >= 2)
        df = (counts[:, self.used] > 0).sum(0)
        weight = np.log((1 + len(counts)) / (1 + df)) + 0.1
        x = _hellinger(counts)[:, self.used] * weight
        self.projection = np.zeros((len(self.used), 1), np.float32)
        if len(self.used):
            # range finder with two power steps; the seed makes a run repeatable
            draw = np.random.default_rng(7).standard_normal((len(self.used), min(rank + 16, len(self.used))))
            q = np.linalg.qr(x @ draw)[0]
            for _ in range(2):
                q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
            right = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank]
            self.projection = (weight[:, None] * right.T).astype(np.float32)
        self.vectors = _unit(_hellinger(counts)[:, self.used] @ self.projection).astype(np.float32)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(counts), block):
            part = counts[at:at + block]
            mine = _unit(_hellinger(part)[:, self.used] @ self.projection)
            cosine = mine @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** self.power
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            seen = total > 1e-12
            out[at:at + block][seen] = vote[seen] / total[seen]
        return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample`` learnable labelled documents, by least hash of the id."""
    few = (labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .select("doc_id", F.col(label).cast("int").alias("label"))
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")   # at most ``sample`` rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None, sample: int = SAMPLE, **model) -> NeighbourVote:
    """Learn from the labelled sample; ``learn`` says which rows may be learned from."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, sample)

    def counted(batches):
        for batch in batches:
            data, offsets = common.column_bytes(batch.column(2))
            for a, b in common.pieces(data, offsets, PIECE):
                counts = term_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                row, term = np.nonzero(counts)
                cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int16))),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(counts[row, term]))], ["doc_id", "label", "term", "n"])
    got = (rows.select(F.col("doc_id").cast("long"), "label", F.col("text").cast("string"))
           .mapInArrow(counted, "doc_id long, label int, term array<short>, n array<float>").collect())
    got.sort(key=lambda r: r[0])
    counts = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        counts[i, r[2]] = r[3]
    return NeighbourVote(counts, np.array([r[1] for r in got], np.float32), **model)


def _by_blocks(column, held) -> np.ndarray:
    """Scores of a column of texts, block by block."""
    data, offsets = common.column_bytes(column)
    out = np.zeros(len(column))
    for a, b in common.pieces(data, offsets, PIECE):
        for c in range(a, b, 512):
            d = min(c + 512, b)
            out[c:d] = held.value.score(term_counts(data[offsets[c]:offsets[d]], offsets[c:d + 1] - offsets[c]))
    return out


def scored(docs: DataFrame, model: NeighbourVote, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)     # bounded by the sample

    def run(batches):
        for batch in batches:
            score = _by_blocks(batch.column(1), held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()),
                                              pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: NeighbourVote, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``. Only texts go to Python and only scores come back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(_by_blocks(text, held), pa.float64())
    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
