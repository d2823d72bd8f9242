"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | h) = l2[b] c(h w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of the context's frequency
(powers of two). The weights of each bucket are learned by expectation-maximisation on held-out counts: every training
token is left out of the counts it is predicted with. Statistics are taken over all training tokens.

Texts are written once as chunks: a vocabulary and the token sequence as compressed ranks in it. A chunk gives its
distinct words and word pairs with their training counts, as packed keys per range of keys; per range the counts of
all chunks are added up and each chunk gets the totals of its own keys back. So a very common word is one entry per
chunk, no table of n-grams is ever broadcast, and what is shuffled is each chunk's distinct n-grams instead of its
tokens. Two passes join chunks and totals: statistics for the weights, then scores.

Defined cases: null and empty texts have the end token only; a null id is trained on or held out like empty text; without
training text every estimate but the uniform one is 0; repeated rows count and are scored as often as they stand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm import common

CHUNK = 4 << 20              # bytes of text
RANGE_CHARS = 6 << 20        # characters of text per range of keys
ROUNDS = 40

_END, _BEGIN = np.uint64(0x51ED270B27F94C11), np.uint64(0x9D39247E33776D41)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_STEP = 4.0                  # cells per power of two of a probability
_NEVER = -1000               # cell of probability 0


def _packed(values: np.ndarray, width: int = 4) -> bytes:
    """Integers below 2^(8 width), byte planes apart, compressed. Four bytes hold what a chunk counts, as it has ``CHUNK``
    bytes of text or is one text; totals of the corpus take eight."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pairs(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context key of each token and key of the pair."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = _BEGIN
    return before, common.mix(before * _LEFT + tokens * _RIGHT)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end token behind each text, and the offset of each text."""
    data = common.lower_ascii(data)
    start, end, first = common.words(data, offsets)
    keys = common.span_hash(common.prefix_hash(data), start, end)
    return np.insert(keys, first[1:], _END), first + np.arange(len(first))


_CHUNK = "chunk long, n int, a binary, b binary, c binary, d binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts: doc ids, token numbers and training flags, vocabulary (most frequent first), token ranks."""
    def run(batches):
        seq = 0
        base = np.int64(TaskContext.get().partitionId()) << np.int64(24)
        for batch in batches:
            data, offsets = common.column_bytes(batch.column(1))
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in common.pieces(data, offsets, CHUNK):
                tokens, cut = _tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                vocabulary, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(count), np.int64)
                rank[order] = np.arange(len(count))
                row = [int(base + seq), b - a, ids[a:b].tobytes(), np.concatenate([np.diff(cut), train[a:b]]).astype("<i8").tobytes(),
                       vocabulary[order].tobytes(), _packed(rank[place])]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int32()] + [pa.binary()] * 4)],
                                                 ["chunk", "n", "a", "b", "c", "d"])
    return docs.mapInArrow(run, _CHUNK)


class _Sequence:
    """The texts of a chunk row."""

    def __init__(self, row: dict):
        docs = row["n"]
        self.ids = np.frombuffer(row["a"], np.int64)
        flags = np.frombuffer(row["b"], "<i8")
        self.lengths, self.train = flags[:docs], flags[docs:].astype(bool)
        self.vocabulary = np.frombuffer(row["c"], np.uint64)
        self.ranks = _unpacked(row["d"], int(self.lengths.sum()))
        self.first = np.cumsum(self.lengths) - self.lengths
        _, pairs = _pairs(self.vocabulary[self.ranks], self.first)
        self.pair_keys, self.pair_place = np.unique(pairs, return_inverse=True)


def _requests(chunks: DataFrame, ranges: int) -> DataFrame:
    """The words (kind 1) and pairs (kind 2) of each chunk in each range of keys, with their training counts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Sequence(row)
                learn = np.repeat(c.train, c.lengths)
                order = np.argsort(c.vocabulary)
                words = np.bincount(c.ranks[learn], minlength=len(order))[order]
                pairs = np.bincount(c.pair_place[learn], minlength=len(c.pair_keys))
                out = [[], [], [], [], [], []]
                for kind, keys, counts in ((1, c.vocabulary[order], words), (2, c.pair_keys, pairs)):
                    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        for column, value in zip(out, (kind, row["chunk"], int(part[lo]), hi - lo, _packed_keys(keys[lo:hi]), _packed(counts[lo:hi]))):
                            column.append(value)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["kind", "chunk", "part", "n", "a", "b"])
    return chunks.mapInArrow(run, "kind int, chunk long, part int, n int, a binary, b binary")


def _totals(requests: DataFrame) -> DataFrame:
    """Totals for each request, and per range (in its first row) the training tokens and the known words."""
    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        keys = np.concatenate([_unpacked_keys(x, k) for x, k in zip(table.column("a").to_pylist(), n)])
        counts = np.concatenate([_unpacked(x, k) for x, k in zip(table.column("b").to_pylist(), n)])
        _, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(n)])
        replies = [_packed(total[place[i:j]], 8) for i, j in zip(edges[:-1], edges[1:])]
        kind = table.column("kind")[0].as_py()
        rest = [0] * (len(n) - 1)
        return pa.table({"kind": table.column("kind"), "chunk": table.column("chunk"), "part": table.column("part"),
                         "n": table.column("n"), "totals": pa.array(replies, pa.binary()),
                         "tokens": pa.array([int(total.sum()) if kind == 1 else 0, *rest], pa.int64()),
                         "known": pa.array([int((total > 0).sum()) if kind == 1 else 0, *rest], pa.int64())})
    return requests.groupBy("kind", "part").applyInArrow(
        run, "kind int, chunk long, part int, n int, totals binary, tokens long, known long")


class _Chunk(_Sequence):
    """Counts of every token of a chunk, put together from its sequence and the replies."""

    def __init__(self, own: pa.Table, replies: pa.Table):
        super().__init__({c: own.column(c)[0].as_py() for c in ("n", "a", "b", "c", "d")})
        order = np.lexsort((replies.column("part").to_numpy(), replies.column("kind").to_numpy()))
        kinds, sizes, raw = (replies.column(c).to_pylist() for c in ("kind", "n", "totals"))

        def totals(kind):
            return np.concatenate([_unpacked(raw[i], sizes[i], 8) for i in order.tolist() if kinds[i] == kind]).astype(np.float64)
        by_rank = np.empty(len(self.vocabulary))
        by_rank[np.argsort(self.vocabulary)] = totals(1)
        self.word = by_rank[self.ranks]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = by_rank[self.vocabulary == _END]      # texts that begin are as many as texts that end
        self.pair = totals(2)[self.pair_place]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _ratio(a, b):
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _cells(joined, tokens: float) -> DataFrame:
    """Held-out statistics: training tokens by context bucket and (logarithmic) cells of both estimates."""
    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        columns = [np.zeros(0)] * 6
        if own.num_rows:
            c = _Chunk(own, replies)
            use = np.repeat(c.train, c.lengths)
            # each token is left out of the counts that predict it
            pair, context, word = c.pair[use] - 1, c.context[use] - 1, c.word[use] - 1
            p2, p1 = _ratio(pair, context), word / max(tokens - 1, 1)

            def cell(p):
                log = np.log2(np.maximum(p, 1e-300))
                return np.where(p > 0, np.floor(log * _STEP), _NEVER), np.where(p > 0, log, 0.0)
            (k2, g2), (k1, g1) = cell(p2), cell(p1)
            key = np.stack([_bucket(context), k2.astype(np.int64), k1.astype(np.int64)], 1)
            if len(key):
                code = (key[:, 0] << 32) + ((key[:, 1] + 2000) << 16) + (key[:, 2] + 2000)
                _, at, place = np.unique(code, return_index=True, return_inverse=True)
                columns = [*key[at].T, np.bincount(place), np.bincount(place, g2), np.bincount(place, g1)]
        return pa.table(dict(zip(["bucket", "k2", "k1", "n", "g2", "g1"],
                                 [*(pa.array(np.asarray(x).astype(np.int64)) for x in columns[:4]),
                                  *(pa.array(np.asarray(x).astype(np.float64)) for x in columns[4:])])))
    found = joined.applyInArrow(run, "bucket long, k2 long, k1 long, n long, g2 double, g1 double")
    return found.groupBy("bucket", "k2", "k1").agg(F.sum("n").alias("n"), F.sum("g2").alias("g2"), F.sum("g1").alias("g1"))


def learn_weights(cells: list, vocabulary: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, word, uniform) per bucket of context frequency, by expectation-maximisation."""
    weights = np.full((64, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    if not cells:
        return weights
    bucket, k2, k1, n, g2, g1 = (np.array(x, np.float64) for x in zip(*cells))
    bucket = bucket.astype(np.int64)
    p = np.stack([np.where(k2 > _NEVER, 2 ** (g2 / n), 0.0), np.where(k1 > _NEVER, 2 ** (g1 / n), 0.0),
                  np.full(len(n), 1 / (vocabulary + 1))], 1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        for k in range(3):
            weights[:, k] = np.where(np.bincount(bucket, n, 64) > 0, np.bincount(bucket, share[:, k], 64) / np.maximum(np.bincount(bucket, n, 64), 1),
                                     weights[:, k])
    return weights


def scores(documents: DataFrame, train) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` says which rows are learned
    from."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.as_text(F.col("text")).alias("text"),
                            F.coalesce(train, F.lit(False)).alias("train"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    own = common.written(_chunks(docs), "chunks")
    totals = common.written(_totals(_requests(own, max(4, int(chars // RANGE_CHARS)))), "totals")
    tokens, known = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("known")).first())
    replies = totals.select("chunk", "kind", "part", "n", "totals")

    def joined():
        return own.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    cells = [tuple(r) for r in _cells(joined(), tokens).collect()]       # bounded: buckets x cells of two probabilities
    weights = learn_weights(cells, known)

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not own.num_rows:
            return pa.table(dict(zip(names, [pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())] * 2)))
        c = _Chunk(own, replies)
        w = weights[_bucket(c.context)]
        p = w[:, 0] * _ratio(c.pair, c.context) + w[:, 1] * c.word / max(tokens, 1) + w[:, 2] / (known + 1)
        base = np.log10((c.word + 1) / (tokens + known + 1))

        def per_doc(x):
            return np.add.reduceat(x, c.first)
        ids = pa.array(c.ids, mask=c.ids == -(1 << 63))
        return pa.table(dict(zip(names, [ids, pa.array(c.lengths), pa.array(per_doc((c.word > 0).astype(np.int64))),
                                         pa.array(np.full(len(c.ids), tokens)), pa.array(per_doc(base)), pa.array(per_doc(np.log10(p)))])))
    return joined().applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
