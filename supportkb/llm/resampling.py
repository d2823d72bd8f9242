"""Target-distribution importance resampling: documents are drawn by how much likelier their n-grams are in a target text
collection than in the corpus, with Gumbel noise.

Each batch interns its n-grams in an open-addressed table of numpy arrays: XXH64 of an n-gram's bytes is its key, probing is
linear, and a hit counts only after its length and bytes were compared. A slot holds the bucket (crc32 modulo
``buckets``) and the count of its n-gram, so each distinct n-gram of a batch is hashed into its bucket once; the slot ids of
the occurrences later gather the buckets' gains, which are summed per document.

Two passes over the corpus: bucket counts (per task, then summed by bucket) and weights. What is broadcast and what the
driver holds are the ``buckets`` gains. The draw orders the eligible documents by range partitions; a rank is the place in
the partition plus the sizes of the partitions before it.

Defined cases: null, empty and wordless texts have no n-grams and weight 0; fewer words than an n-gram has give none of
that length; an empty corpus gives no row, an empty target gains from an empty histogram; ties of scores go to the smaller
id, null ids first, repeated rows are rows of their own; very long texts are cut into pieces of ``PIECE`` bytes between words
inside a task and their pieces are added up; other columns don't matter."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from supportkb.llm import common

BUCKETS, PIECE = 10_000, 1 << 20

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                                  9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian integers that begin at every byte of ``data`` (padded)."""
    return np.ndarray(len(data) - np.dtype(kind).itemsize + 1, kind, data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of many spans; ``data`` has 8 spare bytes at its end. Spans of 32 bytes or more, which are rare
    among words, go to the library one by one."""
    eight, four = _lanes(data, "<u8"), _lanes(data, "<u4")
    h = _P5 + size.astype(np.uint64)
    at, left = start.copy(), np.where(size < 32, size, 0)
    while len(go := np.flatnonzero(left >= 8)):
        h[go] = _turn(h[go] ^ (_turn(eight[at[go]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _turn(h[go] ^ (four[at[go]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[go] += 4
    left[go] -= 4
    while len(go := np.flatnonzero(left > 0)):
        h[go] = _turn(h[go] ^ (data[at[go]].astype(np.uint64) * _P5), 11) * _P1
        at[go] += 1
        left[go] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]])
    return h


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at a and b are equal, eight at a time."""
    eight = _lanes(data, "<u8")
    same, done = np.ones(len(a), bool), 0
    go = np.flatnonzero((size > 0) & (a != b))
    while len(go):
        rest = np.minimum(size[go] - done, 8).astype(np.uint64)
        unlike = (eight[a[go] + done] ^ eight[b[go] + done]) << ((np.uint64(8) - rest) * np.uint64(8))
        same[go] = unlike == 0
        done += 8
        go = go[(unlike == 0) & (size[go] > done)]
    return same


class Interned:
    """The distinct spans of a piece: ``slot`` of every occurrence, and per slot one owner, its bucket and its count."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int):
        room = 1 << max(4, int(2 * len(start)).bit_length())
        key = xxh64(data, start, size)
        owner = np.full(room, -1, np.int64)
        self.slot = np.zeros(len(start), np.int64)
        place, mask = (key & np.uint64(room - 1)).astype(np.int64), room - 1
        open_ = np.arange(len(start))
        while len(open_):
            at = place[open_]
            empty = owner[at] < 0
            owner[at[empty]] = open_[empty]               # of several that find it empty, one stays
            mine = owner[at]
            hit = (key[open_] == key[mine]) & (size[open_] == size[mine])
            hit[hit] = _same_bytes(data, start[open_[hit]], start[mine[hit]], size[open_[hit]])
            self.slot[open_[hit]] = at[hit]
            open_ = open_[~hit]
            place[open_] = (place[open_] + 1) & mask
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, np.int64)
        spans = memoryview(data)
        first, last = start[owner[self.used]].tolist(), (start + size)[owner[self.used]].tolist()
        self.bucket[self.used] = [zlib.crc32(spans[a:b]) % buckets for a, b in zip(first, last)]


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Digits, lower-case letters, and every byte of a character beyond ASCII."""
    return ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)


def word_runs(data: np.ndarray, offsets: np.ndarray, least: int, most: int):
    """Runs of ``least`` to ``most`` words of each text: (bytes with one space between words, start, size, text of each run), and
    the words of each text."""
    data = common.lower_ascii(data)
    word = _word_bytes(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]          # a byte of the same word stands before
    first = word & ~before
    space = ~word & before                                 # the first byte behind a word
    keep = word | space
    spot = np.cumsum(keep) - keep
    out = np.where(word, data, np.uint8(32))[keep]
    begin = np.flatnonzero(first)
    after = np.r_[~word[1:], True] | edge[1:]
    end = np.flatnonzero(word & after)
    start, size = spot[begin], end - begin + 1
    n_words = np.diff(np.searchsorted(begin, offsets))
    row = np.repeat(np.arange(len(n_words)), n_words)
    runs = []
    for k in range(least, most + 1):
        here = np.arange(max(0, len(start) - k + 1))
        here = here[row[here] == row[here + k - 1]]
        runs.append((start[here], start[here + k - 1] + size[here + k - 1] - start[here], row[here]))
    start, size, row = (np.concatenate(x).astype(np.int64) for x in zip(*runs))
    return np.concatenate([out, np.zeros(8, np.uint8)]), start, size, row, n_words


def _pieces(column, most: int):
    """(first row, bytes, offsets) of bounded pieces; a longer text comes alone."""
    data, offsets = common.column_bytes(column)
    for a, b in common.pieces(data, offsets, most):
        yield a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _cuts(data: np.ndarray, most: int):
    """Ends of parts of a text, none between the bytes of a word."""
    at = 0
    while len(data) - at > most:
        end = at + most
        while end < len(data):
            gap = np.flatnonzero(~_word_bytes(common.lower_ascii(data[end:end + 4096])))
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        end = min(end, len(data))
        yield at, end
        at = end
    yield at, len(data)


def _interned(data, offsets, least, most, buckets, piece):
    """(table, row of each occurrence, words of each row) of a piece. A single text longer than a piece is taken in parts cut
    between words; runs that reach over a cut come from a part of their own, the last words before it and the first behind."""
    if len(offsets) != 2 or len(data) <= piece:
        text, start, size, row, n_words = word_runs(data, offsets, least, most)
        yield Interned(text, start, size, buckets), row, n_words
        return
    tail = []
    for a, b in _cuts(data, piece):
        text, start, size, row, n_words = word_runs(data[a:b], np.array([0, b - a]), least, most)
        yield Interned(text, start, size, buckets), row, n_words
        if most > 1 and n_words[0]:
            head, at, width = (word_runs(data[a:b], np.array([0, b - a]), 1, 1)[i] for i in range(3))
            words = [head[x:x + w].tobytes() for x, w in zip(at[:most - 1].tolist(), width[:most - 1].tolist())]
            over = [b" ".join((tail + words)[i:i + k]) for k in range(max(2, least), most + 1)
                    for i in range(max(0, len(tail) - k + 1), len(tail)) if i + k <= len(tail + words)]
            if over:
                joined = np.frombuffer(b"".join(over) + bytes(8), np.uint8)
                size = np.array([len(x) for x in over])
                yield Interned(joined, np.cumsum(size) - size, size, buckets), np.zeros(len(over), np.int64), np.zeros(1, np.int64)
            last = [head[x:x + w].tobytes() for x, w in zip(at[-(most - 1):].tolist(), width[-(most - 1):].tolist())]
            tail = (tail + last)[-(most - 1):]


def bucket_counts(texts: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of word runs of a table per bucket, at most ``buckets`` rows."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _pieces(batch.column(0), PIECE):
                for table, _, _ in _interned(data, offsets, least, most, buckets, PIECE):
                    np.add.at(total, table.bucket[table.used], table.count[table.used])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log likelihood ratio) of every bucket, smoothed by one; both counts have at most ``buckets`` rows."""
    def counts(df):
        out = np.zeros(buckets, np.int64)
        for bucket, n in df.collect():
            out[bucket] = n
        return out
    s, t = counts(corpus), counts(target)
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * total_s / ((float(a) + 1) * total_t)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)        # one number per bucket
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for a, data, offsets in _pieces(batch.column(1), PIECE):
                n = len(offsets) - 1
                words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
                for table, row, n_words in _interned(data, offsets, least, most, buckets, PIECE):
                    each = held.value[table.bucket][table.slot]
                    words += n_words
                    features += np.bincount(row, minlength=n)
                    # whole numbers far below 2^53 in a piece, so the doubles are exact
                    weight += np.bincount(row, weights=each, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(words), pa.array(features), pa.array(weight)],
                                                 ["doc_id", "n_words", "n_features", "weight"])
    return (docs.select(F.col(order).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def gumbel(doc_id, seed: int):
    """floor(1000 * Gumbel noise) of an id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list, eligible, share) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... by ``order`` among the ``eligible`` up to share(n) of them, null elsewhere.

    The order is one range-partitioned sort; places inside a partition are counted as it is written, and the sizes of the
    partitions, one number each, give what stands before it."""
    seen = Observation()
    chosen = rows.filter(eligible).repartitionByRange(*order).sortWithinPartitions(*order)
    chosen = chosen.withColumn("_at", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n"))
    chosen = common.written(chosen, "ordered")
    draw = share(seen.get["n"])
    part = F.shiftright("_at", 33)
    sizes = sorted((p, n) for p, n in chosen.groupBy(part.alias("p")).count().collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    session = rows.sparkSession
    offsets = session.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    chosen = chosen.join(F.broadcast(offsets), part == F.col("_part"))       # one row per partition
    chosen = chosen.select(*rows.columns, F.when(place <= draw, place).alias("rank"))
    rest = rows.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, percent: int = 10, min_words: int = 20,
              seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; the drawn ones have a rank."""
    gain = gains(bucket_counts(docs, least, most, buckets), bucket_counts(target, least, most, buckets), buckets)
    scored = weights(docs, gain, least, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = common.written(scored.withColumn("row", F.monotonically_increasing_id()), "weights")
    out = ranked(scored, [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()], F.col("n_words") >= min_words,
                 lambda n: n * percent // 100)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; ids are taken to be unique."""
    ids = resampled(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_drawn"]), "left_semi")
