"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from supportkb.llm import resampling
from tests.llm.samples import documents, lower, odd_rows, table, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, least, most):
    w = WORDS.findall(lower(text or ""))
    return len(w), [" ".join(w[i:i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, least=1, most=1, percent=10, min_words=20, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(bucket(g) for x in some for g in runs(x, least, most)[1]) for some in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out, fit = [], []
    for i, x in rows:
        n_words, grams = runs(x, least, most)
        weight = sum(gain(bucket(g)) for g in grams)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(grams), weight, score, None])
        if n_words >= min_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(fit[:len(fit) * percent // 100], 1):
        r[4] = place
    return collections.Counter(map(tuple, out))


def found(df):
    return collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_documents_against_plain(spark):
    rows, target = documents(), [t for _, t in table("benchmark")]
    aim = texts(spark, list(enumerate(target)))
    assert found(resampling.resampled(texts(spark, rows).repartition(4), aim)) == plain(rows, target)


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_longer_runs_and_small_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rows, target = odd_rows() + [(50 + i, t) for i, (_, t) in enumerate(documents()[:40])], ["one two words 漢字", None, "" ]
    aim = texts(spark, list(enumerate(target)))
    for least, most in ((1, 1), (1, 3), (2, 2)):
        got = resampling.resampled(texts(spark, rows), aim, least=least, most=most, percent=30, min_words=2)
        assert found(got) == plain(rows, target, least, most, 30, 2), (least, most)


def test_empty_tables(spark):
    rows = [(1, "some words here"), (2, None)]
    assert found(resampling.resampled(texts(spark, rows), texts(spark, []), min_words=1)) == plain(rows, [], min_words=1)
    assert resampling.resampled(texts(spark, []), texts(spark, rows)).count() == 0
    assert resampling.resampled(texts(spark, []), texts(spark, [])).count() == 0


def test_drawn_rows_keep_their_columns(spark):
    docs = texts(spark, documents())
    out = resampling.drawn(docs, texts(spark, documents()[:20]))
    assert out.dtypes == docs.dtypes and out.count() == len([1 for _, t in documents() if runs(t, 1, 1)[0] >= 20]) * 10 // 100


def test_interned_spans_are_verified(monkeypatch):
    """Keys that all collide still give each n-gram a slot of its own."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode() for _ in range(300)]
    words += rng.choices(words, k=500)
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    keys = resampling.xxh64(data, start, size)
    assert keys.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(resampling, "xxh64", lambda d, s, n: np.full(len(s), 5, np.uint64))
        table_ = resampling.Interned(data, start, size, 97)
        assert len(set(zip(words, table_.slot.tolist()))) == len(set(words)) == len(table_.used)
        count = collections.Counter(words)
        for w, slot in zip(words, table_.slot.tolist()):
            assert table_.count[slot] == count[w] and table_.bucket[slot] == zlib.crc32(w) % 97
