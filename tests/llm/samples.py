"""Small inputs and brute-force versions for the operators of supportkb.llm."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: doc_id and text, and columns whose names the operators use themselves.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [
    T.StructField(c, T.StringType()) for c in ("kept", "component", "n_shingles", "row", "key", "th", "spans", "label", "score",
                                               "features", "chunk", "sigs", "_block", "seed", "place", "train", "lang", "source")] + [
    T.StructField("n_chars", T.LongType())])


def texts(spark, rows):
    extra = ("x",) * (len(SCHEMA.fields) - 3)
    return spark.createDataFrame([(i, t, *extra, len(t or "")) for i, t in rows], SCHEMA)


def odd_rows(seed: int = 5):
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties, one-word texts, foreign scripts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    near = long.split(" ")
    near[100:103] = ["changed", "in", "place"]
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, " ".join(near)), (8, long), (None, long[:3000]),
            (None, None), (9, "漢字 😀 é " * 40), (10, "漢字 😀 é " * 40), (11, "x" * 5000), (12, "!!! ??? ..."), (13, "two words"), (14, "ONE")]


def documents(sf: str = SF):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()


def table(name: str, sf: str = SF):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent: int = 75) -> dict:
    """doc_id -> (set size, least id that can be reached), all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    ids = [i for i in sorted(sets) if sets[i]]
    for at, a in enumerate(ids):
        for b in ids[:at]:
            if min(len(sets[a]), len(sets[b])) * 100 < percent * max(len(sets[a]), len(sets[b])):
                continue
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(rows, length: int = 100) -> dict:
    """doc_id -> (bytes, removed, spans, digest), kept bytes; every window looked up among all earlier ones."""
    seen, out, left = set(), {}, {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i], left[i] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()), kept
    return out, left


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def language_model(rows):
    """doc_id -> (n_tokens, n_known, base_score) and the training counts."""
    tokens = {i: WORD.findall(lower(t or "")) + ["</s>"] for i, t in rows}
    counts = collections.Counter()
    for i in tokens:
        if fold(i, 7) != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
            for i, t in tokens.items()}, tokens, n
