"""MinHash forest and suffix dedup against brute force."""

import random

import numpy as np
import pytest

from supportkb.llm import components as stars
from supportkb.llm import minhash, suffix_dedup
from tests.llm.samples import components, documents, odd_rows, texts, without_repeats


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def crowd(seed: int = 3):
    """A group of 150 copies at differing distances, some of which reach the group through few others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(220)]
    rows, texts_ = [], [base]
    for i in range(150):
        words = list(rng.choice(texts_[-20:]))
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10 ** 6)}"
        texts_.append(words)
        rows.append((i * 3, " ".join(words)))
    return rows + [(1000 + i, " ".join(f"u{rng.randint(0, 9999)}" for _ in range(80))) for i in range(60)]


def test_documents_against_all_pairs(spark):
    rows = documents()
    assert found(minhash.near_duplicates(texts(spark, rows))) == components(rows)


@pytest.mark.parametrize("per_partition", [150_000, 300])
def test_crowded_group_in_one_and_in_many_partitions(spark, monkeypatch, per_partition):
    monkeypatch.setattr(minhash, "TREE_ROWS", per_partition)
    rows = crowd()
    assert found(minhash.near_duplicates(texts(spark, rows))) == components(rows)


def test_odd_rows_of_minhash(spark):
    rows = odd_rows()
    out = minhash.near_duplicates(texts(spark, rows))
    assert out.count() == len(rows)
    got, want = found(out.filter("doc_id IS NOT NULL")), components([r for r in rows if r[0] is not None])
    assert got == want
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[5][1] == 4 and got[14][1] == 4 and got[7][1] == 6
    assert minhash.near_duplicates(texts(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in stars.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def cut(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_all_windows(spark, hot):
    rows = documents()
    assert cut(suffix_dedup.removed(texts(spark, rows), hot)) == without_repeats(rows)[0]


def test_repeats_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 50)
    rows = documents()
    assert cut(suffix_dedup.removed(texts(spark, rows))) == without_repeats(rows)[0]


def test_odd_rows_of_repeats(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    unique = sorted(set(rows), key=lambda r: r[0])
    assert cut(suffix_dedup.removed(texts(spark, rows))) == without_repeats(unique)[0]
    assert suffix_dedup.removed(texts(spark, odd_rows())).count() == len(odd_rows())
    assert suffix_dedup.removed(texts(spark, [])).count() == 0


def test_left_texts_keep_columns(spark):
    rows = documents()
    out = suffix_dedup.without_repeats(texts(spark, rows))
    _, left = without_repeats(rows)
    assert out.columns == texts(spark, []).columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: b.decode("utf-8", "ignore") for i, b in left.items()}


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order, tied = suffix_dedup.multikey_order(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows)
    assert tied.tolist() == [False] + [a == b for a, b in zip(rows, rows[1:])]
