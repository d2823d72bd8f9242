"""Exact copies with and without heavy digests."""

import hashlib
import random
from collections import Counter

import pytest

from supportkb.llm import exact_dedup
from tests.llm.samples import odd_rows, texts


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = True
        for i in ids:
            stays = left and i == keep
            left = left and not stays
            out[(i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def crowd(seed=2):
    """A third of all rows is one text, some more are common, ids repeat."""
    rng = random.Random(seed)
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"common {i % 7}") for i in range(200)]
    rows += [(5000 + i, f"alone {i}") for i in range(300)] + [(5, "hot text"), (5003, "alone 3"), (None, "hot text"), (None, None), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", [1024, 8, 1])
def test_against_groups(spark, counters):
    rows = crowd()
    got = exact_dedup.copy_groups(texts(spark, rows).repartition(5), counters=counters)
    found = Counter((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got.collect())
    assert found == plain(rows)


def test_heavy_digests_are_found_and_bounded(spark):
    rows = exact_dedup.digests(texts(spark, crowd()).repartition(5))
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for counters in (2, 8, 64):
        heavy = [bytes(r.digest) for r in exact_dedup.heavy_digests(rows, rows._rows, counters).collect()]
        assert len(heavy) <= counters
        assert digest("hot text") in heavy or counters == 2


def test_summary_never_overcounts_and_bounds_its_loss():
    rng = random.Random(4)
    stream = [rng.choice("aaaabbbcc" + "".join(chr(200 + i) for i in range(40))) for _ in range(5000)]
    truth, summary = Counter(stream), Counter()
    for at in range(0, 5000, 137):
        summary = exact_dedup.merge_counts(summary, Counter(stream[at:at + 137]), 10)
        assert len(summary) <= 10
    for k, n in truth.items():
        assert n - 5000 / 11 <= summary[k] <= n


def test_odd_rows(spark):
    rows = odd_rows()
    got = exact_dedup.marked(texts(spark, rows))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == plain(rows)
    assert exact_dedup.marked(texts(spark, [])).count() == 0


def test_rows_that_stay_keep_their_columns(spark):
    rows = odd_rows() + crowd()
    docs = texts(spark, rows).repartition(3)
    out = exact_dedup.deduplicated(docs)
    assert out.dtypes == docs.dtypes
    want = Counter((i, h) for (i, _, _, stays, h), n in plain(rows).items() if stays)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()) == want


def test_normalised(spark):
    from pyspark.sql import functions as F
    out = exact_dedup.copy_groups(texts(spark, [(1, "One"), (2, "one "), (3, "two")]), normalise=lambda t: F.lower(F.trim(t)))
    assert {r.id: r.keep_id for r in out.collect()} == {1: 2, 2: 2, 3: 3}
