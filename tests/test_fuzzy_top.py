"""The fuzzy search hands on the best rows of a term only, and loses none of them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from supportkb.functions.fuzzy import _codes, best_hits, inside_ratios, partial_ratio
from supportkb.operators import search as S
from tests.test_text import brute_partial

SCHEMA = pa.schema([("scope", pa.string()), ("layer", pa.string()), ("row_ord", pa.int64()), ("term", pa.string()), ("_s", pa.int64())])


def _batches(rows, pack, size):
    for lo in range(0, len(rows), size):
        part = rows[lo:lo + size]
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([""] * n), pa.array([0] * n), pa.array([0] * n), pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64()),
             pa.array([r[2] for r in part], pa.string()), pa.array([pack] * n)], ["scope", "slot", "pack_no", "layer", "row_ord", "_text", "pack"])


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_a_task_hands_on_the_best_rows_of_each_term_only(order):
    random.seed(3)
    word = lambda a, lo, hi: "".join(random.choice(a) for _ in range(random.randint(lo, hi)))
    pack = ["abc", "abcabcab", "bbaac", "加湿器", "ab\0c", word("abc", 70, 70)]
    rows = [(random.choice(["OCR", "FAQ", None]), i // 2 if i % 50 else None, random.choice([word("abcd", 0, 12), word("abcd加湿器\0", 20, 90), None]))
            for i in range(1500)]
    rows = {"up": rows, "down": rows[::-1], "mixed": random.sample(rows, len(rows))}[order]
    top, key = 4, lambda r: (r is not None, r)
    got = {}
    for batch in best_hits(50.0, top, SCHEMA)(_batches(rows, pack, 200)):
        for h in batch.to_pylist():
            got.setdefault((h["layer"], h["term"]), []).append((h["row_ord"], h["_s"]))
    best = {}
    for layer, row, text in rows:
        for term in pack:
            if text and (score := partial_ratio(term, text)) >= 50:
                of = best.setdefault((layer, term), {})
                of[row] = max(of.get(row, 0), round(score * 1_000_000))
    want = {k: sorted(v.items(), key=lambda x: (-x[1], key(x[0])))[:top] for k, v in best.items()}
    assert {k: sorted(v, key=lambda x: (-x[1], key(x[0]))) for k, v in got.items()} == want


def test_short_texts_slide_over_the_term():
    random.seed(5)
    for m in (1, 7, 8, 9, 31, 33, 64, 65):
        term = "".join(random.choice("abcd") for _ in range(m))
        texts = ["".join(random.choice("abcde") for _ in range(random.randint(1, m))) for _ in range(40)]
        got = inside_ratios([_codes(t) for t in texts], _codes(term))
        want = [max(200 * _lcs_len(t, term[max(s, 0):s + len(t)]) / (len(t) + len(term[max(s, 0):s + len(t)]))
                    for s in range(1 - len(t), m)) for t in texts]
        assert np.allclose(got, want)


def _lcs_len(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_repeated_rows_queries_and_terms_of_several_products(spark):
    random.seed(8)
    blobs = ["".join(random.choice("abcde") for _ in range(random.randint(1, 25))) for _ in range(120)]
    rows = [("OCR", i % 80, f"n{i % 3}", "", b, "") for i, b in enumerate(blobs)]
    q = [(1, "", "abcde"), (2, "n1", "abcde"), (3, "", "ddee")]
    terms = [(1, 0, "abcde"), (1, 1, "eddc"), (2, 0, "abcde"), (3, 0, "ddee"), (3, 1, "ab"), (3, 2, "abcde")]
    df = lambda data, schema: spark.createDataFrame(data, schema).repartition(5)
    hits = S.search_fuzzy(df(rows, "layer string, row_ord long, name string, page string, blob string, ref string"),
                          df(terms, "query_id long, ord int, term string"), df(q, "query_id long, product string, q string"), top=7)
    got = {(h.query_id, h.rank): (h.row_ord, h.score, h.term) for h in hits.collect()}
    want = {}
    for query, product, _ in q:
        best = {}
        for _, row, name, _, blob, _ in rows:
            for owner, ord_, term in terms:
                score = round(brute_partial(term, blob), 6)
                if owner == query and product in name and score >= 62:
                    best[row] = min(best.get(row, (0, 0, "")), (-score, ord_, term))
        for rank, (row, (s, _, term)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:7], 1):
            want[query, rank] = (row, -s, term)
    assert got == want
