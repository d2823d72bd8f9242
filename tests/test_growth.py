"""Steps whose rows must not grow with queries times entries: the same results as the plain forms, and bounded rows between."""

import json
import random

import pytest

from supportkb.functions.text import norm
from supportkb.operators import search as S
from supportkb.operators.containment import contains_groups
from supportkb.plans import answer
from supportkb.streaming import flows

ROWS = "layer string, row_ord long, name string, page string, blob string, ref string"
Q = "query_id long, product string, q string"
SYN = "term string, expansion string, ord int"
FAQ = "sheet string, item_ord long, question string, answer string, template string"


@pytest.fixture
def written(monkeypatch):
    """Rows of every lineage cut of the search and the cascade."""
    sizes, cut = [], S.cut_lineage

    def counted(df):
        back = cut(df)
        sizes.append((tuple(back.columns), back.count()))
        return back
    monkeypatch.setattr(S, "cut_lineage", counted)
    monkeypatch.setattr(answer, "cut_lineage", counted)
    return sizes


def test_terms_in_the_row_equal_the_joins(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, n)))
    syn = spark.createDataFrame([(word(3), word(4), None if i % 9 == 0 else rng.randint(0, 12)) for i in range(60)], SYN)
    q = spark.createDataFrame([(i % 35, "", None if i == 7 else word(12)) for i in range(40)] + [(None, "", "ab")], Q)
    normed = syn.select(norm("term").alias("nkey"), norm("expansion").alias("nexp"), "ord").filter("nkey <> '' AND nexp <> ''")
    plain = S._expand_by_joins(q.select("query_id", norm("q").alias("qn")).filter("qn <> ''"), normed)
    got = S.expand_terms(q, syn)
    assert got.schema["ord"].dataType == plain.schema["ord"].dataType
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(repr, df.select("query_id", "ord", "term").collect()))
    assert key(got) == key(plain) and got.count() > 200


def test_groups_of_a_text_by_both_routes(spark):
    texts = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "zz"), (3, None)], "k int, t string")
    words = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("", "n")], "w string, g string")
    for route in ("finder", "grams"):
        got = contains_groups(texts, "t", words, "w", "g", ["k"], route).collect()
        assert {(r.k, tuple(sorted(r.g))) for r in got} == {(1, ("x", "y"))}
    assert contains_groups(texts, "t", words.limit(0), "w", "g", ["k"]).count() == 0


def test_lookup_brings_a_few_entries_per_key(spark, written):
    """60 entries of a sheet share a key that 60 queries ask for: 3,600 pairs, of which only the first 3 entries matter."""
    items = spark.createDataFrame([("s", i, f"charge no {i}", "a", "") for i in range(60)] + [("t", 5, "charge", "b", "")], FAQ)
    syn = spark.createDataFrame([("charge", "power", 0)], SYN)
    q = spark.createDataFrame([(i, "s", f"charge no {i}") for i in range(60)] + [(100, "t", "power"), (101, "", "charge"), (102, "u", "charge")], Q)
    got = {}
    for r in S.lookup_fast(S.build_faq_lookup(items, syn), S.expand_terms(q, syn), q).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.sheet, r.item_ord))
    # the term "charge" is a key only where a query expands to it
    assert got[100] == [(1, "t", 5)] and 101 not in got and 102 not in got
    assert all(got[i] == [(1, "s", i)] for i in range(60))
    entries = [n for columns, n in written if columns == ("sheet", "item_ord", "key")]
    assert entries == [60 + 3 + 1]


def test_queries_with_hits_equal_the_pairs(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rows = spark.createDataFrame([(("OCR", "CHATGPT")[i % 2], i, f"N{i % 4}", "", word(14), "") for i in range(30)], ROWS)
    q = spark.createDataFrame([(i, rng.choice(["", "n1", "N2", "a", "zz"]), "x") for i in range(80)], Q)
    terms = spark.createDataFrame([(i, o, word(rng.randint(2, 7))) for i in range(80) for o in range(2)], "query_id long, ord int, term string")
    want = {r.query_id for r in S.search_exact(rows, terms, q).collect()}
    assert 20 < len(want) < 78
    for limit in (100_000, 60, 0):         # all in one pass, some left for the second, all left for it
        monkeypatch.setattr(S, "MAX_FINDER_TERMS", limit)
        got = [r.query_id for r in S.search_exact(rows, terms, q, per_row=False).collect()]
        assert sorted(got) == sorted(want)
    assert S.search_exact(rows, terms.limit(0), q, per_row=False).count() == 0


def test_cascade_keeps_terms_of_open_queries_only(spark, written):
    items = spark.createDataFrame([("s", i, f"question {i}", "a", "") for i in range(20)], FAQ)
    rows = spark.createDataFrame([("OCR", 0, "m", "1", "elsewhere", "")], ROWS)
    syn = spark.createDataFrame([("question", f"word{i}", i) for i in range(10)], SYN)
    q = spark.createDataFrame([(i, "s", f"question {i}") for i in range(20)] + [(50, "", "elsewhere")], Q)
    got = answer.hybrid_search(q, rows, items, syn, fuzzy=False).filter("rank <= 1").collect()
    assert {r.query_id: r.stage for r in got} == {50: "exact"} | {i: "lookup" for i in range(20)}
    assert [n for columns, n in written if columns == ("query_id", "ord", "term")] == [1]


class _State:
    def __init__(self):
        self.value, self.map = None, {}
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]


def test_a_busy_product_waits_in_the_state(spark):
    """Times in any order, most of them beyond what a call holds: the same rows, and nothing stays behind."""
    rng = random.Random(7)
    kinds = [flows.RECORD, flows.RECORD, "acknowledge", flows.RESET]
    actions = [(t * 300, t % 7, rng.choice(kinds)) for t in range(200)]
    rows = [{"actions": [dict(zip(("micros", "ord", "action"), a)) for a in actions[b * 10:b * 10 + 10][::-1]]} for b in range(20)]
    rng.shuffle(rows)
    out = []
    for held in (1000, 25):
        counter = flows.MissCounter(3, 1, held)
        counter.counter, counter.waiting = _State(), _State()
        out.append([tuple(r) for r in counter.handleInputRows(("p",), iter(json.loads(json.dumps(rows))), None)])
        assert not counter.waiting.map
    assert out[0] == out[1] and [r[1] for r in out[0]] == [t % 7 for t in range(200)]
