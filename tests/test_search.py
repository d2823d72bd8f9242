"""Retrieval on small CJK tables against brute force in Python."""

import math
import random
import pytest
from pyspark.sql import functions as F

from supportkb import defaults as D
from supportkb.operators import search as S
from supportkb.functions.text import tokenize_cjk
from supportkb.operators.containment import CHUNK, contains_any_join, contains_join
from supportkb.plans.answer import hybrid_search, misses_from_search
from tests.test_text import brute_partial

ROWS = "layer string, row_ord long, name string, page string, blob string, ref string"
Q = "query_id long, product string, q string"
SYN = "term string, expansion string, ord int"
FAQ = "sheet string, item_ord long, question string, answer string, template string"


@pytest.mark.parametrize("route", ["finder", "grams", None])
def test_contains_join_routes_agree_with_brute_force(spark, route):
    random.seed(3)
    alphabet = "ab加湿😀"
    word = lambda k: "".join(random.choice(alphabet) for _ in range(k))
    texts = [(i, word(random.randint(0, 40))) for i in range(60)]
    # A text longer than two chunks, with a term across the cut and the same term again later.
    seam = "SEAMacrossTHEcut"
    long = "x" * (CHUNK - 7) + seam + "y" * CHUNK + seam + "z"
    texts.append((999, long))
    terms = sorted({word(random.randint(1, 12)) for _ in range(80)} | {seam, "", "zz", "z"})
    got = contains_join(spark.createDataFrame(texts, "id long, t string"), "t",
                        spark.createDataFrame([(w, len(w)) for w in terms], "w string, n int"), "w", route=route)
    found = sorted((r["id"], r["w"], r["n"], r["pos"]) for r in got.collect())
    assert found == sorted((i, w, len(w), t.find(w) + 1) for i, t in texts for w in terms if w and w in t)


@pytest.mark.parametrize("route", ["finder", "grams"])
def test_contains_any_join_unites_groups(spark, route):
    texts = [(1, "加湿器V10"), (2, "v10 v20"), (3, "none"), (4, "")]
    words = [("v10", "a"), ("V10", "a"), ("加湿", "a"), ("v20", "b"), ("v10", "b"), ("", "c")]
    got = contains_any_join(spark.createDataFrame(texts, "id long, t string"), "t",
                            spark.createDataFrame(words, "w string, g string"), "w", "g", route=route)
    assert sorted((r["id"], r["g"]) for r in got.collect()) == [(1, "a"), (2, "a"), (2, "b")]


def test_expand_terms_order_and_reverse(spark):
    syn = spark.createDataFrame(D.synonym_rows(), SYN)
    q = spark.createDataFrame([(1, "", "电源线 长度"), (2, "", "消費電力"), (3, "", "XYZ")], Q)
    got = {}
    for r in S.expand_terms(q, syn).orderBy("query_id", "ord").collect():
        got.setdefault(r["query_id"], []).append(r["term"])
    # 线长, 线长度, 电源线 and 电源线长度 all lie in the query; their expansions follow table order.
    assert got[1] == ["电源线长度", "線長", "コード長", "ケーブル長", "電源コード長", "電源側コード長", "本体側コード長",
                      "電源コード", "電源側コード", "コード", "電源側", "本体側"]
    assert got[2] == ["消費電力", "消费电力", "功率"]
    assert got[3] == ["xyz"]


def test_longest_term_wins_and_one_row_per_sheet(spark):
    rows = spark.createDataFrame([
        ("FAQ", 0, "sheetA", "", "コード", ""), ("FAQ", 1, "sheetA", "", "電源コード長は1.8m", ""),
        ("OCR", 0, "マニュアル", "3", "電源コード長", ""), ("KDOCS", 0, "表", "", "なし", "")], ROWS)
    q = spark.createDataFrame([(1, "", "q"), (2, "sheet a", "q")], Q)
    terms = spark.createDataFrame([(i, 0, "コード") for i in (1, 2)] + [(i, 1, "電源コード長") for i in (1, 2)], "query_id long, ord int, term string")
    hits = S.search_exact(rows, terms, q)
    ranked = S.rank_exact_hits(hits, rows, terms, q).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["layer"], r["row_ord"], r["term"], r["score"]) for r in ranked] == [
        (1, "FAQ", 1, "電源コード長", 1000.0), (1, "OCR", 0, "電源コード長", 980.0), (2, "FAQ", 1, "電源コード長", 1000.0)]
    assert ranked[0]["snippet"] == "電源コード長は1.8m"


def test_bm25_against_brute_force(spark):
    random.seed(5)
    blobs = ["".join(random.choice("加湿器充電線長abc") for _ in range(random.randint(0, 25))) for _ in range(40)]
    rows = spark.createDataFrame([("OCR", i, f"n{i % 3}", "", b, "") for i, b in enumerate(blobs)], ROWS)
    q = spark.createDataFrame([(1, "", "充電線長"), (2, "N1", "加湿器加湿器abc")], Q)
    asked = {"充電線長": ["充電", "電線", "線長", "充電線長"],
             "加湿器加湿器abc": ["abc", "加湿", "湿器", "器加", "加湿", "湿器", "加湿器加湿器"]}
    tokens = dict(enumerate(r[0] for r in rows.orderBy("row_ord").select(tokenize_cjk(F.col("blob"))).collect()))
    got = {(r["query_id"], r["row_ord"]): r["score"] for r in S.search_bm25(rows, S.plain_terms(q), q).collect()}
    want = {}
    for qid, product, text in ((1, "", "充電線長"), (2, "n1", "加湿器加湿器abc")):
        ids = [i for i in range(40) if product in f"n{i % 3}"]
        docs = {i: tokens[i] for i in ids}
        avg = sum(map(len, docs.values())) / len(docs)
        df = {}
        for d in docs.values():
            for t in set(d):
                df[t] = df.get(t, 0) + 1
        idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
        scores = []
        for i, d in docs.items():
            s = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in asked[text])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        want.update({(qid, i): -s for s, i in sorted(scores)[:12]})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_fuzzy_against_brute_force(spark):
    random.seed(11)
    blobs = ["".join(random.choice("加湿器充電線長abc") for _ in range(random.randint(1, 30))) for _ in range(40)]
    rows = spark.createDataFrame([("OCR", i, f"n{i % 3}", "", b, "") for i, b in enumerate(blobs)], ROWS)
    q = spark.createDataFrame([(1, "", "充電線長"), (2, "N1", "加湿器abc")], Q)
    got = {(r["query_id"], r["row_ord"]): r["score"] for r in S.search_fuzzy(rows, S.plain_terms(q), q).collect()}
    want = {}
    for qid, product, t in ((1, "", "充電線長"), (2, "n1", "加湿器abc")):
        s = sorted((-round(brute_partial(t, blobs[i]), 6), i) for i in range(40) if product in f"n{i % 3}")
        want.update({(qid, i): -v for v, i in s[:15] if -v >= 62})
    assert got == want


def test_cascade_on_the_smoke_tables(spark):
    faq = spark.createDataFrame([("kdocs_日本站售后对应方案表_测试产品", 0, "无法充电", "", "別のUSBケーブルで充電をお試しください。")], FAQ)
    rows = spark.createDataFrame([
        ("FAQ", 0, "kdocs_日本站售后对应方案表_测试产品", "", "无法充电別のusbケーブルで充電をお試しください。", ""),
        ("OCR", 0, "便携式车载马桶", "1", "組み立て方法", "")], ROWS)
    syn = spark.createDataFrame(D.synonym_rows(), SYN)
    q = spark.createDataFrame([(1, "测试产品", "无法充电"), (2, "便携式车载马桶", "組み立て方法"),
                               (3, "kdocs_日本站售后对应方案表_测试产品", "无法充电"), (4, "", "組み立て方去"), (5, "无", "zz")], Q)
    res = hybrid_search(q, rows, faq, syn)
    got = {r["query_id"]: (r["stage"], r["layer"]) for r in res.filter("rank <= 1").collect()}
    # The product only lies inside the sheet name, so the lookup must not answer query 1.
    assert got == {1: ("exact", "FAQ"), 2: ("exact", "OCR"), 3: ("lookup", "FAQ"), 4: ("recall", "OCR"), 5: ("not_found", "")}
    assert [r["query_id"] for r in misses_from_search(q, res).collect()] == [5]


def test_chat_rows_match_product_in_text(spark):
    rows = spark.createDataFrame([("CHATGPT", 0, "タイトル", "proj", "V10 の充電について", "c0"),
                                  ("CHATGPT", 1, "V10", "proj", "充電", "c1"), ("CHATGPT", 2, "他", "proj", "充電", "c2")], ROWS)
    q = spark.createDataFrame([(1, "v10", "充電")], Q)
    terms = S.plain_terms(q)
    assert sorted(r["row_ord"] for r in S.search_exact(rows, terms, q).collect()) == [0, 1]
    near = S.search_fuzzy(rows, terms, q).collect()
    assert {(r["name"], r["page"]) for r in near} == {("c0", "タイトル"), ("c1", "V10")}
