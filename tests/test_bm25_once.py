"""The BM25 statistics read each text once, and rows without a token count as rows."""

import pytest
from pyspark.sql import functions as F

from supportkb.operators import search as S

ROWS = "layer string, row_ord long, name string, page string, blob string, ref string"


@pytest.mark.parametrize("products", [[""], ["n1"], ["", "n1"]])
def test_statistics_tokenize_each_text_once(spark, products):
    texts = ["ab cd ab", "cd", "", None, "ab", "ef"]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([("OCR", i, f"n{i % 2}", "", t, "") for i, t in enumerate(texts)], ROWS).withColumn("blob", read("blob"))
    queries = spark.createDataFrame([(i, p, "ab") for i, p in enumerate(products)], "query_id long, product string, q string")
    got = {(r.scope, r.tok): (r.n, r.df, round(r.avg_len, 6)) for r in S.bm25_corpus_stats(rows, S.Scopes(queries), "word").collect()}
    want = {("", "ab"): (6, 2, 1.0), ("", "cd"): (6, 2, 1.0), ("", "ef"): (6, 1, 1.0),
            ("n1", "cd"): (3, 1, 0.666667), ("n1", "ef"): (3, 1, 0.666667)}
    assert got == {k: v for k, v in want.items() if k[0] in products}
    assert seen.value == len(texts)
