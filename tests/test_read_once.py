"""Sheets' rows and chat exports are taken apart once, whatever filters and numbers follow."""

import json

from pyspark.sql import functions as F

from supportkb.operators import chat as C
from supportkb.operators import sheets as SH


def _counting(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    return seen, read


def test_rows_of_large_sheets_are_cleaned_once(spark):
    texts = ['a\t" b ""c"" "', "\t", ' " x\ny " \t　z　', "", None]
    seen, read = _counting(spark)
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "sheet string, row_no long, text string")
    got = SH.large_sheet_rows(rows.withColumn("text", read("text"))).orderBy("item_ord").collect()
    assert [(r.item_ord, r.cells) for r in got] == [(0, ["a", 'b "c"']), (1, ["x y", "z"])]
    assert seen.value == len(texts)


def test_exports_are_parsed_once(spark):
    one = {"title": "t", "messages": []}
    texts = [json.dumps(one), json.dumps([one, 3, [one], one]), json.dumps({"items": [one, one]}), json.dumps(json.dumps(one)),
             json.dumps({"items": []}), "[]", "3", '"x"', "null", "broken", None, json.dumps({"data": 1, "items": {"a": 1}}), json.dumps(json.dumps([one]))]
    seen, read = _counting(spark)
    files = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("text", read("text"))
    got = C.scan_chat_exports(files).select("n", "pos", F.to_json("payload").alias("p")).collect()
    found = sorted(((r.n, r.pos, json.loads(r.p)) for r in got), key=lambda r: r[:2])
    assert found == [(0, 0, one), (1, 0, one), (1, 3, one), (2, 0, one), (2, 1, one), (3, 0, one),
                     (11, 0, {"data": 1, "items": {"a": 1}}), (12, 0, one)]
    assert seen.value == len(texts)


def test_kinds_of_values(spark):
    texts = ["[]", "[1]", '[{"a": 1}]', "{}", '{"a": [1]}', '{"a": {"b": 1}}', '"x"', '"[1]"', '"{}"', "1", "1.5", "true", "null", None]
    v = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = v.select("i", C._is_list(F.col("v")), C._is_object(F.col("v"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, (t or "")[:1] == "[", (t or "")[:1] == "{") for i, t in enumerate(texts)]
