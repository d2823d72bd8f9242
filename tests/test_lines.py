"""Large text files cut into blocks at every possible place, against reading each file as one row."""

import json
import os

import pytest
from pyspark.sql import functions as F

from supportkb.operators import chat as C
from supportkb.operators import sheets as SH
from supportkb.sources import files as S
from supportkb.sources import lines as L

TEXTS = {
    "a.tsv": "﻿name\tblob\r\nn1\tb1\r\n\r\nn2\tb2 \x85n3\tb3\n\nonly\nn4\tb4\tmore\n",
    "b.tsv": "n5\t﻿kept n6\tlast without end",
    "c.tsv": "",
    "d.tsv": "\n\n\nx\ty\n",
}
SHEETS = {
    "s1.txt": "﻿note before\n日期\t问题\t回复模板\n2026-08-01\t\"two\nlines \"\"quoted\"\"\tand a tab\"\tok\n\n2026-08-02\tmid\"dle\nquote\" cell\tx\nID_1\tID_2\n",
    "s2.txt": "2026/08/03\tfree text\tanswer one\tanswer two\n\n\"a\n\nb\"\tc",
    "_capture_log.txt": "ignored\tline\n",
}


def _written(folder, texts):
    for name, text in texts.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(folder)


@pytest.fixture(params=[1 << 20, 1, 6])
def cut(spark, request, monkeypatch):
    """Largest bytes of a block while a text is read; one byte cuts everywhere."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    tasks = []

    def written(df, real=L.cut_lineage):
        before = {k: spark.conf.get(k) for k in keys}
        try:
            for k, v in keys.items():
                spark.conf.set(k, v)
            tasks.append(df.rdd.getNumPartitions())
            return real(df)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    monkeypatch.setattr(L, "cut_lineage", written)
    yield request.param, tasks


def _whole(spark, path, pattern):
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(S.stem(F.col("_metadata.file_name")).alias("stem"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_numbers_and_rows_of_files_cut_anywhere(spark, tmp_path, cut):
    path = _written(tmp_path / "t", TEXTS)
    want = S.numbered_lines(_whole(spark, path, "*.tsv")).select("stem", "line_no", "line")
    assert _set(S.numbered_file_lines(spark, path, "*.tsv").select("stem", F.col("line_no").cast("int"), "line")) == _set(want)
    path = _written(tmp_path / "s", SHEETS)
    sheets = _whole(spark, path, "s*.txt").withColumnRenamed("stem", "sheet")
    want = SH.faq_items(sheets).withColumn("item_ord", F.col("item_ord").cast("long"))
    got = SH.large_faq_items(S.read_sheet_rows(spark, path))
    assert got.columns == want.columns and _set(got) == _set(want) and len(want.collect()) >= 4
    assert cut[0] > 6 or min(cut[1]) > 15


def test_headerless_index_file(spark, tmp_path):
    path = _written(tmp_path / "t", {"x.tsv": TEXTS["a.tsv"]})
    rows = S.read_index_tsv(spark, path, "plain", True).collect()
    assert sorted((r.row_ord, r.name, r.blob) for r in rows) == [(1, "n1", "b1"), (3, "n2", "b2 "), (4, "n3", "b3"), (7, "n4", "b4\tmore")]


def test_exports_by_folder_and_priority(spark, tmp_path):
    doc = lambda i, t: json.dumps({"id": i, "title": t})
    path = _written(tmp_path / "e", {
        "conversations.jsonl": doc("a", "main lines") + "\n\n" + doc("b", "main lines") + "\n", "conversations.json": "[" + doc("a", "main") + "]",
        "Work/x.json": doc("a", "file"), "Work/deep/y.jsonl": doc("c", "nested"), "z.meta.json": doc("m", "meta"), "top.json": doc("d", "top")})
    docs = S.read_export_documents(spark, path)
    got = C.payload_header(C.scan_chat_exports(docs), "folder")
    rows = {(r["id"], r["title"]): (r["project_title"], r["input"]["kind"]) for r in got.collect()}
    assert rows == {("a", "main"): ("", 0), ("a", "main lines"): ("", 1), ("b", "main lines"): ("", 1), ("a", "file"): ("Work", 2),
                    ("c", "nested"): ("Work/deep", 3), ("d", "top"): ("", 2)}
    last = C.latest_payloads(got.select("id", "title", "input", "ord"), ["input", "ord"])
    assert {r["id"]: r["title"] for r in last.collect()}["a"] == "file"
