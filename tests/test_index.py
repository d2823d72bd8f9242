"""The kept inverted index against the search that reads all texts."""

import random

import pytest
from pyspark.sql import functions as F

from supportkb.operators import inverted
from supportkb.operators import search as S
from supportkb.sources import versions

ROWS = "layer string, row_ord long, name string, page string, blob string, ref string"


def _rows(spark, seed=1, n=260):
    """Words of very different frequency, two layers, a chat row, empty rows and one very long one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=k))
    rows = [("OCR", i, f"n{i % 5}", str(i), text(rng.randint(0, 60)), "") for i in range(n)]
    rows += [("CHATGPT", i, f"title {i}", "project", text(20), f"c{i}") for i in range(30)] + [("OCR", n, "long", "", text(20_000), ""), ("OCR", n + 1, "", "", "", "")]
    queries = [(i, "", text(6)) for i in range(25)] + [(98, "", "w250 w251 w252"), (99, "", "nowhere")]
    return spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(queries, "query_id long, product string, q string")


def _all(df):
    return sorted(tuple(r[c] for c in ("query_id", "layer", "rank", "row_ord", "score", "name", "page", "snippet")) for r in df.collect())


@pytest.mark.parametrize("first", [2, 10_000])
def test_index_equals_full_search(spark, tmp_path, first):
    rows, queries = _rows(spark)
    terms = queries.select("query_id", F.lit(0).alias("ord"), F.col("q").alias("term"))
    path = str(tmp_path / "index")
    assert inverted.append_segment(rows.filter("row_ord < 200"), path, "word") == 1
    assert inverted.append_segment(rows.filter("row_ord >= 200"), path, "word") == 2
    got = inverted.search_index(spark, path, terms, first_ranges=first)
    want = S.search_bm25(rows, terms, queries, mode="word")
    assert _all(got) == _all(want)


def test_rare_words_leave_blocks_unread(spark, tmp_path):
    rows, _ = _rows(spark, n=1500)
    path = str(tmp_path / "index")
    inverted.append_segment(rows, path, "word")
    terms = spark.createDataFrame([(1, "w290 w291 w292 w293 w0")], "query_id long, term string")
    found = {r.layer: r for r in inverted.IndexSearch(spark, path, terms, top=3, first_ranges=4).pruning().collect()}
    assert found["OCR"].blocks_read < 0.7 * found["OCR"].blocks


def test_segments_without_a_version_are_not_seen(spark, tmp_path, monkeypatch):
    """A crash before the commit leaves the old index as it was, and the next attempt replaces what it left."""
    rows, queries = _rows(spark)
    terms = queries.select("query_id", F.col("q").alias("term"))
    path = str(tmp_path / "index")
    inverted.append_segment(rows.filter("row_ord < 200"), path, "word")
    before = _all(inverted.search_index(spark, path, terms))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            inverted.append_segment(rows.filter("row_ord >= 230"), path, "word")
    assert _all(inverted.search_index(spark, path, terms)) == before
    assert inverted.append_segment(rows.filter("row_ord >= 200"), path, "word") == 2
    whole = S.search_bm25(rows, terms.withColumn("ord", F.lit(0)), queries, mode="word")
    assert _all(inverted.search_index(spark, path, terms)) == _all(whole)
    with pytest.raises(ValueError):
        inverted.append_segment(rows, path, "cjk")


def test_a_version_is_written_once(spark, tmp_path):
    root = str(tmp_path / "v")
    assert versions.read(spark, root) is None
    versions.commit(spark, root, 1, {"a": "ä"})
    with pytest.raises(FileExistsError):
        versions.commit(spark, root, 1, {"a": 2})
    versions.commit(spark, root, 12, {"a": 3})
    assert versions.numbers(spark, root) == [1, 12] and versions.read(spark, root) == {"a": 3} and versions.read(spark, root, 1) == {"a": "ä"}


def test_blocks_are_whole_and_tokens_are_not_written(spark, tmp_path, monkeypatch):
    """Rows of a block may come in several batches; a block's postings are made in its task, without a copy of the tokens."""
    rows, _ = _rows(spark)
    rows = rows.unionByName(spark.createDataFrame([(None, 7, "n", "", "w1 w1 w2", ""), ("OCR", None, "n", "", "w1", ""), ("OCR", 9, "n", "", None, "")], ROWS))
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        with monkeypatch.context() as m:
            m.setattr(inverted, "cut_lineage", None)
            inverted.append_segment(rows, path, "word", buckets=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = spark.read.schema(inverted.PARTS["postings"]).parquet(f"{path}/segment=1/postings").collect()
    assert len({(r.layer, r.tok, r.block) for r in blocks}) == len(blocks) and max(len(r.postings) for r in blocks) > 20
    assert all(len(r.postings) <= 1 << inverted.SPAN_BITS and r.max_tf == max(p.tf for p in r.postings)
               and r.min_len == min(p.doc_len for p in r.postings) for r in blocks)
    key = lambda t: tuple((v is not None, v) for v in t)
    got = sorted(((r.layer, r.tok, p.row_ord, p.tf, p.doc_len) for r in blocks for p in r.postings), key=key)
    want = []
    for r in rows.collect():
        words = (r.blob or "").split()
        want += [(r.layer, w, r.row_ord, words.count(w), len(words)) for w in set(words)]
    assert got == sorted(want, key=key)
