"""Registered queries on small made tables whose groups are longer than any display list."""

import __spark_entry__ as entry
from supportkb.plans.manuals import GROUPS
from supportkb.sources.files import representative_query


def _write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_graph_has_every_pair(spark, tmp_path):
    parts = [(i, f"name{i}", "TYPE", "Brand", 1) for i in range(1, 31)]
    d = _write(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
               pages=([(i, f"https://h/{i}") for i in range(1, 31)], "page_id long, url string"))
    rows = entry.queries()["build_graph"](spark, d).collect()
    edges = [r["c"] for r in rows if r["part"] == "edge"]
    assert [edges.count(x) for x in ("has_manual", "has_page", "has_video")] == [30, 20, 30]
    nodes = [r["b"] for r in rows if r["part"] == "node"]
    assert [nodes.count(x) for x in ("ocr", "page", "video")] == [30, 20, 30]
    summary = {r["measure"]: r["n"] for r in entry.queries()["graph_summary"](spark, d).collect()}
    assert [summary[f"nodes:{x}"] for x in ("ocr", "page", "video")] == [30, 20, 30] and summary["no_ocr"] == summary["no_video"] == 0


def test_facts_of_every_document_and_place(spark, tmp_path):
    group, word = next((g, w) for g, words in GROUPS.items() for w in words)
    text = "".join(f"{i:03d}" + "x" * 300 + word for i in range(9))
    d = _write(spark, tmp_path, documents=([(i, text, "en", "src", len(text)) for i in range(12)],
                                           "doc_id long, text string, lang string, source string, n_chars long"))
    for name, key in (("product_facts", "manual"), ("fact_snippets", "base")):
        rows = [r for r in entry.queries()[name](spark, d).collect() if r["kw"] == word and r["grp"] == group]
        assert len({r[key] for r in rows}) == 12 and len(rows) == 12 * 9, name
        assert {r["pick"] for r in rows} == set(range(1, 10))


_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_differ_after_a_shared_start(spark, tmp_path):
    same = "license head " * 20
    docs = [(i, same + tail, "en", "SRC 1", 300) for i, tail in ((1, "alpha beta"), (5, "gamma"))]
    html = "<html><body>" + "x" * 100 + "end"
    d = _write(spark, tmp_path, documents=(docs, _DOCS), labels=([(1, 1, 0)], "doc_id long, quality int, toxic int"),
               benchmark=([(i, "alpha beta one two three four") for i in (1, 2)], "item_id long, text string"),
               pages=([(2, "https://h/2", html)], "page_id long, url string, html string"))
    run = entry.queries()
    row, = run["resolve_sources"](spark, d).collect()
    assert row["conflict"] and row["answer"] == same + "alpha beta"
    found = [r["detail"] for r in run["diagnose_not_found"](spark, d).collect() if r["section"] == "CANDIDATE_IMAGES"]
    assert found == ["page=1 -> img1"] * 2
    merged, = run["merge_shards_first_wins"](spark, d).collect()
    assert merged["description"] == "d0-" + html


def test_representative_query_looks_at_every_row(spark):
    items = "sheet string, item_ord long, question string"
    lines = "layer string, row_ord long, blob string"
    faq = spark.createDataFrame([("a", i, "") for i in range(25)] + [("a", 30, "late"), ("b", 1, "later")], items)
    rows = spark.createDataFrame([("KDOCS", i, "abc") for i in range(12)] + [("KDOCS", 20, "long enough text"), ("OCR", 1, "other text")], lines)
    assert [tuple(r) for r in representative_query(faq, rows).collect()] == [("a", "late")]
    assert [tuple(r) for r in representative_query(faq.filter("question = ''"), rows).collect()] == [("", "long enough ")]
    assert representative_query(faq.limit(0), rows.filter("blob = 'abc'")).collect() == []
