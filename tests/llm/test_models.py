"""Quality and toxicity: held-out accuracy on the labelled tables, and defined cases."""

import pytest
from pyspark.sql import functions as F

from supportkb.llm import common, quality, toxicity
from tests.llm.samples import odd_rows, texts

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def held_out_accuracy(scored, truth, label, held):
    rows = scored.join(truth, "doc_id").filter(held).collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows), [r for r in rows if r[label] == 1]


def test_quality_on_held_out_rows(spark):
    docs, truth = tables(spark)
    held = common.fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, truth, "quality", ~held)
    accuracy, _ = held_out_accuracy(quality.scored(docs, model), truth, "quality", held)
    assert accuracy >= 0.95
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.scored(docs, model).filter("predicted = 1").count()


def test_toxicity_on_held_out_rows(spark):
    docs, truth = tables(spark)
    held = common.fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, truth, "toxic", ~held, trees=8)
    accuracy, toxic = held_out_accuracy(model.scored(docs), truth, "toxic", held)
    assert accuracy >= 0.9
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)
    assert model.scored(docs).filter("score < 0 OR score > 1").count() == 0
    odd = model.scored(texts(spark, odd_rows())).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)


def test_few_or_no_labels(spark):
    rows = odd_rows()
    docs = texts(spark, rows)
    for given, prior in (([], 0.5), ([(6, 1, 1, "x"), (7, None, None, "x"), (None, 1, 1, "x")], 1.0)):
        truth = labels(spark, given)
        got = quality.scored(docs, quality.fit(docs, truth)).collect()
        assert len(got) == len(rows) and {r.score for r in got if r.doc_id in (1, 2)} == {prior}
        got = toxicity.fit(docs, truth).scored(docs).collect()
        assert len(got) == len(rows) and {r.score for r in got} == {prior}
    assert quality.scored(texts(spark, []), quality.fit(docs, labels(spark, []))).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs, truth = tables(spark)
    a, b = ({r.doc_id for r in quality.labelled_sample(docs, truth, "quality", F.lit(True), 50).collect()} for _ in range(2))
    assert a == b and len(a) == 50


@pytest.mark.parametrize("text,near,hidden", [("you are an idiot", 1, 0), ("idiot " + "far " * 20 + "you", 0, 0), ("an id1ot and m0r0n", 0, 2)])
def test_features(text, near, hidden):
    memo = toxicity._Memo({"idiot": 7.0, "moron": 7.0, "moro*": 6.0})
    row = toxicity.text_features(text, memo)
    assert (row[5] > 0) == bool(near) and (row[7] > 0) == bool(hidden)
    assert (row[8] > 0) == bool(hidden)
