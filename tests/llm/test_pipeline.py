"""Each stage of the pipeline on its own input, against the plain versions."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from supportkb.llm.common import written
from tests.llm.samples import SF, components, table, texts, odd_rows, without_repeats


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, types = docs.columns, docs.dtypes
    steps = dict(corpus_pipeline.STAGES)
    kept = written(steps["quality"](spark, docs, SF), "t")
    assert kept.dtypes == types
    truth = {d: q for d, q, _ in table("labels")}
    left = {r.doc_id for r in kept.collect()}
    judged = [(d in left) == bool(q) for d, q in truth.items()]
    assert sum(judged) >= 0.95 * len(judged)

    groups = components([(r.doc_id, r.text) for r in kept.collect()])
    unique = written(steps["near_duplicates"](spark, kept, SF), "t")
    assert unique.dtypes == types
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in groups.items() if c == i}

    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    cut = written(steps["repeats"](spark, unique, SF), "t")
    assert cut.dtypes == types
    assert {r.doc_id: r.text for r in cut.collect()} == {i: b.decode("utf-8", "ignore") for i, b in without_repeats(rows)[1].items()}
    assert cut.filter("n_chars <> length(text)").count() == 0

    clean = written(steps["decontamination"](spark, cut, SF), "t")
    assert clean.columns == columns
    items = [" ".join(t.split()) for _, t in table("benchmark")]
    dropped = {r.doc_id for r in cut.collect()} - {r.doc_id for r in clean.collect()}
    leaking = {r.doc_id for r in cut.collect() if any(x in " ".join(r.text.split()) for x in items)}
    assert leaking <= dropped and len(dropped) <= len(leaking) + 3

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = steps["sentencepiece"](spark, clean, SF).collect()
    text = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.ids for r in last} == {i: library.encode(t) + [2] for i, t in text.items()}
    ran = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.ids_sha256) for r in ran} == {(r.doc_id, r.ids_sha256) for r in last}


def test_stages_take_odd_rows(spark):
    docs = texts(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(odd_rows()), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
