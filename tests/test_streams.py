"""Registered stream queries over tables that are one file, a folder of files, or empty."""

import pytest

from supportkb.plans import review as R

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
TURNS = "conv_id long, turn int, role string, text string"


def _one_file(df, path, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(path)


@pytest.mark.parametrize("form", ["folder", "file"])
def test_streams_read_files_and_folders(spark, tmp_path, form):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(9)], DOCS)
    turns = spark.createDataFrame([(1, t, "user", "x") for t in range(5)], TURNS)
    for name, df in (("documents", docs), ("conversations", turns)):
        if form == "folder":
            df.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            _one_file(df, tmp_path / f"{name}.parquet", tmp_path / name)
    # another table beside it whose name begins alike
    spark.createDataFrame([(99, "not asked", "en", "s", 1)], DOCS).write.parquet(str(tmp_path / "documents.parquet2"))
    got = R.stream_candidates(spark, str(tmp_path)).collect()
    assert sorted(r.candidate_id for r in got) == [f"Cand{i}" for i in range(9)]
    assert sorted(r.update_time for r in R.stream_ingest_exports(spark, str(tmp_path)).collect()) == ["v0", "v1", "v2"]


def test_streams_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    events = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([], events).write.parquet(str(tmp_path / "events.parquet"))
    assert R.stream_candidates(spark, str(tmp_path)).collect() == []
    assert R.stream_decisions(spark, str(tmp_path)).collect() == []
    assert R.miss_rate_windows(spark, str(tmp_path)).collect() == []
