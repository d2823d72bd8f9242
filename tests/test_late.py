"""Late rows kept aside, and approved cases that stay right whatever comes when."""

import itertools

import pytest
from pyspark.sql import functions as F

from supportkb.operators import learning as L
from supportkb.sources import versions
from supportkb.streaming import flows
from supportkb.streaming.late import MissWindows

ACTIONS = "product string, ord long, micros long, action string"


def _rates(table):
    return {(r.product, r.start_micros): r.misses for r in table.rates().collect()}


def test_late_rows_are_kept_and_epochs_count_once(spark, tmp_path, monkeypatch):
    def batch(*rows):
        return spark.createDataFrame([(p, i, t, a) for i, (p, t, a) in enumerate(rows)], ACTIONS)
    table = MissWindows(spark, str(tmp_path), "product string, ord long, micros long", 10, 20, fold=2)
    assert table.rates().count() == table.late().count() == 0
    table.merge(batch(("a", 5, "record"), ("a", 7, "record"), ("a", 8, "reset"), ("b", 41, "record"), (None, 3, "record")), 0)
    table.merge(batch(("z", 5, "record")), 0)                                       # the epoch has been committed
    second = batch(("a", 9, "record"), ("a", 10, "record"), ("a", 25, "record"), ("b", None, "record"), ("b", 99, "record"))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(second, 1)
    assert table.numbers() == {"in_time": 4, "late_rows": 0}
    table.merge(second, 1)                                                          # newest 41, so windows that ended by 21 are late
    assert {(r.product, r.micros) for r in table.late().collect()} == {("a", 9), ("a", 10)}
    assert _rates(table) == {("a", 0): 2, ("b", 40): 1, (None, 0): 1, ("a", 20): 1, ("b", 90): 1, ("b", None): 1}
    again = MissWindows(spark, str(tmp_path), "product string, ord long, micros long", 10, 20, fold=2)
    again.merge(batch(("c", 69, "record"), ("c", 70, "record")), 2)
    again.merge(batch(), 3)
    assert _rates(again)[("c", 70)] == 1 and ("c", 60) not in _rates(again)
    assert again.numbers() == {"in_time": 8, "late_rows": 3} and sum(_rates(again).values()) == 8


def test_approved_cases_after_any_arrival(spark, tmp_path):
    cases = spark.createDataFrame([("A1", 1, 0, "same"), ("B2", 2, 1, "same"), ("C3", 3, 2, "other"), ("a1", 9, 5, "a copy"), ("", 1, 6, "x"), (None, 1, 7, "x")],
                                  "candidate_id string, created_at long, ord long, japanese_reply string")
    cases = L.new_candidates(cases.withColumns({c: F.lit("p") for c in ("product", "issue", "chinese_logic")}))
    events = spark.createDataFrame([("a1", 10, 0, "approve"), ("A1", 20, 1, "revoke"), ("b2", 11, 2, "Approve"), ("C3", 12, 3, "approve"),
                                    ("c3", 12, 4, "reject"), ("D4", 1, 5, "approve"), ("", 1, 6, "approve")],
                                   "candidate_id string, created_at long, ord long, action string")
    want = sorted(r.candidate_id for r in L.approved_cases(cases, events).collect())
    assert want == ["B2", "C3"]
    rounds = [("candidates", cases), ("events", events.filter("ord = 1")), ("events", events.filter("ord <> 1"))]
    for n, order in enumerate(itertools.islice(itertools.permutations(rounds), 0, 6, 2)):
        base = str(tmp_path / str(n))
        for name, df in (("candidates", cases), ("events", events)):
            df.limit(0).write.parquet(f"{base}/{name}")
        write = lambda df, epoch: df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")
        for name, df in order:
            df.coalesce(1).write.mode("append").parquet(f"{base}/{name}")
            read = {k: spark.readStream.schema(d.schema).parquet(f"{base}/{k}") for k, d in (("candidates", cases), ("events", events))}
            (flows.live_cases(read["candidates"], read["events"]).writeStream.foreachBatch(write).outputMode("update")
             .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination())
        state = (spark.read.parquet(f"{base}/out").groupBy("_id")
                 .agg(F.max_by(F.struct("candidate", "action"), "_epoch").alias("s")).select("_id", "s.*"))
        assert sorted(r.candidate_id for r in flows.approved_now(state).collect()) == want
