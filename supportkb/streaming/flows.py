"""Structured Streaming forms of the append-only logs. Batch and stream share their operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from supportkb.operators.gaps import ACKNOWLEDGE, RECORD, RESET
from supportkb.operators.learning import new_candidates, searchable_cases


def ingest_exports(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop re-deliveries of the same (id, update time) within the watermark. What a changed update
    time means is decided against the stored state, see ``write_upserts``."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "update_time"])


def write_upserts(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch to ``merge(batch, epoch)``. A repeated epoch must give the same result,
    which an upsert by id does."""
    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def candidates(stream: DataFrame) -> DataFrame:
    """Redacted, fingerprinted candidates; stateless."""
    return new_candidates(stream)


def write_candidates(stream: DataFrame, root: str, checkpoint: str):
    """Append candidates as JSON below one folder per device."""
    return (candidates(stream).writeStream.format("json").partitionBy("device_id").option("path", root)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def decisions(stream: DataFrame) -> DataFrame:
    """Current decision per candidate in update mode; a late older event cannot win, whatever the
    order of arrival."""
    newest = F.struct("created_at", (-F.col("ord")).alias("o"))
    return (stream.groupBy(F.lower("candidate_id").alias("candidate_id"))
            .agg(F.max_by("action", newest).alias("action"), F.max("created_at").alias("created_at"),
                 F.count(F.lit(1)).alias("events")))


def live_cases(candidates: DataFrame, events: DataFrame, order: str = "ord") -> DataFrame:
    """What is known of every candidate, joined from the streams of candidates and of decisions, in update mode: _id, candidate
    (its first record), action (of its newest decision), either null as long as it has not come.

    Both streams feed one state per candidate of two order-free aggregates, so a decision may come before its candidate and a
    revoke at any later time, which a join of the streams bounded by a watermark would lose. Copies of a hot id combine
    before the shuffle. Ids that are null or empty are left out."""
    of = lambda df: df.filter("candidate_id <> ''")
    case = F.struct(*[F.col(c) for c in candidates.columns])
    newest = F.struct("created_at", (-F.col(order)).alias("o"))
    shown = of(candidates).select(F.lower("candidate_id").alias("_id"), case.alias("candidate"), F.col(order).cast("long").alias("_place"))
    decided = of(events).select(F.lower("candidate_id").alias("_id"), "action", newest.alias("_newest"))
    return (shown.unionByName(decided, allowMissingColumns=True).groupBy("_id")
            .agg(F.min_by("candidate", "_place").alias("candidate"), F.max_by("action", "_newest").alias("action")))


def approved_now(state: DataFrame) -> DataFrame:
    """The approved cases of a table of ``live_cases`` rows."""
    return searchable_cases(state.filter("candidate IS NOT NULL AND lower(action) = 'approve'").select("candidate.*"))


def miss_rates(stream: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Misses per product and window; rows later than the watermark are dropped."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (stream.filter(F.col("action") == RECORD).withWatermark("ts", delay).groupBy(win.alias("w"), "product")
            .agg(F.count(F.lit(1)).alias("misses")).select("w.start", "w.end", "product", "misses"))


ALERTS = "product string, ord long, records long, reminder_due boolean, cycles long, last_reminder long"
HELD = 100_000


class MissCounter(StatefulProcessor):
    """Counter state after every action, per product. A row holds the actions of one time; all rows of a call lie after those of the
    calls before.

    A call reads and writes the counter once. Beyond ``held`` actions those of a busy product wait in the state by buckets of
    ``bucket_ms`` and come back one bucket at a time, so a release never holds a whole trigger."""

    def __init__(self, threshold: int = 3, bucket_ms: int = 3_600_000, held: int = HELD):
        self.threshold, self.bucket_ms, self.held = threshold, bucket_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "records long, cycles long, last long")
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "actions string")

    def _park(self, actions: list[tuple], parts: dict[int, int]) -> None:
        for bucket, some in groupby(sorted(actions), lambda a: a[0] // (1000 * self.bucket_ms)):
            self.waiting.updateValue((bucket, parts.get(bucket, 0)), (json.dumps(list(some)),))
            parts[bucket] = parts.get(bucket, 0) + 1
        actions.clear()

    def _in_order(self, rows: Iterator[Row]) -> Iterator[tuple]:
        held, parts = [], {}
        for row in rows:
            held.extend((a["micros"], a["ord"], a["action"]) for a in row["actions"])
            if len(held) > self.held:
                self._park(held, parts)
        if not parts:
            yield from sorted(held)
            return
        self._park(held, parts)
        for bucket in sorted(parts):
            keys = [(bucket, i) for i in range(parts[bucket])]
            yield from sorted(tuple(a) for k in keys for a in json.loads(self.waiting.getValue(k)[0]))
            for k in keys:
                self.waiting.removeKey(k)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        records, cycles, last = self.counter.get() if self.counter.exists() else (0, 0, None)
        for micros, ord_, action in self._in_order(rows):
            if action == RECORD:
                records += 1
            elif action in ACKNOWLEDGE:
                records, cycles, last = 0, cycles + 1, micros
            elif action == RESET:
                records, last = 0, None
            yield Row(product=key[0], ord=ord_, records=records, reminder_due=records >= self.threshold, cycles=cycles, last_reminder=last)
        self.counter.update((records, cycles, last))

    def close(self) -> None:
        pass


def miss_alerts(stream: DataFrame, threshold: int = 3, delay: str = "1 day", bucket_ms: int = 3_600_000) -> DataFrame:
    """Counter state after every action, per product: records since the last close, sticky reminder, closed cycles, last
    reminder. Input: product, ord, ts, micros (of ts), action. Actions may arrive in any order and in any trigger as long as they are
    no later than ``delay``; they wait in a native aggregate per product and time and come out, in the order of (time, ord), once the
    watermark has passed them; later ones are dropped. ``bucket_ms`` is the stretch of time a very busy product is released
    by. Times lie after 1970, where watermarks begin. Needs the RocksDB state store."""
    waiting = (stream.filter("ts IS NOT NULL").withWatermark("ts", delay).groupBy("product", "ts")
               .agg(F.collect_list(F.struct("micros", "ord", "action")).alias("actions")))
    return waiting.select("product", "actions").groupBy("product").transformWithState(MissCounter(threshold, bucket_ms), ALERTS, "Append", "None")
