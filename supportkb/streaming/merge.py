"""A table of conversations kept current by micro-batches: idempotent copy-on-write upserts by id bucket.

The table is cut into buckets by a hash of the id. A batch rewrites only the buckets it touches, below a folder of its own
epoch, and then commits one version that names the folder of every bucket, the epoch and the running counts. So

* an epoch that has been committed changes nothing when it comes again,
* a crash before the commit leaves the old version, and the repeated epoch replaces what the crash left,
* a reader always sees the buckets of one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportkb.operators.chat import judged_imports, latest_payloads
from supportkb.sizing import cut_lineage
from supportkb.sources import versions

BUCKETS = 16
COUNTS = ("imported", "skipped", "failed")


class ConversationTable:
    """``schema`` holds id, update_time, payload and ``order``, the running number of a delivery."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, order: str = "ord", buckets: int = BUCKETS,
                 project: str | None = None, force: bool = False):
        self.spark, self.root, self.schema, self.order, self.buckets = spark, root, schema, order, buckets
        self.project, self.force = project, force

    def _version(self) -> dict:
        return versions.read(self.spark, self.root) or {"epoch": -1, "buckets": {}, **{c: 0 for c in COUNTS}}

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the latest version, of some buckets if given."""
        folders = [f"{self.root}/{folder}/bucket={b}" for b, folder in sorted(self._version()["buckets"].items())
                   if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def counts(self) -> dict:
        """Deliveries imported, skipped and failed so far."""
        known = self._version()
        return {c: known[c] for c in COUNTS}

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Take in one micro-batch. ``batch`` has the table's columns, and folder and title where a project is asked for."""
        known = self._version()
        if epoch <= known["epoch"]:
            return
        batch = cut_lineage(batch)
        # a number per bucket at most comes back
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]
        state = self.read(touched)
        judged = cut_lineage(judged_imports(state, batch, self.order, self.project, self.force))
        counted = dict(judged.groupBy("outcome").count().collect())
        newest = cut_lineage(latest_payloads(judged.filter("outcome = 'imported'"), [self.order]).select(*self.schema.fieldNames()))
        filled = [r[0] for r in newest.select(self._bucket()).distinct().collect()]
        rows = self.read(filled).join(newest.select("id"), "id", "left_anti").select(*self.schema.fieldNames()).unionByName(newest)
        folder = f"data/epoch={epoch}"
        # files of a good size per bucket, a large one split over several tasks
        (rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/{folder}"))
        buckets = {**known["buckets"], **{str(b): folder for b in filled}}
        versions.commit(self.spark, self.root, epoch, {"epoch": epoch, "buckets": buckets,
                                                       **{c: known[c] + counted.get(c, 0) for c in COUNTS}})
