"""Miss rates of a stream with nothing lost: rows behind the watermark are kept aside and counted instead of dropped.

Every micro-batch writes two folders of its own epoch, the counts per product and window of the rows in time and the late rows as
they came, and then commits one version that names the folders, the newest time seen and the running numbers. The
watermark of a batch is the newest time of the batches before it less the delay, and a row is late when its window ended by
then, which is the rule of the streaming aggregate. A repeated epoch changes nothing, and what a crash left is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportkb.operators.gaps import RECORD
from supportkb.sizing import cut_lineage
from supportkb.sources import versions

COUNTS = "product string, start_micros long, misses long"


class MissWindows:
    """Tumbling windows of ``length_micros`` over the recorded misses. Batches hold product, action and micros (event time) and any
    other columns, of which ``late_schema`` (a DDL string) names those kept with a late row. When ``fold`` folders of counts
    have gathered they are added up into one."""

    def __init__(self, spark: SparkSession, root: str, late_schema: str, length_micros: int = 86_400_000_000,
                 delay_micros: int = 86_400_000_000, fold: int = 32):
        self.spark, self.root, self.late_schema = spark, root, late_schema
        self.length, self.delay, self.fold = length_micros, delay_micros, fold

    def _version(self) -> dict:
        return versions.read(self.spark, self.root) or {"epoch": -1, "newest": None, "counts": [], "late": [], "in_time": 0, "late_rows": 0}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def rates(self) -> DataFrame:
        """product, start_micros, misses of all rows that came in time."""
        parts = self._read(self._version()["counts"], COUNTS)
        return parts.groupBy("product", "start_micros").agg(F.sum("misses").alias("misses"))

    def late(self) -> DataFrame:
        """The rows that came too late, whole."""
        return self._read(self._version()["late"], self.late_schema)

    def numbers(self) -> dict:
        known = self._version()
        return {"in_time": known["in_time"], "late_rows": known["late_rows"]}

    def merge(self, batch: DataFrame, epoch: int) -> None:
        known = self._version()
        if epoch <= known["epoch"]:
            return
        start = F.col("micros") - F.pmod(F.col("micros"), F.lit(self.length))
        behind = F.lit(False) if known["newest"] is None else start + self.length <= known["newest"] - self.delay
        rows = cut_lineage(batch.filter(F.col("action") == RECORD).withColumn("start_micros", start)
                           .withColumn("_late", F.coalesce(behind, F.lit(False))))
        seen = rows.agg(F.max("micros").alias("newest"), F.count_if("_late").alias("late"), F.count_if(~F.col("_late")).alias("in_time")).first()
        counts = rows.filter("NOT _late").groupBy("product", "start_micros").agg(F.count(F.lit(1)).alias("misses"))
        held, out = known["counts"], f"counts/epoch={epoch}"
        if len(held) + 1 >= self.fold:
            counts = (counts.unionByName(self._read(held, COUNTS)).groupBy("product", "start_micros").agg(F.sum("misses").alias("misses")))
            held = []
        counts.write.mode("overwrite").parquet(f"{self.root}/{out}")
        late = list(known["late"])
        if seen["late"]:
            kept = self.spark.createDataFrame([], self.late_schema).columns
            rows.filter("_late").select(*kept).write.mode("overwrite").parquet(f"{self.root}/late/epoch={epoch}")
            late.append(f"late/epoch={epoch}")
        newest = max((t for t in (known["newest"], seen["newest"]) if t is not None), default=None)
        versions.commit(self.spark, self.root, epoch, {
            "epoch": epoch, "newest": newest, "counts": [*held, out], "late": late,
            "in_time": known["in_time"] + seen["in_time"], "late_rows": known["late_rows"] + seen["late"]})
