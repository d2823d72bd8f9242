"""Writers: index tables, append-only event logs, index counts and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layers that make an index searchable, the sheet layer, and the states of an index.
SEARCHABLE = ["FAQ", "OCR", "KDOCS", "SPEC"]
SHEET_LAYER = "KDOCS"


def write_index(rows: DataFrame, path: str) -> None:
    """Full overwrite of the index, one folder per layer so that a query reads only its layers."""
    rows.write.mode("overwrite").partitionBy("layer").parquet(path)


def export_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Text export for other tools."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_event_log(events: DataFrame, roots: list[str], device: str = "device_id") -> None:
    """Append JSON lines below each root, one folder per device: no device writes another's files."""
    for root in roots:
        events.write.mode("append").partitionBy(device).json(root)


def index_union(*layers: DataFrame, allow_chat: bool = False) -> DataFrame:
    """All layers as one table; the chat layer only when old history is allowed."""
    out = layers[0]
    for part in layers[1:]:
        out = out.unionByName(part)
    return out if allow_chat else out.filter("layer <> 'CHATGPT'")


def build_meta(rows: DataFrame) -> DataFrame:
    """Rows per layer, and TOTAL."""
    return (rows.rollup("layer").agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce("layer", F.lit("TOTAL")).alias("layer"), "n"))


def index_health(rows: DataFrame) -> DataFrame:
    """One row: searchable rows, sheet rows, state."""
    counts = rows.agg(F.count_if(F.col("layer").isin(SEARCHABLE)).alias("searchable"),
                      F.count_if(F.col("layer") == SHEET_LAYER).alias("sheet_rows"))
    state = (F.when(F.col("searchable") == 0, "EMPTY").when(F.col("sheet_rows") > 0, "READY_WITH_WPS")
             .otherwise("READY_LOCAL_ONLY"))
    return counts.withColumn("state", state)
