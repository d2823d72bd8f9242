"""Knowledge gaps and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportkb.functions.text import norm_keep_case
from supportkb.operators.ordered import running_last, running_sums

# Actions that close a cycle of misses; all but the reset count as a cycle.
ACKNOWLEDGE, RESET, RECORD = ["acknowledge", "update-done"], "reset", "record"


def gap_report(manuals: DataFrame, products: DataFrame, faq_counts: DataFrame, misses: DataFrame,
               least: int = 200) -> DataFrame:
    """type, subject, detail: unreadable manuals, products without or with empty FAQ, products
    without manual (only looked at when the FAQ file exists), recorded misses. Duplicates stay.

    ``manuals``: name, text; ``products``: product, faq, ocr_files array; ``faq_counts``: faq, items;
    ``misses``: product, question, reason."""
    row = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("type"), subject.alias("subject"), detail.alias("detail"))
    n = F.char_length(norm_keep_case(F.col("text")))
    empty = row(manuals.withColumn("_n", n).filter(F.col("_n") < least), "empty_ocr", F.col("name"),
                F.concat(F.lit("normalized_len="), F.col("_n").cast("string")))
    known = products.join(faq_counts, "faq", "left")
    missing = F.col("items").isNull() | (F.col("faq") == "")
    no_file = row(known.filter(missing), "no_faq", F.col("product"), F.concat(F.lit("missing faq file: "), F.col("faq")))
    has_file = known.filter(~missing)
    no_items = row(has_file.filter("items = 0"), "no_faq", F.col("product"), F.lit("faq has zero items"))
    no_ocr = row(has_file.filter(F.size("ocr_files") == 0), "no_ocr", F.col("product"), F.lit("no OCR files mapped"))
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    asked = row(misses, "miss_record", dash("product"), F.concat(dash("question"), F.lit(" | "), dash("reason")))
    return empty.unionByName(no_file).unionByName(no_items).unionByName(no_ocr).unionByName(asked)


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Gaps per type, and TOTAL."""
    return gaps.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "n")


def miss_cycles(actions: DataFrame, keys: list[str], order: list[str], block: Column, threshold: int = 3) -> DataFrame:
    """Counter state after every action: records since the last close, whether a reminder is due,
    closed cycles, time of the last reminder.

    ``actions`` has action and ts besides keys and order; ``block`` grows with the order and keeps
    one busy key from being one task."""
    is_record = (F.col("action") == RECORD).cast("long")
    is_ack = F.col("action").isin(ACKNOWLEDGE)
    closes = is_ack | (F.col("action") == RESET)
    summed = running_sums(actions, keys, block, order, _records=is_record, cycles=is_ack.cast("long"))
    based = running_last(summed, keys, block, order, "_base", F.when(closes, F.col("_records")))
    # A reset forgets the last reminder; an acknowledgement sets it.
    dated = running_last(based, keys, block, order, "_mark", F.when(closes, F.struct(F.when(is_ack, F.col("ts")).alias("t"))))
    n = F.col("_records") - F.coalesce("_base", F.lit(0))
    return (dated.withColumn("records", n).withColumn("reminder_due", F.col("records") >= threshold)
            .withColumn("last_reminder", F.col("_mark.t")).drop("_records", "_base", "_mark"))
