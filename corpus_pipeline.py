"""A corpus pipeline of five operators: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes all rows its predecessor kept; its result is written as Parquet in the shared folder and read again
as the next one's documents, so a lost executor costs no finished stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportkb.llm import decontam, minhash, piece_bpe, quality, suffix_dedup
from supportkb.llm.common import fold, written
from supportkb.llm.queries import model_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts (score 0.3 or more)."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 5) != 0)
    return quality.accepted(docs, model)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that stand earlier in the corpus; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Each row is judged by its own text, whatever its id."""
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.select(row.alias("doc_id"), "text")
    leaks = decontam.contaminated(keyed, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(leaks, row == leaks["_leaks"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of its ids and of the text they decode to."""
    return piece_bpe.round_trip_digests(docs, model_path(), with_ids=True)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_first_of_group), ("repeats", cut_repeats),
          ("decontamination", drop_leaks), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trees, neighbours and merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}

ORACLE: dict[str, str] = {}
