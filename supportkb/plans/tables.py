"""The engine's input tables derived from the driver's tables, for Spark and as DuckDB CTEs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportkb.functions.text import norm
from supportkb.operators.chat import opening_text, reply_turns
from supportkb.sources.files import read_table


@functools.lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. They do not change, so a session plans each scan once."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# DuckDB spelling of the blank class.
SQL_BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_keep_case(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[{SQL_BLANKS}]+', '', 'g')"


def sql_norm(x: str) -> str:
    return f"lower({sql_keep_case(x)})"


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '\\A[{SQL_BLANKS}]+|[{SQL_BLANKS}]+\\z', '', 'g')"


# --- queries and synonyms ----------------------------------------------------------------------

def word(c, i: int):
    """i-th blank-separated word of a text, '' beyond the end."""
    return F.coalesce(F.get(F.split(c, r"[ \n]+"), F.lit(i - 1)), F.lit(""))


def sql_word(c: str, i: int) -> str:
    return f"coalesce(regexp_split_to_array({c}, '[ \\n]+')[{i}], '')"


def text_queries(spark, sf_dir) -> DataFrame:
    """Each benchmark passage as a query over everything."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("").alias("product"), F.col("text").alias("q"))


SQL_TEXT_QUERIES = "SELECT item_id AS query_id, '' AS product, text AS q FROM benchmark"


def word_queries(spark, sf_dir) -> DataFrame:
    """Two words of each passage; every second query names a source as its product."""
    b = table(spark, sf_dir, "benchmark")
    product = F.when(F.col("item_id") % 2 == 0, F.lit("")).otherwise(
        F.concat(F.lit("SRC "), (F.col("item_id") % 20).cast("string")))
    return b.select(F.col("item_id").alias("query_id"), product.alias("product"),
                    F.concat_ws(" ", word(F.col("text"), 1), word(F.col("text"), 2)).alias("q"))


SQL_WORD_QUERIES = f"""SELECT item_id AS query_id,
  CASE WHEN item_id % 2 = 0 THEN '' ELSE 'SRC ' || (item_id % 20) END AS product,
  concat_ws(' ', {sql_word('text', 1)}, {sql_word('text', 2)}) AS q FROM benchmark"""


def word_synonyms(spark, sf_dir) -> DataFrame:
    """First word of each passage -> its next words."""
    b = table(spark, sf_dir, "benchmark")
    t = F.col("text")
    pairs = F.array(
        F.struct(F.concat_ws(" ", word(t, 2), word(t, 3)).alias("expansion"), (F.col("item_id") * 2).alias("ord")),
        F.struct(word(t, 4).alias("expansion"), (F.col("item_id") * 2 + 1).alias("ord")))
    return b.select(word(t, 1).alias("term"), F.inline(pairs))


SQL_WORD_SYNONYMS = f"""SELECT {sql_word('text', 1)} AS term,
  concat_ws(' ', {sql_word('text', 2)}, {sql_word('text', 3)}) AS expansion, item_id * 2 AS ord FROM benchmark
  UNION ALL SELECT {sql_word('text', 1)}, {sql_word('text', 4)}, item_id * 2 + 1 FROM benchmark"""


def sql_terms(queries: str, synonyms: str) -> str:
    """CTEs q, syn, terms for expand_terms."""
    return f"""q AS ({queries}),
qn AS (SELECT query_id, product, {sql_norm('q')} AS qn FROM q WHERE {sql_norm('q')} <> ''),
syn AS (SELECT {sql_norm('term')} AS nkey, {sql_norm('expansion')} AS nexp, ord FROM ({synonyms})
        WHERE {sql_norm('term')} <> '' AND {sql_norm('expansion')} <> ''),
syn_keys AS (SELECT nkey, min(ord) AS key_ord FROM syn GROUP BY nkey),
placed AS (
  SELECT query_id, qn AS term, 0 AS place FROM qn
  UNION ALL SELECT query_id, nexp, 1000000000 + ord FROM qn JOIN syn ON contains(qn, nkey)
  UNION ALL SELECT query_id, syn.nkey, 2000000000 + key_ord FROM qn JOIN syn ON contains(qn, nexp)
            JOIN syn_keys ON syn.nkey = syn_keys.nkey),
terms AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY place, term) - 1 AS ord
          FROM (SELECT query_id, term, min(place) AS place FROM placed GROUP BY query_id, term))"""


# --- index rows --------------------------------------------------------------------------------

def document_rows(spark, sf_dir, layer: str = "OCR", raw: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit(layer).alias("layer"), F.col("doc_id").alias("row_ord"), F.col("source").alias("name"),
                    F.col("doc_id").cast("string").alias("page"),
                    (F.col("text") if raw else norm(F.col("text"))).alias("blob"), F.lit("").alias("ref"))


def sql_document_rows(layer: str = "OCR", raw: bool = False) -> str:
    return f"""SELECT '{layer}' AS layer, doc_id AS row_ord, source AS name, CAST(doc_id AS VARCHAR) AS page,
  {'text' if raw else sql_norm('text')} AS blob, '' AS ref FROM documents"""


def turn_pairs(spark, sf_dir) -> DataFrame:
    """User turn directly followed by an assistant turn."""
    return reply_turns(table(spark, sf_dir, "conversations"))


SQL_TURN_PAIRS = """SELECT conv_id, turn, question, text AS answer FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
  WHERE role = 'assistant' AND before = 'user'"""


def faq_items(spark, sf_dir) -> DataFrame:
    return turn_pairs(spark, sf_dir).select(
        F.concat(F.lit("sheet"), (F.col("conv_id") % 10).cast("string")).alias("sheet"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("item_ord"),
        "question", "answer", F.lit("").alias("template"))


SQL_FAQ_ITEMS = f"""SELECT 'sheet' || (conv_id % 10) AS sheet, conv_id * 1000000 + turn AS item_ord,
  question, answer, '' AS template FROM ({SQL_TURN_PAIRS})"""


def faq_rows(items: DataFrame) -> DataFrame:
    """FAQ layer: one row per item."""
    return items.select(F.lit("FAQ").alias("layer"), F.col("item_ord").alias("row_ord"),
                        F.col("sheet").alias("name"), F.lit("").alias("page"),
                        norm(F.concat_ws(" ", "question", "answer", "template")).alias("blob"),
                        F.lit("").alias("ref"))


SQL_FAQ_ROWS = f"""SELECT 'FAQ' AS layer, item_ord AS row_ord, sheet AS name, '' AS page,
  {sql_norm("concat_ws(' ', question, answer, template)")} AS blob, '' AS ref FROM ({SQL_FAQ_ITEMS})"""


def chat_rows(spark, sf_dir) -> DataFrame:
    """Chat layer: raw text of all user and assistant turns of a conversation."""
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    return (opening_text(c).select(
        F.lit("CHATGPT").alias("layer"), F.col("conv_id").alias("row_ord"),
        F.concat(F.lit("title "), (F.col("conv_id") % 7).cast("string")).alias("name"),
        F.concat(F.lit("project"), (F.col("conv_id") % 3).cast("string")).alias("page"),
        "blob", F.col("conv_id").cast("string").alias("ref")))


SQL_CHAT_ROWS = """SELECT 'CHATGPT' AS layer, conv_id AS row_ord, 'title ' || (conv_id % 7) AS name,
  'project' || (conv_id % 3) AS page,
  translate(string_agg(text, chr(10) ORDER BY turn), chr(9) || chr(10), '  ') AS blob,
  CAST(conv_id AS VARCHAR) AS ref
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"""


def all_rows(spark, sf_dir) -> DataFrame:
    return (faq_rows(faq_items(spark, sf_dir)).unionByName(document_rows(spark, sf_dir))
            .unionByName(chat_rows(spark, sf_dir)))


SQL_ALL_ROWS = f"""{SQL_FAQ_ROWS}
UNION ALL {sql_document_rows()}
UNION ALL {SQL_CHAT_ROWS}"""
