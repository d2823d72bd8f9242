"""A kept inverted index for BM25: built once, grown by appended segments, read with block-max pruning.

Layout below the index folder, every segment written once and never changed:
  segment=<s>/docs        layer, row_ord, name, page, head, doc_len
  segment=<s>/postings    bucket=<b>/ layer, tok, block, max_tf, min_len, postings array<struct<row_ord, tf, doc_len>>
  segment=<s>/vocabulary  bucket=<b>/ layer, tok, df
  _versions/<n>.json      the segments of version n and, per layer, rows, total length and mean raw idf

A block holds one token's postings among SPAN neighbouring rows, so blocks of all tokens are cut at the same rows.
``bucket`` is a hash of the token: a batch of questions reads the folders of its tokens only. ``max_tf`` and ``min_len`` bound
the score that any row of a block can get from the token, whatever the mean length has become.

A search first sums these bounds per (question, row range) from the block heads, without reading postings. The ranges
with the highest bounds are scored; the score of the k-th best row so far is a threshold that every range has to
reach by its bound to be scored at all. The result equals scoring everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from supportkb.functions.text import TOKENIZERS
from supportkb.operators.search import CHAT
from supportkb.sizing import MAX_BROADCAST_ROWS, broadcast_if, cut_lineage, is_small, measure
from supportkb.sources import versions

SPAN_BITS, BUCKETS, FIRST_RANGES = 5, 16, 8
STEP_BLOCKS = 32             # blocks counted at a time
PARTS = {
    "docs": "layer string, row_ord long, name string, page string, head string, doc_len int",
    "postings": "layer string, tok string, block long, max_tf int, min_len int, postings array<struct<row_ord: long, tf: int, doc_len: int>>, bucket int",
    "vocabulary": "layer string, tok string, df long, bucket int",
}


def _bucket(tok: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(buckets)).cast("int")


def _block_postings(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of a task's rows (layer, row_ord, block, tokens), whose block numbers grow along the task and are in no other:
    a row per (layer, tok, block). SPAN rows stay together over batches; counting is a sort of numbers."""
    def count(t: pa.Table) -> pa.RecordBatch:
        col = {c: t.column(c).combine_chunks() for c in ("layer", "row_ord", "block", "tokens")}
        words = pc.dictionary_encode(pc.list_flatten(col["tokens"]))
        layers = pc.dictionary_encode(col["layer"], null_encoding="encode")
        lens = pc.list_value_length(col["tokens"]).to_numpy().astype(np.int32)
        block, layer = col["block"].to_numpy(), layers.indices.to_numpy()
        place = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
        pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(lens) + place, return_counts=True)
        code, row = pairs // len(lens), pairs % len(lens)
        order = np.lexsort((row, block[row], layer[row], code))
        code, row, tf = code[order], row[order], tf[order].astype(np.int32)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (np.diff(code) != 0) | (np.diff(layer[row]) != 0) | (np.diff(block[row]) != 0)
        first = np.flatnonzero(new)
        entries = pa.StructArray.from_arrays([col["row_ord"].take(pa.array(row)), pa.array(tf), pa.array(lens[row])], fields=list(schema.field("postings").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), entries)
        return pa.RecordBatch.from_arrays([
            layers.dictionary.take(pa.array(layer[row[first]])), words.dictionary.take(pa.array(code[first])), pa.array(block[row[first]]),
            pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(lens[row], first)), lists.cast(schema.field("postings").type)], schema=schema)

    def whole(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(starts[:-1:STEP_BLOCKS], [*starts[STEP_BLOCKS:-1:STEP_BLOCKS], starts[-1]]):
            part = t.slice(lo, hi - lo)
            if pc.sum(pc.list_value_length(part.column("tokens"))).as_py():
                yield count(part)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            starts = np.flatnonzero(np.diff(t.column("block").to_numpy(), prepend=-1))
            yield from whole(t, starts)                     # the last block may go on in the next batch
            rest = t.slice(starts[-1])
        if rest is not None:
            yield from whole(rest, np.array([0, rest.num_rows]))

    return build


def _raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def append_segment(rows: DataFrame, path: str, mode: str = "cjk", buckets: int = BUCKETS) -> int:
    """Index ``rows`` (layer, row_ord, name, page, blob, ref), none of which may be in the index yet, as a new segment; the
    index shows them when the last step has committed the next version. Returns that version's number. ``buckets`` is chosen with
the first segment."""
    spark = rows.sparkSession
    known = versions.read(spark, path) or {"version": 0, "mode": mode, "buckets": buckets, "segments": [], "layers": {}}
    if known["mode"] != mode:
        raise ValueError(f"the index at {path} holds {known['mode']} tokens")
    number = known["version"] + 1
    base = f"{path}/segment={number}"
    chat = F.col("layer") == CHAT
    tokens = TOKENIZERS[mode](F.col("blob"))
    docs = rows.select("layer", "row_ord", F.when(chat, F.col("ref")).otherwise(F.col("name")).alias("name"),
                       F.when(chat, F.col("name")).otherwise(F.col("page")).alias("page"),
                       F.substring("blob", 1, 300).alias("head"), F.size(tokens).alias("doc_len"))
    docs.write.mode("overwrite").parquet(f"{base}/docs")
    sizes = (spark.read.schema(PARTS["docs"]).parquet(f"{base}/docs").groupBy("layer")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len")).collect())   # a row per layer
    # Neighbouring rows are rows of one task, so its blocks are whole and nothing is shuffled. Name, page and ref go along because a
    # repartition before this places a row by all its columns.
    placed = rows.select("layer", F.col("row_ord").cast("long").alias("row_ord"), "name", "page", "ref",
                         F.shiftright(F.monotonically_increasing_id(), SPAN_BITS).alias("block"), tokens.alias("tokens"))
    schema = StructType(StructType.fromDDL(PARTS["postings"]).fields[:-1])
    blocks = placed.mapInArrow(_block_postings(to_arrow_schema(schema)), schema)
    order = ["bucket", "layer", "tok", "block"]
    (blocks.withColumn("bucket", _bucket(F.col("tok"), known["buckets"])).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings"))
    heads = spark.read.schema(PARTS["postings"]).parquet(f"{base}/postings")
    words = heads.groupBy("bucket", "layer", "tok").agg(F.sum(F.size("postings")).alias("df"))
    words.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/vocabulary")
    layers = {layer: dict(v) for layer, v in known["layers"].items()}
    for r in sizes:
        have = layers.setdefault(r["layer"], {"n": 0, "len": 0})
        have["n"], have["len"] = have["n"] + r["n"], have["len"] + r["len"]
    content = {"version": number, "mode": mode, "buckets": known["buckets"], "segments": [*known["segments"], number], "layers": layers}
    counts = _vocabulary(spark, path, content).join(F.broadcast(_layer_table(spark, content)), "layer")
    for layer, mean in counts.groupBy("layer").agg(F.avg(_raw_idf(F.col("n"), F.col("df")))).collect():
        layers[layer]["mean_raw"] = mean
    versions.commit(spark, path, number, content)
    return number


def _layer_table(spark: SparkSession, version: dict) -> DataFrame:
    """layer, n, avg_len, mean_raw: one row per layer."""
    rows = [(layer, v["n"], v["len"] / v["n"], v.get("mean_raw")) for layer, v in version["layers"].items()]
    return spark.createDataFrame(rows, "layer string, n long, avg_len double, mean_raw double")


def _read(spark: SparkSession, path: str, version: dict, part: str) -> DataFrame:
    """A part of all segments of a version, with the segment's number."""
    out = None
    for s in version["segments"]:
        one = spark.read.schema(PARTS[part]).parquet(f"{path}/segment={s}/{part}").withColumn("segment", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def _vocabulary(spark: SparkSession, path: str, version: dict, buckets: list[int] | None = None) -> DataFrame:
    words = _read(spark, path, version, "vocabulary")
    words = words if buckets is None else words.filter(F.col("bucket").isin(buckets))
    return words.groupBy("layer", "tok").agg(F.sum("df").alias("df"))


class IndexSearch:
    """One batch of questions against one version of an index. ``terms``: query_id, term."""

    def __init__(self, spark: SparkSession, path: str, terms: DataFrame, top: int = 12, k1: float = 1.5, b: float = 0.75,
                 eps: float = 0.25, first_ranges: int = FIRST_RANGES):
        self.spark, self.path, self.top, self.k1, self.b, self.first_ranges = spark, path, top, k1, b, first_ranges
        self.version = versions.read(spark, path)
        if self.version is None:
            raise FileNotFoundError(f"no index at {path}")
        asked = cut_lineage(terms.select("query_id", F.explode(TOKENIZERS[self.version["mode"]](F.col("term"))).alias("tok"))
                            .groupBy("query_id", "tok").agg(F.count(F.lit(1)).alias("qtf")))
        self.few = is_small(measure(asked), MAX_BROADCAST_ROWS // 8)
        # a number per bucket at most comes back
        buckets = [r[0] for r in asked.select(_bucket(F.col("tok"), self.version["buckets"])).distinct().collect()]
        self.postings = _read(spark, path, self.version, "postings").filter(F.col("bucket").isin(buckets))
        words = _vocabulary(spark, path, self.version, buckets).join(broadcast_if(asked.select("tok").distinct(), self.few), "tok")
        raw = _raw_idf(F.col("n"), F.col("df"))
        idf = (words.join(F.broadcast(_layer_table(spark, self.version)), "layer")
               .select("layer", "tok", "avg_len", F.when(raw < 0, F.col("mean_raw") * eps).otherwise(raw).alias("idf")))
        self.weights = cut_lineage(idf.join(broadcast_if(asked, self.few), "tok")
                                   .select("query_id", "layer", "tok", "avg_len", (F.col("qtf") * F.col("idf")).alias("w")))

    def _part(self, tf: Column, doc_len: Column) -> Column:
        return F.col("w") * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * doc_len / F.col("avg_len")))

    def bounds(self) -> DataFrame:
        """query_id, layer, segment, block, bound, blocks: the most a row of the range can score, from block heads alone."""
        heads = self.postings.select("layer", "tok", "segment", "block", "max_tf", "min_len")
        found = heads.join(broadcast_if(self.weights, self.few), ["layer", "tok"])
        return (found.groupBy("query_id", "layer", "segment", "block")
                .agg(F.sum(F.greatest(self._part(F.col("max_tf"), F.col("min_len")), F.lit(0.0))).alias("bound"),
                     F.count(F.lit(1)).alias("blocks")))

    def _scores(self, ranges: DataFrame) -> DataFrame:
        """query_id, layer, row_ord, score of the rows of ``ranges`` (query_id, layer, segment, block)."""
        spots = ["layer", "segment", "block"]
        wanted = self.postings.select(*spots, "tok", "postings").join(broadcast_if(self.weights, self.few), ["layer", "tok"])
        wanted = wanted.join(ranges.select("query_id", *spots), ["query_id", *spots], "left_semi")
        each = wanted.select("query_id", "layer", "w", "avg_len", F.inline("postings"))
        return (each.groupBy("query_id", "layer", "row_ord").agg(F.round(F.sum(self._part(F.col("tf"), F.col("doc_len"))), 6).alias("score"))
                .filter("score > 0"))

    def _plan(self) -> tuple[DataFrame, DataFrame]:
        """(scores of the first ranges, the ranges with bound, whether they were first, and the threshold)."""
        by = W.partitionBy("query_id", "layer").orderBy(F.desc("bound"), "segment", "block")
        ranges = cut_lineage(self.bounds())
        first = cut_lineage(ranges.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= self.first_ranges).drop("_r"))
        scores = cut_lineage(self._scores(first))
        place = F.row_number().over(W.partitionBy("query_id", "layer").orderBy(F.desc("score")))
        kth = (scores.withColumn("_r", place).filter(F.col("_r") <= self.top).groupBy("query_id", "layer")
               .agg(F.when(F.count(F.lit(1)) >= self.top, F.min("score")).alias("threshold")))
        keys = ["query_id", "layer", "segment", "block"]
        ranges = (ranges.join(first.select(*keys, F.lit(True).alias("first")), keys, "left").join(kth, ["query_id", "layer"], "left")
                  .withColumn("first", F.coalesce("first", F.lit(False)))
                  # scores are rounded to 6 places, so a bound may fall short by that much
                  .withColumn("read", F.col("first") | F.col("threshold").isNull() | (F.col("bound") + 1e-5 >= F.col("threshold"))))
        return scores, cut_lineage(ranges)

    def topk(self) -> DataFrame:
        """query_id, layer, rank, row_ord, score, name, page, snippet: as ``search_bm25`` over whole layers."""
        scores, ranges = self._plan()
        scored = scores.unionByName(self._scores(ranges.filter("read AND NOT first")))
        docs = _read(self.spark, self.path, self.version, "docs").select("layer", "row_ord", "name", "page", F.col("head").alias("snippet"))
        rn = F.row_number().over(W.partitionBy("query_id", "layer").orderBy(F.desc("score"), "row_ord"))
        best = cut_lineage(scored.withColumn("rank", rn).filter(F.col("rank") <= self.top))
        return (docs.join(broadcast_if(best, is_small(measure(best))), ["layer", "row_ord"])
                .select("query_id", "layer", "rank", "row_ord", "score", "name", "page", "snippet"))

    def pruning(self) -> DataFrame:
        """query_id, layer, blocks that hold a token of the question, blocks_read of them."""
        _, ranges = self._plan()
        return ranges.groupBy("query_id", "layer").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("read"), F.col("blocks")).otherwise(0)).alias("blocks_read"))


def search_index(spark: SparkSession, path: str, terms: DataFrame, **options) -> DataFrame:
    """BM25 of all terms' tokens against the latest version of the index at ``path``."""
    return IndexSearch(spark, path, terms, **options).topk()
