"""Totals of the language model beyond 32 bits."""

import pyarrow as pa
from pyspark.sql import functions as F

from supportkb.llm import interp_lm as lm


def test_totals_beyond_32_bits(spark):
    docs = spark.createDataFrame([(1, "a a b", True)], "doc_id long, text string, train boolean")
    own = lm._chunks(docs)
    asked = lm._requests(own, 4).toArrow()
    most = [lm._packed(lm.np.full(n, 2**32 - 1)) for n in asked.column("n").to_pylist()]
    other = asked.set_column(1, "chunk", pa.array([-1] * len(asked), pa.int64())).set_column(5, "b", pa.array(most, pa.binary()))
    schema = "kind int, chunk long, part int, n int, a binary, b binary"
    rows = [tuple(r.values()) for t in (asked, other) for r in t.to_pylist()]
    totals = lm._totals(spark.createDataFrame(rows, schema))
    chunk = lm._Chunk(own.toArrow(), totals.filter(F.col("chunk") != -1).toArrow())
    assert chunk.word.tolist() == [2.0**32 + n for n in (1, 1, 0, 0)]
    assert chunk.pair.tolist() == [2.0**32] * 4
