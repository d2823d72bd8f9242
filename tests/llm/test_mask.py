"""The loss text is what stands under the mask."""

import hashlib

from pyspark.sql import functions as F

from supportkb.llm import chat_format


def test_loss_text_follows_the_spans(spark):
    said = lambda i: f"t{i} <|im_end|> & é😀 {i * 7}"
    rows = [(1, i, "assistant" if i % 2 else "user", said(i)) for i in range(1400)] + [(2, 0, "user", "only"), (3, 0, "assistant", None), (4, 0, "assistant", "one")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(messages)
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.chat_digests(formatted).collect()}
    want = {1: "".join(said(i) for i in range(1400) if i % 2), 2: "", 3: "", 4: "one"}
    assert got == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    wrong = formatted.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(s["turn"].alias("turn"), (s["start"] + 1).alias("start"), s["end"].alias("end"))))
    off = {r.conv_id: r.loss_sha256 for r in chat_format.chat_digests(wrong).collect()}
    assert off[1] != got[1][1] and off[4] == hashlib.sha256(b"ne").hexdigest()
