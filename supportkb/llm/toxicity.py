"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon (words and word beginnings with their log odds) is learned from a bounded sample of labelled training
documents (``sample``, the ones with the least hash of their id); trees and calibration are fitted on disjoint parts
of the same sample. Everything that is broadcast is bounded by the lexicon's size and the number of trees.

Features of the whole text: lexicon densities, their nearness to the second person, capitals, exclamation and other
punctuation, obfuscated spellings and how many of those read as lexicon words once undone.

Defined cases: null and empty texts have all features 0 and are scored like any other; labels that are null are not
learned from; a sample without both labels gives every text the share of label 1 (0.5 without labels)."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm import common
from supportkb.llm.quality import labelled_sample

SAMPLE = 8192
LEXICON = 600
MEMO_WORDS = 400_000

# Fixed values.
SECOND_PERSON = {"you", "your", "yours", "yourself", "ur", "u", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre",
                 "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros"}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l",
                      "*": "", ".": "", "-": "", "_": ""})
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 6
FEATURES = ["sure", "sure_count", "likely", "odds", "most", "near_you", "you", "capitals", "exclaimed", "punctuation",
            "digits", "obfuscated", "undone"]

_WORD = re.compile(r"[^\W_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$*!|][0-9@$*!|\w]*[^\W\d_]|\b(?:[^\W\d_][.\-_*]){3,}[^\W\d_]\b")


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words and beginnings (written ``begin*``) of the sample with their log odds, the ``size`` most telling ones."""
    w = F.explode(F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"))).alias("w")
    found = rows.select("doc_id", "label", w).filter("w <> ''")
    forms = F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES])
    terms = (found.select("doc_id", "label", F.explode(forms).alias("term")).filter("term IS NOT NULL").distinct()
             .groupBy("term").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).filter("t >= 4"))
    total = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    toxic, clean = int(total[1] or 0), int(total[0]) - int(total[1] or 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    best = (terms.withColumn("odds", odds).filter("odds >= 2.5")
            .orderBy(F.desc(F.col("odds") * F.log1p(F.col("t"))), "term").limit(size))
    return {r["term"]: float(r["odds"]) for r in best.collect()}      # at most ``size`` rows


class _Memo(dict):
    """Word to its log odds in the lexicon; -1 for the second person, 0 for other words."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word):
        if len(self) > MEMO_WORDS:
            self.clear()
        get = self.lexicon.get
        value = max([get(word, 0.0), *(get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k)])
        if not value and word in SECOND_PERSON:
            value = -1.0
        self[word] = value
        return value


def text_features(text: str, memo: _Memo) -> list[float]:
    """The features that need words; byte densities are added for a whole batch."""
    values = list(map(memo.__getitem__, _WORD.findall(text.lower())))
    n = max(len(values), 1)
    hits = [i for i, v in enumerate(values) if v]
    you = [i for i in hits if values[i] < 0]
    odds = [values[i] for i in hits if values[i] > 0]
    places = [i for i in hits if values[i] > 0]
    sure = sum(o >= 4.5 for o in odds)
    near = at = 0
    for p in places:
        while at < len(you) and you[at] < p - NEAR:
            at += 1
        near += at < len(you) and you[at] <= p + NEAR
    hidden = _OBFUSCATED.findall(text)
    undone = sum(memo[h.lower().translate(LEET)] > 0 for h in hidden)
    return [sure / n, math.log1p(sure), (len(odds) - sure) / n, sum(odds) / n, max(odds, default=0.0), near / n,
            len(you) / n, len(hidden) / n, math.log1p(undone)]


def features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns and the feature array of every row; ``text`` must be a column."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)      # bounded by the lexicon's size
    tables = np.zeros((5, 256), np.float32)
    tables[0, 65:91] = 1
    tables[1, [ord("!"), ord("?")]] = 1
    tables[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
    tables[3, 48:58] = 1
    tables[4] = 1

    def run(batches):
        memo = _Memo(held.value)
        for batch in batches:
            texts = batch.column(len(keep))
            data, offsets = common.column_bytes(texts)
            for a, b in common.pieces(data, offsets, 1 << 21):
                part = data[offsets[a]:offsets[b]]
                cut = offsets[a:b + 1] - offsets[a]
                share = np.zeros((4, b - a))
                size = np.maximum(np.diff(cut), 1)
                for k in range(4):
                    run_sum = np.concatenate([[0.0], np.cumsum(tables[k][part], dtype=np.float64)])
                    share[k] = np.diff(run_sum[cut]) / size
                rows = np.array([text_features(t.as_py() or "", memo) for t in texts.slice(a, b - a)]).reshape(b - a, 9)
                every = np.column_stack([rows[:, :7], share.T, rows[:, 7:]])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * every.shape[1]),
                                                pa.array(every.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), flat],
                                                 [*keep, "features"])
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, docs["text"].cast("string")).mapInArrow(run, f"{kinds}, features array<double>")


class ToxicityModel:
    """Lexicon, trees and calibration; ``trees`` is None where only the share of label 1 is known."""

    def __init__(self, lexicon, trees, calibration, prior):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def scored(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        if self.trees is None:
            out = ids.select("doc_id", F.lit(self.prior).alias("score"))
        else:
            found = features(ids, self.lexicon, ["doc_id"]).withColumn("features", array_to_vector("features"))
            raw = self.trees.transform(found).select("doc_id", vector_to_array("probability")[1].alias("raw"))
            out = self.calibration.transform(raw).select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, sample: int = SAMPLE, trees: int = 20,
        depth: int = 3) -> ToxicityModel:
    learnable = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, sample)
    rows = common.written(learnable.select(F.col("doc_id").cast("long").alias("doc_id"), "label",
                                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                           (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("calibrates")), "toxic-sample")
    seen = {(r[0], r[1]): r[2] for r in rows.groupBy("calibrates", "label").count().collect()}
    n = sum(seen.values())
    prior = sum(c for (_, y), c in seen.items() if y == 1) / n if n else 0.5
    if not all((c, y) in seen for c in (True, False) for y in (0, 1)):
        return ToxicityModel({}, None, None, prior)
    lexicon = learn_lexicon(rows.filter("NOT calibrates"))
    made = (features(rows, lexicon, ["doc_id", "label", "calibrates"])
            .withColumn("features", array_to_vector("features")).withColumn("label", F.col("label").cast("double")))
    made = made.repartition(4, "doc_id").persist()      # a bounded sample, read by every boosting step
    try:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(made.filter("NOT calibrates"))
        raw = model.transform(made.filter("calibrates")).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", predictionCol="score").fit(raw)
    finally:
        made.unpersist()
    return ToxicityModel(lexicon, model, calibration, prior)
