"""Benchmark decontamination by spaced seeds, DataFrame functions only.

Fixed masks over a few neighbouring tokens leave some positions out, so a seed still hits where one of those tokens
was replaced. Seeds of the benchmark meet the seeds of every document position; each hit tells which of its tokens
agree with the item on its diagonal (document place minus item place). The agreeing places of a diagonal are scored as
the best segment, +1 for a token that agrees and ``mismatch`` for each one that does not, so isolated substitutions
are tolerated and chance hits are not.

No text is shuffled: the benchmark's seeds go to the documents when their measured number is below
``broadcast_rows``, otherwise seeds are joined by a shuffle; results are the same.

Items of fewer tokens than the seed span are found exactly: their whole token sequence must stand in the document, by one
more hash per length that such items have (items of one or two tokens are not searched unless asked for). Scripts without blanks are split into characters, so a sentence of them is a
passage of tokens like any other.

Defined cases: null texts are empty and match nothing, nor do texts without tokens; a null doc_id or item_id is an id like any other;
repeated items and repeated documents each give their own row, rows that share an id count as one; of equal best segments
the first in the document, then the longest is reported; other columns are not looked at. A document's tokens are held some eight
times in its row while its places are listed, so the longest text should stay below a task's memory by that factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm.common import as_text

# 1 is a token that must agree, 0 one that is ignored.
MASKS = ["1110110", "1101011", "1011101", "1100111"]
SPAN = 7
# Ranges of characters, which are quick to test: scripts without blanks, and punctuation and blanks beyond ASCII.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17DF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
BREAKS = r"[\s\p{Punct}\u00A0-\u00BF\u2000-\u206F\u3000-\u3040\uFF00-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]+"
BROADCAST_CHARS = 256 * 1024 * 1024


def tokens(text):
    low = F.lower(as_text(text))
    ascii_only = F.octet_length(low) == F.length(low)
    spaced = F.when(ascii_only, low).otherwise(F.regexp_replace(low, f"({UNSPACED})", " $1 "))
    return F.filter(F.split(spaced, BREAKS), lambda w: w != "")


def positions(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per token position with its place and the SPAN tokens w0.. from there on, '' beyond the end."""
    toks = docs.select(*keep, tokens(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    n = F.size("_w")
    padded = F.concat("_w", F.array_repeat(F.lit(""), SPAN - 1))
    cut = [F.slice(padded, F.lit(k + 1), n).alias(f"w{k}") for k in range(SPAN)]
    zipped = F.arrays_zip(*cut, F.sequence(F.lit(0), n - 1).alias("place"))
    return toks.select(*keep, n.alias("n_tokens"), F.inline(zipped))


def seed(mask_no: int):
    """Hash of a mask's tokens where the whole span lies in the text, else null."""
    key = F.xxhash64(F.lit(mask_no), *[F.col(f"w{k}") for k in range(SPAN) if MASKS[mask_no][k] == "1"])
    return F.when(F.col(f"w{SPAN - 1}") != "", key)


def whole(length: int):
    """Hash of the next ``length`` tokens, null where the text ends before."""
    key = F.xxhash64(F.lit(-length), *[F.col(f"w{k}") for k in range(length)])
    return F.when(F.col(f"w{length - 1}") != "", key)


def seeded(rows: DataFrame, *seeds) -> DataFrame:
    return rows.withColumn("seed", F.explode(F.array(*seeds))).filter("seed IS NOT NULL")


def best_segment(places, mismatch: float):
    """Best run over sorted agreeing places: struct(score, first, last, matches)."""
    zero = F.struct(*[F.lit(0.0).alias("run"), F.lit(-1).alias("begin"), F.lit(-1).alias("at"), F.lit(0).alias("n"),
                      F.lit(0.0).alias("score"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("matches")])

    def step(acc, p):
        gap = acc["run"] - mismatch * (p - acc["at"] - 1)
        goes_on = (acc["at"] >= 0) & (gap > 0)
        run = F.when(goes_on, gap + 1.0).otherwise(F.lit(1.0))
        begin = F.when(goes_on, acc["begin"]).otherwise(p)
        n = F.when(goes_on, acc["n"] + 1).otherwise(F.lit(1))
        better = run > acc["score"]
        return F.struct(run.alias("run"), begin.alias("begin"), p.alias("at"), n.alias("n"),
                        F.when(better, run).otherwise(acc["score"]).alias("score"),
                        F.when(better, begin).otherwise(acc["first"]).alias("first"),
                        F.when(better, p).otherwise(acc["last"]).alias("last"),
                        F.when(better, n).otherwise(acc["matches"]).alias("matches"))
    return F.aggregate(places, zero, step)


def contaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = 9.0, mismatch: float = 1.0,
                 broadcast_rows: int = 500_000, least_tokens: int = 3) -> DataFrame:
    """(doc_id, item_id) of every leak with the best segment: first_token, last_token (places in the document),
    n_match, score. An item shorter than ``least_score`` / 0.8 tokens needs 0.8 of its own length, one shorter than the
    span all of it. Items of fewer than ``least_tokens`` tokens are words and no passages: any text may use them."""
    masked = [seed(m) for m in range(len(MASKS))]
    places = positions(benchmark.select("item_id", as_text(F.col("text")).alias("text")), ["item_id"]).filter(F.col("n_tokens") >= least_tokens)
    short = F.col("n_tokens") < SPAN
    chars = F.sum(sum((F.length(f"w{k}") + 8 for k in range(SPAN)), F.lit(32)))
    size = places.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(chars, F.lit(0)).alias("chars"),
                      F.collect_set(F.when(short, F.col("n_tokens"))).alias("lengths")).first()     # at most SPAN - 1 lengths
    items = seeded(places.filter(~short), *masked)
    for n in size["lengths"]:
        items = items.unionByName(seeded(places.filter((F.col("n_tokens") == n) & (F.col("place") == 0)), whole(n)))
    items = items.select("seed", "item_id", F.col("place").alias("item_place"), F.col("n_tokens").alias("item_tokens"),
                         *[F.col(f"w{k}").alias(f"v{k}") for k in range(SPAN)])
    few = size["rows"] * len(MASKS) <= broadcast_rows and size["chars"] * len(MASKS) <= BROADCAST_CHARS
    docs = seeded(positions(documents.select("doc_id", "text"), ["doc_id"]).drop("n_tokens"),
                  *masked, *[whole(n) for n in sorted(size["lengths"])])
    hits = docs.join(F.broadcast(items) if few else items, "seed")
    agree = F.filter(F.array(*[F.when((F.col(f"w{k}") == F.col(f"v{k}")) & (F.col(f"v{k}") != ""), F.col("place") + k)
                               for k in range(SPAN)]), lambda p: p.isNotNull())
    # repeated hits of a position add nothing: one row per agreeing place before anything is collected
    agreed = (hits.select("doc_id", "item_id", "item_tokens", (F.col("place") - F.col("item_place")).alias("diagonal"),
                          F.explode(agree).alias("place")).distinct())
    runs = (agreed.groupBy("doc_id", "item_id", "item_tokens", "diagonal")
            .agg(F.array_sort(F.collect_list("place")).alias("places"))
            .withColumn("best", best_segment(F.col("places"), mismatch))
            .filter(F.col("best.score") >= F.when(F.col("item_tokens") < SPAN, F.col("item_tokens").cast("double"))
                    .otherwise(F.least(F.lit(least_score), F.lit(0.8) * F.col("item_tokens")))))
    top = runs.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.col("best.score").alias("score"), (-F.col("best.first")).alias("back"), F.col("best.last").alias("last"),
        F.col("best.matches").alias("matches"))).alias("top"))
    return top.select("doc_id", "item_id", (-F.col("top.back")).cast("long").alias("first_token"),
                      F.col("top.last").cast("long").alias("last_token"), F.col("top.matches").cast("long").alias("n_match"),
                      F.col("top.score").alias("score"))
