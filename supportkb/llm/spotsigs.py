"""Document fingerprints by spot signatures, DataFrame functions only.

A signature is a common word (the anchor) with the chain of the next content words behind it; a document's
fingerprint is the set of its signatures. ``similar_pairs`` joins a collection: sets are partitioned by their
length, so only partitions whose lengths can reach the likeness meet, candidates share one of their rarest
signatures, and bounds on the lengths prune before sets are intersected.

Defined cases: null text is empty and has the empty fingerprint; a text without any signature has one signature of
its whole word sequence; two empty fingerprints are alike (1.0), an empty and another one are not (0.0). A very long
text is one row and is held whole; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportkb.llm.common import as_text, let, written

# Common words of the four languages that open a chain.
ANCHORS = ["the", "of", "and", "to", "in", "that", "is", "a",
           "de", "la", "le", "et", "les", "des", "en", "un",
           "der", "die", "und", "den", "von", "zu", "das", "ist",
           "que", "el", "y", "los", "del", "las", "se", "por"]


def spot_signatures(text, anchors: list[str] = ANCHORS, chain: int = 2):
    """Sorted distinct 32-bit signatures of a text."""
    def of_words(every):
        def of_content(content):
            places = F.filter(F.transform(every, lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))),
                              lambda a: a.isNotNull())
            # the j-th anchor at place i has i - j content words before it
            chains = F.transform(places, lambda a, j: F.hash(a["w"], *[F.get(content, a["i"] - j + k) for k in range(chain)]))
            return F.when(F.size(content) == 0, F.array().cast("array<int>")).otherwise(chains)
        return let(F.filter(every, lambda w: ~w.isin(anchors)), of_content)

    def whole(every):
        return let(of_words(every), lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s)))
                   .when(F.size(every) > 0, F.array(F.hash(F.array_join(every, " "))))
                   .otherwise(F.array().cast("array<int>")))
    split = F.filter(F.split(F.lower(as_text(text)), r"[\s\p{Punct}]+"), lambda w: w != "")
    # a text of marks only still has a fingerprint of its own
    return let(split, lambda every: F.when((F.size(every) == 0) & (F.length(as_text(text)) > 0),
                                           F.array(F.hash(as_text(text)))).otherwise(whole(every)))


def fingerprint(signatures):
    """The set as text: eight hexadecimal digits per signature, in ascending order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a, b):
    """Jaccard likeness of two signature sets; lengths alone decide where they can."""
    shared = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(let(shared, lambda n: n / (F.size(a) + F.size(b) - n))))


def with_next(docs: DataFrame, sub_blocks: int = 64) -> DataFrame:
    """doc_id and text with the signatures of the text (sigs), and next_text, next_sigs of the next row by ascending
    doc_id; the last row's next is the first. Rows that share an id follow each other by the hash of their text and
    then the text; null ids come first.

    Rows are placed in blocks by approximate quantiles of the ids, and between two quantiles by even steps, so a table
    of any size and any spread of ids is many small windows; an id with a large share of the rows (and the null id) is
    split by the hash of its texts. Only the first row of each block crosses to the block before it: there are at most
    1,024 * (256 + sub_blocks) blocks however large the table. Only texts are shuffled, signatures are made where the
    rows stand in order."""
    shares = [k / 1024 for k in range(1, 1024)]
    size = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx(F.col("doc_id").cast("long"), shares, 20_000).alias("at")).first()
    at = list(size["at"] or [])
    hot = sorted(v for v, c in Counter(at).items() if c > 1) if size["n"] >= 8 * 1024 else []
    sub_blocks = min(max(size["n"] // (1024 * 256), 1), sub_blocks)
    at = sorted({*at[::max(1, 1024 * 256 // max(size["n"], 1))], *hot})
    placed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_block", _block(F.col("doc_id"), F.col("_hash"), at, hot, sub_blocks))

    first = F.min(F.struct("doc_id", "_hash", "text")).alias("_first")
    heads = written(placed.groupBy("_block").agg(first).select("_block", "_first.text")
                    .withColumn("sigs", spot_signatures(F.col("text"))), "heads")
    least = heads.agg(F.min("_block")).first()[0]
    order = heads.select("_block", F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.lit(least)).alias("_head"))
    crossing = (order.join(heads.withColumnsRenamed({"_block": "_head", "text": "_text", "sigs": "_sigs"}), "_head")
                .select("_block", "_text", "_sigs"))
    inside = Window.partitionBy("_block").orderBy("doc_id", "_hash", "text")
    led = (placed.withColumn("next_text", F.lead("text").over(inside)).withColumn("sigs", spot_signatures(F.col("text")))
           .withColumn("next_sigs", F.lead("sigs").over(inside)))
    return (led.join(crossing, "_block")
            .select("doc_id", "text", "sigs", F.coalesce("next_text", "_text").alias("next_text"),
                    F.coalesce("next_sigs", "_sigs").alias("next_sigs")))


def _block(doc_id, text_hash, at: list[int], hot: list[int], sub_blocks: int):
    """Number of a row's block; ascending with (doc_id, hash of the text), null ids first."""
    by_hash = F.shiftright(text_hash, 56) + 128                        # 0 to 255, in the order of the hash
    if not at:
        return F.when(doc_id.isNull(), by_hash - 1024).otherwise(F.lit(0)).cast("long")
    bounds = F.lit(at)
    here = F.size(F.filter(bounds, lambda b: b <= doc_id))
    low, high = F.get(bounds, here - 1).cast("double"), F.get(bounds, here).cast("double")
    step = F.coalesce(F.floor((doc_id.cast("double") - low) / (high - low) * sub_blocks), F.lit(0))
    among = F.least(F.greatest(step, F.lit(0)), F.lit(sub_blocks - 1)) + 256
    inner = F.when(doc_id.isin(hot), by_hash).otherwise(among) if hot else among
    return F.when(doc_id.isNull(), by_hash - 1024).otherwise(here * (256 + sub_blocks) + inner).cast("long")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text (second half replaced by the start of the next document),
    and the likeness to the edited text and to the next document."""
    docs = documents.select("doc_id", as_text(F.col("text")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    both = pairs.withColumn("edited_sigs", spot_signatures(F.col("edited")))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("sigs")).alias("fingerprint"),
                       fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar_pairs(signed: DataFrame, at_least: float = 0.75) -> DataFrame:
    """Pairs (doc_id, other_id, likeness) of different signature sets at or above ``at_least``.

    Equal sets are one class with its least id as representative; pairs are given between representatives.
    A set meets the others in its own length partition and in the next, through its rarest signatures: two sets
    that reach the likeness share one of the first n - ceil(t n) + 1 in order of frequency."""
    import math
    step = math.log(1 / at_least)
    reps = signed.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    reps = reps.withColumn("part", F.floor(F.log(F.size("sigs").cast("double")) / step + 1e-9))
    rows = reps.select("doc_id", F.explode("sigs").alias("sig"))
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(often, "sig").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "sig")))
    short = (ranked.join(reps.select("doc_id", "part", F.size("sigs").alias("n")), "doc_id")
             .filter(F.col("place") <= F.col("n") - F.ceil(F.lit(at_least) * F.col("n") - 1e-9) + 1))
    left = short.select(F.col("doc_id").alias("a"), "sig", F.col("part"), F.col("n").alias("na"))
    right = short.select(F.col("doc_id").alias("b"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"),
                         F.col("n").alias("nb"), F.col("part").alias("own"))
    meets = (left.join(right, ["sig", "part"])
             .filter((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
             .filter(F.least("na", "nb") >= F.lit(at_least) * F.greatest("na", "nb") - 1e-9)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = reps.select("doc_id", "sigs")
    full = (meets.join(sets.withColumnsRenamed({"doc_id": "a", "sigs": "sa"}), "a")
            .join(sets.withColumnsRenamed({"doc_id": "b", "sigs": "sb"}), "b"))
    return (full.select(F.col("a").alias("doc_id"), F.col("b").alias("other_id"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
            .filter(F.col("likeness") >= at_least))
