"""Substring joins without comparing every text with every term.

Two exact ways, chosen by the measured size of the terms:

* A bounded term set is broadcast and found in one pass over each text (Aho-Corasick in an Arrow
  UDF). Texts stay in their partitions; cost does not depend on the number of terms.
* Beyond that, an equi-join on anchors. A term inside a text shares every n-gram with it, so one
  n-gram per term is enough to find all candidates, and ``instr`` verifies. The anchor length
  follows the term length (8, 4, 2 or 1), and the anchor is the term's n-gram with the least hash,
  which spreads terms with a common beginning. Only grams and keys are shuffled, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportkb.functions.matching import ahocorasick, group_finder, term_finder
from supportkb.functions.text import ngrams
from supportkb.sizing import is_small, measure

MAX_FINDER_TERMS = 100_000
MAX_FINDER_CHARS = 4 * 1024 * 1024
TIERS = (8, 4, 2, 1)
CHUNK = 16_384


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, pos: str = "pos",
                  key: list[str] | None = None, route: str | None = None) -> DataFrame:
    """Inner join of ``texts`` and ``terms`` on "text contains term", adding the 1-based position
    of the first occurrence. Empty terms match nothing.

    ``key`` names the columns that identify a text (default: all but the text). Term columns must
    not clash with text columns. ``route`` forces "finder" or "grams", for tests."""
    terms = terms.filter(F.char_length(F.col(term)) > 0)
    size = measure(terms)
    fits = is_small(size, MAX_FINDER_TERMS, MAX_FINDER_CHARS) and ahocorasick is not None
    if route == "finder" or (route is None and fits):
        return _by_finder(texts, text, terms, term, pos)
    return _by_grams(texts, text, terms, term, pos, key or [c for c in texts.columns if c != text])


def contains_any_join(texts: DataFrame, text: str, words: DataFrame, word: str, group: str,
                      key: list[str] | None = None, route: str | None = None) -> DataFrame:
    """Distinct (text row, group) pairs where the text contains any word of the group. Text rows must
    be distinct. With a bounded word set the groups of a text are united inside its row, so several
    words of a group hitting one text need no distinct over a shuffle."""
    words = words.select(word, group).filter(F.char_length(F.col(word)) > 0)
    size = measure(words)
    fits = is_small(size, MAX_FINDER_TERMS, MAX_FINDER_CHARS) and ahocorasick is not None
    if route == "finder" or (route is None and fits):
        pairs = [(r[0], r[1]) for r in words.distinct().collect()]  # bounded by MAX_FINDER_*
        find = group_finder(texts.sparkSession, pairs)
        return texts.withColumn(group, F.explode(find(F.col(text)))).select(*texts.columns, group)
    hits = _by_grams(texts, text, words.select(word).distinct(), word, "_pos", key or [c for c in texts.columns if c != text])
    return hits.join(words, word).select(*texts.columns, group).distinct()


def contains_groups(texts: DataFrame, text: str, words: DataFrame, word: str, group: str,
                    key: list[str], route: str | None = None) -> DataFrame:
    """The texts' ``key`` with the array of distinct groups any of whose words the text contains, texts without any left out. With a
    bounded word set nothing is shuffled and a key that comes twice stays two rows."""
    words = words.select(word, group).filter(F.char_length(F.col(word)) > 0)
    fits = is_small(measure(words), MAX_FINDER_TERMS, MAX_FINDER_CHARS) and ahocorasick is not None
    if route == "finder" or (route is None and fits):
        pairs = [(r[0], r[1]) for r in words.distinct().collect()]  # bounded by MAX_FINDER_*
        find = group_finder(texts.sparkSession, pairs)
        return texts.select(*key, find(F.col(text)).alias(group)).filter(F.size(group) > 0)
    hits = _by_grams(texts, text, words.select(word).distinct(), word, "_pos", key)
    return hits.join(words, word).groupBy(*key).agg(F.collect_set(group).alias(group))


def contains_words(texts: DataFrame, text: str, words: DataFrame, word: str, key: list[str], found: str,
                   route: str | None = None) -> DataFrame:
    """The texts' ``key`` with the sorted array of the distinct words the text contains, texts without any left out. With a
    bounded word set nothing is shuffled and a key that comes twice stays two rows."""
    words = words.select(word).filter(F.char_length(F.col(word)) > 0).distinct()
    fits = is_small(measure(words), MAX_FINDER_TERMS, MAX_FINDER_CHARS) and ahocorasick is not None
    if route == "finder" or (route is None and fits):
        find = term_finder(texts.sparkSession, [r[0] for r in words.collect()])  # bounded by MAX_FINDER_*
        terms = F.array_sort(F.transform(find(F.col(text)), lambda hit: hit["term"]))
        return texts.select(*key, terms.alias(found)).filter(F.size(found) > 0)
    hits = _by_grams(texts, text, words, word, "_pos", key)
    return hits.groupBy(*key).agg(F.array_sort(F.collect_set(word)).alias(found))


def _by_finder(texts: DataFrame, text: str, terms: DataFrame, term: str, pos: str) -> DataFrame:
    words = [r[0] for r in terms.select(term).distinct().collect()]  # bounded by MAX_FINDER_*
    find = term_finder(texts.sparkSession, words)
    hits = (texts.withColumn("_hit", F.explode(find(F.col(text))))
            .select(*texts.columns, F.col("_hit.term").alias(term), F.col("_hit.pos").alias(pos)))
    if terms.columns != [term]:
        hits = hits.join(F.broadcast(terms), term)
    return hits.select(*texts.columns, *terms.columns, pos)


def _tier(term: Column) -> Column:
    out = F.lit(TIERS[-1])
    for n in reversed(TIERS[:-1]):
        out = F.when(F.char_length(term) >= n, F.lit(n)).otherwise(out)
    return out


def _anchor(term: Column) -> Column:
    """struct(h, off, gram) of the term's least-hash gram; the first one on ties."""
    def least(n: int) -> Column:
        return F.array_min(F.transform(ngrams(term, n), lambda g, i: F.struct(
            F.xxhash64(g).alias("h"), i.alias("off"), g.alias("gram"))))

    out = least(TIERS[-1])
    for n in reversed(TIERS[:-1]):
        out = F.when(_tier(term) == n, least(n)).otherwise(out)
    return out


def _by_grams(texts: DataFrame, text: str, terms: DataFrame, term: str, pos: str, key: list[str]) -> DataFrame:
    """Texts longer than one chunk are cut for the gram scan only; a pair is kept in the one chunk
    that holds the anchor of the term's first occurrence, so none is lost or repeated."""
    anchored = (terms.withColumn("_a", _anchor(F.col(term)))
                .withColumn("_gram", F.col("_a.gram")).withColumn("_off", F.col("_a.off")).drop("_a"))
    t = F.col(text)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1)), F.lit(CHUNK))
    chunked = (texts.withColumn("_start", F.explode(starts))
               .withColumn("_chunk", F.when(F.char_length(t) <= CHUNK, t)
                           .otherwise(F.substr(t, F.col("_start"), F.lit(CHUNK + TIERS[0] - 1)))))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("_chunk"), n) for n in TIERS]))
    candidates = (chunked.select(*key, "_start", F.explode(grams).alias("_gram"))
                  .join(anchored, "_gram"))
    at = F.instr(t, F.col(term))
    anchor_at = at + F.col("_off")
    return (candidates.join(texts, key).withColumn(pos, at)
            .filter((F.col(pos) > 0) & (anchor_at >= F.col("_start")) & (anchor_at < F.col("_start") + CHUNK))
            .select(*texts.columns, *terms.columns, pos))
