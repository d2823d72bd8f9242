"""Many terms in one pass over a text: an Arrow UDF around an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the join falls back to n-grams
    ahocorasick = None

HITS = "array<struct<term: string, pos: int>>"


def matches(automaton, text: str) -> Iterator:
    """All (end, value) of the automaton in the text; an automaton without words can't be asked."""
    return automaton.iter(text) if len(automaton) else iter(())


def first_hits(automaton, text: str) -> list[tuple[str, int]]:
    """Each contained term with the 1-based position of its first occurrence."""
    found: dict[str, int] = {}
    for end, term in matches(automaton, text):
        if term not in found:
            found[term] = end - len(term) + 2
    return list(found.items())


def term_finder(spark: SparkSession, terms: list[str]) -> Callable[[Column], Column]:
    """A column function that finds the given terms. The caller has checked their total size; they
    are broadcast once and each task builds its automaton from them."""
    shared = spark.sparkContext.broadcast(terms)

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for term in shared.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([first_hits(automaton, t or "") for t in texts])

    return find


def group_finder(spark: SparkSession, words: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A column function giving the distinct groups any of whose words occur in the text, for
    (word, group) pairs whose total size the caller has checked."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        groups: dict[str, set[str]] = {}
        for word, group in shared.value:
            groups.setdefault(word, set()).add(group)
        automaton = ahocorasick.Automaton()
        for word, owners in groups.items():
            automaton.add_word(word, (word, owners))
        automaton.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                met = {word: owners for _, (word, owners) in matches(automaton, text or "")}
                out.append(sorted(set().union(*met.values())))
            yield pd.Series(out)

    return find


PIECE = 256


def expansion_finder(spark: SparkSession, synonyms: list[tuple[str, str, int | None]]) -> Callable[[Column], Column]:
    """A column function giving the expansions of the keys inside a text, then the keys of the expansions inside it, each once, in
    the order of its first place, without the text itself. ``synonyms`` are (key, expansion, ord) of a size the caller has checked."""
    shared = spark.sparkContext.broadcast(synonyms)
    at = lambda step, ord_: (step, ord_ is not None, ord_ or 0)

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        led: dict[str, dict[str, tuple]] = {}
        first: dict[str, tuple] = {}
        for key, _, ord_ in shared.value:
            if ord_ is not None:
                first[key] = min(first.get(key, at(2, ord_)), at(2, ord_))
        for key, expansion, ord_ in shared.value:
            for word, other, place in ((key, expansion, at(1, ord_)), (expansion, key, first.get(key, at(2, None)))):
                places = led.setdefault(word, {})
                places[other] = min(places.get(other, place), place)
        automaton = ahocorasick.Automaton()
        for word in led:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            for lo in range(0, len(texts), PIECE):      # the lists are long, so few go out at a time
                out = []
                for text in texts.iloc[lo:lo + PIECE]:
                    best: dict[str, tuple] = {}
                    for word in {word for _, word in matches(automaton, text or "")}:
                        for other, place in led[word].items():
                            if other not in best or place < best[other]:
                                best[other] = place
                    best.pop(text, None)
                    out.append(sorted(best, key=lambda term: (best[term], term)))
                yield pd.Series(out, dtype=object)

    return find
