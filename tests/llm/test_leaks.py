"""Decontamination against all alignments; short items, scripts without blanks, odd ids."""

import re

import pytest

import corpus_pipeline
from supportkb.llm import decontam
from tests.llm.samples import SF, documents, table, texts


def tokens(text):
    spaced = re.sub(r"([぀-ヿ一-鿿])", r" \1 ", (text or "").lower())
    return [w for w in re.split(r"[\W_]+", spaced) if w]


def alignments(doc, item, least=9.0, span=decontam.SPAN):
    """Best (score, first, last, matches) over all diagonals, counting the places that some mask's hit covers."""
    if len(item) < span:
        found = [p for p in range(len(doc) - len(item) + 1) if len(item) >= 3 and doc[p:p + len(item)] == item]
        return (float(len(item)), found[0], found[0] + len(item) - 1, len(item)) if found else None
    at, best = {}, None
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    for shift in {p - i for p, w in enumerate(doc) for i in at.get(w, [])}:
        agree = {p for p in range(len(doc)) if 0 <= p - shift < len(item) and doc[p] == item[p - shift]}
        seen = set()
        for p in range(len(doc) - span + 1):
            inside = 0 <= p - shift <= len(item) - span
            if inside and any(all(p + k in agree for k in range(span) if m[k] == "1") for m in decontam.MASKS):
                seen.update(q for q in range(p, p + span) if q in agree)
        places = sorted(seen)
        for a in range(len(places)):
            for b in range(a, len(places)):
                n = b - a + 1
                score = n - (places[b] - places[a] + 1 - n)
                if score >= min(least, 0.8 * len(item)):
                    key = (score, -places[a], places[b], n)
                    best = max(best, key) if best else key
    return (float(best[0]), -best[1], best[2], best[3]) if best else None


SHORT = "the quokka sings Baroque"
SENTENCE = "吾輩は猫である名前はまだ無い"


@pytest.mark.parametrize("limit", [500_000, 0])
def test_equals_all_alignments(spark, limit):
    bench = [(i, t) for i, t in table("benchmark")][:6] + [(900, SHORT), (901, SENTENCE), (902, "solo"), (903, None), (904, SHORT)]
    first = bench[0][1].split()
    holds = [(20_000, f"So {SHORT.upper()}, again {SHORT}!"), (20_001, f"見よ。{SENTENCE}。"), (20_002, "solo"), (20_003, "the quokka sings"),
             (20_004, " ".join("x" if k % 6 == 5 else w for k, w in enumerate(first))), (20_005, None), (20_006, "、。 !")]
    leaking = [(d, t) for d, t in documents() if any(x.split()[0] in (t or "") for _, x in bench[:6])][:40]
    docs = leaking + holds
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.first_token, r.last_token, r.n_match)
           for r in decontam.contaminated(texts(spark, docs), items, broadcast_rows=limit).collect()}
    want = {(d, i): a for d, t in docs for i, x in bench for a in [alignments(tokens(t), tokens(x))] if a}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][3] == want[k][3] for k in got if k[0] >= 20_000)
    assert {(20_000, 900), (20_000, 904), (20_001, 901), (20_004, bench[0][0])} <= set(got)
    assert not {d for d, _ in got} & {20_002, 20_003, 20_005, 20_006}


def test_rows_without_id_are_judged_alone(spark):
    passage = table("benchmark")[0][1]
    docs = texts(spark, [(None, passage), (None, "a clean text of its own"), (7, passage), (7, "clean under the same id"), (None, None)])
    left = corpus_pipeline.drop_leaks(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in left) == [
        (False, "clean under the same id"), (True, ""), (True, "a clean text of its own")]
