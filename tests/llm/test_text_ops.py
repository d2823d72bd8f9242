"""SentencePiece rounds, HTML extraction and the language model."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from supportkb.llm import common, html_extract, interp_lm, piece_bpe
from tests.llm.samples import documents, fold, language_model, odd_rows, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def strings():
    rng = random.Random(3)
    letters = " ▁\n\tabcdefg....__   éèß中文字漢😀{}()=<>01́　\x00"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    out += [" " * n for n in range(70)] + ["a" * n for n in range(60)] + ["=-" * n for n in range(30)] + ["/" * n + "*" * m for n in range(9) for m in range(9)]
    return out + [t for _, t in documents()] + ["", "x" * 50_000, "<s> </s> <0x0A>"]


def test_ids_and_texts_equal_the_library(library):
    vocabulary = piece_bpe.Vocabulary(MODEL)
    encoder, decoder = piece_bpe.Encoder(vocabulary), piece_bpe.Decoder(vocabulary)
    every = strings()
    ids, offsets = encoder.encode(every, add_end=False)
    want = library.encode(every)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert [decoder.decode(i) for i in want] == [library.decode(i) for i in want]


def test_round_trip_of_rows(spark, library):
    rows = odd_rows()
    df = texts(spark, rows)
    got = piece_bpe.round_trip_digests(df, MODEL, with_ids=True).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got):
        ids = library.encode(text or "") + [2]
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = piece_bpe.decode(piece_bpe.encode(df, MODEL), MODEL).collect()
    assert [r.text for r in back] == [(t or "") for _, t in rows]
    assert piece_bpe.round_trip_digests(texts(spark, []), MODEL).count() == 0


PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>menu {n}</a></li></ul></nav><div class=\"ad\">buy {n}</div>"
        "<div id='cookie-notice'>we use cookies</div>{body}"
        "<section class='comments'><p>first! {n}</p></section><aside>side {n}</aside>"
        "<form><p>mail</p><input></form><footer>&copy; host {n}</footer></body></html>")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, dropped string")


def test_article_only(spark):
    body = "<!-- <p>no</p> --><article><h1>A &amp; B</h1><p><b>one\n  two<br><p>three &lt;x&gt; &#233;</p><ul><li>i<li>j</ul>tail</article>"
    rows = [(1, "http://h.example/1", PAGE.format(n=1, body=body)), (2, None, None), (3, "odd url", ""), (4, "http://h.example/4", "<p>open <b>text"),
            (1, "http://h.example/1", PAGE.format(n=1, body=body)), (5, "http://h.example/5", "<article><p>" + "long text " * 20_000)]
    got = html_extract.extract(pages(spark, [(*r, "x", "y", "z") for r in rows])).collect()
    by_id = {}
    for r in got:
        assert r.n_chars == len(r.text)
        by_id.setdefault(r.page_id, []).append(r.text)
    assert by_id[1] == ["A & B\none two\nthree <x> é\ni\nj\ntail"] * 2
    assert by_id[2] == by_id[3] == [""] and by_id[4] == ["open text"] and by_id[5] == [("long text " * 20_000).strip()]
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_repeated_branches_of_a_host_go(spark):
    """No article marks, no telling class names: only the style tree can tell the two boxes apart."""
    rng = random.Random(1)

    def words(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        own = words(30)
        rows.append((i, f"https://Site.example:80/{i}", f"<body><div class=box{{i}}><p>the same words on every page</p></div>"
                                                        f"<div class=main-text><p>{own}</p></div></body>"))
        want[i] = own
    rows.append((100, "http://other.example/", "<body><div class=box{i}><p>the same words on every page</p></div></body>"))
    want[100] = "the same words on every page"
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, [(*r, "x", "y", "z") for r in rows])).collect()}
    assert got == want


def scores(spark, rows):
    held = common.fold(F.col("doc_id"), 7) == 2
    return interp_lm.scores(texts(spark, rows), ~held).collect()


@pytest.mark.parametrize("chunk", [8 << 20, 20_000])
def test_counts_and_base_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(interp_lm, "RANGE_CHARS", 50_000)
    monkeypatch.setattr(interp_lm, "CHUNK", chunk)
    rows = documents()
    want, tokens, n = language_model(rows)
    for r in scores(spark, rows):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.score < 0
    held = [r for r in scores(spark, rows) if fold(r.doc_id, 7) == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_mixtures_and_scores_do_not_depend_on_chunks(spark, monkeypatch):
    rows = documents()
    one = {r.doc_id: r.score for r in scores(spark, rows)}
    monkeypatch.setattr(interp_lm, "CHUNK", 30_000)
    two = {r.doc_id: r.score for r in scores(spark, rows)}
    assert one == pytest.approx(two, rel=1e-9)
    weights = interp_lm.learn_weights([(1, -4, -40, 10, -10.0, -100.0), (3, -1000, -50, 5, 0.0, -60.0), (3, -2, -50, 5, -2.0, -60.0)], 1000)
    assert weights.sum(1) == pytest.approx(1.0)
    assert weights[1, 0] > 0.9


def test_odd_rows_of_the_language_model(spark):
    rows = odd_rows()
    got = scores(spark, rows)
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert scores(spark, []) == []
