"""Text rules on literal rows, checked against Python's own Unicode behaviour."""

import random
import re

from pyspark.sql import functions as F

from supportkb.functions import text as X
from supportkb.functions.fuzzy import partial_ratio, score_batch

SAMPLES = ["", " a B ", "電源　コード 長", "x​y", "a\x1cb\x1fc\x85d e", "﻿Z \t\r\n", "ÀÉ ß", "😀 加湿器 V10😀"]


def _column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_norm_strip_lines(spark):
    assert _column(spark, SAMPLES, X.norm) == [re.sub(r"\s+", "", s).lower() for s in SAMPLES]
    assert _column(spark, SAMPLES, X.strip) == [s.strip() for s in SAMPLES]
    lines = ["a\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i"]
    assert _column(spark, lines, X.split_lines) == [s.splitlines() for s in lines]


def test_tokenize_cjk(spark):
    expected = {"電源コード長 1.8M": ["1.8m", "電源", "源コ", "コー", "ード", "ド長", "電源コード長"],
                "V10 ABC": ["v10abc"], "": [], "a電b源c": ["a", "b", "c", "電源", "電源"],
                "😀加湿😀": ["😀加", "加湿", "湿😀", "😀加湿😀"]}
    assert _column(spark, list(expected), X.tokenize_cjk) == list(expected.values())


def test_redact_and_fingerprint(spark):
    # Long numbers are masked before order numbers, so an all-digit order number becomes [number].
    values = ["a.b+c@x-y.co.jp まで", "123456789 1234567890 x12345678901", "注文番号：ABC-12345 と 订单号 998877665544",
              "a@b.cc-x@y.zz", "名前@例え.com"]
    assert _column(spark, values, X.redact_pii) == [
        "[email] まで", "123456789 [number] x[number]", "注文番号：[redacted] と 订单号 [number]", "[email][email]", "[email]"]
    import hashlib
    got = _column(spark, ["é"], lambda t: X.fingerprint(t, F.lit(None), t))
    assert got == [hashlib.sha256("é\n\né".encode()).hexdigest()]


def test_cells_names_times_json(spark):
    assert _column(spark, ['"a ""b"""', '"', 'x"y', ' "q" '], X.unquote_cell) == ['a "b"', '"', 'x"y', "q"]
    assert _column(spark, ["a/b:c?.", "...", "  "], X.safe_name) == ["a_b_c_", "Sheet", "Sheet"]
    iso = spark.sql("SELECT 1700000000.5D AS s, CAST(NULL AS DOUBLE) AS n, -0.25D AS m").select(
        X.epoch_to_iso(F.col("s")), X.epoch_to_iso(F.col("n")), X.epoch_to_iso(F.col("m"))).first()
    assert tuple(iso) == ("2023-11-14T22:13:20.500000Z", None, "1969-12-31T23:59:59.750000Z")
    assert _column(spark, ['"a\\nb"', "plain", '"broken'], X.json_text) == ["a\nb", "plain", '"broken']


def test_snippet(spark):
    blob = "x" * 100 + "term" + "y" * 500
    expect = blob[20:104 + 240]
    assert _column(spark, [blob], lambda t: X.snippet(t, F.instr(t, F.lit("term")), F.lit("term"))) == [expect]
    assert _column(spark, ["termz"], lambda t: X.snippet(t, F.lit(1), F.lit("term"))) == ["termz"]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        prev = row
    return prev[-1]


def brute_partial(a, b):
    def one(short, long):
        m = len(short)
        wins = [long[max(s, 0):s + m] for s in range(-(m - 1), len(long))]
        return max(200 * _lcs(short, w) / (m + len(w)) for w in wins)

    a, b = sorted((a, b), key=len)
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def test_partial_ratio_against_brute_force():
    import pandas as pd
    random.seed(7)
    for n in range(150):
        alphabet = random.choice(["ab", "abcdefgh", "加湿器充電abc"])
        word = lambda k: "".join(random.choice(alphabet) for _ in range(k))
        a, b = word(random.choice([1, 2, 8, 9, 17, 33, 64, 65, 70])), word(random.randint(1, 80))
        assert abs(partial_ratio(a, b) - brute_partial(a, b)) < 1e-9, (a, b)
    texts = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 60))) for _ in range(30)]
    pack = ["".join(random.choice("abcdefghij") for _ in range(k)) for k in (2, 5, 9, 20, 70)]
    got = score_batch(pd.Series(texts), pd.Series([pack] * 30), 62.0)
    for t, found in zip(texts, got):
        want = {p: round(brute_partial(p, t), 6) for p in pack}
        assert {d["term"]: round(d["score"], 6) for d in found} == {p: s for p, s in want.items() if s >= 62}
