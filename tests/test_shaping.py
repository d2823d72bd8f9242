"""Sheets, pages, chats, review loop and streams on literal rows."""

import json
import random

from pyspark.sql import functions as F

from supportkb import defaults as D
from supportkb.operators import catalog as K
from supportkb.operators import chat as C
from supportkb.operators import gaps as G
from supportkb.operators import learning as L
from supportkb.operators import ordered as O
from supportkb.operators import pages as P
from supportkb.operators import search as Q
from supportkb.operators import sheets as SH
from supportkb.operators import vision as V
from supportkb.sources import files as S
from supportkb.sources import sinks
from supportkb.streaming import flows


def brute_rows(text):
    """Quote-aware splitting, one character at a time."""
    rows, cells, buf, inside = [], [], "", False
    for ch in text:
        if ch == '"':
            inside = not inside
        if ch in "\t\n" and not inside:
            cells.append(buf)
            buf = ""
            if ch == "\n":
                rows.append(cells)
                cells = []
        else:
            buf += ch
    return rows + [cells + [buf]]


def test_quoted_rows(spark):
    random.seed(2)
    texts = ["".join(random.choice('ab"\t\n') for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(SH.split_quoted_rows(F.col("t"))).collect()]
    assert got == [brute_rows(t) for t in texts]


def test_faq_items(spark):
    sheets = [("headed", 'note\t\n日期\t问题\t回复模板\t图\n2026-08-09\t"无法\t充\n电"\t別の"USB"\tID_1\nID_9\t\n\t=DISPIMG(1)\t\tID_2\n'),
              ("plain", "2026/8/9\tq\ta\tb\nonly\n"), ("late", "x\n" * 10 + "日期\t问题\n")]
    df = spark.createDataFrame(sheets, "sheet string, text string")
    got = {}
    for r in SH.faq_items(df).orderBy("sheet", "item_ord").collect():
        got.setdefault(r["sheet"], []).append((r["date"], r["question"], r["answer"], r["template"], r["media"]))
    # The row before the header stays; rows of media references only are dropped.
    assert got["headed"] == [("note", "", "", "", []), ("2026-08-09", "无法 充 电", "", '別の"USB"', ["ID_1"])]
    assert got["plain"] == [("2026/8/9", "q", "a | b", "", []), ("", "only", "", "", [])]
    assert len(got["late"]) == 10       # the header is found wherever it stands
    assert SH.faq_items(df, header_within=10).filter("sheet = 'late'").count() == 11


def test_cells_to_sheet_text(spark):
    cells = [("S", 1, "A1", "s", "0"), ("S", 1, "C1", "inlineStr", "x\ty"), ("S", 2, "AA2", "b", "0"), ("S", 3, "A3", "", None),
             ("S", 4, "B4", "s", "9"), ("S", 5, "A5", "", "1.5"), ("S", 5, "B5", "", ""), ("E", 1, "A1", "", "")]
    strings = spark.createDataFrame([(0, "共有")], "idx int, text string")
    rows = SH.cells_to_rows(spark.createDataFrame(cells, "sheet string, row int, ref string, t string, v string"), strings)
    got = {r["row"]: r["line"] for r in rows.filter("sheet = 'S'").collect()}
    # Rows of empty cells (a missing value, an unknown shared string) stay as empty lines.
    assert got == {1: "共有\t\tx y", 2: "\t" * 26 + "FALSE", 3: "", 4: "", 5: "1.5"}
    texts = [tuple(r) for r in SH.sheet_texts(rows).collect()]
    assert texts == [("S", "共有\t\tx y\n" + "\t" * 26 + "FALSE\n\n\n1.5\n")]


def test_one_source_with_most_rows(spark):
    """A third and more of all rows under one name: results stay whole and in order."""
    rows = spark.range(3000).select(
        F.lit("OCR").alias("layer"), F.col("id").alias("row_ord"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.lit("").alias("page"), F.concat(F.lit("加湿器"), F.col("id").cast("string")).alias("blob"), F.lit("").alias("ref"))
    q = spark.createDataFrame([(1, "", "加湿器"), (2, "HOT", "加湿器")], "query_id long, product string, q string")
    terms = Q.plain_terms(q)
    hits = Q.search_exact(rows, terms, q)
    assert {r["query_id"]: r["n"] for r in hits.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 3000, 2: 2000}
    ranked = Q.rank_exact_hits(hits, rows, terms, q).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["name"], r["row_ord"]) for r in ranked] == [
        (1, "n0", 0), (1, "hot", 1), (1, "n3", 3), (1, "n6", 6), (1, "n9", 9), (2, "hot", 1)]


def test_pages_segments_markers(spark):
    m = spark.createDataFrame([("a", "pre \n===== PAGE 1 =====\n x \n===== PAGE 3 =====\n\n===== PAGE 5 =====\nz"),
                               ("b", " whole "), ("c", "===== PAGE 2 =====\nq")], "base string, text string")
    pages = [tuple(r) for r in P.split_pages(m).orderBy("base", "place").collect()]
    assert pages == [("a", 0, 1, "pre"), ("a", 1, 1, "x"), ("a", 2, 3, ""), ("a", 3, 5, "z"), ("b", 0, 1, " whole "), ("c", 0, 2, "q")]
    segs = [(r["base"], r["k"], r["marker"]) for r in P.split_segments(m).orderBy("base", "k").collect()]
    assert segs == [("a", 1, "1"), ("a", 2, "3"), ("a", 3, "5"), ("b", 1, ""), ("c", 1, "2")]
    fixed = {r["base"]: (r["changed"], r["text"]) for r in P.renumber_page_markers(m).collect()}
    assert fixed["a"][0] and "PAGE 2" in fixed["a"][1] and "PAGE 5" not in fixed["a"][1]
    assert fixed["c"] == (False, "===== PAGE 2 =====\nq")


def test_page_weakness_and_params(spark):
    pad = "本文" * 20
    body = spark.createDataFrame([("m", "短い"), ("m", f"仕様 品番 {pad}"), ("m", f"仕様 品番 100W {pad}"), ("m", f"仕様 品番 100Wの {pad}"),
                                  ("规格书", pad), ("m", pad)], "base string, body string")
    got = [r[0] for r in body.select(P.page_weakness(F.col("base"), F.col("body"))).collect()]
    assert got == ["empty_ocr len=2", "spec_table_missing_values", "", "spec_table_missing_values", "spec_file_page_no_values", ""]
    lines = spark.createDataFrame([("電源 コード 1.8M\nなし\n電源コード1.8m\n重量 2kg",)], "t string")
    assert lines.select(P.param_lines(F.col("t"))).first()[0] == "電源コード1.8m 重量2kg"


def test_alignment_keeps_leftovers(spark):
    segs = P.split_segments(spark.createDataFrame([("a", "===== PAGE 1 =====\nx\n===== PAGE 2 =====\ny"), ("b", "t")], "base string, text string"))
    imgs = spark.createDataFrame([("a", 7, "a7"), ("b", 1, "b1"), ("b", 2500, "b2"), ("c", 1, "c1")], "base string, num int, image_rel string")
    al = P.align_segments_images(segs, imgs)
    got = sorted((r["base"], r["k"], r["page_seq"], r["image_rel"], r["matched"]) for r in al.collect())
    assert got == [("a", 1, 7, "a7", True), ("a", 2, 2, "", False), ("b", 1, 1, "b1", True), ("b", 2, 2500, "b2", False), ("c", 1, 1, "c1", False)]
    total = P.image_alignment_summary(al, spark.createDataFrame([("odd",)], "x string")).first()
    assert tuple(total) == (3, 5, 5, 2, 3, 1)


def test_payload_shapes(spark):
    tree = {"id": "t", "current_node": "c", "mapping": {
        "a": {"parent": "c", "message": {"author": {"role": "user"}, "content": {"parts": ["one", {"text": "more"}]}}},
        "b": {"parent": "a", "message": {"role": "assistant", "content": [{"value": "two"}]}},
        "c": {"parent": "b", "message": {"author": {"role": "tool"}, "content": "x"}}}}
    leafless = {"id": "u", "mapping": {"r": {"message": {"role": "user", "content": "q"}}, "s": {"parent": "r", "message": {"role": "assistant", "content": "a"}}}}
    files = [("1", json.dumps([{"id": "l", "linear_conversation": [{"author": {"role": "User"}, "content": {"content_type": "text", "text": "hi"}}]}])),
             ("2", json.dumps({"data": [{"title": "T", "create_time": 1.5, "messages": [{"role": "user", "content": "m"}, {"role": "system", "content": "s"}]}]})),
             ("3", json.dumps(json.dumps(tree))), ("4", "not json"), ("5", json.dumps(leafless))]
    p = C.payload_header(C.scan_chat_exports(spark.createDataFrame(files, "folder string, text string")), "folder")
    got = {r["folder"]: (r["id"], [tuple(m) for m in r["m"]]) for r in p.select("folder", "id", C.extract_messages(F.col("payload")).alias("m")).collect()}
    assert got["1"] == ("l", [("user", "hi")])
    assert got["2"][0].startswith("imp_") and got["2"][1] == [("user", "m")]
    # c → b → a → c is a cycle: the walk ends where it meets c again.
    assert got["3"] == ("t", [("user", "one more"), ("assistant", "two")])
    assert got["5"] == ("u", [("user", "q"), ("assistant", "a")])
    assert "4" not in got


def test_relevance_counts_repeated_words(spark):
    convs = spark.createDataFrame([("1", "t", [("user", "加湿器")]), ("2", "t", [("user", "菜谱 旅游")]), ("3", "t", [("user", "你好")]),
                                   ("4", "t", [("user", "菜谱 旅游 加湿器")])], f"id string, title string, messages {C.MESSAGES}")
    got = {r["id"]: (r["relevance"], r["reason"]) for r in C.classify_relevance(convs).collect()}
    assert got == {"1": (1, "work:加湿器,加湿器"), "2": (0, "irrelevant:菜谱,旅游"), "3": (1, "unclear:no_strong_signal"), "4": (1, "work:加湿器,加湿器")}


def test_reply_pairs(spark):
    msgs = [("user", "q\t1"), ("assistant", "お客様\nへ"), ("assistant", "新品"), ("user", " "), ("assistant", "返金いたします"), ("user", "q2"), ("assistant", "plain")]
    convs = spark.createDataFrame([("1", "t", msgs)], f"id string, title string, messages {C.MESSAGES}")
    assert [(r["question"], r["answer"]) for r in C.reply_pairs(convs).collect()] == [("q 1", "お客様 へ")]


def test_upsert_twice_is_once_and_aba(spark):
    state = spark.createDataFrame([("x", "A", "old"), ("y", "A", "keep")], "id string, update_time string, payload string")
    batch = spark.createDataFrame([("x", "A", "same", 0), ("x", "B", "b", 1), ("x", "A", "back", 200_000), ("z", "A", "new", 3)], "id string, update_time string, payload string, ord long")
    once = C.upsert_conversations(state, batch, "ord")
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("x", "A", "back"), ("y", "A", "keep"), ("z", "A", "new")]
    last = batch.filter("ord >= 3")
    assert sorted(tuple(r) for r in C.upsert_conversations(once, last, "ord").collect()) == rows
    assert tuple(C.import_counts(C.import_decisions(state, batch, "ord")).first()) == (3, 1)


def test_review_loop(spark):
    texts = "product string, issue string, chinese_logic string, japanese_reply string"
    drafts = spark.createDataFrame([("ID-1", "d", 1, 1, "测试产品", "无法充电", "换线复测", "mail a@b.co"), ("ID-2", "d", 2, 2, "测试产品", "无法充电", "换线复测", "mail c@d.co"),
                                    ("ID-3", "d", 3, 3, "p", "i", "", "r"), ("id-1", "e", 9, 4, "dup", "dup", "", "dup")],
                                   f"candidate_id string, device_id string, created_at int, ord int, {texts}")
    cand = L.new_candidates(drafts.withColumn("value", F.lit("high")))
    ev = lambda rows: spark.createDataFrame(rows, "candidate_id string, created_at int, action string, ord int")
    none = spark.createDataFrame([], "candidate_id string, created_at int, action string, ord int")
    assert L.approved_cases(cand, none).count() == 0
    both = ev([("id-1", 5, "Approve", 1), ("ID-2", 5, "approve", 2), ("ID-3", 5, "approve", 3), ("ID-3", 6, "revoke", 4), ("ID-3", 6, "approve", 5)])
    got = L.approved_cases(cand, both).collect()
    # Redaction makes the first two equal; the third was revoked, and its equal-time approve came later.
    assert [(r["candidate_id"], r["name"]) for r in got] == [("ID-1", "测试产品|ID-1")]
    assert got[0]["blob"] == "测试产品无法充电换线复测mail[email]"
    assert L.pending_candidates(cand, ev([("id-1", 5, "reject", 1)])).count() == 2
    asked = spark.createDataFrame([("id-2",), ("nope",)], "candidate_id string")
    assert {(r[0], r[1]) for r in L.apply_decisions(asked, cand, "Approve").collect()} == {("id-2", "approve"), ("nope", "NOT_FOUND")}


def test_miss_counter(spark):
    acts = ["record", "record", "record", "acknowledge", "record", "reset", "record", "update-done"]
    df = spark.createDataFrame([("p", i, i, a) for i, a in enumerate(acts)], "product string, ord long, ts long, action string")
    got = [(r["records"], r["reminder_due"], r["cycles"], r["last_reminder"]) for r in
           G.miss_cycles(df, ["product"], ["ord"], F.floor(F.col("ord") / 2)).orderBy("ord").collect()]
    assert got == [(1, False, 0, None), (2, False, 0, None), (3, True, 0, None), (0, False, 1, 3), (1, False, 1, 3), (0, False, 1, None), (1, False, 1, None), (0, False, 2, 7)]


def test_running_values_do_not_depend_on_blocks(spark):
    random.seed(4)
    rows = [(random.choice("aab"), i, random.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for size in (1, 7, 1000):
        s = O.running_sums(df, ["k"], F.floor(F.col("i") / size), ["i"], total=F.coalesce("v", F.lit(0)))
        s = O.running_last(s, ["k"], F.floor(F.col("i") / size), ["i"], "before", F.col("v"), inclusive=False)
        total, last = {}, {}
        for r in s.orderBy("i").collect():
            total[r["k"]] = total.get(r["k"], 0) + (r["v"] or 0)
            assert (r["total"], r["before"]) == (total[r["k"]], last.get(r["k"]))
            last[r["k"]] = r["v"] if r["v"] is not None else last.get(r["k"])


def test_keywords_and_aliases(spark):
    s = spark.createDataFrame([("switch手柄（内部）",), ("XD-1586FB 吸尘器",), ("DS-100熨斗",)], "sheet string")
    kw = {r[0]: r[1] for r in s.select("sheet", K.sheet_keywords(F.col("sheet"))).collect()}
    assert kw["switch手柄（内部）"] == ["switch手柄", "switch"]
    assert kw["XD-1586FB 吸尘器"] == ["1586FB 吸尘器", "XD-1586FB", "XD"]
    aliases = spark.createDataFrame(D.alias_rows(), "key string, alias string, ord int")
    got = {r["sheet"] for r in K.alias_join(s, aliases).collect()}
    assert got == {"switch手柄（内部）", "DS-100熨斗"}
    local = spark.createDataFrame([("DS-100熨斗", "own", 0), ("DS-100熨斗", " ", 1)], "key string, alias string, ord int")
    merged = K.merge_aliases(aliases, local)
    assert [r["alias"] for r in merged.filter("key = 'ds-100熨斗'").collect()] == ["own"]


def test_shards_partition_the_jobs(spark):
    jobs = spark.createDataFrame([("manual", f"i{n:03d}") for n in range(50)], "source string, image_rel string")
    got = sorted((r["image_rel"], r["shard"]) for r in V.shard_jobs(jobs, 3).collect())
    assert got == [(f"i{n:03d}", n % 3) for n in range(50)]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("﻿x\ty\n", encoding="utf-8")
    (tmp_path / "t" / "_capture_log.txt").write_text("log", encoding="utf-8")
    (tmp_path / "t" / "i.tsv").write_text("file\tpage\ttext\nm\t1\ta\tb\nshort\n", encoding="utf-8")
    assert [tuple(r) for r in S.scan_text_files(spark, str(tmp_path / "t")).collect()] == [("a", "a.txt", "x\ty\n")]
    rows = S.read_index_tsv(spark, str(tmp_path / "t"), "params", True).collect()
    assert [(r["name"], r["page"], r["blob"]) for r in rows] == [("m", "1", "a\tb")]
    idx = spark.createDataFrame([("FAQ", 1, "n"), ("CHATGPT", 2, "n")], "layer string, row_ord long, name string")
    sinks.write_index(idx, str(tmp_path / "idx"))
    assert (tmp_path / "idx" / "layer=FAQ").is_dir()
    assert sinks.index_union(idx).count() == 1 and sinks.index_union(idx, allow_chat=True).count() == 2
    sinks.export_tsv(idx, str(tmp_path / "tsv"))
    sinks.export_jsonl(idx, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    assert sinks.index_health(idx.filter("layer = 'CHATGPT'")).first()["state"] == "EMPTY"
    assert S.asset_inventory(spark, str(tmp_path / "t"), ["tsv"]).count() == 1


def test_exports_by_line_and_without_meta_files(spark):
    lines = '{"id":"a","title":"x"}\n\n"{\\"id\\":\\"b\\"}"\n{"id":"c"}\n'
    files = spark.createDataFrame([("all.jsonl", lines), ("x.meta.json", '{"id":"m"}'), ("one.json", '[{"id":"d"}]')], "file string, text string")
    got = C.payload_header(C.scan_chat_exports(files, name="file"))
    assert sorted(r["id"] for r in got.select("id").collect()) == ["a", "b", "c", "d"]


def test_texts_are_whole_and_turns_need_not_be_dense(spark):
    turns = spark.createDataFrame([(1, 7001, "b"), (1, 7000, "a" * 9000), (2, 3, "c\td")], "conv_id long, turn long, text string")
    assert {r["conv_id"]: r["blob"] for r in C.opening_text(turns).collect()} == {1: "a" * 9000 + " b", 2: "c d"}
    assert C.opening_text(turns, 3).filter("conv_id = 1").first()["blob"] == "aaa"
    lines = "\n".join(f"長さ {i}" for i in range(401))
    text = spark.createDataFrame([(lines,)], "t string")
    assert len(text.select(P.param_lines(F.col("t"))).first()[0].split(" ")) == 401


def test_existing_items_of_a_sheet_come_first(spark):
    hits = spark.createDataFrame([(1, "FAQ", "s", i, "t") for i in range(6)] + [(1, "FAQ", "none", i, "t") for i in range(5)],
                                 "query_id long, layer string, name string, row_ord long, term string")
    items = spark.createDataFrame([("s", i, f"q{i}", f"a{i}", "") for i in (3, 4, 5)], "sheet string, item_ord long, question string, answer string, template string")
    rows = spark.createDataFrame([("FAQ", i, n, "", f"blob{i} t", "") for i in range(6) for n in ("s",)],
                                 "layer string, row_ord long, name string, page string, blob string, ref string")
    got = {(r["sheet"], r["row_ord"]): (r["pick"], r["answer"]) for r in Q.enrich_faq_hits(hits, items, rows).collect()}
    assert {k: v for k, v in got.items() if k[0] == "s"} == {("s", 3): (1, "a3"), ("s", 4): (2, "a4"), ("s", 5): (3, "a5")}


def test_text_at_any_depth(spark):
    deep = {"content": {"parts": [{"content": {"text": [{"value": "deep"}]}}, {"text": "flat"}, ["a", ["b"]]]}, "role": "user"}
    marks = 'brackets ]}[{ "quoted" and a \\ at the end\\'
    nested = marks
    for i in range(50):
        nested = [nested, "x"] if i % 2 else {"text": nested}
    for message, want in ((deep, "deep flat a b"), ({"content": nested}, " ".join([marks] + ["x"] * 25)),
                          ({"content": [marks, []]}, marks + " "), ({"content": {}}, ""), ({}, ""), ({"content": 5}, "")):
        v = spark.createDataFrame([(json.dumps(message),)], "t string").select(F.parse_json("t").alias("v"))
        assert (v.select(C.message_text(F.col("v"))).first()[0] or "") == want


def test_walk_of_a_very_long_conversation(spark):
    n = 100_000
    node = lambda i: {"parent": f"n{i - 1}" if i else None, "message": {"role": "user" if i % 2 else "assistant", "content": f"t{i}"}}
    long = {"current_node": f"n{n - 1}", "mapping": {f"n{i}": node(i) for i in range(n)}}
    loop = {"mapping": {"a": {"parent": "c", "message": {"role": "user", "content": "A"}}, "b": {"parent": "a", "message": {"role": "user", "content": "B"}},
                        "c": {"parent": "b", "message": None}, "d": {"parent": "b", "message": {"role": "user", "content": "D"}}}}
    lost = {"current_node": "gone", "mapping": {"a": {"message": {"role": "user", "content": "A"}}}}
    both = {"messages": [{"role": "user", "content": "own"}], **lost}
    rows = [(i, json.dumps(p)) for i, p in enumerate((long, loop, lost, both, {}, {"mapping": {}}))]
    v = spark.createDataFrame(rows, "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = {r.i: [m.text for m in r.m] for r in v.select("i", C.extract_messages(F.col("v")).alias("m")).collect()}
    assert got[0] == [f"t{i}" for i in range(n)]
    assert (got[1], got[2], got[3], got[4], got[5]) == (["A", "B", "D"], [], ["own"], [], [])


def _counted(rows):
    out, n, cycles, last = {}, 0, 0, None
    for _, ord_, micros, action in sorted(rows, key=lambda r: (r[2], r[1])):
        if action == flows.RECORD:
            n += 1
        elif action in flows.ACKNOWLEDGE:
            n, cycles, last = 0, cycles + 1, micros
        else:
            n, last = 0, None
        out[ord_] = (n, n >= 3, cycles, last)
    return out


def test_miss_alerts_in_any_order_of_arrival(spark):
    """One busy product and a quiet one, shuffled over three triggers and many buckets of time; a late action is dropped."""
    from supportkb.plans.review import _in_turns
    rng = random.Random(8)
    kinds = [flows.RECORD, flows.RECORD, flows.RECORD, sorted(flows.ACKNOWLEDGE)[0], flows.RESET]
    busy = [("p", i, (i + 1) * 500_000, rng.choice(kinds)) for i in range(1500)]
    quiet = [("q", 5000 + i, (i + 1) * 90_000_000, rng.choice(kinds)) for i in range(8)]
    rows = busy + quiet
    rng.shuffle(rows)
    frame = lambda some: (spark.createDataFrame(some, "product string, ord long, micros long, action string")
                          .withColumn("ts", F.timestamp_micros("micros")))
    third = len(rows) // 3 + 1
    parts = [frame(rows[i:i + third]) for i in range(0, len(rows), third)]
    late = frame([("p", 9999, 10, flows.RECORD), ("z", 1, 4 * 86_400_000_000, flows.RECORD)])
    out = _in_turns(spark, [*parts, frame([("z", 0, 3 * 86_400_000_000, flows.RECORD)]), late],
                    lambda s: flows.miss_alerts(s, delay="1 day", bucket_ms=60_000), 86_400_000 * 3)
    got = out.collect()
    for product, some in (("p", busy), ("q", quiet)):
        assert {r.ord: (r.records, r.reminder_due, r.cycles, r.last_reminder) for r in got if r["product"] == product} == _counted(some)
