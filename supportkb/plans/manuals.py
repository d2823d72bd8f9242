"""Registered sheet, page and image queries on the driver tables, each with its DuckDB twin.

Manuals are documents with page markers between their lines; a document is one row, so building
and splitting them stays inside the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportkb.functions.text import strip
from supportkb.operators import pages as P
from supportkb.operators import sheets as SH
from supportkb.plans import tables as T

QUERIES, ORACLE = {}, {}

_NL = "chr(10)"
_SQL_BASE = "source || '-' || doc_id"
_SQL_LINES = f"""lines AS (SELECT {_SQL_BASE} AS base, doc_id, source, text, len(string_split(text, {_NL})) AS n_lines,
  unnest(string_split(text, {_NL})) AS l, generate_subscripts(string_split(text, {_NL}), 1) - 1 AS i FROM documents)"""
_SQL_PAGES = f"""pages_ AS (SELECT base, doc_id, source, row_number() OVER (PARTITION BY base ORDER BY i) - 1 AS place,
  CASE WHEN i = 0 THEN 1 ELSE i END AS page_seq,
  CASE WHEN n_lines = 1 THEN l ELSE {T.sql_strip('l')} END AS body
  FROM lines WHERE i > 0 OR n_lines = 1 OR {T.sql_strip('l')} <> '')"""


def _docs(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.withColumn("base", F.concat_ws("-", "source", F.col("doc_id").cast("string")))


def manuals(spark, sf_dir):
    """Every line after the first starts a page."""
    marked = F.transform(F.split("text", "\n"), lambda l, i: F.when(i == 0, l).otherwise(
        F.concat(F.lit("===== PAGE "), i.cast("string"), F.lit(" =====\n"), l)))
    return _docs(spark, sf_dir).select("base", "doc_id", "source", F.array_join(marked, "\n").alias("text"))


def pages(spark, sf_dir):
    return P.split_pages(manuals(spark, sf_dir))


def split_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("base", F.col("place").cast("long").alias("place"),
                                       F.col("page_seq").cast("long").alias("page_seq"), "body")


QUERIES["split_pages"] = split_pages
ORACLE["split_pages"] = f"WITH {_SQL_LINES}, {_SQL_PAGES} SELECT base, place, page_seq, body FROM pages_"


def manual_diagnostics(spark, sf_dir):
    d = P.manual_diagnostics(manuals(spark, sf_dir))
    return d.select("base", F.col("pages").cast("long").alias("pages"), F.col("norm_len").cast("long").alias("norm_len"))


QUERIES["manual_diagnostics"] = manual_diagnostics
ORACLE["manual_diagnostics"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES},
marks AS (SELECT base, sum(CASE WHEN i = 0 THEN 0 ELSE 14 + length(CAST(i AS VARCHAR)) END + length({T.sql_norm('l')})) AS norm_len
          FROM lines GROUP BY base)
SELECT base, count(*) AS pages, CAST(any_value(norm_len) AS BIGINT) AS norm_len FROM pages_ JOIN marks USING (base) GROUP BY base"""


def _marked_segments(spark, sf_dir, odd=True):
    """Non-blank trimmed lines; markers 1, 3, 5 ... (2, 4, 6 ... for every third document)."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda l: l != "")
    number = lambda i: F.when(F.col("doc_id") % 3 == 0, i * 2).otherwise(i * 2 - 1)
    marked = F.transform(lines, lambda l, i: F.when(i == 0, l).otherwise(
        F.concat(F.lit("===== PAGE "), number(i).cast("string"), F.lit(" =====\n"), l)))
    return _docs(spark, sf_dir).select("base", "doc_id", F.array_join(marked, "\n").alias("text"))


_SQL_SOLID = f"""solid AS (SELECT base, doc_id, {T.sql_strip('l')} AS l, row_number() OVER (PARTITION BY base ORDER BY i) - 1 AS i,
  count(*) OVER (PARTITION BY base) AS n FROM lines WHERE {T.sql_strip('l')} <> ''),
marks_ AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN i * 2 ELSE i * 2 - 1 END AS mark FROM solid)"""


def split_segments(spark, sf_dir):
    s = P.split_segments(_marked_segments(spark, sf_dir))
    return s.select("base", F.col("k").cast("long").alias("k"), "marker", "content")


QUERIES["split_segments"] = split_segments
ORACLE["split_segments"] = f"""WITH {_SQL_LINES}, {_SQL_SOLID}
SELECT base, i AS k, CAST(mark AS VARCHAR) AS marker,
  CASE WHEN i = 1 THEN lag(l) OVER (PARTITION BY base ORDER BY i) || {_NL} ELSE '' END || {_NL} || l
    || CASE WHEN i < n - 1 THEN {_NL} ELSE '' END AS content
FROM marks_ QUALIFY i > 0
UNION ALL SELECT base, 1, '', l FROM marks_ WHERE n = 1
UNION ALL SELECT {_SQL_BASE}, 1, '', '' FROM documents WHERE {_SQL_BASE} NOT IN (SELECT base FROM solid)"""


def renumber_page_markers(spark, sf_dir):
    return P.renumber_page_markers(_marked_segments(spark, sf_dir)).select("base", "changed", "text")


QUERIES["renumber_page_markers"] = renumber_page_markers
ORACLE["renumber_page_markers"] = f"""WITH {_SQL_LINES}, {_SQL_SOLID},
fixed AS (SELECT base, n > 2 AND doc_id % 3 <> 0 AS changed,
    CASE WHEN i = 0 THEN l ELSE '===== PAGE ' || CASE WHEN doc_id % 3 = 0 THEN mark ELSE i END || ' =====' || {_NL} || l END AS l, i
  FROM marks_)
SELECT base, any_value(changed) AS changed, string_agg(l, {_NL} ORDER BY i) AS text FROM fixed GROUP BY base
UNION ALL SELECT {_SQL_BASE}, false, '' FROM documents WHERE {_SQL_BASE} NOT IN (SELECT base FROM solid)"""


def _page_sides(spark, sf_dir):
    return pages(spark, sf_dir).select("base", "page_seq", "place", F.col("body").alias("embedded"), F.upper("body").alias("ocr"))


def choose_page_text(spark, sf_dir):
    return P.page_text_status(P.choose_page_text(_page_sides(spark, sf_dir)))


QUERIES["choose_page_text"] = choose_page_text
ORACLE["choose_page_text"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES}
SELECT base, count(*) AS pages, count_if(length({T.sql_strip('body')}) >= 20) AS text_pages,
  count_if(length({T.sql_strip('body')}) < 20) AS ocr_pages,
  CASE WHEN count_if(length({T.sql_strip('body')}) < 20) = 0 THEN 'text-layer' ELSE 'ocr' END AS status
FROM pages_ GROUP BY base"""

# Words of the driver's texts that stand in for parameter hints and fact keywords.
HINTS = ["than", "ción", "keit", "ment"]
GROUPS = {"first": ["that", "der"], "second": ["que", "ation"]}


def param_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("base", P.param_lines(F.col("text"), HINTS).alias("params"))


_SQL_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _sql_params(rows: str) -> str:
    """base-keyed parameter text of rows(key, text)."""
    hint = " OR ".join(f"contains(l, '{h}')" for h in HINTS)
    return f"""SELECT key, string_agg(nl, ' ' ORDER BY i) AS params FROM (
  SELECT key, nl, min(i) AS i FROM (
    SELECT key, {T.sql_norm('l')} AS nl, i FROM (
      SELECT key, unnest(string_split_regex(text, '{_SQL_BREAK}')) AS l,
        generate_subscripts(string_split_regex(text, '{_SQL_BREAK}'), 1) AS i FROM ({rows})) WHERE {hint})
  WHERE nl <> '' GROUP BY key, nl) GROUP BY key"""


QUERIES["param_lines"] = param_lines
ORACLE["param_lines"] = f"""WITH p AS ({_sql_params(f"SELECT {_SQL_BASE} AS key, text FROM documents")})
SELECT {_SQL_BASE} AS base, coalesce(params, '') AS params FROM documents LEFT JOIN p ON p.key = {_SQL_BASE}"""


def fact_snippets(spark, sf_dir):
    return P.fact_snippets(_docs(spark, sf_dir), GROUPS)


_SQL_KW = "(VALUES " + ", ".join(f"('{g}', '{w}')" for g, ws in GROUPS.items() for w in ws) + ") AS kw(grp, kw)"
_SQL_SNIPPETS = f"""pieces AS (SELECT base, grp, kw, n, unnest(string_split(n, kw)) AS p,
    generate_subscripts(string_split(n, kw), 1) AS i, len(string_split(n, kw)) AS cnt
  FROM (SELECT {_SQL_BASE} AS base, {T.sql_keep_case('text')} AS n FROM documents), {_SQL_KW}),
offs AS (SELECT base, grp, kw, n, i, cnt, sum(length(p)) OVER (PARTITION BY base, kw ORDER BY i) + (i - 1) * length(kw) AS at_ FROM pieces),
cuts AS (SELECT base, grp, kw, i, substr(n, CAST(greatest(at_ - 60, 0) + 1 AS BIGINT),
    CAST(at_ + length(kw) + 140 - greatest(at_ - 60, 0) AS BIGINT)) AS snippet FROM offs WHERE i < cnt),
snips AS (SELECT base, grp, kw, snippet, CAST(row_number() OVER (PARTITION BY base, kw ORDER BY min(i)) AS INTEGER) AS pick
  FROM cuts GROUP BY base, grp, kw, snippet)"""
QUERIES["fact_snippets"] = fact_snippets
ORACLE["fact_snippets"] = f"WITH {_SQL_SNIPPETS} SELECT base, grp, kw, pick, snippet FROM snips"

_WEAK = dict(spec_words=["esta", "unge"], labels=["ción", "keit"], table_words=["os", "er"], file_words=["src1"],
             value_pattern="[0-9]+")


def _sql_weak(ctx: str, body: str) -> str:
    n = T.sql_norm(body)
    any_ = lambda x, ws: "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
    nv = f"NOT regexp_matches({body}, '[0-9]+')"
    return f"""CASE WHEN length({n}) < 30 THEN 'empty_ocr len=' || length({n})
  WHEN {any_(n, _WEAK['spec_words'])} AND {any_(n, _WEAK['table_words'])} AND {nv} THEN 'spec_table_missing_values'
  WHEN {any_(n, _WEAK['spec_words'])} AND {any_(n, _WEAK['labels'])} AND {nv} THEN 'spec_page_no_values'
  WHEN ({any_(ctx, _WEAK['file_words'])} OR contains(lower({ctx}), 'spec')) AND {nv} THEN 'spec_file_page_no_values'
  ELSE '' END"""


def page_weakness(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("base", F.col("place").cast("long").alias("place"),
                    P.page_weakness(F.col("base"), F.col("body"), True, **_WEAK).alias("reason"))


QUERIES["page_weakness"] = page_weakness
ORACLE["page_weakness"] = f"WITH {_SQL_LINES}, {_SQL_PAGES} SELECT base, place, {_sql_weak('base', 'body')} AS reason FROM pages_"


def _labelled(spark, sf_dir):
    return T.table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "base"), "doc_id")


def _images(spark, sf_dir):
    """Two images for page 1 and one for page 2 of every labelled manual."""
    shots = F.array(*[F.struct(F.lit(s).alias("page_seq"), F.lit(o).alias("n")) for s, o in ((1, 0), (1, 1), (2, 2))])
    return (_labelled(spark, sf_dir).select("base", "quality", F.inline(shots))
            .select("base", "page_seq", F.concat(F.lit("img/q"), "quality", F.lit("/"), "base", F.lit("-"), "n").alias("image_rel"),
                    F.col("n").alias("ord")))


_SQL_IMAGES = f"""images_ AS (SELECT {_SQL_BASE} AS base, s AS page_seq, 'img/q' || quality || '/' || {_SQL_BASE} || '-' || n AS image_rel, n AS ord
  FROM labels JOIN documents USING (doc_id), (VALUES (1, 0), (1, 1), (2, 2)) AS v(s, n))"""


def repair_todo(spark, sf_dir):
    todo = P.repair_todo(pages(spark, sf_dir), _images(spark, sf_dir), force_spec=True, min_len=5, **_WEAK)
    return todo.select("base", "page_seq", F.col("place").cast("long").alias("place"), "image_rel", "reason", "preview")


QUERIES["repair_todo"] = repair_todo
ORACLE["repair_todo"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES}, {_SQL_IMAGES},
weak AS (SELECT base, page_seq, place, body, {_sql_weak('base', 'body')} AS reason FROM pages_)
SELECT base, CAST(page_seq AS INTEGER) AS page_seq, place, arg_max(image_rel, ord) AS image_rel, any_value(reason) AS reason,
  translate(substr(any_value(body), 1, 120), chr(9) || chr(13) || chr(10), '   ') AS preview
FROM weak JOIN images_ USING (base, page_seq)
WHERE reason <> '' AND NOT (starts_with(reason, 'empty_ocr') AND length({T.sql_norm('body')}) < 5) GROUP BY base, page_seq, place"""


def _repairs(spark, sf_dir):
    """Two repairs per labelled manual; the second one failed where the text is toxic."""
    tries = F.array(F.struct(F.lit(0).alias("n"), F.lit("ok").alias("status")),
                    F.struct(F.lit(1).alias("n"), F.when(F.col("toxic") == 1, "fail:x").otherwise("ok").alias("status")))
    return (_labelled(spark, sf_dir).select("base", "quality", "doc_id", F.inline(tries))
            .select("base", (F.col("quality") + 1).alias("page_seq"), "status", F.col("n").alias("ord"),
                    F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"fix\\n'), "n", F.lit('"')))
                    .otherwise(F.concat(F.lit("fix "), "n")).alias("text")))


_SQL_REPAIRS = f"""repairs_ AS (SELECT {_SQL_BASE} AS base, quality + 1 AS page_seq, n AS ord,
  CASE WHEN n = 1 AND toxic = 1 THEN 'fail:x' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN 'fix' || {_NL} || n ELSE 'fix ' || n END AS text
  FROM labels JOIN documents USING (doc_id), (VALUES (0), (1)) AS v(n)),
fixes AS (SELECT base, page_seq, arg_max(text, ord) AS fix FROM repairs_ WHERE status = 'ok' GROUP BY base, page_seq)"""


def _overlaid(spark, sf_dir):
    return P.overlay_pages(pages(spark, sf_dir), P.merge_repairs(_repairs(spark, sf_dir)))


def overlay_pages(spark, sf_dir):
    return _overlaid(spark, sf_dir).select("base", F.col("place").cast("long").alias("place"),
                                           F.col("page_seq").cast("long").alias("page_seq"), "body")


_SQL_OVERLAID = f"""over_ AS (SELECT base, source, place, page_seq, CASE WHEN fix IS NULL THEN body ELSE fix || {_NL} || body END AS body
  FROM pages_ LEFT JOIN fixes USING (base, page_seq))"""
QUERIES["overlay_pages"] = overlay_pages
ORACLE["overlay_pages"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES}, {_SQL_REPAIRS}, {_SQL_OVERLAID}
SELECT base, place, page_seq, body FROM over_"""


def _names(spark, sf_dir):
    """Image paths of page urls; every seventh page has its image at the top, and manuals beyond the
    number of pages have none."""
    p = T.table(spark, sf_dir, "pages")
    rel = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("top"), F.col("page_id").cast("string"))).otherwise(
        F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/x.jpg")))
    pairs = (p.select(F.col("page_id").alias("doc_id"), rel.alias("image_rel"), F.col("page_id").alias("ord"))
             .join(_docs(spark, sf_dir).select("doc_id", "base"), "doc_id").select("base", "image_rel", "ord"))
    return P.path_context(_docs(spark, sf_dir), pairs)


_SQL_NAMES = rf"""rels AS (SELECT page_id AS doc_id, replace(CASE WHEN page_id % 7 = 0 THEN 'top' || page_id
    ELSE regexp_replace(url, '^[a-z]+://', '') || '/x.jpg' END, '/', '\') AS rel FROM pages),
names AS (SELECT {_SQL_BASE} AS base, CASE WHEN rel IS NULL THEN {_SQL_BASE} || '.txt'
    WHEN contains(rel, '\') THEN regexp_replace(rel, '\\[^\\]*$', '') || '\' || {_SQL_BASE} ELSE {_SQL_BASE} END AS name
  FROM documents LEFT JOIN rels USING (doc_id))"""


def path_context(spark, sf_dir):
    return _names(spark, sf_dir)


QUERIES["path_context"] = path_context
ORACLE["path_context"] = f"WITH {_SQL_NAMES} SELECT base, name FROM names"


def _specs(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("spec"), F.col("item_id").cast("string")).alias("name"), "text")


def text_layers(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    sheets = c.select(F.concat_ws("-", F.lit("sheet"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), "text")
    rows = P.text_layers(sheets, _specs(spark, sf_dir), _overlaid(spark, sf_dir), _names(spark, sf_dir))
    return rows.withColumn("place", F.col("place").cast("long"))


QUERIES["text_layers"] = text_layers
ORACLE["text_layers"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES}, {_SQL_REPAIRS}, {_SQL_OVERLAID}, {_SQL_NAMES}
SELECT 'KDOCS' AS layer, 'sheet-' || conv_id || '-' || turn AS name, '' AS page, {T.sql_norm('text')} AS blob, 0 AS place FROM conversations
UNION ALL SELECT 'SPEC', 'spec' || item_id, '', {T.sql_norm('text')}, 0 FROM benchmark WHERE {T.sql_norm('text')} <> ''
UNION ALL SELECT 'OCR', name, CAST(page_seq AS VARCHAR), {T.sql_norm('body')}, place FROM over_ JOIN names USING (base)"""


def build_params_layer(spark, sf_dir):
    seeds = T.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("product"), F.col("p_brand").alias("model"), F.col("p_type").alias("attribute"),
        F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("value"),
        F.lit("s").alias("source"), F.lit("").alias("page"))
    return P.build_params_layer(_overlaid(spark, sf_dir), _names(spark, sf_dir), _specs(spark, sf_dir), seeds, HINTS)


QUERIES["build_params_layer"] = build_params_layer
ORACLE["build_params_layer"] = f"""WITH {_SQL_LINES}, {_SQL_PAGES}, {_SQL_REPAIRS}, {_SQL_OVERLAID}, {_SQL_NAMES},
pp AS ({_sql_params("SELECT base || chr(9) || place AS key, body AS text FROM over_")}),
sp AS ({_sql_params("SELECT 'spec' || item_id AS key, text FROM benchmark")})
SELECT name, CAST(page_seq AS VARCHAR) AS page, params AS blob FROM over_ JOIN names USING (base) JOIN pp ON pp.key = base || chr(9) || place
UNION ALL SELECT key, '', params FROM sp
UNION ALL SELECT 'param_seeds:' || p_name, '', {T.sql_norm("concat_ws(' ', p_brand, p_type, CAST(p_size AS VARCHAR))")} FROM part WHERE p_size % 5 <> 0"""


def _aligned(spark, sf_dir):
    segs = P.split_segments(_marked_segments(spark, sf_dir))
    n = F.pmod(F.col("n_chars"), F.lit(9)).cast("int")
    imgs = (_docs(spark, sf_dir).filter(n > 0).select("base", F.explode(F.sequence(F.lit(1), n)).alias("j"))
            .select("base", (F.col("j") * 2).alias("num"),
                    F.concat("base", F.lit("_p-"), (F.col("j") * 2).cast("string"), F.lit(".jpg")).alias("image_rel")))
    return P.align_segments_images(segs, imgs)


_SQL_ALIGNED = f"""segs AS (SELECT base, i AS k, CAST(mark AS VARCHAR) AS marker,
    CASE WHEN i = 1 THEN lag(l) OVER (PARTITION BY base ORDER BY i) || {_NL} ELSE '' END || {_NL} || l
      || CASE WHEN i < n - 1 THEN {_NL} ELSE '' END AS content FROM marks_ QUALIFY i > 0
  UNION ALL SELECT base, 1, '', l FROM marks_ WHERE n = 1
  UNION ALL SELECT {_SQL_BASE}, 1, '', '' FROM documents WHERE {_SQL_BASE} NOT IN (SELECT base FROM solid)),
imgs AS (SELECT {_SQL_BASE} AS base, unnest(range(1, n_chars % 9 + 1)) AS k FROM documents),
al AS (SELECT coalesce(s.base, g.base) AS base, coalesce(s.k, g.k) AS k, coalesce(g.k * 2, s.k) AS page_seq, coalesce(marker, '') AS marker,
    coalesce(CAST(length(content) AS VARCHAR), '') AS text_len,
    coalesce(translate(substr(content, 1, 80), chr(9) || chr(13) || chr(10), '   '), '') AS preview,
    CASE WHEN g.k IS NULL THEN '' ELSE g.base || '_p-' || (g.k * 2) || '.jpg' END AS image_rel,
    content IS NOT NULL AND g.k IS NOT NULL AS matched
  FROM segs s FULL JOIN imgs g ON s.base = g.base AND s.k = g.k)"""


def align_segments_images(spark, sf_dir):
    a = _aligned(spark, sf_dir)
    return a.withColumn("k", F.col("k").cast("long")).withColumn("page_seq", F.col("page_seq").cast("long"))


QUERIES["align_segments_images"] = align_segments_images
ORACLE["align_segments_images"] = f"WITH {_SQL_LINES}, {_SQL_SOLID}, {_SQL_ALIGNED} SELECT * FROM al"


def image_alignment_summary(spark, sf_dir):
    unparsed = T.table(spark, sf_dir, "pages").filter(~F.col("url").rlike(r"_p-\d+\.jpg$"))
    return P.image_alignment_summary(_aligned(spark, sf_dir), unparsed)


QUERIES["image_alignment_summary"] = image_alignment_summary
ORACLE["image_alignment_summary"] = rf"""WITH {_SQL_LINES}, {_SQL_SOLID}, {_SQL_ALIGNED},
per AS (SELECT base, count(*) AS p, count_if(text_len <> '') AS s, count_if(image_rel <> '') AS g, count_if(matched) AS m FROM al GROUP BY base),
x AS (SELECT count(*) AS x FROM pages WHERE NOT regexp_matches(url, '_p-[0-9]+\.jpg$'))
SELECT count(*) AS manuals, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(g) + any_value(x) AS BIGINT) AS images, CAST(sum(m) AS BIGINT) AS matched,
  CAST(sum(g - m) + any_value(x) AS BIGINT) AS unmatched_images, CAST(sum(s - m) AS BIGINT) AS unmatched_segments FROM per, x"""


# --- sheets ------------------------------------------------------------------------------------

def _sheets(spark, sf_dir):
    """Each document as a sheet: a note row, a header, then one quoted question per line. Every
    fifth sheet has no header."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = lambda l, i: F.concat_ws("\t", F.concat(F.lit("2026-08-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")),
                                   quote(F.concat(l, F.lit("\n\t"), F.col("lang"))), F.lit("ID_A"), F.col("source"))
    rows = F.array_join(F.transform(F.split("text", "\n"), row), "\n")
    head = F.when(F.col("doc_id") % 5 == 0, "").otherwise("note\t\t\t\n日期\t问题描述\t图\t回复模板\n")
    return _docs(spark, sf_dir).select(F.col("base").alias("sheet"), F.concat(F.lit(""), head, rows).alias("text"))


def faq_items(spark, sf_dir):
    items = SH.faq_items(_sheets(spark, sf_dir))
    return items.select("sheet", F.col("item_ord").cast("long").alias("item_ord"), *SH.FIELDS, F.array_join("media", "|").alias("media"))


def _sql_cell(x: str) -> str:
    return f"regexp_replace({T.sql_strip(x)}, '[ \\t\\r\\n]+', ' ', 'g')"


QUERIES["faq_items"] = faq_items
ORACLE["faq_items"] = f"""WITH {_SQL_LINES},
cells AS (SELECT l.base AS sheet, l.doc_id, l.i, '2026-08-' || lpad(CAST(l.i % 28 + 1 AS VARCHAR), 2, '0') AS date,
  {_sql_cell(f"l.l || {_NL} || chr(9) || d.lang")} AS q, d.source FROM lines l JOIN documents d USING (doc_id))
SELECT sheet, i + 2 AS item_ord, date, '' AS category, '' AS owner, q AS question, '' AS answer, source AS template, '' AS asin,
  '' AS product, 'ID_A' AS media FROM cells WHERE doc_id % 5 <> 0
UNION ALL SELECT {_SQL_BASE}, 0, 'note', '', '', '', '', '', '', '', '' FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT sheet, i, date, '', '', q, 'ID_A | ' || source, '', '', '', '' FROM cells WHERE doc_id % 5 = 0"""


def _cells(spark, sf_dir):
    """Parts as a workbook: a number, a shared string, a gap, an inline text, a flag and a far column."""
    p = T.table(spark, sf_dir, "part")
    row = F.col("p_partkey").cast("int")
    cell = lambda col, t, v: F.struct(F.concat(F.lit(col), row.cast("string")).alias("ref"), F.lit(t).alias("t"), v.alias("v"))
    strings = p.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").cast("int").alias("idx"))
    kept = F.filter(F.array(
        cell("A", "", row.cast("string")), cell("B", "s", F.col("idx").cast("string")),
        cell("D", "inlineStr", F.when(F.col("p_size") % 3 != 0, F.concat(F.col("p_type"), F.lit("\n")))),
        cell("E", "b", (F.col("p_size") % 2).cast("string")),
        cell("AB", "", F.when(F.col("p_size") % 4 == 0, F.col("p_brand")))), lambda c: c["v"].isNotNull())
    cells = (p.join(strings, p["p_name"] == strings["text"])
             .select(F.concat(F.lit("Sheet"), (F.col("p_partkey") % 5).cast("string")).alias("sheet"), row.alias("row"), F.inline(kept)))
    return cells, strings


def cells_to_rows(spark, sf_dir):
    return SH.cells_to_rows(*_cells(spark, sf_dir))


QUERIES["cells_to_rows"] = cells_to_rows
ORACLE["cells_to_rows"] = """SELECT 'Sheet' || (p_partkey % 5) AS sheet, CAST(p_partkey AS INTEGER) AS row,
  p_partkey || chr(9) || p_name || chr(9) || chr(9) || CASE WHEN p_size % 3 <> 0 THEN p_type || ' ' ELSE '' END || chr(9)
  || CASE WHEN p_size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END
  || CASE WHEN p_size % 4 = 0 THEN repeat(chr(9), 23) || p_brand ELSE '' END AS line FROM part"""


def _media_refs(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    key = F.upper(F.hex(F.col("p_partkey") % 997))
    formulas = p.select(
        (F.col("p_partkey") % 3).alias("book"), F.col("p_size").alias("sheet_ord"), F.concat(F.lit("s"), F.col("p_size")).alias("sheet"),
        F.col("p_partkey").alias("cell_ord"), F.concat(F.lit("A"), F.col("p_partkey")).alias("ref"),
        F.when(F.col("p_partkey") % 4 == 0, "=SUM(A1)").otherwise(F.concat(F.lit('=_xlfn.DISPIMG("ID_'), key, F.lit('",1)'))).alias("formula"))
    ids = p.select(key.alias("k"), (F.col("p_partkey") % 997).alias("n")).distinct()
    rels = ids.filter("n % 5 <> 0").select(F.concat(F.lit("ID_"), "k").alias("image_id"), F.concat(F.lit("rId"), F.col("n")).alias("rid"))
    files = ids.filter("n % 7 <> 0").select(F.concat(F.lit("rId"), F.col("n")).alias("rid"), F.concat(F.lit("media/"), F.col("n"), F.lit(".png")).alias("media_file"))
    sizes = files.select("media_file", F.length("media_file").alias("media_size"))
    return SH.cell_media_refs(formulas, rels, files, sizes)


_SQL_REFS = """f AS (SELECT p_partkey % 3 AS book, p_size AS sheet_ord, 's' || p_size AS sheet, p_partkey, p_partkey % 997 AS n FROM part WHERE p_partkey % 4 <> 0),
refs AS (SELECT book, 'ID_' || upper(to_hex(n)) AS image_id, sheet, 'A' || p_partkey AS ref,
  CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN 'media/' || n || '.png' ELSE '' END AS media_file,
  CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN length('media/' || n || '.png') ELSE 0 END AS media_size,
  row_number() OVER (PARTITION BY book ORDER BY sheet_ord, p_partkey) AS seen_order FROM f)"""


def cell_media_refs(spark, sf_dir):
    return _media_refs(spark, sf_dir)


QUERIES["cell_media_refs"] = cell_media_refs
ORACLE["cell_media_refs"] = f"WITH {_SQL_REFS} SELECT * FROM refs"


def cell_media_summary(spark, sf_dir):
    return SH.cell_media_summary(_media_refs(spark, sf_dir))


QUERIES["cell_media_summary"] = cell_media_summary
ORACLE["cell_media_summary"] = f"""WITH {_SQL_REFS} SELECT count(DISTINCT image_id) AS unique_image_ids, count(*) AS cell_references,
  count(DISTINCT sheet) AS sheets_with_images, count_if(media_file = '') AS missing_media FROM refs"""
