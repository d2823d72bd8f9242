"""Registered catalog and graph queries on the driver tables, each with its DuckDB twin.

Products are sheets named after distinct (type, brand) pairs of parts; manuals, images and videos
are named after part names, page urls and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportkb.operators import catalog as C
from supportkb.operators import pages as P
from supportkb.plans import answer
from supportkb.plans import tables as T
from supportkb.plans.manuals import GROUPS, _SQL_SNIPPETS
from supportkb.functions.text import norm
from supportkb.sizing import cut_lineage

QUERIES, ORACLE = {}, {}


def sheets(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(F.concat(F.col("p_type"), F.lit("-"), F.col("p_brand"), F.lit("(x"), F.length("p_type"), F.lit(")")).alias("sheet")).distinct()


_SQL_SHEETS = "SELECT DISTINCT p_type || '-' || p_brand || '(x' || length(p_type) || ')' AS sheet FROM part"
_SQL_PLAIN = "regexp_replace(sheet, '[（(].*?[）)]', '', 'g')"


def aliases(spark, sf_dir):
    """Default aliases by brand; a local table replaces those of brands ending in 1."""
    p = T.table(spark, sf_dir, "part")
    brand = F.lower(F.col("p_brand"))
    names = p.groupBy(brand.alias("key"), F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("ord"))
    local = p.filter(F.endswith("p_brand", F.lit("1"))).select(brand.alias("key"), F.concat(F.lit("own"), F.col("p_size").cast("string")).alias("alias"),
                                                               F.lit(0).cast("long").alias("ord")).distinct()
    return C.merge_aliases(names, local)


_SQL_ALIASES = """SELECT lower(p_brand) AS key, p_name AS alias FROM part WHERE NOT ends_with(p_brand, '1') GROUP BY ALL
UNION SELECT lower(p_brand), 'own' || p_size FROM part WHERE ends_with(p_brand, '1')"""


def sheet_keywords(spark, sf_dir):
    return sheets(spark, sf_dir).select("sheet", F.array_join(C.sheet_keywords(F.col("sheet")), "|").alias("keywords"))


_SQL_KEYWORDS = f"""SELECT DISTINCT sheet, k FROM (
  SELECT sheet, unnest(list_filter(string_split_regex({_SQL_PLAIN}, '[-—&_]'), lambda x: length(x) >= 2)) AS k FROM ({_SQL_SHEETS})
  UNION ALL SELECT sheet, unnest(list_filter(regexp_extract_all({_SQL_PLAIN}, '[A-Za-z0-9]+[-]?[A-Za-z0-9]*'), lambda x: length(x) >= 3)) FROM ({_SQL_SHEETS}))"""
QUERIES["sheet_keywords"] = sheet_keywords
ORACLE["sheet_keywords"] = f"SELECT sheet, string_agg(k, '|' ORDER BY length(k) DESC, k) AS keywords FROM ({_SQL_KEYWORDS}) GROUP BY sheet"


def alias_join(spark, sf_dir):
    return C.alias_join(sheets(spark, sf_dir), aliases(spark, sf_dir))


_SQL_ALIAS_JOIN = f"""SELECT sheet, key, alias FROM ({_SQL_SHEETS}) JOIN ({_SQL_ALIASES})
ON contains(lower({_SQL_PLAIN}), key) OR contains(key, lower({_SQL_PLAIN}))"""
QUERIES["alias_join"] = alias_join
ORACLE["alias_join"] = _SQL_ALIAS_JOIN


def _keywords(spark, sf_dir):
    return C.product_keywords(sheets(spark, sf_dir), aliases(spark, sf_dir))


_SQL_PRODUCT_KEYWORDS = f"""SELECT sheet AS product, k AS keyword FROM ({_SQL_KEYWORDS})
UNION SELECT sheet, alias FROM ({_SQL_ALIAS_JOIN})"""


def _manuals(spark, sf_dir):
    """A manual per (part name, source of the document with that number)."""
    p = T.table(spark, sf_dir, "part")
    stem = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    return p.select(F.concat(stem, F.lit(".txt")).alias("manual"), stem.alias("stem"))


_SQL_MANUALS = "SELECT concat_ws(' ', p_name, p_type, 'm' || p_partkey) AS stem, concat_ws(' ', p_name, p_type, 'm' || p_partkey) || '.txt' AS manual FROM part"


def _images(spark, sf_dir):
    """Two page images per part in a folder of its brand, one for every third part."""
    p = T.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    stem = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit(".jpg")).otherwise(F.lit(".png"))
    return (p.select("p_brand", stem.alias("stem"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n"))
            .select(F.concat("p_brand", F.lit("/"), "stem", F.lit("_p-"), F.col("n").cast("string"), "kind").alias("image_rel")))


_SQL_IMAGES = """SELECT p_brand || '/' || concat_ws(' ', p_name, p_type, 'm' || p_partkey) || '_p-' || n || CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS image_rel,
  concat_ws(' ', p_name, p_type, 'm' || p_partkey) AS stem, p_partkey % 2 = 0 AS jpg FROM part, (VALUES (1), (2)) AS v(n) WHERE p_partkey % 3 = 0"""


def _videos(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    part = T.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (p.join(part, p["page_id"] == part["p_partkey"])
            .select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), "p_brand", F.lit(".mp4")).alias("video")))


_SQL_VIDEOS = "SELECT regexp_replace(url, '^[a-z]+://', '') || '/' || p_brand || '.mp4' AS video FROM pages JOIN part ON page_id = p_partkey"


def _catalog_items(spark, sf_dir):
    """The catalog, its items and the products of their keyword sets."""
    keywords = cut_lineage(_keywords(spark, sf_dir))
    items = C.product_items(keywords, _manuals(spark, sf_dir), _images(spark, sf_dir), _videos(spark, sf_dir))
    return C.match_products(sheets(spark, sf_dir), keywords, *items), items


def catalog(spark, sf_dir):
    return _catalog_items(spark, sf_dir)[0]


def match_products(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("product", "faq", *["ocr_count", "page_count", "video_count"],
                    *[F.array_join(x, "|").alias(x) for x in ("keywords", "ocr_files", "pages", "videos")])


def _sql_match(rel: str, item: str) -> str:
    return f"SELECT DISTINCT product, {item} AS item FROM kw JOIN {rel} ON length(keyword) >= 2 AND contains(lower({item}), lower(keyword))"


_SQL_CATALOG = f"""kw AS ({_SQL_PRODUCT_KEYWORDS}), man AS ({_SQL_MANUALS}), img AS ({_SQL_IMAGES}), vid AS ({_SQL_VIDEOS}),
m1 AS (SELECT DISTINCT product, manual AS item FROM kw JOIN man ON length(keyword) >= 2 AND contains(lower(stem), lower(keyword))
  UNION SELECT DISTINCT product, manual FROM kw JOIN img ON jpg AND length(keyword) >= 2 AND contains(lower(image_rel), lower(keyword)) JOIN man USING (stem)),
m2 AS ({_sql_match('img', 'image_rel')}), m3 AS ({_sql_match('vid', 'video')}),
agg AS (SELECT s.sheet AS product, s.sheet || '.json' AS faq,
  (SELECT string_agg(DISTINCT keyword, '|' ORDER BY keyword) FROM kw WHERE kw.product = s.sheet) AS keywords,
  (SELECT list(item ORDER BY item) FROM m1 WHERE m1.product = s.sheet) AS l1, (SELECT list(item ORDER BY item) FROM m2 WHERE m2.product = s.sheet) AS l2,
  (SELECT list(item ORDER BY item) FROM m3 WHERE m3.product = s.sheet) AS l3 FROM ({_SQL_SHEETS}) s),
cat AS (SELECT product, faq, coalesce(keywords, '') AS keywords, coalesce(len(l1), 0) AS ocr_count, coalesce(l1[1:8], []) AS ocr_files,
  coalesce(len(l2), 0) AS page_count, coalesce(l2[1:8], []) AS pages, coalesce(len(l3), 0) AS video_count, coalesce(l3[1:6], []) AS videos,
  coalesce(l1, []) AS all_ocr, coalesce(l2, []) AS all_pages, coalesce(l3, []) AS all_videos FROM agg)"""
QUERIES["match_products"] = match_products
ORACLE["match_products"] = f"""WITH {_SQL_CATALOG} SELECT product, faq, ocr_count, page_count, video_count, keywords,
array_to_string(ocr_files, '|') AS ocr_files, array_to_string(pages, '|') AS pages, array_to_string(videos, '|') AS videos FROM cat"""


def explode_lists(spark, sf_dir):
    """Catalog lists as pipe-delimited cells, back to rows."""
    return C.explode_list(match_products(spark, sf_dir).select("product", "ocr_files"), "ocr_files", "manual").select("product", "manual")


QUERIES["explode_lists"] = explode_lists
ORACLE["explode_lists"] = f"WITH {_SQL_CATALOG} SELECT product, unnest(ocr_files) AS manual FROM cat"


def _specs(spark, sf_dir):
    """Spec files: one folder per brand, named by type and brand, or by the whole product."""
    p = T.table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(
        F.concat(F.lit("About "), "p_type", F.lit(" - "), "p_brand", F.lit("(x"), F.length("p_type"), F.lit(")")))
    return p.select(F.concat(F.lit("spec\\"), "p_brand", F.lit("\\"), name).alias("file")).distinct()


_SQL_SPECS = r"""SELECT DISTINCT 'spec\' || p_brand || '\' || short AS file, short FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN p_brand
  ELSE 'About ' || p_type || ' - ' || p_brand || '(x' || length(p_type) || ')' END AS short FROM part)"""


def link_specs_params(spark, sf_dir):
    products = sheets(spark, sf_dir).withColumnRenamed("sheet", "product")
    return C.link_either_way(products, _specs(spark, sf_dir), "file")


_SQL_LINKS = f"""SELECT DISTINCT sheet AS product, file FROM ({_SQL_SHEETS}) s JOIN ({_SQL_SPECS}) f
ON contains({T.sql_norm('sheet')}, {T.sql_norm('short')}) OR contains({T.sql_norm('file')}, {T.sql_norm('sheet')})"""
QUERIES["link_specs_params"] = link_specs_params
ORACLE["link_specs_params"] = _SQL_LINKS


def _tables(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(F.concat_ws(" ", F.lit("Table"), "p_brand", "p_name").alias("table")).distinct()


_SQL_TABLES = "SELECT DISTINCT concat_ws(' ', 'Table', p_brand, p_name) AS \"table\" FROM part"


def related_tables(spark, sf_dir):
    return C.related_tables(_keywords(spark, sf_dir), _tables(spark, sf_dir))


_SQL_RELATED = f"""SELECT DISTINCT product, "table" FROM kw JOIN ({_SQL_TABLES}) t
ON length(keyword) >= 2 AND contains({T.sql_norm('"table"')}, {T.sql_norm('keyword')})"""
QUERIES["related_tables"] = related_tables
ORACLE["related_tables"] = f"WITH kw AS ({_SQL_PRODUCT_KEYWORDS}) {_SQL_RELATED}"


def _graph(spark, sf_dir):
    cat, items = _catalog_items(spark, sf_dir)
    cat, tables = cut_lineage(cat), _tables(spark, sf_dir)
    links = cut_lineage(link_specs_params(spark, sf_dir))
    return cat, *C.graph_nodes_edges(cat, tables, links, links, related_tables(spark, sf_dir), *items)


_SQL_GRAPH = rf"""{_SQL_CATALOG}, rel_ AS ({_SQL_RELATED}), lk AS ({_SQL_LINKS}),
links AS (SELECT product, 'faq:' || faq AS dst, 'has_faq' AS rel, 'faq' AS kind, faq AS label, 'faq/' || faq AS path FROM cat
  UNION ALL SELECT product, 'ocr:' || x, 'has_manual', 'ocr', x, 'pdf_ocr/' || x FROM (SELECT product, unnest(all_ocr) AS x FROM cat)
  UNION ALL SELECT product, 'page:' || x, 'has_page', 'page', x, 'pdf_pages/' || x FROM (SELECT product, unnest(all_pages) AS x FROM cat)
  UNION ALL SELECT product, 'video:' || x, 'has_video', 'video', x, x FROM (SELECT product, unnest(all_videos) AS x FROM cat)
  UNION ALL SELECT product, 'spec:' || file, 'has_spec', 'spec', string_split(file, '\')[-1], file FROM lk
  UNION ALL SELECT product, 'params:' || file, 'has_params', 'params', file, 'quick_index/params_norm.tsv' FROM lk
  UNION ALL SELECT product, 'table:' || "table", 'related_table', 'table', "table", 'kdocs/' || "table" || '.txt' FROM rel_),
nodes AS (SELECT DISTINCT id, kind, label, path FROM (SELECT 'product:' || product AS id, 'product' AS kind, product AS label, '' AS path FROM cat
  UNION ALL SELECT 'table:' || "table", 'table', "table", 'kdocs/' || "table" || '.txt' FROM ({_SQL_TABLES})
  UNION ALL SELECT dst, kind, label, path FROM links)),
edges AS (SELECT DISTINCT 'product:' || product AS src, dst, rel FROM links)"""


def build_graph(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return (nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("label").alias("c"), "path")
            .unionByName(edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rel").alias("c"), F.lit("").alias("path"))))


QUERIES["build_graph"] = build_graph
ORACLE["build_graph"] = f"""WITH {_SQL_GRAPH} SELECT 'node' AS part, id AS a, kind AS b, label AS c, path FROM nodes
UNION ALL SELECT 'edge', src, dst, rel, '' FROM edges"""


def graph_summary(spark, sf_dir):
    cat, nodes, edges = _graph(spark, sf_dir)
    return C.graph_summary(nodes, edges, cat)


QUERIES["graph_summary"] = graph_summary
ORACLE["graph_summary"] = f"""WITH {_SQL_GRAPH} SELECT 'nodes:' || kind AS measure, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'products', count(*) FROM cat
UNION ALL SELECT 'no_faq', 0 UNION ALL SELECT 'no_ocr', count_if(len(ocr_files) = 0) FROM cat UNION ALL SELECT 'no_video', count_if(len(videos) = 0) FROM cat"""


def missing_sources(spark, sf_dir):
    return C.missing_sources(catalog(spark, sf_dir))


QUERIES["missing_sources"] = missing_sources
ORACLE["missing_sources"] = f"""WITH {_SQL_CATALOG} SELECT product, 'no_ocr' AS missing FROM cat WHERE len(ocr_files) = 0
UNION ALL SELECT product, 'no_video' FROM cat WHERE len(videos) = 0"""


def product_facts(spark, sf_dir):
    """Sources as products: facts over all documents of each source."""
    d = T.table(spark, sf_dir, "documents").withColumn("base", F.concat_ws("-", "source", F.col("doc_id").cast("string")))
    pairs = d.select(F.col("source").alias("product"), F.concat("base", F.lit(".txt")).alias("manual"))
    return C.product_facts(pairs, P.fact_snippets(d, GROUPS))


QUERIES["product_facts"] = product_facts
ORACLE["product_facts"] = f"""WITH {_SQL_SNIPPETS}, listed AS (SELECT source AS product, source || '-' || doc_id || '.txt' AS manual FROM documents)
SELECT product, manual, grp, kw, pick, snippet FROM listed JOIN snips ON base || '.txt' = manual"""


# --- diagnosis ---------------------------------------------------------------------------------

def diagnose_not_found(spark, sf_dir):
    q = T.word_queries(spark, sf_dir)
    from supportkb.operators import search as S

    terms = S.expand_terms(q, T.word_synonyms(spark, sf_dir))
    d = T.table(spark, sf_dir, "documents")
    manuals = d.select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"),
                       F.size(F.split("text", "\n")).cast("string").alias("pages"), F.char_length(norm(F.col("text"))).cast("string").alias("norm_len"))
    files = d.select(F.concat(F.lit("f/"), "lang", F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
                     F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("stem"))
    images = T.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.concat(F.lit("SRC "), (F.col("page_id") % 30).cast("string")).alias("stem"))
    pairs = d.select(F.col("source").alias("pdf_base"), F.col("doc_id").cast("string").alias("page_seq"),
                     F.col("text").alias("preview"),
                     F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("img"), F.col("doc_id").cast("string"))).alias("image_rel"))
    return answer.diagnose_not_found(q, terms, manuals, files, images, pairs)


def _sql_section(rows: str, label: str, cap: int, order: str) -> str:
    return f"""SELECT query_id, '{label}' AS section, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS place, subject, detail,
  count(*) OVER (PARTITION BY query_id) AS total FROM ({rows}) QUALIFY place <= {cap}"""


def _pn(col: str) -> str:
    return f"(pn = '' OR contains({T.sql_norm(col)}, pn))"


_STEM = "source || '-' || doc_id"
QUERIES["diagnose_not_found"] = diagnose_not_found
ORACLE["diagnose_not_found"] = f"""WITH {T.sql_terms(T.SQL_WORD_QUERIES, T.SQL_WORD_SYNONYMS)},
asked AS (SELECT query_id, {T.sql_norm('product')} AS pn FROM q),
man AS (SELECT query_id, {_STEM} AS subject, 'pages=' || len(string_split(text, chr(10))) || ' norm_len=' || length({T.sql_norm('text')}) AS detail
  FROM asked JOIN documents ON {_pn(_STEM)}),
fil AS (SELECT query_id, 'f/' || lang || '/' || {_STEM} || '.pdf' AS subject, '' AS detail FROM asked JOIN documents ON {_pn(_STEM)}),
im AS (SELECT query_id, url AS subject, '' AS detail FROM asked JOIN pages ON {_pn("'SRC ' || (page_id % 30)")}),
cand AS (SELECT DISTINCT query_id, source AS subject, CAST(doc_id AS VARCHAR) AS page_seq, 'page=' || doc_id || ' -> img' || doc_id AS detail
  FROM asked JOIN terms USING (query_id) JOIN documents ON doc_id % 4 <> 0 AND length(term) >= 2 AND contains({T.sql_norm('text')}, term) AND {_pn('source')})
SELECT * FROM ({_sql_section('SELECT * FROM man', 'MANUALS', 10, 'subject')})
UNION ALL SELECT * FROM ({_sql_section('SELECT * FROM fil', 'FILES', 5, 'subject')})
UNION ALL SELECT * FROM ({_sql_section('SELECT * FROM im', 'PAGE_IMAGES', 8, 'subject')})
UNION ALL SELECT * FROM ({_sql_section('SELECT * FROM cand', 'CANDIDATE_IMAGES', 10, 'subject, page_seq, detail')})"""
