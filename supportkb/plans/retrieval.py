"""Registered retrieval queries on the driver tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportkb.functions.text import norm, norm_keep_case, tokenize_cjk, tokenize_words
from supportkb.operators import inverted
from supportkb.operators import search as S
from supportkb.plans import answer
from supportkb.plans import tables as T
from supportkb.sizing import cut_lineage, scratch_path

QUERIES, ORACLE = {}, {}


def norm_text(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", norm(F.col("text")).alias("norm_text"),
                    F.char_length(norm_keep_case(F.col("text"))).cast("long").alias("kept_len"))


QUERIES["norm"] = norm_text
ORACLE["norm"] = f"""SELECT doc_id, {T.sql_norm('text')} AS norm_text,
  length({T.sql_keep_case('text')}) AS kept_len FROM documents"""


def tokenize(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tokenize_cjk(F.col("text")), "|").alias("cjk_tokens"),
                    F.array_join(tokenize_words(F.col("text")), "|").alias("word_tokens"))


QUERIES["tokenize"] = tokenize
ORACLE["tokenize"] = rf"""WITH n AS (SELECT doc_id, text, {T.sql_norm('text')} AS s FROM documents),
p AS (SELECT doc_id, text, list_filter(string_split_regex(s, '[^\x00-\x7f]+'), lambda x: x <> '') AS runs,
      regexp_replace(s, '[\x00-\x7f]+', '', 'g') AS wide FROM n)
SELECT doc_id,
  array_to_string(list_concat(list_concat(runs,
    list_transform(range(1, length(wide)), lambda i: substr(wide, i, 2))),
    CASE WHEN wide = '' THEN [] ELSE [wide] END), '|') AS cjk_tokens,
  array_to_string(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), '|') AS word_tokens
FROM p"""


def expand_terms(spark, sf_dir):
    return S.expand_terms(T.word_queries(spark, sf_dir), T.word_synonyms(spark, sf_dir))


QUERIES["expand_terms"] = expand_terms
ORACLE["expand_terms"] = f"""WITH {T.sql_terms(T.SQL_WORD_QUERIES, T.SQL_WORD_SYNONYMS)}
SELECT query_id, CAST(ord AS INTEGER) AS ord, term FROM terms"""

_SQL_PRODUCT = (f"({T.sql_norm('q.product')} = '' OR contains({T.sql_norm('r.name')}, {T.sql_norm('q.product')})"
                f" OR (r.layer = 'CHATGPT' AND contains({T.sql_norm('r.blob')}, {T.sql_norm('q.product')})))")
_SQL_HITS = f"""rows_ AS ({{rows}}),
hits AS (SELECT t.query_id, r.layer, r.row_ord, r.name, r.page, r.ref, t.term,
    substr(r.blob, greatest(instr(r.blob, t.term) - 80, 1),
           instr(r.blob, t.term) + length(t.term) + 240 - greatest(instr(r.blob, t.term) - 80, 1)) AS snippet
  FROM terms t JOIN q USING (query_id) JOIN rows_ r ON contains(r.blob, t.term) AND {_SQL_PRODUCT}
  QUALIFY row_number() OVER (PARTITION BY t.query_id, r.layer, r.row_ord ORDER BY length(t.term) DESC, t.ord) = 1)"""


def _sql_hits(rows: str) -> str:
    return _SQL_HITS.replace("{rows}", rows)


_SQL_WEIGHT = ("CASE layer " + " ".join(f"WHEN '{n}' THEN {w}" for n, w, *_ in S.LAYERS) + " END")
_SQL_PLACE = ("CASE layer " + " ".join(f"WHEN '{n}' THEN {o}" for n, _, o, _f in S.LAYERS) + " END")
_SQL_RANKED = f"""uniq AS (SELECT *, CAST({_SQL_WEIGHT} AS DOUBLE) AS score, {_SQL_PLACE} AS place FROM hits
  QUALIFY row_number() OVER (PARTITION BY query_id, layer, name, page
                             ORDER BY length(term) DESC, score DESC, place, row_ord) = 1),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id
             ORDER BY length(term) DESC, score DESC, place, row_ord) AS rank,
           score, layer, name, page, row_ord, term, snippet FROM uniq QUALIFY rank <= 5)"""


def exact_search(spark, sf_dir):
    """Benchmark passages found whole in documents."""
    q, rows = T.text_queries(spark, sf_dir), T.document_rows(spark, sf_dir)
    terms = S.plain_terms(q)
    return S.rank_exact_hits(S.search_exact(rows, terms, q), rows, terms, q)


QUERIES["exact_search"] = exact_search
ORACLE["exact_search"] = f"""WITH q AS ({T.SQL_TEXT_QUERIES}),
terms AS (SELECT query_id, 0 AS ord, {T.sql_norm('q')} AS term FROM q),
{_sql_hits(T.sql_document_rows())}, {_SQL_RANKED}
SELECT * FROM ranked"""


def _word_search(spark, sf_dir):
    q, rows = T.word_queries(spark, sf_dir), T.all_rows(spark, sf_dir)
    terms = cut_lineage(S.expand_terms(q, T.word_synonyms(spark, sf_dir)))
    return S.search_exact(rows, terms, q), rows, terms, q


def exact_hits(spark, sf_dir):
    """Every (query, row) hit of expanded word queries over three layers, with product filters."""
    return _word_search(spark, sf_dir)[0].select("query_id", "layer", "row_ord", "name", "page", "term")


QUERIES["exact_hits"] = exact_hits
_SQL_EXPANDED = T.sql_terms(T.SQL_WORD_QUERIES, T.SQL_WORD_SYNONYMS)
ORACLE["exact_hits"] = f"WITH {_SQL_EXPANDED}, {_sql_hits(T.SQL_ALL_ROWS)} SELECT query_id, layer, row_ord, name, page, term FROM hits"


def rank_exact_hits(spark, sf_dir):
    return S.rank_exact_hits(*_word_search(spark, sf_dir))


QUERIES["rank_exact_hits"] = rank_exact_hits
ORACLE["rank_exact_hits"] = (f"WITH {_SQL_EXPANDED}, {_sql_hits(T.SQL_ALL_ROWS)}, {_SQL_RANKED} "
                             "SELECT * FROM ranked")


def enrich_faq_hits(spark, sf_dir):
    items = T.faq_items(spark, sf_dir)
    q = T.word_queries(spark, sf_dir).withColumn("product", F.lit(""))
    terms = cut_lineage(S.expand_terms(q, T.word_synonyms(spark, sf_dir)))
    rows = T.faq_rows(items)
    # Whole sheets and, in the others, every item of a third of the conversations are missing from the item table.
    return S.enrich_faq_hits(S.search_exact(rows, terms, q), items.filter("sheet <> 'sheet3' AND item_ord DIV 1000000 % 3 <> 0"), rows)


QUERIES["enrich_faq_hits"] = enrich_faq_hits
_SQL_KNOWN = "(i.sheet <> 'sheet3' AND i.item_ord // 1000000 % 3 <> 0)"
ORACLE["enrich_faq_hits"] = f"""WITH {T.sql_terms(f"SELECT query_id, '' AS product, q FROM ({T.SQL_WORD_QUERIES})",
                                                  T.SQL_WORD_SYNONYMS)},
{_sql_hits(T.SQL_FAQ_ROWS)}, items AS ({T.SQL_FAQ_ITEMS}),
paired AS (SELECT *, {_SQL_KNOWN} AS known, bool_or({_SQL_KNOWN}) OVER (PARTITION BY query_id, h.name) AS any_known
  FROM hits h JOIN items i ON i.sheet = h.name AND i.item_ord = h.row_ord)
SELECT query_id, name AS sheet, row_number() OVER (PARTITION BY query_id, name ORDER BY row_ord) AS pick,
  row_ord, term, CASE WHEN known THEN question ELSE snippet END AS question,
  CASE WHEN known THEN answer ELSE '' END AS answer, CASE WHEN known THEN template ELSE '' END AS template
FROM paired WHERE known = any_known QUALIFY pick <= 3"""


def _lookup_queries(spark, sf_dir):
    """Every known question, asked of its own sheet."""
    return T.faq_items(spark, sf_dir).select(F.col("item_ord").alias("query_id"), F.col("sheet").alias("product"),
                                             F.col("question").alias("q"))


_SQL_LOOKUP_QUERIES = f"SELECT item_ord AS query_id, sheet AS product, question AS q FROM ({T.SQL_FAQ_ITEMS})"


def faq_lookup_build(spark, sf_dir):
    lookup = S.build_faq_lookup(T.faq_items(spark, sf_dir), T.word_synonyms(spark, sf_dir))
    return lookup.select("sheet", "item_ord", F.array_join("keys", "|").alias("keys"), "question", "answer", "template")


_SQL_LOOKUP = f"""items AS ({T.SQL_FAQ_ITEMS}),
entry AS (SELECT sheet, item_ord, {T.sql_strip('question')} AS question, {T.sql_strip('answer')} AS answer,
          {T.sql_strip('template')} AS template FROM items),
blobs AS (SELECT *, {T.sql_norm("concat_ws(' ', question, answer, template)")} AS b FROM entry
          WHERE question <> '' OR answer <> '' OR template <> ''),
words AS (SELECT {T.sql_norm('term')} AS k, {T.sql_norm('expansion')} AS w FROM ({T.SQL_WORD_SYNONYMS})
          UNION SELECT {T.sql_norm('term')}, {T.sql_norm('term')} FROM ({T.SQL_WORD_SYNONYMS})),
keys AS (SELECT sheet, item_ord, {T.sql_norm('question')} AS key FROM blobs
         UNION SELECT sheet, item_ord, k FROM blobs JOIN words ON w <> '' AND k <> '' AND contains(b, w))"""
QUERIES["faq_lookup_build"] = faq_lookup_build
ORACLE["faq_lookup_build"] = f"""WITH {_SQL_LOOKUP}
SELECT b.sheet, b.item_ord, coalesce(string_agg(key, '|' ORDER BY key) FILTER (WHERE key <> ''), '') AS keys,
  any_value(question) AS question, any_value(answer) AS answer, any_value(template) AS template
FROM blobs b LEFT JOIN keys k ON k.sheet = b.sheet AND k.item_ord = b.item_ord GROUP BY b.sheet, b.item_ord"""


def lookup_fast(spark, sf_dir):
    q = _lookup_queries(spark, sf_dir)
    syn = T.word_synonyms(spark, sf_dir)
    lookup = cut_lineage(S.build_faq_lookup(T.faq_items(spark, sf_dir), syn))
    return S.lookup_fast(lookup, S.expand_terms(q, syn), q)


QUERIES["lookup_fast"] = lookup_fast
ORACLE["lookup_fast"] = f"""WITH {T.sql_terms(_SQL_LOOKUP_QUERIES, T.SQL_WORD_SYNONYMS)}, {_SQL_LOOKUP},
hit AS (SELECT DISTINCT t.query_id, k.sheet, k.item_ord FROM terms t JOIN q USING (query_id)
        JOIN keys k ON k.key = t.term AND k.sheet = q.product)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY item_ord) AS rank, sheet, item_ord,
  question, answer, template FROM hit JOIN blobs USING (sheet, item_ord) QUALIFY rank <= 3"""


def _sql_bm25(mode: str, top: int = 12) -> str:
    """CTEs over q, terms, rows_: bm25(query_id, layer, rank, row_ord, score, name, page, snippet)."""
    if mode == "word":
        tok = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    else:
        wide = lambda x: f"regexp_replace({x}, '[\\x00-\\x7f]+', '', 'g')"
        tok = lambda x: (f"list_concat(list_concat(list_filter(string_split_regex({x}, '[^\\x00-\\x7f]+'), lambda x: x <> ''),"
                         f" list_transform(range(1, length({wide(x)})), lambda i: substr({wide(x)}, i, 2))),"
                         f" CASE WHEN {wide(x)} = '' THEN [] ELSE [{wide(x)}] END)")
    return f"""scopes AS (SELECT DISTINCT {T.sql_norm('product')} AS scope FROM q),
toks AS (SELECT layer, row_ord, name, blob, {tok('blob' if mode == 'word' else T.sql_norm('blob'))} AS tl FROM rows_),
docs AS (SELECT scope, layer, row_ord, tl, len(tl) AS dl FROM toks JOIN scopes
         ON scope = '' OR contains({T.sql_norm('name')}, scope)
            OR (layer = 'CHATGPT' AND contains({T.sql_norm('blob')}, scope))),
corpus AS (SELECT scope, layer, count(*) AS n, sum(dl) / count(*) AS avgdl FROM docs GROUP BY scope, layer),
post AS (SELECT scope, layer, row_ord, dl, tok, count(*) AS tf
         FROM (SELECT scope, layer, row_ord, dl, unnest(tl) AS tok FROM docs) GROUP BY ALL),
df AS (SELECT scope, layer, tok, count(*) AS df FROM post GROUP BY scope, layer, tok),
raw AS (SELECT scope, layer, tok, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN corpus USING (scope, layer)),
fl AS (SELECT scope, layer, 0.25 * avg(raw) AS fl FROM raw GROUP BY scope, layer),
idf AS (SELECT scope, layer, tok, avgdl, CASE WHEN raw < 0 THEN fl ELSE raw END AS idf FROM raw JOIN fl USING (scope, layer)),
asked AS (SELECT query_id, scope, tok, count(*) AS qtf FROM
            (SELECT query_id, {T.sql_norm('product')} AS scope, unnest({tok('term')}) AS tok
             FROM terms JOIN q USING (query_id)) GROUP BY ALL),
scored AS (SELECT query_id, layer, row_ord,
             round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM asked JOIN idf USING (scope, tok) JOIN post USING (scope, layer, tok) GROUP BY query_id, layer, row_ord),
top_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, row_ord) AS rank
         FROM scored WHERE score > 0 QUALIFY rank <= {top}),
bm25 AS (SELECT query_id, layer, rank, row_ord, score,
           CASE WHEN layer = 'CHATGPT' THEN ref ELSE name END AS name,
           CASE WHEN layer = 'CHATGPT' THEN name ELSE page END AS page, substr(blob, 1, 300) AS snippet
         FROM top_ JOIN rows_ USING (layer, row_ord))"""


def bm25_topk(spark, sf_dir):
    """Benchmark passages against documents, word tokens."""
    q = T.text_queries(spark, sf_dir)
    terms = q.select("query_id", F.lit(0).alias("ord"), F.lower("q").alias("term"))
    return S.search_bm25(T.document_rows(spark, sf_dir, raw=True), terms, q, mode="word")


QUERIES["bm25_topk"] = bm25_topk
ORACLE["bm25_topk"] = f"""WITH q AS ({T.SQL_TEXT_QUERIES}), terms AS (SELECT query_id, 0 AS ord, lower(q) AS term FROM q),
rows_ AS ({T.sql_document_rows(raw=True)}), {_sql_bm25('word')} SELECT * FROM bm25"""


def _kept_index(spark, sf_dir):
    """An index of the documents in two appended segments, and the passages as terms."""
    path = scratch_path(spark, "inverted")
    rows = T.document_rows(spark, sf_dir, raw=True)
    inverted.append_segment(rows.filter("row_ord % 3 <> 1"), path, "word")
    inverted.append_segment(rows.filter("row_ord % 3 = 1"), path, "word")
    q = T.text_queries(spark, sf_dir)
    return path, q.select("query_id", F.lower("q").alias("term"))


def bm25_index(spark, sf_dir):
    """The passages against the kept index: equal to the search that reads all texts."""
    return inverted.search_index(spark, *_kept_index(spark, sf_dir))


QUERIES["bm25_index"] = bm25_index
ORACLE["bm25_index"] = ORACLE["bm25_topk"]


def bm25_by_product(spark, sf_dir):
    """Statistics per product: half of the queries see only their own source's rows."""
    q = T.word_queries(spark, sf_dir)
    terms = q.select("query_id", F.lit(0).alias("ord"), F.lower("q").alias("term"))
    rows = T.document_rows(spark, sf_dir, raw=True).unionByName(T.chat_rows(spark, sf_dir))
    return S.search_bm25(rows, terms, q, mode="word")


QUERIES["bm25_by_product"] = bm25_by_product
ORACLE["bm25_by_product"] = f"""WITH q AS ({T.SQL_WORD_QUERIES}), terms AS (SELECT query_id, 0 AS ord, lower(q) AS term FROM q),
rows_ AS ({T.sql_document_rows(raw=True)} UNION ALL {T.SQL_CHAT_ROWS}), {_sql_bm25('word')} SELECT * FROM bm25"""


def bm25_corpus_stats(spark, sf_dir):
    q = T.text_queries(spark, sf_dir)
    stats = S.bm25_corpus_stats(T.document_rows(spark, sf_dir), S.Scopes(q), "cjk")
    return stats.select("layer", "tok", "n", "df", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


QUERIES["bm25_corpus_stats"] = bm25_corpus_stats
ORACLE["bm25_corpus_stats"] = f"""WITH q AS ({T.SQL_TEXT_QUERIES}), terms AS (SELECT query_id, 0 AS ord, lower(q) AS term FROM q),
rows_ AS ({T.sql_document_rows()}), {_sql_bm25('cjk')}
SELECT layer, tok, n, df, round(idf.avgdl, 6) AS avg_len, round(idf, 6) AS idf
FROM idf JOIN corpus USING (scope, layer) JOIN df USING (scope, layer, tok)"""


def _part_queries(spark, sf_dir):
    """Each distinct part name as a short question."""
    p = T.table(spark, sf_dir, "part")
    return (p.groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
            .select("query_id", F.lit("").alias("product"), F.col("p_name").alias("q")))


def fuzzy_topk(spark, sf_dir):
    q = _part_queries(spark, sf_dir)
    return S.search_fuzzy(T.document_rows(spark, sf_dir), S.plain_terms(q), q)


QUERIES["fuzzy_topk"] = fuzzy_topk


def fuzzy_names(spark, sf_dir):
    """Names of nations and regions against the part names, both as they stand: short whole texts, so SQL can follow."""
    place = lambda table, key, name, base: T.table(spark, sf_dir, table).select(
        (F.col(key) + base).cast("long").alias("query_id"), F.lit("").alias("product"), F.col(name).alias("q"))
    q = place("nation", "n_nationkey", "n_name", 0).unionByName(place("region", "r_regionkey", "r_name", 1000))
    rows = T.table(spark, sf_dir, "part").select(F.lit("OCR").alias("layer"), F.col("p_partkey").cast("long").alias("row_ord"), F.col("p_brand").alias("name"),
                                                 F.col("p_type").alias("page"), norm(F.col("p_name")).alias("blob"), F.lit("").alias("ref"))
    return S.search_fuzzy(rows, S.plain_terms(q), q, cutoff=45.0)


QUERIES["fuzzy_names"] = fuzzy_names
# The shorter of the two slides over the longer, both ways when equally long. Its common subsequence with a window is a fold over
# the window's characters, each a number whose bits are that character's places in the shorter text.
ORACLE["fuzzy_names"] = f"""WITH q AS (SELECT n_nationkey AS query_id, {T.sql_norm('n_name')} AS term FROM nation
  UNION ALL SELECT r_regionkey + 1000, {T.sql_norm('r_name')} FROM region),
rows_ AS (SELECT p_partkey AS row_ord, p_brand AS name, p_type AS page, {T.sql_norm('p_name')} AS blob FROM part),
met AS (SELECT DISTINCT term, blob FROM q, rows_ WHERE length(term) >= 2 AND blob <> ''),
slid AS (SELECT term, blob, term AS a, blob AS b FROM met WHERE length(term) <= length(blob)
  UNION ALL SELECT term, blob, blob, term FROM met WHERE length(blob) <= length(term)),
bits AS (SELECT a, ch, sum(1::BIGINT << (i - 1))::BIGINT AS bits FROM
  (SELECT a, unnest(string_split(a, '')) AS ch, generate_subscripts(string_split(a, ''), 1) AS i FROM (SELECT DISTINCT a FROM slid)) GROUP BY a, ch),
chars AS (SELECT b, unnest(string_split(b, '')) AS ch, generate_subscripts(string_split(b, ''), 1) AS i FROM (SELECT DISTINCT b FROM slid)),
coded AS (SELECT term, blob, a, list(coalesce(bits, 0) ORDER BY i) AS codes FROM slid JOIN chars USING (b) LEFT JOIN bits USING (a, ch) GROUP BY ALL),
windows AS (SELECT term, blob, length(a) AS m, (1::BIGINT << length(a)) - 1 AS whole,
  unnest(list_transform(range(2 - length(a), len(codes) + 1), lambda s: codes[greatest(s, 1):least(s + length(a) - 1, len(codes))])) AS w FROM coded),
folded AS (SELECT term, blob, m, len(w) AS n, whole, list_reduce(w, lambda s, u: ((s + (s & u)) | (s & ~(s & u))) & whole, whole) AS s FROM windows),
best AS (SELECT term, blob, max(200.0::DOUBLE * bit_count(whole & ~s) / (m + n)) AS score FROM folded GROUP BY term, blob)
SELECT query_id, 'OCR' AS layer, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, row_ord) AS rank, row_ord, round(score, 6) AS score,
  term, name, page, substr(blob, 1, 300) AS snippet
FROM q JOIN best USING (term) JOIN rows_ USING (blob) WHERE score >= 45 QUALIFY rank <= 15"""


def _mixed_queries(spark, sf_dir):
    """Known questions with their sheet, passages, and part names that occur nowhere."""
    big = 1_000_000_000
    known = _lookup_queries(spark, sf_dir)
    passages = T.text_queries(spark, sf_dir).withColumn("query_id", F.col("query_id") + big)
    names = _part_queries(spark, sf_dir).withColumn("query_id", F.col("query_id") + 2 * big)
    return known.unionByName(passages).unionByName(names)


_SQL_MIXED = f"""{_SQL_LOOKUP_QUERIES}
UNION ALL SELECT query_id + 1000000000, product, q FROM ({T.SQL_TEXT_QUERIES})
UNION ALL SELECT min(p_partkey) + 2000000000, '', p_name FROM part GROUP BY p_name"""


def hybrid_search(spark, sf_dir):
    return answer.hybrid_search(_mixed_queries(spark, sf_dir), T.all_rows(spark, sf_dir), T.faq_items(spark, sf_dir),
                                T.word_synonyms(spark, sf_dir), fuzzy=False)


_SQL_HYBRID = f"""{T.sql_terms(_SQL_MIXED, T.SQL_WORD_SYNONYMS).replace('q AS (', 'all_q AS (', 1)
                   .replace('FROM q WHERE', 'FROM all_q WHERE').replace('terms AS (SELECT', 'all_terms AS (SELECT')},
{_SQL_LOOKUP},
lhit AS (SELECT DISTINCT t.query_id, k.sheet, k.item_ord FROM all_terms t JOIN all_q USING (query_id)
         JOIN keys k ON k.key = t.term AND k.sheet = all_q.product),
looked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY item_ord) AS rank, sheet, question, answer, template
           FROM lhit JOIN blobs USING (sheet, item_ord) QUALIFY rank <= 3),
open1 AS (SELECT * FROM all_q WHERE query_id NOT IN (SELECT query_id FROM looked)),
ex AS (WITH q AS (SELECT * FROM open1), terms AS (SELECT * FROM all_terms WHERE query_id IN (SELECT query_id FROM open1)),
       {_sql_hits(T.SQL_ALL_ROWS)}, {_SQL_RANKED} SELECT * FROM ranked),
open2 AS (SELECT * FROM open1 WHERE query_id NOT IN (SELECT query_id FROM ex)),
bm AS (WITH q AS (SELECT * FROM open2), terms AS (SELECT * FROM all_terms WHERE query_id IN (SELECT query_id FROM open2)),
       rows_ AS ({T.SQL_ALL_ROWS}), {_sql_bm25('cjk')} SELECT * FROM bm25),
rc AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, rank, name, page) AS rank,
         round(score, 6) AS score, layer, name, page, row_ord, '' AS term, snippet
       FROM (SELECT *, {_SQL_PLACE} AS place FROM bm
             QUALIFY row_number() OVER (PARTITION BY query_id, layer, name, page
                                        ORDER BY score DESC, {_SQL_PLACE}, rank) = 1) u
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, u.rank, name, page) <= 15),
res AS (SELECT query_id, 'lookup' AS stage, rank, CAST(0 AS DOUBLE) AS score, 'FAQ' AS layer, sheet AS name, '' AS page,
          '' AS term, question AS snippet, question, answer, template FROM looked
        UNION ALL SELECT query_id, stage, rank, score, layer, name, page, term, snippet, coalesce(question, ''),
          coalesce(answer, ''), coalesce(template, '') FROM (
            SELECT *, 'exact' AS stage FROM ex UNION ALL BY NAME SELECT *, 'recall' AS stage FROM rc) h
          LEFT JOIN ({T.SQL_FAQ_ITEMS}) i ON h.layer = 'FAQ' AND i.sheet = h.name AND i.item_ord = h.row_ord
        UNION ALL SELECT query_id, 'not_found', 0, 0, '', '', '', '', '', '', '', '' FROM open2
                  WHERE query_id NOT IN (SELECT query_id FROM rc))"""
QUERIES["hybrid_search"] = hybrid_search
ORACLE["hybrid_search"] = f"WITH {_SQL_HYBRID} SELECT * FROM res"


def hybrid_search_fuzzy(spark, sf_dir):
    """The full cascade with the fuzzy stage, for part names."""
    return answer.hybrid_search(_part_queries(spark, sf_dir), T.all_rows(spark, sf_dir), T.faq_items(spark, sf_dir),
                                T.word_synonyms(spark, sf_dir))


QUERIES["hybrid_search_fuzzy"] = hybrid_search_fuzzy


def misses_from_search(spark, sf_dir):
    q = _mixed_queries(spark, sf_dir)
    terms = S.expand_terms(q, T.word_synonyms(spark, sf_dir))
    hits = S.search_exact(T.all_rows(spark, sf_dir), terms, q, per_row=False)
    return answer.misses_from_search(q, hits.withColumn("stage", F.lit("exact")))


QUERIES["misses_from_search"] = misses_from_search
ORACLE["misses_from_search"] = f"""WITH {T.sql_terms(_SQL_MIXED, T.SQL_WORD_SYNONYMS)}, {_sql_hits(T.SQL_ALL_ROWS)}
SELECT query_id, product, q AS question, 'NOT_FOUND' AS reason, 'record' AS action FROM q
WHERE query_id NOT IN (SELECT query_id FROM hits)"""
