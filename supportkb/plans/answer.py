"""The whole question-to-answer cascade for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supportkb.functions.text import norm
from supportkb.operators import search as S
from supportkb.operators.containment import contains_join
from supportkb.sizing import cut_lineage


def hybrid_search(queries: DataFrame, rows: DataFrame, faq_items: DataFrame, synonyms: DataFrame,
                  mode: str = "cjk", fuzzy: bool = True) -> DataFrame:
    """Lookup, else exact, else fuzzy and BM25, else NOT_FOUND - decided per query.

    Each stage only sees the queries the stage before left open. The short result of a stage is
    written to the checkpoint folder, because it is read twice: as output and as the anti join
    that narrows the next stage.

    Returns query_id, stage, rank, score, layer, name, page, term, snippet, and of hits in the FAQ layer the item's
    question, answer and template."""
    found = cut_lineage(_lookup_stage(queries, S.expand_terms(queries, synonyms), faq_items, synonyms))
    # The terms are many times the queries, so only those of the queries left open are kept.
    open_q = cut_lineage(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    open_terms = cut_lineage(S.expand_terms(open_q, synonyms))
    exact = cut_lineage(S.rank_exact_hits(S.search_exact(rows, open_terms, open_q), rows, open_terms, open_q))
    open_q2 = open_q.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    left = _of(open_terms, open_q2)
    bm25 = S.search_bm25(rows, left, open_q2, mode=mode)
    near = (S.search_fuzzy(rows, left, open_q2) if fuzzy else
            bm25.withColumn("term", F.lit("")).filter(F.lit(False)))
    recall = cut_lineage(S.rank_recall_hits(near, bm25))
    missing = (open_q2.join(recall.select("query_id").distinct(), "query_id", "left_anti")
               .select("query_id", F.lit("not_found").alias("stage"), F.lit(0).alias("rank"),
                       F.lit(0.0).alias("score"), *[F.lit("").alias(c) for c in _TEXTS]))
    hits = _with_items(_staged(exact, "exact").unionByName(_staged(recall, "recall")), faq_items)
    return found.unionByName(hits).unionByName(missing.withColumns({c: F.lit("") for c in _ITEM}))


_TEXTS = ["layer", "name", "page", "term", "snippet"]
_ITEM = ["question", "answer", "template"]


def _staged(hits: DataFrame, stage: str) -> DataFrame:
    return hits.select("query_id", F.lit(stage).alias("stage"), "rank", "score", *_TEXTS, "row_ord")


def _with_items(hits: DataFrame, faq_items: DataFrame) -> DataFrame:
    """The full item behind each hit of the FAQ layer; the ranked hits are few, so only they are joined."""
    item = faq_items.select(F.lit("FAQ").alias("layer"), F.col("sheet").alias("name"), F.col("item_ord").alias("row_ord"), *_ITEM)
    return (hits.join(item, ["layer", "name", "row_ord"], "left")
            .select("query_id", "stage", "rank", "score", *_TEXTS, *[F.coalesce(c, F.lit("")).alias(c) for c in _ITEM]))


def _of(terms: DataFrame, queries: DataFrame) -> DataFrame:
    return terms.join(queries.select("query_id"), "query_id", "left_semi")


def _lookup_stage(queries: DataFrame, terms: DataFrame, faq_items: DataFrame, synonyms: DataFrame) -> DataFrame:
    asked = queries.filter("product <> ''")
    # Only the sheets that some query names can answer it: an equality, so it narrows the items.
    items = faq_items.join(asked.select(F.col("product").alias("sheet")).distinct(), "sheet", "left_semi")
    hits = S.lookup_fast(cut_lineage(S.build_faq_lookup(items, synonyms)), terms, queries)
    return hits.select("query_id", F.lit("lookup").alias("stage"), "rank", F.lit(0.0).alias("score"),
                       F.lit("FAQ").alias("layer"), F.col("sheet").alias("name"), F.lit("").alias("page"),
                       F.lit("").alias("term"), F.col("question").alias("snippet"), *_ITEM)


def misses_from_search(queries: DataFrame, results: DataFrame, reason: str = "NOT_FOUND") -> DataFrame:
    """Queries that ended without any hit, as miss records."""
    hit = results.filter("stage <> 'not_found'").select("query_id").distinct()
    return (queries.join(hit, "query_id", "left_anti")
            .select("query_id", "product", F.col("q").alias("question"), F.lit(reason).alias("reason"),
                    F.lit("record").alias("action")))


SHOWN = {"MANUALS": 10, "FILES": 5, "PAGE_IMAGES": 8, "CANDIDATE_IMAGES": 10}


def diagnose_not_found(queries: DataFrame, terms: DataFrame, manuals: DataFrame, files: DataFrame,
                       images: DataFrame, pairs: DataFrame, shown: dict[str, int | None] = SHOWN) -> DataFrame:
    """Where a query's content may have been lost: matching manuals with page count and length,
    source files, page images and candidate images whose text holds a term. ``shown`` is how many of each
    section are listed (None: all); total counts all.

    ``manuals``: name, pages, norm_len; ``files``/``images``: path, stem; ``pairs``: pdf_base,
    page_seq, preview (searched as it is, so pass the whole text), image_rel. The first three depend on
    the product only, so they are found once per distinct product and then handed to its queries.
    Returns query_id, section, place, subject, detail, total."""
    asked = queries.select("query_id", norm(F.col("product")).alias("pn"))
    products = asked.select("pn").distinct()

    def matched(df: DataFrame, name_col: str, key: list[str]) -> DataFrame:
        named = df.withColumn("_n", norm(F.col(name_col)))
        by_product = contains_join(named, "_n", products.filter("pn <> ''"), "pn", key=key).drop("pos", "_n")
        everything = df.withColumn("pn", S.empty_text(F.col(name_col))).join(products, "pn", "left_semi").select(*by_product.columns)
        return by_product.unionByName(everything)

    def section(df: DataFrame, owner: str, label: str, *order: str) -> DataFrame:
        rn = F.row_number().over(W.partitionBy(owner).orderBy(*order))
        total = df.groupBy(owner).agg(F.count(F.lit(1)).alias("total"))
        cap = shown.get(label)
        listed = df.withColumn("place", rn)
        return ((listed if cap is None else listed.filter(F.col("place") <= cap)).join(total, owner)
                .select(owner, F.lit(label).alias("section"), "place", "subject", "detail", "total"))

    m = (matched(manuals, "name", ["name"])
         .select("pn", F.col("name").alias("subject"),
                 F.concat(F.lit("pages="), "pages", F.lit(" norm_len="), "norm_len").alias("detail")))
    path = lambda df: matched(df, "stem", ["path"]).select("pn", F.col("path").alias("subject"), F.lit("").alias("detail"))
    by_product = (section(m, "pn", "MANUALS", "subject")
                  .unionByName(section(path(files), "pn", "FILES", "subject"))
                  .unionByName(section(path(images), "pn", "PAGE_IMAGES", "subject")))
    hints = terms.filter(F.char_length("term") >= 2)
    searched = pairs.filter("image_rel <> ''").withColumn("_p", norm(F.col("preview")))
    hit = contains_join(searched, "_p", hints.select("term").distinct(), "term", key=["pdf_base", "page_seq", "image_rel"])
    cand = (hit.select("pdf_base", "page_seq", "image_rel", norm(F.col("pdf_base")).alias("_b"), "term")
            .join(hints.select("query_id", "term"), "term").join(asked, "query_id")
            .filter((F.col("pn") == "") | F.contains("_b", "pn"))
            .select("query_id", F.col("pdf_base").alias("subject"), "page_seq",
                    F.concat(F.lit("page="), "page_seq", F.lit(" -> "), "image_rel").alias("detail")).distinct())
    return (by_product.join(asked, "pn").select("query_id", "section", "place", "subject", "detail", "total")
            .unionByName(section(cand, "query_id", "CANDIDATE_IMAGES", "subject", "page_seq", "detail")))
