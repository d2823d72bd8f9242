"""Batched retrieval: term expansion, exact, fuzzy and BM25 search, lookup, and ranking.

Tables
  queries     query_id, product, q
  terms       query_id, ord, term              (normalized, in order, distinct per query)
  index_rows  layer, row_ord, name, page, blob, ref
              row_ord orders the rows of a layer; ref is the conversation id in the chat layer
  synonyms    term, expansion, ord             (ord runs over the table in file order)
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from supportkb.functions.fuzzy import best_hits
from supportkb.functions.matching import ahocorasick, expansion_finder
from supportkb.functions.text import TOKENIZERS, norm, snippet, strip
from supportkb.operators.containment import MAX_FINDER_CHARS, MAX_FINDER_TERMS, contains_groups, contains_join
from supportkb.sizing import MAX_BROADCAST_ROWS, broadcast_if, broadcast_if_small, cut_lineage, is_small, measure

# Rank weight of each layer for exact hits, its place in the output order, and the
# factor on fuzzy scores.
LAYERS = [
    ("FAQ", 1000.0, 1, 1.00),
    ("KDOCS", 900.0, 2, 1.00),
    ("SPEC", 950.0, 3, 1.00),
    ("OCR", 980.0, 4, 0.95),
    ("PARAMS", 975.0, 5, 0.95),
    ("APPROVED", 965.0, 6, 0.95),
    ("CHATGPT", 920.0, 7, 0.90),
]
CHAT = "CHATGPT"


def _by_layer(layer: Column, field: int) -> Column:
    out = F.lit(None)
    for row in LAYERS:
        out = F.when(layer == row[0], F.lit(row[field])).otherwise(out)
    return out


def exact_weight(layer: Column) -> Column:
    return _by_layer(layer, 1)


def layer_order(layer: Column) -> Column:
    return _by_layer(layer, 2)


def fuzzy_weight(layer: Column) -> Column:
    return _by_layer(layer, 3)


# --- terms -------------------------------------------------------------------------------------

def expand_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query text, then expansions of every synonym key inside it, then keys of every expansion
    inside it; distinct, first place kept. Returns query_id, ord (from 0), term.

    A bounded synonym table is broadcast and each query expanded in its row, without a shuffle."""
    qn = queries.select("query_id", norm(F.col("q")).alias("qn")).filter("qn <> ''")
    syn = (synonyms.select(norm(F.col("term")).alias("nkey"), norm(F.col("expansion")).alias("nexp"), "ord")
           .filter("nkey <> '' AND nexp <> ''"))
    if ahocorasick is not None and is_small(measure(syn), MAX_FINDER_TERMS, MAX_FINDER_CHARS):
        find = expansion_finder(queries.sparkSession, [tuple(r) for r in syn.collect()])  # bounded by MAX_FINDER_*
        all_terms = F.concat(F.array("qn"), find(F.col("qn")))
        return qn.select("query_id", F.posexplode(all_terms).alias("ord", "term"))
    return _expand_by_joins(qn, syn)


def _expand_by_joins(qn: DataFrame, syn: DataFrame) -> DataFrame:
    distinct_q = qn.select("qn").distinct()
    keys = syn.groupBy("nkey").agg(F.min("ord").alias("key_ord"))

    fwd = (contains_join(distinct_q, "qn", syn.select("nkey").distinct(), "nkey")
           .join(syn, "nkey").select("qn", F.lit(1).alias("step"), "ord", F.col("nexp").alias("term")))
    rev = (contains_join(distinct_q, "qn", syn.select("nexp").distinct(), "nexp")
           .join(syn.select("nexp", "nkey"), "nexp").join(keys, "nkey")
           .select("qn", F.lit(2).alias("step"), F.col("key_ord").alias("ord"), F.col("nkey").alias("term")))
    own = distinct_q.select("qn", F.lit(0).alias("step"), F.lit(0).alias("ord"), F.col("qn").alias("term"))
    placed = (own.unionByName(fwd).unionByName(rev)
              .groupBy("qn", "term").agg(F.min(F.struct("step", "ord")).alias("place")))
    ranked = placed.withColumn("ord", F.row_number().over(W.partitionBy("qn").orderBy("place", "term")) - 1)
    return qn.join(ranked, "qn").select("query_id", F.col("ord").cast("int").alias("ord"), "term")


def plain_terms(queries: DataFrame) -> DataFrame:
    """Terms without a synonym table: the normalized query itself."""
    return (queries.select("query_id", F.lit(0).alias("ord"), norm(F.col("q")).alias("term"))
            .filter("term <> ''"))


# --- product filter ----------------------------------------------------------------------------

def product_matches(product: Column, layer: Column, name: Column, blob: Column) -> Column:
    """Row-wise product filter: the normalized product occurs in the normalized row name; chat
    rows also match on their text. An empty product matches all."""
    pn = norm(product)
    return ((pn == "") | F.contains(norm(name), pn)
            | ((layer == CHAT) & F.contains(norm(blob), pn)))


def scope_key() -> Column:
    return F.when(F.col("layer") == CHAT, F.col("row_ord").cast("string")).otherwise(F.col("name"))


def empty_text(of: Column) -> Column:
    """Always '', but an expression of the row: a literal would be folded out of an equi-join on it
    and leave a nested loop."""
    return F.coalesce(F.substring(of.cast("string"), 1, 0), F.lit(""))


class Scopes:
    """The distinct products of a query batch, and which rows each one selects.

    One look at the query table tells how many queries and products there are. The empty product
    selects every row and needs no join. For the others, (scope, layer, scope_key) pairs are found
    by a containment join over the distinct row names (and chat texts) and written out once."""

    def __init__(self, queries: DataFrame):
        self.products = queries.select(norm(F.col("product")).alias("scope")).distinct()
        seen = (queries.select(norm(F.col("product")).alias("scope"))
                .agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("scope").alias("products"),
                     F.count_if(F.col("scope") == "").alias("open")).first())
        self.n_queries, self.n_products = seen["queries"], seen["products"]
        self.has_open = seen["open"] > 0
        self.has_named = self.n_products > (1 if self.has_open else 0)
        self._members: DataFrame | None = None

    @property
    def few(self) -> bool:
        """Whether a table with one row per (product, layer) is surely small."""
        return self.n_products * len(LAYERS) <= MAX_BROADCAST_ROWS

    def few_hits(self, top: int) -> bool:
        """Whether a table of ``top`` hits per (query, layer) is surely small."""
        return self.n_queries * len(LAYERS) * top <= MAX_BROADCAST_ROWS

    def members(self, rows: DataFrame) -> DataFrame:
        if self._members is None:
            named = self.products.filter("scope <> ''")
            keyed = rows.withColumn("scope_key", scope_key())
            groups = keyed.select("layer", "scope_key", norm(F.col("name")).alias("_name")).distinct()
            by_name = contains_join(groups, "_name", named, "scope", key=["layer", "scope_key"])
            chat = keyed.filter(F.col("layer") == CHAT).select(
                "layer", "scope_key", norm(F.col("blob")).alias("_text"))
            by_text = contains_join(chat, "_text", named, "scope", key=["layer", "scope_key"])
            cols = ["scope", "layer", "scope_key"]
            self._members = broadcast_if_small(cut_lineage(
                by_name.select(*cols).unionByName(by_text.select(*cols)).distinct()))
        return self._members

    def apply(self, df: DataFrame, rows: DataFrame) -> DataFrame:
        """Give each row of ``df`` (with layer, scope_key) one copy per product that selects it."""
        parts = []
        if self.has_open:
            parts.append(df.withColumn("scope", empty_text(F.col(df.columns[-1]))))
        if self.has_named:
            parts.append(df.join(self.members(rows), ["layer", "scope_key"]).select(*df.columns, "scope"))
        if not parts:
            return df.withColumn("scope", F.lit("")).filter(F.lit(False))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- exact -------------------------------------------------------------------------------------

def search_exact(rows: DataFrame, terms: DataFrame, queries: DataFrame, per_row: bool = True) -> DataFrame:
    """Per (query, row) the longest term inside the row, earlier term on ties. Without ``per_row`` only the query_id of each query
    that has any such row, for callers that need no more: the pairs grow with queries times rows.

    The best term is the maximum of one number (length, then earlier ordinal), so the pairs combine
    in a hash aggregate before they are shuffled, and no text travels with them.
    Returns query_id, layer, row_ord, name, page, ord, term, term_len."""
    if not per_row:
        return _queries_with_hits(rows, terms, queries)
    wanted = cut_lineage(terms.join(queries.select("query_id", norm(F.col("product")).alias("_pn")), "query_id"))
    few = is_small(measure(wanted))
    named = rows.select("layer", "row_ord", "name", "page", "blob", norm(F.col("name")).alias("_name"),
                        F.when(F.col("layer") == CHAT, norm(F.col("blob"))).otherwise("").alias("_text"))
    found = contains_join(named, "blob", wanted.select("term").distinct(), "term", key=["layer", "row_ord"])
    pairs = (found.select("layer", "row_ord", "name", "page", "_name", "_text", "term")
             .join(broadcast_if(wanted, few), "term")
             .filter((F.col("_pn") == "") | F.contains("_name", "_pn") | F.contains("_text", "_pn")))
    code = F.char_length("term").cast("long") * _PLACES - F.col("ord")
    best = pairs.groupBy("query_id", "layer", "row_ord", "name", "page").agg(F.max(code).alias("_code"))
    length = F.shiftright(F.col("_code") + (_PLACES - 1), 31)
    return (best.withColumn("term_len", length).withColumn("ord", (length * _PLACES - F.col("_code")).cast("int"))
            .join(broadcast_if(wanted.select("query_id", "ord", "term"), few), ["query_id", "ord"])
            .select("query_id", "layer", "row_ord", "name", "page", "ord", "term", F.col("term_len").cast("int").alias("term_len")))


_PLACES = 1 << 31


def _queries_with_hits(rows: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct query_id with a row that holds any of the query's terms and passes its product filter.

    One hit is enough, so the shortest terms are looked for first, as many as the finder takes in one pass over the texts, and the
    longer ones only for queries still open. What is shuffled are distinct (product, term) pairs, never (query, row) pairs."""
    scope = queries.select("query_id", norm(F.col("product")).alias("scope"))
    asked = (terms.groupBy("query_id").agg(F.collect_set("term").alias("_terms")).join(scope, "query_id")
             .select("query_id", "scope", F.explode("_terms").alias("term")))
    wanted = cut_lineage(asked)
    lengths = (wanted.select("term").distinct().groupBy(F.char_length("term").alias("n")).agg(F.count(F.lit(1)).alias("terms"))
               .orderBy("n").collect())      # a row per length
    short = n_terms = n_chars = 0
    for r in lengths:
        n_terms, n_chars = n_terms + r["terms"], n_chars + r["terms"] * (r["n"] + 8)
        if n_terms > MAX_FINDER_TERMS or n_chars > MAX_FINDER_CHARS:
            break
        short = r["n"]
    scopes, met = Scopes(queries), None
    for part in (wanted.filter(F.char_length("term") <= short), wanted.filter(F.char_length("term") > short)):
        left = part if met is None else cut_lineage(part.join(met, "query_id", "left_anti"))
        if left.isEmpty():
            continue
        hits = cut_lineage(left.join(_met_terms(rows, left, scopes), ["scope", "term"]).select("query_id").distinct())
        met = hits if met is None else met.unionByName(hits)
    return wanted.select("query_id").limit(0) if met is None else met


def _met_terms(rows: DataFrame, wanted: DataFrame, scopes: Scopes) -> DataFrame:
    """Distinct (scope, term) of ``wanted`` with a row that the scope selects and that holds the term."""
    keyed = rows.withColumn("scope_key", scope_key()).select("layer", "row_ord", "scope_key", "blob")
    of = lambda keep: wanted.filter(keep).select("term").distinct()
    kinds = {r[0] for r in wanted.select(F.col("scope") == "").distinct().collect()}
    parts = []
    if True in kinds:
        found = contains_join(keyed.select("layer", "row_ord", "blob"), "blob", of("scope = ''"), "term", key=["layer", "row_ord"])
        parts.append(found.select("term").distinct().withColumn("scope", empty_text(F.col("term"))))
    if False in kinds:
        members = scopes.members(rows)
        inside = keyed.join(members.select("layer", "scope_key").distinct(), ["layer", "scope_key"], "left_semi")
        found = contains_join(inside, "blob", of("scope <> ''"), "term", key=["layer", "row_ord"])
        parts.append(found.select("layer", "scope_key", "term").distinct().join(members, ["layer", "scope_key"])
                     .select("term", "scope").distinct())
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_snippets(hits: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
    """Adds the text around the term to a short list of hits."""
    text = rows.select("layer", "row_ord", "blob")
    return (text.join(broadcast_if(hits, few), ["layer", "row_ord"])
            .select(*hits.columns, snippet(F.col("blob"), F.instr("blob", F.col("term")), F.col("term")).alias("snippet")))


def rank_exact_hits(hits: DataFrame, rows: DataFrame, terms: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """Longest term, then layer weight, then arrival; one hit per (layer, name, page); top 5, each
    with its snippet.

    Inside a (layer, name, page) the weight is the same, so its best hit is the maximum of (length,
    earlier row) - again one number, wide enough for any row ordinal. Terms and texts are fetched
    for the short ranked list only."""
    order = (F.col("term_len").cast("decimal(38,0)") * F.lit(Decimal(10 ** 19)) - F.col("row_ord")).cast("decimal(38,0)")
    uniq = (hits.withColumn("_o", order).groupBy("query_id", "layer", "name", "page")
            .agg(F.max_by("row_ord", "_o").alias("row_ord"), F.max_by("ord", "_o").alias("ord"),
                 F.max("term_len").alias("term_len")))
    by = [F.desc("term_len"), F.desc("score"), layer_order(F.col("layer")), "row_ord", "name", "page"]
    ranked = (uniq.withColumn("score", exact_weight(F.col("layer")))
              .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by)))
              .filter(F.col("rank") <= top).join(terms.select("query_id", "ord", "term"), ["query_id", "ord"])
              .select("query_id", "rank", "score", "layer", "name", "page", "row_ord", "term"))
    return with_snippets(ranked, rows, Scopes(queries).n_queries * top <= MAX_BROADCAST_ROWS)


def enrich_faq_hits(hits: DataFrame, faq_items: DataFrame, rows: DataFrame | None = None, per_sheet: int = 3) -> DataFrame:
    """The first items of each hit sheet that exist and contain any of the query's terms, with their original
    texts; only where the item table has none of a sheet's hits do the first hits' snippets stand in.

    Items carrying any term are exactly the exact hits of the FAQ layer, so no second scan runs.
    ``faq_items``: sheet, item_ord, question, answer, template."""
    faq = hits.filter(F.col("layer") == "FAQ")
    known = faq_items.select(F.col("sheet").alias("name"), F.col("item_ord").alias("row_ord"), F.lit(1).alias("_known"))
    sheet = W.partitionBy("query_id", "name")
    first = (faq.join(known, ["name", "row_ord"], "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
             .withColumns({"pick": F.row_number().over(sheet.orderBy(F.desc("_known"), "row_ord")), "_any": F.max("_known").over(sheet)})
             .filter((F.col("pick") <= per_sheet) & (F.col("_known") == F.col("_any"))).drop("_known", "_any"))
    items = faq_items.select(F.col("sheet").alias("name"), F.col("item_ord").alias("row_ord"),
                             "question", "answer", "template")
    empty = F.lit("")
    instead = empty
    if rows is not None:
        first, instead = with_snippets(first, rows.filter(F.col("layer") == "FAQ"), False), F.col("snippet")
    return (first.join(items, ["name", "row_ord"], "left")
            .select("query_id", F.col("name").alias("sheet"), "pick", "row_ord", "term",
                    F.coalesce("question", instead).alias("question"),
                    *[F.coalesce(F.col(c), empty).alias(c) for c in ("answer", "template")]))


# --- lookup ------------------------------------------------------------------------------------

def build_faq_lookup(faq_items: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Entries with at least one text, and their keys: the normalized question plus every synonym
    key that occurs, or one of whose expansions occurs, in the entry. Keys sorted and distinct."""
    entry = (faq_items.select("sheet", "item_ord", *[strip(F.col(c)).alias(c)
                                                     for c in ("question", "answer", "template")])
             .filter("question <> '' OR answer <> '' OR template <> ''"))
    blobs = entry.select("sheet", "item_ord", norm(F.concat_ws(" ", "question", "answer", "template")).alias("_b"))
    syn = synonyms.select(norm(F.col("term")).alias("syn_key"), norm(F.col("expansion")).alias("word"))
    words = (syn.unionByName(syn.select("syn_key", F.col("syn_key").alias("word")))
             .filter("syn_key <> '' AND word <> ''").distinct())
    empty = F.array().cast("array<string>")
    own = entry.select("sheet", "item_ord", norm(F.col("question")).alias("key")).filter("key <> ''")
    hit = contains_groups(blobs, "_b", words, "word", "syn_key", key=["sheet", "item_ord"]).select("sheet", "item_ord", F.col("syn_key").alias("keys"))
    keys = (hit.unionByName(own.select("sheet", "item_ord", F.array("key").alias("keys"))).groupBy("sheet", "item_ord")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys")))
    return (entry.join(keys, ["sheet", "item_ord"], "left")
            .withColumn("keys", F.coalesce("keys", empty)))


def lookup_fast(lookup: DataFrame, terms: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """Entries of the sheet equal to the product whose keys hold any term; first 3 in sheet order.

    The first 3 of a query are among the first 3 of its keys, so no key brings more, however many entries hold it. Terms
    that are no entry's key are dropped by the hash of the keys before anything is shuffled."""
    entries = lookup.select("sheet", "item_ord", F.explode("keys").alias("key"))
    place = F.dense_rank().over(W.partitionBy("sheet", "key").orderBy("item_ord"))
    entries = cut_lineage(entries.withColumn("_place", place).filter(F.col("_place") <= top).select("sheet", "item_ord", "key").distinct())
    hashes = entries.select(F.xxhash64("key").alias("_h")).distinct()
    known = terms.withColumn("_h", F.xxhash64("term")).join(broadcast_if_small(hashes), "_h", "left_semi")
    asked = (known.join(queries.filter("product <> ''").select("query_id", "product"), "query_id")
             .select("query_id", F.col("product").alias("sheet"), F.col("term").alias("key")))
    hit = asked.join(entries, ["sheet", "key"]).select("query_id", "sheet", "item_ord").distinct()
    rn = F.row_number().over(W.partitionBy("query_id").orderBy("item_ord"))
    return (hit.withColumn("rank", rn).filter(F.col("rank") <= top)
            .join(lookup.select("sheet", "item_ord", "question", "answer", "template"), ["sheet", "item_ord"])
            .select("query_id", "rank", "sheet", "item_ord", "question", "answer", "template"))


# --- fuzzy -------------------------------------------------------------------------------------

def search_fuzzy(rows: DataFrame, terms: DataFrame, queries: DataFrame, cutoff: float = 62.0,
                 top: int = 15, text_chars: int | None = None, pack_size: int = 64,
                 salts: int = 64) -> DataFrame:
    """Best partial ratio of a query's terms (two characters or more) per row, at least ``cutoff``,
    top 15 per query and layer. ``text_chars`` is the length of text the score looks at.

    Distinct terms of a product are packed into short arrays, and each row of that product meets
    each pack once: the texts cross to Python once per pack instead of once per query. A task hands on the top rows
    of each term and layer only, not every pair above the cutoff."""
    scoped = cut_lineage(terms.filter(F.char_length("term") >= 2)
                         .join(queries.select("query_id", norm(F.col("product")).alias("scope")), "query_id"))
    few = is_small(measure(scoped))
    distinct_terms = scoped.select("scope", "term").distinct()
    slots = max(1, distinct_terms.count() // pack_size)
    bucket = F.floor((F.row_number().over(W.partitionBy("scope", "slot").orderBy("term")) - 1) / pack_size)
    packs = (distinct_terms.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(slots)))
             .withColumn("pack_no", bucket).groupBy("scope", "slot", "pack_no")
             .agg(F.array_sort(F.collect_set("term")).alias("pack")))

    text = F.col("blob") if text_chars is None else F.substring("blob", 1, text_chars)
    base = rows.withColumn("scope_key", scope_key()).select("layer", "row_ord", "scope_key", text.alias("_text"))
    scopes = Scopes(queries)
    in_scope = scopes.apply(base, rows)
    if few:
        met = in_scope.join(F.broadcast(packs), "scope")
    else:
        # One product may hold most rows: spread it, and repeat its packs on every spread part.
        spread = in_scope.withColumn("_salt", F.pmod(F.xxhash64("layer", "row_ord"), F.lit(salts)))
        repeated = packs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
        met = spread.join(repeated, ["scope", "_salt"]).drop("_salt")
    found = met.select("scope", "slot", "pack_no", "layer", "row_ord", "_text", "pack")
    schema = StructType([found.schema["scope"], found.schema["layer"], found.schema["row_ord"],
                         StructField("term", StringType()), StructField("_s", LongType())])
    scored = found.mapInArrow(best_hits(cutoff, top, to_arrow_schema(schema)), schema)
    # Best score, then earliest term, as one number: a hash aggregate that combines before the shuffle.
    per_row = (scored.join(broadcast_if(scoped, few), ["scope", "term"])
               .groupBy("query_id", "layer", "row_ord").agg(F.max(F.col("_s") * _PLACES - F.col("ord")).alias("_code"))
               .withColumn("_s", F.shiftright(F.col("_code") + (_PLACES - 1), 31))
               .withColumn("ord", (F.col("_s") * _PLACES - F.col("_code")).cast("int"))
               .withColumn("score", F.col("_s") / 1_000_000))
    rn = F.row_number().over(W.partitionBy("query_id", "layer").orderBy(F.desc("score"), "row_ord"))
    ranked = (per_row.withColumn("rank", rn).filter(F.col("rank") <= top)
              .join(scoped.select("query_id", "ord", "term"), ["query_id", "ord"]))
    return _with_row_text(ranked, rows, scopes.few_hits(top),
                          ["query_id", "layer", "rank", "row_ord", "score", "term"])


def _with_row_text(ranked: DataFrame, rows: DataFrame, few: bool, cols: list[str]) -> DataFrame:
    """Join the row's name and the first 300 characters back onto a short ranked list."""
    chat = F.col("layer") == CHAT
    named = rows.select("layer", "row_ord",
                        F.when(chat, F.col("ref")).otherwise(F.col("name")).alias("name"),
                        F.when(chat, F.col("name")).otherwise(F.col("page")).alias("page"),
                        F.substring("blob", 1, 300).alias("snippet"))
    return (named.join(broadcast_if(ranked, few), ["layer", "row_ord"])
            .select(*cols, "name", "page", "snippet"))


# --- BM25 --------------------------------------------------------------------------------------

def bm25_corpus_stats(rows: DataFrame, scopes: Scopes, mode: str = "cjk", eps: float = 0.25) -> DataFrame:
    """Okapi statistics: scope, layer, tok, n, avg_len, df, idf.

    Counts are first made per name, then summed over the names of each product. A token in more
    than half of the rows gets ``eps`` times the mean idf of all tokens, taken before that.

    Texts are tokenized once: a row's length travels with its first distinct token, or with a NULL if it has none, and the
    counts are written once, as the corpus, the mean and the result all read them."""
    keys = ["layer", "scope_key"] if scopes.has_named else ["layer"]
    each = _tokenized(rows, mode).select(*keys, "doc_len", F.posexplode_outer(F.array_distinct("tokens")).alias("_i", "tok"))
    first = F.coalesce("_i", F.lit(0)) == 0
    counted = cut_lineage(each.groupBy(*keys, "tok").agg(
        F.count(F.lit(1)).alias("df"), F.count_if(first).alias("n"), F.sum(F.when(first, F.col("doc_len")).otherwise(0)).alias("len")))
    per_key = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    corpus = (scopes.apply(per_key, rows).groupBy("scope", "layer")
              .agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len")))
    df = scopes.apply(counted.filter("tok IS NOT NULL").select(*keys, "tok", "df"), rows)
    if scopes.has_named:        # otherwise a (layer, tok) is one row already
        df = df.groupBy("scope", "layer", "tok").agg(F.sum("df").alias("df"))
    raw = df.join(broadcast_if(corpus, scopes.few), ["scope", "layer"]).withColumn(
        "raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    floor = raw.groupBy("scope", "layer").agg((F.avg("raw") * eps).alias("floor"))
    return (raw.join(broadcast_if(floor, scopes.few), ["scope", "layer"])
            .select("scope", "layer", "tok", "n", "avg_len", "df",
                    F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf")))


def _tokenized(rows: DataFrame, mode: str) -> DataFrame:
    return (rows.withColumn("scope_key", scope_key())
            .withColumn("tokens", TOKENIZERS[mode](F.col("blob")))
            .select("layer", "row_ord", "scope_key", "tokens", F.size("tokens").alias("doc_len")))


def search_bm25(rows: DataFrame, terms: DataFrame, queries: DataFrame, top: int = 12,
                mode: str = "cjk", k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """Okapi BM25 of all terms' tokens, repeats counted, positive scores, top 12 per query and layer.

    Only tokens that some query asks for reach the postings; scores are rounded to 6 places before
    ranking so that summation order cannot change the result."""
    scopes = Scopes(queries)
    idf = bm25_corpus_stats(rows, scopes, mode, eps)
    asked = cut_lineage(terms.join(queries.select("query_id", norm(F.col("product")).alias("scope")), "query_id")
                        .select("query_id", "scope", F.explode(TOKENIZERS[mode](F.col("term"))).alias("tok"))
                        .groupBy("query_id", "scope", "tok").agg(F.count(F.lit(1)).alias("qtf")))
    size = measure(asked)
    few_asked = is_small(size, MAX_BROADCAST_ROWS // len(LAYERS))
    needed = broadcast_if(asked.select("tok").distinct(), few_asked)
    weights = (idf.join(broadcast_if(asked, few_asked), ["scope", "tok"])
               .select("query_id", "scope", "layer", "tok", "avg_len", (F.col("qtf") * F.col("idf")).alias("w")))
    # Outer, so that no "size > 0" filter tokenizes the text twice; the join drops the NULL.
    tf = (_tokenized(rows, mode)
          .select("layer", "row_ord", "scope_key", "doc_len", F.explode_outer("tokens").alias("tok"))
          .join(needed, "tok")
          .groupBy("layer", "row_ord", "scope_key", "doc_len", "tok").agg(F.count(F.lit(1)).alias("tf")))
    part = (F.col("w") * F.col("tf") * (k1 + 1)
            / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))))
    scored = (scopes.apply(tf, rows)
              .join(broadcast_if(weights, few_asked), ["scope", "layer", "tok"])
              .groupBy("query_id", "layer", "row_ord").agg(F.round(F.sum(part), 6).alias("score"))
              .filter("score > 0"))
    rn = F.row_number().over(W.partitionBy("query_id", "layer").orderBy(F.desc("score"), "row_ord"))
    ranked = scored.withColumn("rank", rn).filter(F.col("rank") <= top)
    return _with_row_text(ranked, rows, scopes.few_hits(top), ["query_id", "layer", "rank", "row_ord", "score"])


# --- recall ranking ----------------------------------------------------------------------------

def rank_recall_hits(fuzzy: DataFrame, bm25: DataFrame, top: int = 15) -> DataFrame:
    """Fuzzy hits by term length and weighted score, then BM25 hits by score; one per
    (layer, name, page), fuzzy first; top 15."""
    cols = ["query_id", "layer", "row_ord", "name", "page", "term", "score", "snippet", "kind", "rank"]
    f = fuzzy.withColumn("score", F.col("score") * fuzzy_weight(F.col("layer"))).withColumn("kind", F.lit(0))
    m = bm25.withColumn("term", F.lit("")).withColumn("kind", F.lit(1))
    arrival = F.struct((-F.char_length("term")).alias("n"), (-F.col("score")).alias("s"),
                       layer_order(F.col("layer")).alias("l"), F.col("kind").alias("k"), F.col("rank").alias("r"))
    both = f.select(*cols).unionByName(m.select(*cols)).withColumn("_key", arrival).drop("rank")
    uniq = (both.groupBy("query_id", "layer", "name", "page")
            .agg(F.min_by(F.struct("row_ord", "term", "score", "snippet", "_key"), F.col("_key")).alias("b"))
            .select("query_id", "layer", "name", "page", "b.*"))
    rn = F.row_number().over(W.partitionBy("query_id").orderBy("_key", "name", "page"))
    return (uniq.withColumn("rank", rn).filter(F.col("rank") <= top)
            .select("query_id", "rank", F.round("score", 6).alias("score"), "layer", "name", "page", "row_ord",
                    "term", "snippet"))
