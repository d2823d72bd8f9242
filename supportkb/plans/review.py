"""Registered review, gap, job, index and stream queries on the driver tables, each with its
DuckDB twin.

Events are decisions and misses (user = candidate or product); documents are candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types

from supportkb.functions.text import (clean_cell, epoch_to_iso, fallback_id, fingerprint, json_text, preview, redact_pii,
                                      safe_name, snippet, split_lines, unquote_cell)
from supportkb.operators import gaps as G
from supportkb.operators import learning as L
from supportkb.operators import sheets as SH
from supportkb.operators import vision as V
from supportkb.plans import tables as T
from supportkb.sources import files as S
from supportkb.sources import sinks as K
from supportkb.streaming import flows
from supportkb.streaming.late import MissWindows
from supportkb.streaming.merge import ConversationTable
from supportkb.sizing import cut_lineage, scratch_path

QUERIES, ORACLE = {}, {}
_NL = "chr(10)"

# --- text --------------------------------------------------------------------------------------
_MAIL = r"[\p{L}\p{M}\p{N}\p{Pc}.+-]+@[\p{L}\p{M}\p{N}\p{Pc}.-]+\.[A-Za-z]{2,}"


def _sql_redact(x: str) -> str:
    return T.sql_strip(f"regexp_replace(regexp_replace({x}, '{_MAIL}', '[email]', 'g'), '\\d{{10,}}', '[number]', 'g')")


def redact(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", redact_pii(F.col("text")).alias("clean"))


QUERIES["redact_pii"] = redact
ORACLE["redact_pii"] = f"SELECT doc_id, {_sql_redact('text')} AS clean FROM documents"


def fingerprints(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fp"))


QUERIES["fingerprint"] = fingerprints
ORACLE["fingerprint"] = f"SELECT doc_id, sha256(source || {_NL} || lang || {_NL} || text) AS fp FROM documents"


def text_functions(spark, sf_dir):
    """Cells, names, ids, times, previews and snippets over every document."""
    d = T.table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", clean_cell(t).alias("clean"), unquote_cell(F.concat(F.lit(' "'), t, F.lit('""x" '))).alias("unquoted"),
        safe_name(F.concat(F.substring(t, 1, 40), F.lit(' a/b:c?. ..'))).alias("file_name"), preview(t, 120).alias("preview"),
        fallback_id(F.col("source"), F.col("lang")).alias("fid"), epoch_to_iso(F.col("doc_id") * 86399 + 0.25).alias("iso"),
        json_text(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('\\n"'))).otherwise(t)).alias("cell"),
        snippet(t, F.instr(t, F.lit("that")), F.lit("that")).alias("snip"))


QUERIES["text_functions"] = text_functions
_SQL_COLLAPSED = f"regexp_replace({T.sql_strip('text')}, '[ \\t\\r\\n]+', ' ', 'g')"
_SQL_FILE = T.sql_strip("regexp_replace(substr(text, 1, 40) || ' a/b:c?. ..', '[\\\\/:*?\"<>|]', '_', 'g')")
_POS = "greatest(instr(text, 'that') - 80, 1)"
ORACLE["text_functions"] = f"""SELECT doc_id, {_SQL_COLLAPSED} AS clean, replace(text || '""x', '""', '"') AS unquoted,
  CASE WHEN regexp_replace({_SQL_FILE}, '\\.+\\z', '') = '' THEN 'Sheet' ELSE regexp_replace({_SQL_FILE}, '\\.+\\z', '') END AS file_name,
  translate(substr(text, 1, 120), chr(9) || chr(13) || chr(10), '   ') AS preview,
  'imp_' || substr(sha1(source || '|' || lang), 1, 16) AS fid,
  strftime(make_timestamp(doc_id * 86399000000 + 250000), '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
  CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id || {_NL} ELSE text END AS cell,
  substr(text, {_POS}, instr(text, 'that') + 4 + 240 - {_POS}) AS snip FROM documents"""


# --- candidates and decisions ------------------------------------------------------------------

def _drafts(spark, sf_dir):
    """Documents as drafts; the issue is their language, so copies share a fingerprint."""
    d = T.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("Cand"), F.col("doc_id").cast("string")).alias("candidate_id"),
                    F.concat(F.lit("dev"), (F.col("doc_id") % 4).cast("string")).alias("device_id"), F.col("doc_id").alias("created_at"),
                    F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("normal").alias("value"),
                    F.lit("p").alias("product"), F.col("lang").alias("issue"), F.lit("").alias("chinese_logic"), F.col("text").alias("japanese_reply"))


def _candidates(spark, sf_dir):
    return L.new_candidates(_drafts(spark, sf_dir))


def _decisions(spark, sf_dir):
    """Events of three kinds as decisions; the candidate is the user, in either case."""
    e = T.table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for kv in (("purchase", "Approve"), ("error", "reject"), ("signup", "revoke")) for x in kv])
    prefix = F.when(F.col("event_id") % 2 == 0, "Cand").otherwise("CAND")
    return (e.filter("event_type IN ('purchase', 'error', 'signup')")
            .select(F.concat(prefix, F.col("user_id").cast("string")).alias("candidate_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at")
                    if e.schema["ts"].dataType.typeName() == "timestamp" else F.col("ts").alias("created_at"),
                    action[F.col("event_type")].alias("action"), F.col("event_id").alias("ord")))


_SQL_DECISIONS = """dec AS (SELECT 'cand' || user_id AS cid, ts AS created_at, event_id AS ord,
  CASE event_type WHEN 'purchase' THEN 'Approve' WHEN 'error' THEN 'reject' ELSE 'revoke' END AS action FROM events
  WHERE event_type IN ('purchase', 'error', 'signup')),
latest AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY cid ORDER BY created_at DESC, ord) = 1)"""
_SQL_CANDS = f"""cand AS (SELECT doc_id, 'Cand' || doc_id AS candidate_id, lower('Cand' || doc_id) AS cid, lang, {_sql_redact('text')} AS reply,
  CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'normal' END AS value, 'dev' || (doc_id % 4) AS device_id FROM documents),
fp AS (SELECT *, sha256('p' || {_NL} || lang || {_NL} || {_NL} || reply) AS fingerprint FROM cand)"""
_SQL_APPROVED = f"""appr AS (SELECT f.* FROM fp f JOIN latest l USING (cid) WHERE lower(action) = 'approve'
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) = 1)"""


def latest_decision(spark, sf_dir):
    return L.latest_decision(_decisions(spark, sf_dir)).select(F.lower("candidate_id").alias("candidate_id"), "action", "ord")


QUERIES["latest_decision"] = latest_decision
ORACLE["latest_decision"] = f"WITH {_SQL_DECISIONS} SELECT cid AS candidate_id, action, ord FROM latest"


def first_candidate(spark, sf_dir):
    """Candidates delivered by two roots, ids differing in case only."""
    c = _drafts(spark, sf_dir).select("candidate_id", "issue", "ord")
    again = c.select(F.upper("candidate_id").alias("candidate_id"), F.lit("again").alias("issue"), (F.col("ord") + 10_000_000).alias("ord"))
    return L.first_candidate(c.unionByName(again))


QUERIES["first_candidate"] = first_candidate
ORACLE["first_candidate"] = "SELECT 'Cand' || doc_id AS candidate_id, lang AS issue, doc_id AS ord FROM documents"


def new_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("candidate_id", "device_id", "value", "japanese_reply", "fingerprint", "status")


QUERIES["new_candidates"] = new_candidates
ORACLE["new_candidates"] = f"""WITH {_SQL_CANDS} SELECT candidate_id, device_id, value, reply AS japanese_reply, fingerprint, 'pending' AS status FROM fp"""


def approved_cases(spark, sf_dir):
    a = L.approved_cases(_candidates(spark, sf_dir), _decisions(spark, sf_dir))
    return a.select("candidate_id", "fingerprint", "name", "blob")


QUERIES["approved_cases"] = approved_cases
ORACLE["approved_cases"] = f"""WITH {_SQL_DECISIONS}, {_SQL_CANDS}, {_SQL_APPROVED}
SELECT candidate_id, fingerprint, 'p|' || candidate_id AS name, {T.sql_norm("concat_ws(' ', 'p', lang, '', reply)")} AS blob FROM appr"""


def learning_summary(spark, sf_dir):
    c, e = _candidates(spark, sf_dir), _decisions(spark, sf_dir)
    return L.learning_summary(c, L.approved_cases(c, e), e)


QUERIES["learning_summary"] = learning_summary
ORACLE["learning_summary"] = f"""WITH {_SQL_DECISIONS}, {_SQL_CANDS}, {_SQL_APPROVED}
SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM appr) AS approved_cases,
  (SELECT count(*) FROM cand) - (SELECT count(*) FROM appr) AS deduplicated,
  (SELECT count(*) FROM cand WHERE cid NOT IN (SELECT cid FROM dec)) AS undecided"""


def pending_candidates(spark, sf_dir):
    return L.pending_candidates(_candidates(spark, sf_dir), _decisions(spark, sf_dir), high_only=True)


QUERIES["pending_candidates"] = pending_candidates
ORACLE["pending_candidates"] = f"""WITH {_SQL_DECISIONS}, {_SQL_CANDS}
SELECT candidate_id, doc_id AS created_at, 'p' AS product, lang AS issue, reply FROM cand
WHERE value = 'high' AND cid NOT IN (SELECT cid FROM dec) ORDER BY doc_id LIMIT 10"""


def apply_decisions(spark, sf_dir):
    """Labelled documents and all events' users are requested; users beyond the documents are unknown."""
    asked = (T.table(spark, sf_dir, "labels").select(F.concat(F.lit("CAND"), F.col("doc_id").cast("string")).alias("candidate_id"))
             .unionByName(T.table(spark, sf_dir, "orders").select(F.concat(F.lit("cand"), F.col("o_custkey").cast("string")).alias("candidate_id")).distinct()))
    return L.apply_decisions(asked, _drafts(spark, sf_dir), "Approve", "ok")


QUERIES["apply_decisions"] = apply_decisions
ORACLE["apply_decisions"] = """SELECT candidate_id, CASE WHEN d.doc_id IS NULL THEN 'NOT_FOUND' ELSE 'approve' END AS action,
  CASE WHEN d.doc_id IS NULL THEN '' ELSE 'ok' END AS reason
FROM (SELECT 'CAND' || doc_id AS candidate_id, doc_id AS n FROM labels UNION ALL SELECT DISTINCT 'cand' || o_custkey, o_custkey FROM orders) LEFT JOIN documents d ON d.doc_id = n"""


def last_candidate(spark, sf_dir):
    return L.last_candidate(_drafts(spark, sf_dir), "dev1")


QUERIES["last_candidate"] = last_candidate
ORACLE["last_candidate"] = "SELECT 'Cand' || max(doc_id) AS candidate_id FROM documents WHERE doc_id % 4 = 1"


def resolve_sources(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.element_at(F.array(*[F.lit(k) for k in L.SOURCE_PRIORITY]), (F.col("doc_id") % 4 + 1).cast("int"))
    return L.resolve_sources(d.select(
        F.col("source").alias("product"), F.col("lang").alias("issue"), kind.alias("kind"), F.coalesce("quality", F.lit(0)).alias("specificity"),
        F.floor(F.col("doc_id") / 40).alias("updated"), F.col("text").alias("answer")))


QUERIES["resolve_sources"] = resolve_sources
ORACLE["resolve_sources"] = """WITH s AS (SELECT source AS product, lang AS issue, doc_id % 4 AS p, coalesce(quality, 0) AS sp, doc_id // 40 AS u, text AS answer
  FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT *, min(answer) OVER w <> max(answer) OVER w AS conflict, count(*) OVER w AS sources FROM s WINDOW w AS (PARTITION BY product, issue)
  QUALIFY row_number() OVER (PARTITION BY product, issue ORDER BY sp DESC, u DESC, p, answer DESC) = 1)
SELECT product, issue, CASE p WHEN 0 THEN 'sheet' WHEN 1 THEN 'approved' WHEN 2 THEN 'manual' ELSE 'online' END AS kind, answer, conflict, sources FROM b"""


# --- gaps and misses ---------------------------------------------------------------------------

def _gaps(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    part = T.table(spark, sf_dir, "part")
    products = part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("product"),
                           F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand")).alias("faq"),
                           F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("ocr_files"))
    faq = part.filter("p_size % 3 = 0").groupBy(F.col("p_brand").alias("faq")).agg(F.count_if(F.col("p_size") > 45).alias("items"))
    misses = T.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("product"), F.col("props").alias("question"), F.lit(None).cast("string").alias("reason"))
    manuals = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return G.gap_report(manuals, products, faq, misses)


_SQL_GAPS = f"""pr AS (SELECT p_name || ' ' || p_partkey AS product, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS faq, p_size % 7 <> 0 AS has_ocr FROM part),
fc AS (SELECT p_brand AS faq, count_if(p_size > 45) AS items FROM part WHERE p_size % 3 = 0 GROUP BY p_brand),
gaps AS (SELECT 'empty_ocr' AS type, doc_id || '.txt' AS subject, 'normalized_len=' || length({T.sql_keep_case('text')}) AS detail FROM documents WHERE length({T.sql_keep_case('text')}) < 200
  UNION ALL SELECT 'no_faq', product, 'missing faq file: ' || faq FROM pr LEFT JOIN fc USING (faq) WHERE items IS NULL
  UNION ALL SELECT 'no_faq', product, 'faq has zero items' FROM pr JOIN fc USING (faq) WHERE items = 0
  UNION ALL SELECT 'no_ocr', product, 'no OCR files mapped' FROM pr JOIN fc USING (faq) WHERE NOT has_ocr
  UNION ALL SELECT 'miss_record', 'u' || user_id, props || ' | -' FROM events WHERE event_type = 'error')"""
QUERIES["gap_report"] = _gaps
ORACLE["gap_report"] = f"WITH {_SQL_GAPS} SELECT type, subject, detail FROM gaps"


def gap_counts(spark, sf_dir):
    return G.gap_counts(_gaps(spark, sf_dir))


QUERIES["gap_counts"] = gap_counts
ORACLE["gap_counts"] = f"WITH {_SQL_GAPS} SELECT type, count(*) AS n FROM gaps GROUP BY type UNION ALL SELECT 'TOTAL', count(*) FROM gaps"


def _actions(df):
    """Events of three kinds as counter actions per user, with time in microseconds."""
    action = F.create_map(*[F.lit(x) for kv in (("error", "record"), ("purchase", "acknowledge"), ("signup", "reset")) for x in kv])
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (df.filter("event_type IN ('error', 'purchase', 'signup')")
            .select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("product"), F.col("event_id").alias("ord"),
                    micros.alias("micros"), "ts", action[F.col("event_type")].alias("action")))


def miss_cycles(spark, sf_dir):
    a = _actions(T.table(spark, sf_dir, "events")).withColumn("ts", F.col("ord"))
    out = G.miss_cycles(a, ["product"], ["ord"], F.floor(F.col("ord") / 1000))
    return out.select("product", "ord", "records", "reminder_due", "cycles", F.col("last_reminder").alias("last_reminder"))


_SQL_CYCLES = """act AS (SELECT 'u' || user_id AS product, event_id AS ord, CASE event_type WHEN 'error' THEN 'record' WHEN 'purchase' THEN 'acknowledge' ELSE 'reset' END AS action
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
grp AS (SELECT *, count_if(action <> 'record') OVER w AS g, count_if(action = 'acknowledge') OVER w AS cycles FROM act WINDOW w AS (PARTITION BY product ORDER BY ord)),
cnt AS (SELECT product, ord, cycles, count_if(action = 'record') OVER (PARTITION BY product, g ORDER BY ord) AS records,
  first_value(CASE WHEN action = 'acknowledge' THEN ord END) OVER (PARTITION BY product, g ORDER BY ord) AS last_reminder FROM grp)"""
QUERIES["miss_cycles"] = miss_cycles
ORACLE["miss_cycles"] = f"WITH {_SQL_CYCLES} SELECT product, ord, records, records >= 3 AS reminder_due, cycles, last_reminder FROM cnt"


# --- jobs --------------------------------------------------------------------------------------

def _jobs(spark, sf_dir):
    pairs = T.table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 6 == 0, "").otherwise(F.col("url")).alias("image_rel"))
    cells = T.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat(F.lit("media/"), "p_name", "p_type")).alias("media_file"))
    return V.vision_jobs(pairs, cells)


_SQL_JOBS = """jobs AS (SELECT 'manual' AS source, url AS image_rel FROM pages WHERE page_id % 6 <> 0
  UNION ALL SELECT DISTINCT 'xlsx', 'xlsx:media/' || p_name || p_type FROM part WHERE p_size % 9 <> 0)"""
QUERIES["vision_jobs"] = _jobs
ORACLE["vision_jobs"] = f"WITH {_SQL_JOBS} SELECT * FROM jobs"


def shard_jobs(spark, sf_dir):
    return V.shard_jobs(_jobs(spark, sf_dir).distinct(), 4)


QUERIES["shard_jobs"] = shard_jobs
ORACLE["shard_jobs"] = f"""WITH {_SQL_JOBS} SELECT source, image_rel, CAST((row_number() OVER (ORDER BY source, image_rel) - 1) % 4 AS INTEGER) AS shard
FROM (SELECT DISTINCT * FROM jobs)"""


def _results(spark, sf_dir):
    """Descriptions from three shards; later shards repeat rows of earlier ones."""
    p = T.table(spark, sf_dir, "pages")
    status = F.element_at(F.array(F.lit("ok"), F.lit("fail:timeout"), F.lit(""), F.lit("ok")), (F.col("page_id") % 4 + 1).cast("int"))
    shard = lambda i, keep: p.filter(keep).select(
        F.lit("manual").alias("source"), F.col("url").alias("image_rel"), F.lit(i).alias("shard"), "page_id",
        status.alias("status"), F.concat(F.lit(f"d{i}-"), "html").alias("description"))
    return shard(0, "page_id % 2 = 0").unionByName(shard(1, "page_id % 3 = 0")).unionByName(shard(2, "page_id % 5 <> 1"))


_SQL_RESULTS = """res AS (SELECT 'manual' AS source, url AS image_rel, i AS shard, page_id, CASE page_id % 4 WHEN 1 THEN 'fail:timeout' WHEN 2 THEN '' ELSE 'ok' END AS status,
  'd' || i || '-' || html AS description FROM pages, (VALUES (0), (1), (2)) AS v(i)
  WHERE (i = 0 AND page_id % 2 = 0) OR (i = 1 AND page_id % 3 = 0) OR (i = 2 AND page_id % 5 <> 1)),
merged AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY source, image_rel ORDER BY shard, page_id) = 1)"""


def merge_shards(spark, sf_dir):
    return V.merge_shards_first_wins(_results(spark, sf_dir), ["shard", "page_id"])


QUERIES["merge_shards_first_wins"] = merge_shards
ORACLE["merge_shards_first_wins"] = f"WITH {_SQL_RESULTS} SELECT * FROM merged"


def vision_summary(spark, sf_dir):
    return V.vision_summary(merge_shards(spark, sf_dir))


QUERIES["vision_summary"] = vision_summary
ORACLE["vision_summary"] = f"""WITH {_SQL_RESULTS} SELECT count(*) AS total_unique, count_if(status = 'ok') AS ok, count_if(starts_with(status, 'fail')) AS fail,
  count_if(status = '') AS unattempted FROM merged"""


def pending_jobs(spark, sf_dir):
    done = _results(spark, sf_dir)
    fresh = V.pending_jobs(_jobs(spark, sf_dir), done).withColumn("mode", F.lit("new"))
    return fresh.unionByName(V.pending_jobs(_jobs(spark, sf_dir), done, retry_failed=True).withColumn("mode", F.lit("retry")))


QUERIES["pending_jobs"] = pending_jobs
ORACLE["pending_jobs"] = f"""WITH {_SQL_JOBS}, {_SQL_RESULTS}
SELECT source, image_rel, 'new' AS mode FROM jobs WHERE (source, image_rel) NOT IN (SELECT (source, image_rel) FROM res WHERE status <> '')
UNION ALL SELECT source, image_rel, 'retry' FROM jobs WHERE (source, image_rel) NOT IN (SELECT (source, image_rel) FROM res WHERE NOT starts_with(status, 'fail'))"""


def status_filter(spark, sf_dir):
    return V.status_filter(_results(spark, sf_dir)).select("image_rel", "shard", "page_id")


QUERIES["status_filter"] = status_filter
ORACLE["status_filter"] = f"WITH {_SQL_RESULTS} SELECT image_rel, shard, page_id FROM res WHERE status = 'ok'"


def cleaned_counts(spark, sf_dir):
    return V.cleaned_counts(_results(spark, sf_dir))


QUERIES["cleaned_counts"] = cleaned_counts
ORACLE["cleaned_counts"] = f"WITH {_SQL_RESULTS} SELECT count_if(status = 'ok') AS total_ok, count_if(status <> 'ok') AS failed_rows_cleaned FROM res"


def pending_repairs(spark, sf_dir):
    """Documents as weak pages; labelled ones have been tried, successfully when not toxic."""
    d = T.table(spark, sf_dir, "documents")
    todo = d.select(F.col("source").alias("base"), F.col("doc_id").alias("page_seq"),
                    F.when(F.col("n_chars") < 300, F.concat(F.lit("empty_ocr len="), F.col("n_chars").cast("string"))).otherwise("spec_table_missing_values").alias("reason"))
    tried = T.table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("base"), F.col("doc_id").alias("page_seq"), F.when(F.col("toxic") == 1, "fail:x").otherwise("ok").alias("status"))
    return V.pending_repairs(todo, tried)


QUERIES["pending_repairs"] = pending_repairs
ORACLE["pending_repairs"] = """SELECT source AS base, doc_id AS page_seq, 'spec_table_missing_values' AS reason FROM documents
WHERE n_chars >= 300 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1)"""


def repair_summary(spark, sf_dir):
    tried = T.table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "fail:x").otherwise("ok").alias("status"))
    return V.repair_summary(tried)


QUERIES["repair_summary"] = repair_summary
ORACLE["repair_summary"] = "SELECT count_if(toxic <> 1) AS repaired_pages, count_if(toxic = 1) AS failed FROM labels"


# --- sources and sinks -------------------------------------------------------------------------

def _assets(spark, sf_dir):
    """Pages as files: path from url, size of the html."""
    p = T.table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("_p-1.jpg", "_p-x.jpg", ".PDF", "_P-22.PNG", ".xlsx", ".txt")]), (F.col("page_id") % 6 + 1).cast("int"))
    folder = (F.when(F.col("page_id") % 8 == 0, "说明书/m1/规格书").when(F.col("page_id") % 4 == 0, "manuals/规格书").otherwise("manuals/other"))
    name = F.concat(F.element_at(F.array(F.lit("kdocs_"), F.lit("售后方案"), F.lit("Doc")), (F.col("page_id") % 3 + 1).cast("int")), (F.col("page_id") % 40).cast("string"))
    return p.select(F.concat_ws("/", folder, F.concat(name, kind)).alias("path"), F.length("html").cast("long").alias("length"), F.col("page_id").alias("modificationTime"))


_SQL_ASSETS = """files AS (SELECT CASE WHEN page_id % 8 = 0 THEN '说明书/m1/规格书' WHEN page_id % 4 = 0 THEN 'manuals/规格书' ELSE 'manuals/other' END AS folder,
  CASE page_id % 3 WHEN 0 THEN 'kdocs_' WHEN 1 THEN '售后方案' ELSE 'Doc' END || (page_id % 40) ||
  CASE page_id % 6 WHEN 0 THEN '_p-1.jpg' WHEN 1 THEN '_p-x.jpg' WHEN 2 THEN '.PDF' WHEN 3 THEN '_P-22.PNG' WHEN 4 THEN '.xlsx' ELSE '.txt' END AS name,
  length(html) AS length, page_id AS mt FROM pages),
assets AS (SELECT folder || '/' || name AS path, * FROM files)"""


def page_image_names(spark, sf_dir):
    images = _assets(spark, sf_dir).filter(S.extension(F.col("path")).isin(S.IMAGE_TYPES))
    return S.page_image_names(images).select("path", "modificationTime", "base", F.coalesce("num", F.lit(-1)).alias("num"), "parsed")


QUERIES["page_image_names"] = page_image_names
ORACLE["page_image_names"] = rf"""WITH {_SQL_ASSETS} SELECT path, mt AS "modificationTime", regexp_extract(name, '(?i)^(.+)_p-(\d+)\.(jpg|jpeg|png)$', 1) AS base,
  coalesce(TRY_CAST(regexp_extract(name, '(?i)^(.+)_p-(\d+)\.(jpg|jpeg|png)$', 2) AS INTEGER), -1) AS num,
  regexp_matches(name, '(?i)^(.+)_p-(\d+)\.(jpg|jpeg|png)$') AS parsed FROM assets WHERE regexp_matches(name, '(?i)\.(jpg|jpeg|png)$')"""


def dedupe_assets_by_name(spark, sf_dir):
    return S.dedupe_assets_by_name(_assets(spark, sf_dir)).select("base_key", "path", "length", "modificationTime", "copies")


QUERIES["dedupe_assets_by_name"] = dedupe_assets_by_name
ORACLE["dedupe_assets_by_name"] = rf"""WITH {_SQL_ASSETS} SELECT lower(regexp_replace(name, '\.[^.]*$', '')) AS base_key, path, length, mt AS "modificationTime",
  count(*) OVER (PARTITION BY lower(regexp_replace(name, '\.[^.]*$', ''))) AS copies FROM assets
QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(name, '\.[^.]*$', '')) ORDER BY length DESC, mt DESC, path DESC) = 1"""


def select_source_files(spark, sf_dir):
    return S.select_source_files(_assets(spark, sf_dir), "manuals/规格书").select("path", "modificationTime", "kind")


QUERIES["select_source_files"] = select_source_files
ORACLE["select_source_files"] = rf"""WITH {_SQL_ASSETS} SELECT path, mt AS "modificationTime", CASE WHEN regexp_matches(name, '(?i)^kdocs_.*\.txt$') THEN 'sheet_text' ELSE 'workbook' END AS kind
FROM assets WHERE folder <> 'manuals/规格书' AND (regexp_matches(name, '(?i)^kdocs_.*\.txt$') OR regexp_matches(name, '售后.*方案.*\.xlsx$'))"""


def spec_file_filter(spark, sf_dir):
    return S.spec_file_filter(_assets(spark, sf_dir)).select("path", "modificationTime")


QUERIES["spec_file_filter"] = spec_file_filter
ORACLE["spec_file_filter"] = rf"""WITH {_SQL_ASSETS} SELECT path, mt AS "modificationTime" FROM assets WHERE folder = '说明书/m1/规格书' AND regexp_matches(name, '(?i)\.(xlsx|pdf)$')"""


def scan_text_files(spark, sf_dir):
    """Documents written as one text file per source and read back whole."""
    out = scratch_path(spark, "texts")
    c = T.table(spark, sf_dir, "benchmark")
    c.select(F.concat(F.lit("﻿"), "text").alias("value"), "item_id").repartition(4).write.mode("overwrite").partitionBy("item_id").text(out)
    return S.scan_text_files(spark, out).select(F.regexp_replace("text", r"\n\z", "").alias("text"))


QUERIES["scan_text_files"] = scan_text_files
ORACLE["scan_text_files"] = "SELECT text FROM benchmark"


def scan_index_tsv(spark, sf_dir):
    """Documents as index files: one line per text line, cells split at commas as tabs."""
    d = T.table(spark, sf_dir, "documents")
    lines = S.numbered_lines(d.select(F.col("doc_id").cast("string").alias("stem"), F.translate("text", ",", "\t").alias("text")))
    kinds = [S.scan_index_tsv(lines, "line", k, "line_no", h).withColumn("kind", F.lit(k))
             for k, h in (("plain", False), ("paged", True), ("params", True), ("chat", False))]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("row_ord", F.col("row_ord").cast("long"))


_BRK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _sql_tsv(kind: str, k: int, header: bool, name: int, page: str, rest: int | None, blob: str, ref: str) -> str:
    cut = f"array_to_string(c[{rest}:], chr(9))" if rest else blob
    return f"""SELECT i - 1 AS row_ord, c[{name}] AS name, {page} AS page, {cut} AS blob, {ref} AS ref, '{kind}' AS kind FROM cells
  WHERE len(c) >= {k}{' AND i > 1' if header else ''}"""


QUERIES["scan_index_tsv"] = scan_index_tsv
ORACLE["scan_index_tsv"] = f"""WITH t AS (SELECT translate(text, ',', chr(9)) AS t FROM documents),
l AS (SELECT unnest(string_split_regex(t, '{_BRK}')) AS l, generate_subscripts(string_split_regex(t, '{_BRK}'), 1) AS i FROM t),
cells AS (SELECT string_split(l, chr(9)) AS c, i FROM l WHERE l <> '')
{_sql_tsv('plain', 2, False, 1, "''", 2, '', "''")} UNION ALL {_sql_tsv('paged', 3, True, 1, 'c[2]', None, 'c[3]', "''")}
UNION ALL {_sql_tsv('params', 3, True, 1, 'c[2]', 3, '', "''")} UNION ALL {_sql_tsv('chat', 4, False, 2, 'c[3]', 4, '', 'c[1]')}"""


def scan_jsonl_lenient(spark, sf_dir):
    """Turns written as JSON lines, every seventh one broken, and read back leniently."""
    out = scratch_path(spark, "jsonl")
    c = T.table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    c.select(broken.alias("value")).write.mode("overwrite").text(out)
    return S.scan_jsonl_lenient(spark, out, "conv_id long, turn long, role string, text string")


QUERIES["scan_jsonl_lenient"] = scan_jsonl_lenient
ORACLE["scan_jsonl_lenient"] = "SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id + turn) % 7 <> 0"


def index_rows(spark, sf_dir):
    """Three layers in one table; the chat layer stays out unless allowed."""
    f, d, c = T.faq_rows(T.faq_items(spark, sf_dir)), T.document_rows(spark, sf_dir), T.chat_rows(spark, sf_dir)
    return K.index_union(f, d, c).select("layer", "row_ord", "name", "page", "blob")


QUERIES["index_rows"] = index_rows
ORACLE["index_rows"] = f"SELECT layer, row_ord, name, page, blob FROM ({T.SQL_ALL_ROWS}) WHERE layer <> 'CHATGPT'"


def write_index(spark, sf_dir):
    """The index written by layer and read back; one layer is read by partition pruning."""
    out = scratch_path(spark, "index")
    K.write_index(T.all_rows(spark, sf_dir), out)
    return spark.read.parquet(out).filter("layer = 'OCR'").select("layer", "row_ord", "name", "page", "blob")


QUERIES["write_index"] = write_index
ORACLE["write_index"] = f"SELECT layer, row_ord, name, page, blob FROM ({T.sql_document_rows()})"


def build_meta(spark, sf_dir):
    return K.build_meta(T.all_rows(spark, sf_dir))


QUERIES["build_meta"] = build_meta
ORACLE["build_meta"] = f"""WITH r AS ({T.SQL_ALL_ROWS}) SELECT layer, count(*) AS n FROM r GROUP BY layer UNION ALL SELECT 'TOTAL', count(*) FROM r"""


def index_health(spark, sf_dir):
    return K.index_health(T.all_rows(spark, sf_dir))


QUERIES["index_health"] = index_health
ORACLE["index_health"] = f"""WITH r AS ({T.SQL_ALL_ROWS}) SELECT count_if(layer IN ('FAQ', 'OCR', 'KDOCS', 'SPEC')) AS searchable, 0 AS sheet_rows, 'READY_LOCAL_ONLY' AS state FROM r"""


def append_event_log(spark, sf_dir):
    """Two appends of decisions below one folder per device, read back."""
    out = scratch_path(spark, "log")
    e = T.table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("dev"), (F.col("user_id") % 3).cast("string")).alias("device_id"))
    K.append_event_log(e.filter("event_id % 2 = 0"), [out])
    K.append_event_log(e.filter("event_id % 2 = 1"), [out])
    return spark.read.schema("event_id long, event_type string, device_id string").json(out)


QUERIES["append_event_log"] = append_event_log
ORACLE["append_event_log"] = "SELECT event_id, event_type, 'dev' || (user_id % 3) AS device_id FROM events"


def representative_query(spark, sf_dir):
    return S.representative_query(T.faq_items(spark, sf_dir), T.document_rows(spark, sf_dir))


QUERIES["representative_query"] = representative_query
ORACLE["representative_query"] = f"""SELECT sheet AS product, question AS q FROM ({T.SQL_FAQ_ITEMS})
WHERE question <> '' ORDER BY sheet, item_ord LIMIT 1"""


# --- streams -----------------------------------------------------------------------------------

def _stream(spark, sf_dir, table):
    """One of the driver's tables as a stream, whether it is one file or a folder of files: the pattern matches just its name, and
    a path with a pattern may be either."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _drain(spark, stream, mode):
    """Run a stream over what is there and return its rows from a table of files."""
    base, schema = scratch_path(spark, "stream"), stream.schema
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
             .outputMode("append").trigger(availableNow=True).start())
    else:
        schema = types.StructType([*schema.fields, types.StructField("_epoch", types.IntegerType())])
        spark.createDataFrame([], schema).write.parquet(f"{base}/out")     # a stream without rows has no epoch
        write = lambda df, epoch: df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/cp")
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _newest_epoch(df, key):
    """Rows of an update-mode stream: the last one written per key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (key, "_epoch")]), "_epoch").alias("b")).select(key, "b.*")


def stream_decisions(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error', 'signup')")
    d = e.select(F.concat(F.lit("Cand"), F.col("user_id").cast("string")).alias("candidate_id"), F.col("ts").alias("created_at"),
                 F.col("event_type").alias("action"), F.col("event_id").alias("ord"))
    return _newest_epoch(_drain(spark, flows.decisions(d), "update"), "candidate_id").select("candidate_id", "action", "events")


QUERIES["stream_decisions"] = stream_decisions
ORACLE["stream_decisions"] = """SELECT 'cand' || user_id AS candidate_id, event_type AS action, count(*) OVER (PARTITION BY user_id) AS events FROM events
WHERE event_type IN ('purchase', 'error', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"""


def stream_candidates(spark, sf_dir):
    d = _stream(spark, sf_dir, "documents").select(
        F.concat(F.lit("Cand"), F.col("doc_id").cast("string")).alias("candidate_id"), F.lit("p").alias("product"), F.col("lang").alias("issue"),
        F.lit("").alias("chinese_logic"), F.col("text").alias("japanese_reply"))
    return _drain(spark, flows.candidates(d), "append").select("candidate_id", "japanese_reply", "fingerprint", "status")


QUERIES["stream_candidates"] = stream_candidates
ORACLE["stream_candidates"] = f"WITH {_SQL_CANDS} SELECT candidate_id, reply AS japanese_reply, fingerprint, 'pending' AS status FROM fp"


def stream_ingest_exports(spark, sf_dir):
    """Every turn re-delivers its conversation; half of the deliveries repeat an update time."""
    c = _stream(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("v"), F.floor(F.col("turn") / 2).cast("string")).alias("update_time"),
                 F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return _drain(spark, flows.ingest_exports(s), "append").select("id", "update_time")


QUERIES["stream_ingest_exports"] = stream_ingest_exports
ORACLE["stream_ingest_exports"] = "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, 'v' || (turn // 2) AS update_time FROM conversations"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_turns(spark, parts, build, delay_ms):
    """Rows that each of ``parts`` appends to a folder, one run of the stream ``build`` makes of it after each, and a last row of no
    product that moves the watermark past everything."""
    base, provider = scratch_path(spark, "turns"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        end = parts[0].limit(1).select(*[F.timestamp_millis(F.lit(3 * delay_ms)).alias(c) if c == "ts" else F.lit(3000 * delay_ms).alias(c)
                                         if c == "micros" else F.lit("").cast(t).alias(c) if t == "string" else F.lit(-1).cast(t).alias(c)
                                         for c, t in parts[0].dtypes])
        for part in [*parts, end]:
            part.write.mode("append").parquet(f"{base}/in")
            q = (build(spark.readStream.schema(parts[0].schema).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/cp").outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(flows.ALERTS).parquet(f"{base}/out")


def stream_miss_alerts(spark, sf_dir):
    """Events in three triggers that each hold a third from all over the time line; one millisecond per event number."""
    a = (_actions(T.table(spark, sf_dir, "events")).withColumn("ts", F.timestamp_millis(F.col("ord") + 1)).withColumn("micros", (F.col("ord") + 1) * 1000))
    parts = [a.filter(F.pmod(F.xxhash64("ord"), F.lit(3)) == i) for i in range(3)]
    days = 4000
    out = _in_turns(spark, parts, lambda s: flows.miss_alerts(s, delay=f"{days} days", bucket_ms=1 << 16), days * 86_400_000)
    return out.withColumn("last_reminder", F.expr("last_reminder div 1000 - 1"))


QUERIES["stream_miss_alerts"] = stream_miss_alerts
ORACLE["stream_miss_alerts"] = f"WITH {_SQL_CYCLES} SELECT product, ord, records, records >= 3 AS reminder_due, cycles, last_reminder FROM cnt"


def stream_merge_exports(spark, sf_dir):
    """Turns as deliveries of their conversations in three runs of a stream, each merged into a kept table by id bucket; turns
    without text can't be read, two turns share an update time."""
    c = T.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("v"), F.floor(F.col("turn") / 2).cast("string")).alias("update_time"),
                    F.nullif("text", F.lit("")).alias("payload"), F.col("turn").cast("long").alias("ord"))
    base = scratch_path(spark, "merge")
    table = ConversationTable(spark, f"{base}/table", rows.schema, buckets=4)
    for part in ("ord < 2", "ord BETWEEN 2 AND 4", "ord > 4"):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        flows.write_upserts(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), table.merge, f"{base}/cp").awaitTermination()
    counts = table.counts()
    return table.read().withColumns({k: F.lit(counts[k]).cast("long") for k in sorted(counts)})


QUERIES["stream_merge_exports"] = stream_merge_exports
ORACLE["stream_merge_exports"] = """WITH d AS (SELECT CAST(conv_id AS VARCHAR) AS id, 'v' || (turn // 2) AS update_time, nullif(text, '') AS payload, CAST(turn AS BIGINT) AS ord FROM conversations),
j AS (SELECT *, lag(update_time) OVER (PARTITION BY id ORDER BY ord) IS DISTINCT FROM update_time AS imported FROM d WHERE payload IS NOT NULL)
SELECT id, update_time, payload, ord, (SELECT count_if(imported) FROM j) AS imported, (SELECT count_if(NOT imported) FROM j) AS skipped,
  (SELECT count_if(payload IS NULL) FROM d) AS failed FROM j WHERE imported QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1"""


def scan_index_files(spark, sf_dir):
    """Documents written as index lines into a few files, read back in blocks; a line's number relative to its document's first."""
    out = scratch_path(spark, "tsv")
    parts = F.transform(split_lines(F.col("text")), lambda l, i: F.concat_ws("\t", F.col("doc_id").cast("string"), i.cast("string"), l))
    T.table(spark, sf_dir, "documents").select(F.array_join(parts, "\n").alias("value")).write.text(out)
    rows = cut_lineage(S.scan_index_tsv(S.numbered_file_lines(spark, out, "*.txt"), "line", "params", "line_no", False))
    first = rows.groupBy("name").agg(F.min("row_ord").alias("_first"))
    return rows.join(first, "name").select(F.col("name").cast("long").alias("doc_id"), F.col("page").cast("long").alias("line"), "blob",
                                           (F.col("row_ord") - F.col("_first")).alias("place"))


QUERIES["scan_index_files"] = scan_index_files
ORACLE["scan_index_files"] = f"""SELECT doc_id, i - 1 AS line, l AS blob, i - 1 AS place FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{_BRK}')) AS l,
  generate_subscripts(string_split_regex(coalesce(text, ''), '{_BRK}'), 1) AS i FROM documents)"""


def quoted_sheet_files(spark, sf_dir):
    """Documents written as quoted cells that hold line ends, read back in blocks as cleaned cells of one row each."""
    out = scratch_path(spark, "sheets")
    cell = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    T.table(spark, sf_dir, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), cell).alias("value")).write.text(out)
    rows = SH.large_sheet_rows(S.read_sheet_rows(spark, out))
    return rows.select(F.col("cells")[0].cast("long").alias("doc_id"), F.col("cells")[1].alias("cell"))


QUERIES["quoted_sheet_files"] = quoted_sheet_files
ORACLE["quoted_sheet_files"] = rf"""SELECT doc_id, regexp_replace({T.sql_strip('text')}, '[ \t\r\n]+', ' ', 'g') AS cell FROM documents"""


def _rates(stream, slide):
    r = flows.miss_rates(stream.withColumn("ts", F.col("ts").cast("timestamp")), "7 days" if slide else "1 day", slide, "400 days")
    first = F.unix_seconds("start")
    return r.select(first.alias("start_sec"), "product", "misses")


def miss_rate_windows(spark, sf_dir):
    """Misses per product and day, and per sliding week, as a stream in update mode."""
    parts = []
    for name, slide in (("day", None), ("week", "1 day")):
        out = _drain(spark, _rates(_actions(_stream(spark, sf_dir, "events")), slide), "update")
        key = F.concat_ws("|", "start_sec", "product")
        parts.append(_newest_epoch(out.withColumn("k", key), "k").select(F.lit(name).alias("span"), "start_sec", "product", "misses"))
    return parts[0].unionByName(parts[1])


QUERIES["miss_rate_windows"] = miss_rate_windows
ORACLE["miss_rate_windows"] = """WITH m AS (SELECT 'u' || user_id AS product, epoch_us(ts) // 86400000000 AS d FROM events WHERE event_type = 'error')
SELECT 'day' AS span, d * 86400 AS start_sec, product, count(*) AS misses FROM m GROUP BY ALL
UNION ALL SELECT 'week', (d - o) * 86400, product, count(*) FROM m, (SELECT unnest(range(7)) AS o) GROUP BY ALL"""


def stream_approved_cases(spark, sf_dir):
    """Candidates and decisions that arrive in three rounds in no order: some decisions long before their candidate."""
    base = scratch_path(spark, "live")
    c, e = _candidates(spark, sf_dir), _decisions(spark, sf_dir)
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(f"{base}/{name}")
    write = lambda df, epoch: df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")
    for i in range(3):
        for df, name, key in ((c, "candidates", "candidate_id"), (e, "events", "ord")):
            df.filter(F.pmod(F.xxhash64(key), F.lit(3)) == i).write.mode("append").parquet(f"{base}/{name}")
        (flows.live_cases(read(c, "candidates"), read(e, "events")).writeStream.foreachBatch(write).outputMode("update")
         .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination())
    state = _newest_epoch(spark.read.parquet(f"{base}/out"), "_id")
    return flows.approved_now(state).select("candidate_id", "fingerprint", "name", "blob")


QUERIES["stream_approved_cases"] = stream_approved_cases
ORACLE["stream_approved_cases"] = ORACLE["approved_cases"]


def stream_late_misses(spark, sf_dir):
    """Misses per product and day in three rounds of ten days or so, every seventh event a round late, with a delay of three
    days: counts of the rows in time, and of the late ones kept aside."""
    a = _actions(T.table(spark, sf_dir, "events")).select("product", "ord", "micros", "action")
    day = 86_400_000_000
    ends = a.agg(F.min("micros").alias("lo"), F.max("micros").alias("hi")).first()
    lo, span = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    part = F.least(F.lit(2), F.floor((F.col("micros") - lo) * 3 / span) + F.when(F.col("ord") % 7 == 0, 1).otherwise(0))
    base = scratch_path(spark, "late")
    table = MissWindows(spark, f"{base}/table", "product string, ord long, micros long", day, 3 * day, fold=2)
    parts = cut_lineage(a.withColumn("_part", part))
    for i in range(3):
        parts.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(a.schema).parquet(f"{base}/in")
        flows.write_upserts(stream, table.merge, f"{base}/cp").awaitTermination()
    late = table.late().groupBy("product", (F.col("micros") - F.pmod("micros", F.lit(day))).alias("start_micros")).agg(F.count(F.lit(1)).alias("misses"))
    return (table.rates().withColumn("state", F.lit("in time")).unionByName(late.withColumn("state", F.lit("late")))
            .select("state", "product", "start_micros", "misses"))


QUERIES["stream_late_misses"] = stream_late_misses
ORACLE["stream_late_misses"] = """WITH a AS (SELECT 'u' || user_id AS product, event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events
  WHERE event_type IN ('error', 'purchase', 'signup')),
b AS (SELECT min(us) AS lo, max(us) - min(us) + 1 AS span FROM a),
p AS (SELECT a.*, us - us % 86400000000 AS start_micros, least(2, (us - lo) * 3 // span + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS part
  FROM a, b WHERE event_type = 'error'),
w AS (SELECT k.part, max(p.us) - 3 * 86400000000 AS mark FROM (SELECT unnest([1, 2]) AS part) k JOIN p ON p.part < k.part GROUP BY k.part)
SELECT CASE WHEN start_micros + 86400000000 <= mark THEN 'late' ELSE 'in time' END AS state, product, start_micros, count(*) AS misses
FROM p LEFT JOIN w USING (part) GROUP BY ALL"""
