"""Registered chat queries on the driver tables, each with its DuckDB twin.

Conversations are documents whose lines alternate between user and assistant, one row each; turn
tables are the driver's ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportkb.functions.text import is_blank
from supportkb.operators import chat as C
from supportkb.plans import tables as T

QUERIES, ORACLE = {}, {}
_NL = "chr(10)"
WORK = ["that", "ción", "unge", "que", "that", "keit", "ation"]
PRIVATE = ["esta", "ichen", "ment", "ough"]
PHRASES = ["than", "der", "os", "es", "ment", "tion", "zu"]
REPLY = "tion|ción|keit|er"


def _role(i):
    return F.when(i % 2 == 0, "user").otherwise("assistant")


def conversations(spark, sf_dir):
    """Non-blank lines of a document are the messages, user first."""
    d = T.table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda l: ~is_blank(l))
    msgs = F.transform(lines, lambda l, i: F.struct(_role(i).alias("role"), l.alias("text")))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"),
                    F.lit("").alias("project_id"),
                    F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("doc_id") % 17).cast("string"))).alias("project_title"),
                    F.lit("").alias("create_time"), F.lit("").alias("update_time"), msgs.alias("messages"))


def feedback(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark")
    return b.select(F.lit("2026-08-07").alias("date"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("product"),
                    T.word(F.col("text"), 1).alias("issue"),
                    F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("chinese_logic"),
                    F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit("re: "), "text")).alias("japanese_reply"))


_SQL_MSGS = f"""raw_ AS (SELECT doc_id, source, unnest(string_split(text, {_NL})) AS l, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents),
msgs AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, l AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i
  FROM raw_ WHERE {T.sql_keep_case('l')} <> ''),
m AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM msgs),
joined AS (SELECT id, any_value(title) AS title, string_agg(text, {_NL} ORDER BY i) AS all_text, count(*) AS n FROM m GROUP BY id)"""


def _sql_verdict(hay: str) -> str:
    hits = lambda ws: "list_filter([" + ", ".join(f"'{w}'" for w in ws) + f"], lambda w: contains({hay}, w))"
    w, i = hits(WORK), hits(PRIVATE)
    return f"""CASE WHEN len({i}) > 0 AND len({w}) < len({i}) THEN 0 ELSE 1 END AS relevance,
  CASE WHEN len({i}) > 0 AND len({w}) < len({i}) THEN 'irrelevant:' || array_to_string(({i})[1:5], ',')
    WHEN len({w}) > 0 THEN 'work:' || array_to_string(({w})[1:8], ',') ELSE 'unclear:no_strong_signal' END AS reason"""


_SQL_JUDGED = f"""judged AS (SELECT id, title, all_text, n, {_sql_verdict('hay')}
  FROM (SELECT *, {T.sql_norm("all_text || ' ' || title")} AS hay FROM joined))"""


def _classified(spark, sf_dir):
    return C.classify_relevance(conversations(spark, sf_dir), work=WORK, irrelevant=PRIVATE)


def classify_relevance(spark, sf_dir):
    return _classified(spark, sf_dir).filter(F.size("messages") > 0).select("id", "relevance", "reason")


QUERIES["classify_relevance"] = classify_relevance
ORACLE["classify_relevance"] = f"WITH {_SQL_MSGS}, {_SQL_JUDGED} SELECT id, CAST(relevance AS INTEGER) AS relevance, reason FROM judged"


def classify_title(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", C.classify_title(F.col("text"), WORK).alias("keep"))


QUERIES["classify_title"] = classify_title
ORACLE["classify_title"] = ("SELECT conv_id, turn, " + " OR ".join(f"contains({T.sql_norm('text')}, '{w}')" for w in WORK)
                            + " AS keep FROM conversations")


def _files(spark, sf_dir):
    """One file per document; those dividing by 50 count as unreadable."""
    d = T.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("conv_"), F.col("doc_id"), F.lit(".json")).alias("file"),
                    F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 50 != 0).alias("parsed"))


def relevance_report(spark, sf_dir):
    return C.relevance_report(_files(spark, sf_dir), _classified(spark, sf_dir))


QUERIES["relevance_report"] = relevance_report
ORACLE["relevance_report"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}
SELECT 'conv_' || doc_id || '.json' AS file, CASE WHEN doc_id % 50 = 0 THEN 'parse_error' WHEN j.id IS NULL THEN 'no_messages'
  ELSE CAST(relevance AS VARCHAR) END AS verdict, CASE WHEN doc_id % 50 = 0 THEN '' ELSE coalesce(reason, '') END AS reason, source AS title
FROM documents LEFT JOIN judged j ON j.id = CAST(doc_id AS VARCHAR)"""


def reply_pairs(spark, sf_dir):
    return C.reply_pairs(conversations(spark, sf_dir), REPLY).withColumn("place", F.col("place").cast("long"))


QUERIES["reply_pairs"] = reply_pairs
_SQL_PAIRS = f"""pairs AS (SELECT a.id AS conv_id, a.title, a.i AS place, translate(u.text, chr(9) || {_NL}, '  ') AS question,
  translate(a.text, chr(9) || {_NL}, '  ') AS answer FROM m a JOIN m u ON u.id = a.id AND u.i = a.i - 1
  WHERE a.role = 'assistant' AND regexp_matches(a.text, '{REPLY}'))"""
ORACLE["reply_pairs"] = f"WITH {_SQL_MSGS}, {_SQL_PAIRS} SELECT * FROM pairs"


def reply_turns(spark, sf_dir):
    return C.reply_turns(T.table(spark, sf_dir, "conversations"))


QUERIES["reply_turns"] = reply_turns
ORACLE["reply_turns"] = T.SQL_TURN_PAIRS


def opening_text(spark, sf_dir):
    return C.opening_text(T.table(spark, sf_dir, "conversations"))


QUERIES["opening_text"] = opening_text
ORACLE["opening_text"] = f"""SELECT conv_id, translate(string_agg(text, ' ' ORDER BY turn), chr(9) || {_NL}, '  ') AS blob
FROM conversations GROUP BY conv_id"""


def _work(spark, sf_dir):
    return C.work_conversations(_classified(spark, sf_dir), C.feedback_conversations(feedback(spark, sf_dir)))


def corpus_rows(spark, sf_dir):
    rows = C.corpus_rows(_work(spark, sf_dir))
    return rows.select(F.when(F.startswith("id", F.lit("feedback_")), "feedback").otherwise(F.col("id")).alias("id"), "title", "project", "text")


_SQL_FEEDBACK = f"""fb AS (SELECT item_id, 'item' || item_id AS title,
  CASE WHEN item_id % 2 = 0 THEN text ELSE {T.sql_word('text', 1)} END AS q, CASE WHEN item_id % 5 = 0 THEN '' ELSE 're: ' || text END AS a FROM benchmark)"""
QUERIES["corpus_rows"] = corpus_rows
ORACLE["corpus_rows"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}, {_SQL_FEEDBACK}
SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN '' ELSE 'p' || (CAST(id AS BIGINT) % 17) END AS project,
  translate(all_text, chr(9) || {_NL}, '  ') AS text FROM judged WHERE relevance = 1
UNION ALL SELECT 'feedback', title, '人工反馈', translate(q || {_NL} || a, chr(9) || {_NL}, '  ') FROM fb"""


def feedback_pairs(spark, sf_dir):
    return C.feedback_pairs(C.feedback_conversations(feedback(spark, sf_dir))).select("title", "question", "answer")


QUERIES["feedback_pairs"] = feedback_pairs
ORACLE["feedback_pairs"] = f"""WITH {_SQL_FEEDBACK} SELECT title, translate(q, chr(9) || {_NL}, '  ') AS question,
  translate(a, chr(9) || {_NL}, '  ') AS answer FROM fb WHERE a <> ''"""


def corpus_stats(spark, sf_dir):
    return C.corpus_stats(_work(spark, sf_dir), REPLY)


QUERIES["corpus_stats"] = corpus_stats
_SQL_WORK_MSGS = "wm AS (SELECT m.id, m.role, m.text FROM m JOIN judged j USING (id) WHERE relevance = 1)"
_SQL_ALL_MSGS = f"""{_SQL_WORK_MSGS}, am AS (SELECT * FROM wm UNION ALL SELECT 'f' || item_id, 'user', q FROM fb
  UNION ALL SELECT 'f' || item_id, 'assistant', a FROM fb)"""
ORACLE["corpus_stats"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}, {_SQL_FEEDBACK}, {_SQL_ALL_MSGS}
SELECT CAST(sum(length(text)) FILTER (WHERE role = 'user') AS BIGINT) AS user_chars,
  CAST(sum(length(text)) FILTER (WHERE role <> 'user') AS BIGINT) AS assistant_chars,
  count(DISTINCT id) FILTER (WHERE role = 'assistant' AND regexp_matches(text, '{REPLY}')) AS polite_conversations,
  (SELECT count(*) FROM fb) AS feedback_cases FROM am"""


def top_projects(spark, sf_dir):
    work = C.work_conversations(_classified(spark, sf_dir)).withColumn("ord", F.col("id").cast("long"))
    return C.top_projects(work, "ord")


QUERIES["top_projects"] = top_projects
ORACLE["top_projects"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}
SELECT CASE WHEN o % 6 = 0 THEN '未分类' ELSE 'p' || (o % 17) END AS project, count(*) AS n
FROM (SELECT CAST(id AS BIGINT) AS o FROM judged WHERE relevance = 1) GROUP BY 1 ORDER BY n DESC, min(o) LIMIT 12"""


def top_phrases(spark, sf_dir):
    return C.top_phrases(_work(spark, sf_dir), PHRASES, top=5)


QUERIES["top_phrases"] = top_phrases
ORACLE["top_phrases"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}, {_SQL_FEEDBACK}, {_SQL_ALL_MSGS}
SELECT phrase, count(*) AS n FROM am, (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(PHRASES))}) AS p(phrase, ord)
WHERE role = 'assistant' AND contains(text, phrase) GROUP BY phrase, ord ORDER BY n DESC, ord LIMIT 5"""


def corpus_summary(spark, sf_dir):
    classified, work = _classified(spark, sf_dir), _work(spark, sf_dir)
    pairs = C.reply_pairs(C.work_conversations(classified), REPLY).unionByName(
        C.feedback_pairs(C.feedback_conversations(feedback(spark, sf_dir))))
    return C.corpus_summary(_files(spark, sf_dir), classified, work, pairs)


QUERIES["corpus_summary"] = corpus_summary
ORACLE["corpus_summary"] = f"""WITH {_SQL_MSGS}, {_SQL_JUDGED}, {_SQL_FEEDBACK}, {_SQL_ALL_MSGS}, {_SQL_PAIRS}
SELECT (SELECT count(*) FROM documents) AS raw_files, (SELECT count(*) FROM judged WHERE relevance = 1) AS work_conversations,
  (SELECT count(*) FROM fb) AS feedback_cases,
  (SELECT count(*) FROM pairs JOIN judged ON id = conv_id WHERE relevance = 1) + (SELECT count(*) FROM fb WHERE a <> '') AS template_pairs,
  (SELECT count(*) FROM judged WHERE relevance = 0) AS irrelevant_skipped, (SELECT count(*) FROM am) AS total_messages"""


# --- payloads ----------------------------------------------------------------------------------

def _payload_files(spark, sf_dir):
    """Each document as an export file, in four shapes by doc_id: a linear conversation inside a
    list, messages inside a wrapper, a mapping tree, and a mapping tree as a JSON string."""
    d = T.table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda l: ~is_blank(l))
    flat = F.transform(lines, lambda l, i: F.struct(
        F.struct(_role(i).alias("role")).alias("author"),
        F.struct(F.lit("text").alias("content_type"), F.array(l).alias("parts")).alias("content")))
    plain = F.transform(lines, lambda l, i: F.struct(F.upper(_role(i)).alias("role"), l.alias("content")))
    nid = lambda i: F.concat(F.lit("n"), i.cast("string"))
    tree = F.map_from_entries(F.transform(lines, lambda l, i: F.struct(nid(i).alias("key"), F.struct(
        F.when(i > 0, nid(i - 1)).alias("parent"),
        F.struct(F.struct(_role(i).alias("role")).alias("author"), F.struct(F.array(F.struct(l.alias("text"))).alias("parts")).alias("content")).alias("message")).alias("value"))))
    head = [F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), (F.col("doc_id") + 0.5).alias("create_time")]
    kind = F.col("doc_id") % 4
    no_id = head[1:]
    mapped = F.to_json(F.struct(*head, tree.alias("mapping"), F.when(F.size(lines) > 0, nid(F.size(lines) - 1)).alias("current_node")))
    text = (F.when(kind == 0, F.to_json(F.array(F.struct(*head, flat.alias("linear_conversation")))))
            .when(kind == 1, F.to_json(F.struct(F.array(F.struct(*no_id, plain.alias("messages"))).alias("items"))))
            .when(kind == 2, mapped)
            .otherwise(F.concat(F.lit('"'), F.replace(F.replace(mapped, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))))
    return d.select(F.concat(F.lit("folder"), (F.col("doc_id") % 3).cast("string")).alias("folder"), text.alias("text"))


def _parsed(spark, sf_dir):
    return C.payload_header(C.scan_chat_exports(_payload_files(spark, sf_dir)), "folder")


def scan_chat_exports(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "title", "create_time", "update_time", "project_title")


QUERIES["scan_chat_exports"] = scan_chat_exports
ORACLE["scan_chat_exports"] = f"""WITH d AS (SELECT *, strftime(make_timestamp(doc_id * 1000000 + 500000), '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM documents)
SELECT CASE WHEN doc_id % 4 = 1 THEN 'imp_' || substr(sha1(source || '|' || iso), 1, 16) ELSE CAST(doc_id AS VARCHAR) END AS id,
  source AS title, iso AS create_time, '' AS update_time, 'folder' || (doc_id % 3) AS project_title FROM d"""


def extract_messages(spark, sf_dir):
    p = _parsed(spark, sf_dir).select("title", "create_time", F.posexplode(C.extract_messages(F.col("payload"))).alias("i", "m"))
    return p.select("title", "create_time", F.col("i").cast("long").alias("i"), "m.role", "m.text")


QUERIES["extract_messages"] = extract_messages
ORACLE["extract_messages"] = f"""WITH {_SQL_MSGS}
SELECT title, strftime(make_timestamp(CAST(id AS BIGINT) * 1000000 + 500000), '%Y-%m-%dT%H:%M:%S.%fZ') AS create_time, i, role, text FROM m"""


def linearize_tree(spark, sf_dir):
    """Turns as a tree: each turn's parent is the turn before; odd conversations branch, and every
    ninth one has a cycle at its root."""
    c = T.table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 9 == 0, F.lit(1))).otherwise(
        F.when((F.col("conv_id") % 2 == 1) & (F.col("turn") >= 2), F.col("turn") - 2).otherwise(F.col("turn") - 1))
    nodes = c.select("conv_id", F.col("turn").alias("node"), parent.cast("long").alias("parent"))
    current = c.groupBy("conv_id").agg(F.max("turn").alias("node"))
    path = C.linearize_tree(nodes, current)
    return path.join(c.select("conv_id", F.col("turn").alias("node"), "role"), ["conv_id", "node"]).select("conv_id", "node", "place", "role")


QUERIES["linearize_tree"] = linearize_tree
ORACLE["linearize_tree"] = """WITH RECURSIVE nodes AS (SELECT conv_id, turn AS node, role,
  CASE WHEN turn = 0 THEN CASE WHEN conv_id % 9 = 0 THEN 1 END WHEN conv_id % 2 = 1 AND turn >= 2 THEN turn - 2 ELSE turn - 1 END AS parent
  FROM conversations),
walk AS (SELECT conv_id, node, parent, role, [node] AS path FROM nodes n WHERE node = (SELECT max(turn) FROM conversations c WHERE c.conv_id = n.conv_id)
  UNION ALL SELECT n.conv_id, n.node, n.parent, n.role, list_append(w.path, n.node) FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.node = w.parent
  WHERE NOT list_contains(w.path, n.node))
SELECT conv_id, node, max(len(path)) OVER (PARTITION BY conv_id) - len(path) AS place, role FROM walk"""


# --- import state ------------------------------------------------------------------------------

def _import_batch(spark, sf_dir):
    """Stored conversations (two of three) and a batch in which every turn re-delivers its
    conversation; the update time changes with turn div 2."""
    c = T.table(spark, sf_dir, "conversations")
    version = lambda t: F.concat(F.lit("v"), F.floor(t / 2).cast("string"))
    batch = c.select(F.col("conv_id").cast("string").alias("id"), version(F.col("turn")).alias("update_time"),
                     F.col("text").alias("payload"), (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("ord"))
    state = (c.filter("turn = 0 AND conv_id % 3 <> 0").select(
        F.col("conv_id").cast("string").alias("id"), F.lit("v0").alias("update_time"), F.lit("old").alias("payload"), F.lit(-1).cast("long").alias("ord")))
    return state, batch


_SQL_IMPORT = """state_ AS (SELECT CAST(conv_id AS VARCHAR) AS id, 'v0' AS update_time, 'old' AS payload, -1 AS ord FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0),
batch_ AS (SELECT CAST(conv_id AS VARCHAR) AS id, 'v' || (turn // 2) AS update_time, text AS payload, turn * 1000000 + conv_id AS ord FROM conversations),
judged AS (SELECT b.*, coalesce(coalesce(lag(b.update_time) OVER (PARTITION BY b.id ORDER BY b.ord), s.update_time) <> b.update_time, true) AS imported
  FROM batch_ b LEFT JOIN state_ s ON s.id = b.id)"""


def import_decisions(spark, sf_dir):
    state, batch = _import_batch(spark, sf_dir)
    return C.import_decisions(state, batch, "ord", block=3_000_000).select("id", "ord", "update_time", "imported")


QUERIES["import_decisions"] = import_decisions
ORACLE["import_decisions"] = f"WITH {_SQL_IMPORT} SELECT id, ord, update_time, imported FROM judged"


def import_counts(spark, sf_dir):
    state, batch = _import_batch(spark, sf_dir)
    return C.import_counts(C.import_decisions(state, batch, "ord"))


QUERIES["import_counts"] = import_counts
ORACLE["import_counts"] = f"WITH {_SQL_IMPORT} SELECT count_if(imported) AS imported, count_if(NOT imported) AS skipped FROM judged"


def upsert_conversations(spark, sf_dir):
    return C.upsert_conversations(*_import_batch(spark, sf_dir), "ord")


QUERIES["upsert_conversations"] = upsert_conversations
_SQL_UPSERTED = """newest AS (SELECT id, update_time, payload, ord FROM judged WHERE imported QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"""
ORACLE["upsert_conversations"] = f"""WITH {_SQL_IMPORT}, {_SQL_UPSERTED}
SELECT id, update_time, payload, ord FROM newest UNION ALL SELECT * FROM state_ WHERE id NOT IN (SELECT id FROM newest)"""


def pending_after_import(spark, sf_dir):
    state, batch = _import_batch(spark, sf_dir)
    pending = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return C.pending_after_import(pending, C.import_decisions(state, batch, "ord"))


QUERIES["pending_after_import"] = pending_after_import
ORACLE["pending_after_import"] = f"""WITH {_SQL_IMPORT} SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM judged WHERE imported)"""


def incremental_worklist(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    listed = c.select(cid.alias("id"), F.col("text").alias("title"), F.concat(F.lit("v"), (F.col("conv_id") % 4).cast("string")).alias("update_time"),
                      (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("ord"))
    heads = c.filter("turn = 0")
    state = heads.filter("conv_id % 3 = 0").select(cid.alias("id"), F.lit("v0").alias("update_time"))
    pending = heads.filter("conv_id % 5 = 0").select(cid.alias("id"), F.col("conv_id").alias("ord"))
    on_disk = heads.filter("conv_id % 7 = 0").select(cid.alias("id"))
    return C.incremental_worklist(listed, state, pending, on_disk)


QUERIES["incremental_worklist"] = incremental_worklist
ORACLE["incremental_worklist"] = """WITH h AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'v' || (conv_id % 4) END AS update_time,
  CASE WHEN conv_id % 5 = 0 THEN 'pending' ELSE 'listed' END AS source, conv_id AS ord FROM h
WHERE conv_id % 5 = 0 OR CASE WHEN conv_id % 3 = 0 THEN conv_id % 4 <> 0 ELSE conv_id % 7 <> 0 END"""
