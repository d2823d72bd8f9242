"""Chat history: export payloads, messages, relevance, reply pairs, corpus and its numbers.

A conversation is one row with an array of messages, so most operators stay inside the row and
shuffle nothing:

  conversations  id, title, project_id, project_title, create_time, update_time,
                 messages array<struct<role, text>>
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from supportkb import defaults as D
from supportkb.functions.text import contains_any, epoch_to_iso, fallback_id, is_blank, norm, with_fields
from supportkb.operators.ordered import running_last
from supportkb.operators.summary import side_by_side
from supportkb.sizing import cut_lineage

MESSAGES = "array<struct<role: string, text: string>>"


# --- turn tables -------------------------------------------------------------------------------

def reply_turns(turns: DataFrame) -> DataFrame:
    """User turn directly followed by an assistant turn, from a table of numbered turns. An
    equi-join on (conversation, turn) spreads even one huge conversation over all tasks, which a
    window over the conversation would not."""
    users = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return users.join(replies, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer")


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or the whole text."""
    return text if chars is None else F.substring(text, 1, chars)


def opening_text(turns: DataFrame, chars: int | None = None) -> DataFrame:
    """All turns in order joined by blanks, or the first ``chars`` characters of that: conv_id, blob. Turn numbers
    need not be dense."""
    near = turns.select("conv_id", "turn", head(F.col("text"), chars).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return near.groupBy("conv_id").agg(head(F.translate(joined, "\t\n", "  "), chars).alias("blob"))


# --- export payloads ---------------------------------------------------------------------------

def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def unwrap_json(text: Column) -> Column:
    """Parse JSON; a document that is itself a JSON string is parsed once more."""
    return _unwrapped(F.try_parse_json(text))


def _unwrapped(v: Column) -> Column:
    inner = F.try_parse_json(_get(v, "$", "string"))
    return F.when(_is_object(v) | _is_list(v), v).when(_kind(v) == "STRING", F.coalesce(inner, v)).otherwise(v)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_list(v: Column) -> Column:
    """By a cast: a schema would look at every value inside."""
    return _get(v, "$", "array<variant>").isNotNull()


def _is_object(v: Column) -> Column:
    return _get(v, "$", "struct<>").isNotNull()


def scan_chat_exports(files: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """Export files to one payload per conversation. A file is a list, an object, or an object that
    wraps a list as conversations, items or data; other columns (project folder, order) are kept.

    ``name`` is the column of file names: files named .jsonl hold one such document per line, and
    .meta.json files are no exports."""
    if name is not None:
        lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda line: ~is_blank(line))
        parts = F.when(F.lower(F.col(name)).endswith(".jsonl"), lines).otherwise(F.array(F.col(text)))
        files = files.filter(~F.lower(F.col(name)).endswith(".meta.json")).withColumn(text, F.explode(parts))
    kept = [c for c in files.columns if c != text]
    parsed = files.select(*kept, F.try_parse_json(F.col(text)).alias("_v"))
    # a generated column: the filter on it does not parse the file again
    doc = with_fields(parsed, F.struct(_unwrapped(F.col("_v")).alias("_doc"))).drop("_v").filter("_doc IS NOT NULL")
    wrapped = F.coalesce(*[F.when(_is_list(_get(F.col("_doc"), f"$.{k}", "variant")), _get(F.col("_doc"), f"$.{k}", "variant"))
                           for k in ("conversations", "items", "data")])
    items = F.when(_is_list(F.col("_doc")), F.col("_doc")).when(_is_object(F.col("_doc")), wrapped)
    listed = doc.withColumn("_items", items)
    # One list per file, so that a file is parsed once, whatever its shape.
    each = F.when(F.col("_items").isNull(), F.array("_doc")).otherwise(F.try_variant_get("_items", "$", "array<variant>"))
    return listed.select(*kept, F.posexplode_outer(each).alias("pos", "payload")).filter(_is_object(F.col("payload")))


def payload_header(payloads: DataFrame, folder: str | None = None) -> DataFrame:
    """Adds id, title, create_time, update_time and project_title (payload over folder name)."""
    p = F.col("payload")

    def when(field: str) -> Column:
        seconds = _get(p, f"$.{field}", "double")
        is_text = _kind(_get(p, f"$.{field}", "variant")) == "STRING"
        return F.coalesce(F.when(is_text, _get(p, f"$.{field}")).otherwise(epoch_to_iso(seconds)), F.lit(""))

    title = F.coalesce(_get(p, "$.title"), F.lit(""))
    folder_name = F.col(folder) if folder else F.lit("")
    own = F.nullif(F.coalesce(_get(p, "$.meta.project_title"), F.lit("")), F.lit(""))
    out = (payloads.withColumn("title", title).withColumn("create_time", when("create_time"))
           .withColumn("update_time", when("update_time")).withColumn("project_title", F.coalesce(own, folder_name)))
    given = F.nullif(F.coalesce(_get(p, "$.id"), F.lit("")), F.lit(""))
    return out.withColumn("id", F.coalesce(given, fallback_id(F.col("title"), F.col("create_time"))))


def _opened(part: Column) -> Column:
    """One level of a content part opened: the parts of a list, the first of text, content and value of an object that is
    not empty, or the part itself. An empty list or object stands for one empty text."""
    kind = _kind(part)
    empty = F.array(F.try_parse_json(F.lit('""')))
    def field(k):
        v = _get(part, f"$.{k}", "variant")
        return F.when(F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]", "{}", '[""]'), F.lit(None)).otherwise(v)
    listed = F.try_variant_get(part, "$", "array<variant>")
    chosen = F.coalesce(*[field(k) for k in ("text", "content", "value")])
    return (F.when(F.startswith(kind, F.lit("ARRAY")), F.when(F.size(listed) == 0, empty).otherwise(listed))
            .when(F.startswith(kind, F.lit("OBJECT")), F.when(chosen.isNull(), empty).otherwise(F.array(chosen)))
            .otherwise(F.array(part)))


def _depth(part: Column) -> Column:
    """Levels of lists and objects in a part, from the brackets of its JSON outside strings."""
    kind = _kind(part)
    unescaped = F.regexp_replace(F.to_json(part), r"\\.", "")
    brackets = F.regexp_replace(F.regexp_replace(unescaped, '"[^"]*"', ""), r"[^\[\]{}]", "")
    step = lambda b: F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    most = F.aggregate(F.split(brackets, ""), start, lambda at, b: F.struct(
        (at["now"] + step(b)).alias("now"), F.greatest(at["most"], at["now"] + step(b)).alias("most")), lambda at: at["most"])
    return (F.when(kind == "ARRAY<STRING>", F.lit(1))
            .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), most).otherwise(F.lit(0)))


def _part_text(part: Column) -> Column:
    """Text of a content part: a string, a list of parts, or an object with text, content or value, nested as deep as it is."""
    rounds = F.sequence(F.lit(1), F.greatest(_depth(part), F.lit(1)))
    levels = F.aggregate(rounds, F.array(part), lambda parts, _: F.flatten(F.transform(parts, _opened)))
    texts = F.transform(levels, lambda p: F.coalesce(F.when(_kind(p) == "STRING", _get(p, "$")), F.lit("")))
    return F.when(part.isNull(), F.lit("")).otherwise(F.array_join(texts, " "))


def message_text(msg: Column) -> Column:
    """User-facing text of a message variant."""
    content = _get(msg, "$.content", "variant")
    inner = F.coalesce(_get(content, "$.parts", "variant"), _get(content, "$.text", "variant"))
    part = F.when(_is_list(content), content).otherwise(inner)
    nested = F.get(F.transform(F.array(part), _part_text), F.lit(0))       # the part is taken once, then opened
    return F.when(_kind(content) == "STRING", _get(content, "$")).otherwise(nested)


def role_of(msg: Column) -> Column:
    own = F.nullif(F.coalesce(_get(msg, "$.author.role"), F.lit("")), F.lit(""))
    return F.lower(F.coalesce(own, _get(msg, "$.role"), F.lit("")))


def _kept(msgs: Column) -> Column:
    """role and text of user and assistant messages that have text."""
    pairs = F.transform(msgs, lambda m: F.struct(role_of(m).alias("role"), message_text(m).alias("text")))
    return F.filter(pairs, lambda x: x["role"].isin("user", "assistant") & ~is_blank(x["text"]))


@F.pandas_udf(ArrayType(IntegerType()))
def tree_path(ids: pd.Series, parents: pd.Series, current: pd.Series) -> pd.Series:
    """Places of the nodes from the root to the current node, in time linear in the nodes; no text crosses to Python."""
    def path(names, ups, at):
        if names is None:
            return None
        place = {name: i for i, name in enumerate(names)}
        if not at:
            at = max(place.keys() - set(ups), default=None)
        found: dict[int, None] = {}
        i = place.get(at)
        while i is not None and i not in found:
            found[i] = None
            i = place.get(ups[i])
        return list(found)[::-1]
    return pd.Series([path(*row) for row in zip(ids, parents, current)], dtype=object)


def walk_mapping(mapping: Column, current: Column) -> Column:
    """Messages along the path from the current node up to the root, in reading order; null without a mapping.

    Follows parents at most once per node, stopping at a node already seen. Without a current node
    the walk starts at a leaf; of several leaves the greatest id is taken."""
    nodes = F.try_variant_get(mapping, "$", "map<string, variant>")
    path = tree_path(F.map_keys(nodes), F.transform(F.map_values(nodes), lambda n: _get(n, "$.parent")), current)
    walked = F.transform(F.array(F.struct(F.map_values(nodes).alias("nodes"), path.alias("path"))), lambda tree: _kept(F.filter(
        F.transform(tree["path"], lambda i: _get(F.get(tree["nodes"], i), "$.message", "variant")), lambda m: m.isNotNull())))
    return F.get(walked, F.lit(0))


def extract_messages(payload: Column) -> Column:
    """Messages of a payload: linear_conversation, else messages, else the mapping tree."""
    def listed(k: str) -> Column:
        return _get(payload, f"$.{k}", "variant")

    # only trees that are read cross to the walk
    own = _is_list(listed("linear_conversation")) | _is_list(listed("messages"))
    tree = F.when(~own & _is_object(listed("mapping")), listed("mapping"))
    array = lambda k: _kept(F.try_variant_get(payload, f"$.{k}", "array<variant>"))
    return F.coalesce(F.when(_is_list(listed("linear_conversation")), array("linear_conversation"))
                      .when(_is_list(listed("messages")), array("messages"))
                      .otherwise(walk_mapping(tree, _get(payload, "$.current_node"))),
                      F.array().cast(MESSAGES))


def linearize_tree(nodes: DataFrame, current: DataFrame, max_rounds: int = 40) -> DataFrame:
    """The same walk for a table of nodes, for conversations of any size: conv_id, node, place
    (0 at the root end).

    ``nodes``: conv_id, node, parent; ``current``: conv_id, node. Pointer doubling: after round k
    the first 2^k nodes of each path are known and every node knows its 2^k-th ancestor, so a path
    of n nodes takes log2(n) rounds of equi-joins on (conv_id, node). Keeping the least distance
    per node makes cycles end at the first node met again."""
    known = nodes.select("conv_id", F.col("node").alias("parent"))
    jump = nodes.select("conv_id", "node", "parent").join(known, ["conv_id", "parent"], "left_semi")
    jump = cut_lineage(jump.select("conv_id", "node", F.col("parent").alias("up")))
    reach = current.join(nodes, ["conv_id", "node"], "left_semi").select("conv_id", "node", F.lit(0).cast("long").alias("dist"))
    size = -1
    for k in range(max_rounds):
        more = reach.join(jump, ["conv_id", "node"]).select(
            "conv_id", F.col("up").alias("node"), (F.col("dist") + 2 ** k).alias("dist"))
        reach = cut_lineage(reach.unionByName(more).groupBy("conv_id", "node").agg(F.min("dist").alias("dist")))
        n = reach.count()
        if n == size:
            break
        size = n
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id"))
                                     & (F.col("a.up") == F.col("b.node")))
        jump = cut_lineage(twice.select("a.conv_id", "a.node", "b.up"))
    length = reach.groupBy("conv_id").agg(F.max("dist").alias("_last"))
    return reach.join(length, "conv_id").select("conv_id", "node", (F.col("_last") - F.col("dist")).alias("place"))


# --- relevance ---------------------------------------------------------------------------------

def classify_text(hay: Column, work: list[str] | None = None, irrelevant: list[str] | None = None) -> Column:
    """struct<relevance, reason> of a normalized text. Private words must outnumber work words."""
    words = lambda ws: F.array(*[F.struct(F.lit(w).alias("w"), F.lit("".join(w.split()).lower()).alias("n")) for w in ws])
    hits = lambda ws: F.transform(F.filter(words(ws), lambda x: F.contains(hay, x["n"])), lambda x: x["w"])
    w, i = hits(D.WORK_KEYWORDS if work is None else work), hits(D.IRRELEVANT_HINTS if irrelevant is None else irrelevant)
    private = (F.size(i) > 0) & (F.size(w) < F.size(i))
    return F.struct(
        F.when(private, 0).otherwise(1).alias("relevance"),
        F.when(private, F.concat(F.lit("irrelevant:"), F.array_join(F.slice(i, 1, 5), ",")))
        .when(F.size(w) > 0, F.concat(F.lit("work:"), F.array_join(F.slice(w, 1, 8), ",")))
        .otherwise(F.lit("unclear:no_strong_signal")).alias("reason"))


def joined_text(messages: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(messages, lambda m: m["text"]), sep)


def classify_relevance(conversations: DataFrame, **words) -> DataFrame:
    """Adds relevance (1 work, 0 private) and reason, judged on all messages and the title."""
    hay = norm(F.concat(joined_text(F.col("messages")), F.lit(" "), F.coalesce("title", F.lit(""))))
    return with_fields(conversations.withColumn("_hay", hay), classify_text(F.col("_hay"), **words)).drop("_hay")


def classify_title(title: Column, keywords: list[str] | None = None) -> Column:
    """Whether a title alone marks the conversation as work."""
    return contains_any(norm(title), D.TITLE_KEYWORDS if keywords is None else keywords)


def relevance_report(files: DataFrame, classified: DataFrame) -> DataFrame:
    """Every input file with its verdict: parse_error, no_messages, or relevance and reason.

    ``files``: file, id, parsed; ``classified``: id, title, relevance, reason, messages."""
    judged = classified.select("id", "title", "relevance", "reason", (F.size("messages") == 0).alias("_none"))
    verdict = (F.when(~F.col("parsed"), F.lit("parse_error")).when(F.coalesce("_none", F.lit(True)), F.lit("no_messages"))
               .otherwise(F.col("relevance").cast("string")))
    empty = F.lit("")
    return (files.join(judged, "id", "left").withColumn("verdict", verdict)
            .select("file", "verdict",
                    F.when(F.col("verdict").isin("0", "1"), F.col("reason")).otherwise(empty).alias("reason"),
                    F.coalesce("title", empty).alias("title")))


# --- pairs and corpus --------------------------------------------------------------------------

def reply_pairs(conversations: DataFrame, reply_pattern: str = D.PAIR_REPLY, question_chars: int | None = None,
                answer_chars: int | None = None) -> DataFrame:
    """Polite assistant message with the user message right before it: question, answer, conv_id,
    title, place."""
    m = F.col("messages")
    numbered = F.transform(m, lambda x, i: F.struct(
        x["role"].alias("role"), x["text"].alias("text"), i.alias("i"),
        F.when(i > 0, F.get(m, i - 1)).alias("before")))
    hits = F.filter(numbered, lambda x: (x["role"] == "assistant") & (x["i"] > 0) & x["text"].rlike(reply_pattern)
                    & (x["before"]["role"] == "user") & ~is_blank(x["before"]["text"]))
    return (conversations.select(F.col("id").alias("conv_id"), "title", F.explode(hits).alias("h"))
            .select("conv_id", "title", F.col("h.i").alias("place"),
                    head(F.translate("h.before.text", "\t\n", "  "), question_chars).alias("question"),
                    head(F.translate("h.text", "\t\n", "  "), answer_chars).alias("answer")))


def feedback_conversations(feedback: DataFrame) -> DataFrame:
    """Curated cases as two-message conversations. The id adds a content hash to the date, so
    several cases of one day stay apart."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    question = F.coalesce(F.nullif(c("chinese_logic"), F.lit("")), c("issue"))
    content = F.concat_ws("\n", c("product"), c("issue"), c("chinese_logic"), c("japanese_reply"))
    return feedback.select(
        F.concat(F.lit("feedback_"), c("date"), F.lit("_"), F.substring(F.sha1(content), 1, 12)).alias("id"),
        c("product").alias("title"), F.lit("").alias("project_id"), F.lit(D.FEEDBACK_PROJECT).alias("project_title"),
        c("date").alias("create_time"), F.lit("").alias("update_time"),
        F.lit(1).alias("relevance"), F.lit("feedback:curated").alias("reason"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("text")),
                F.struct(F.lit("assistant").alias("role"), c("japanese_reply").alias("text"))).alias("messages"))


def feedback_pairs(feedback_convs: DataFrame, question_chars: int | None = None, answer_chars: int | None = None) -> DataFrame:
    """Feedback replies always make a pair."""
    text = lambda i: F.translate(F.get("messages", F.lit(i))["text"], "\t\n", "  ")
    return (feedback_convs.filter(F.get("messages", F.lit(1))["text"] != "")
            .select(F.col("id").alias("conv_id"), "title", F.lit(1).alias("place"),
                    head(text(0), question_chars).alias("question"),
                    head(text(1), answer_chars).alias("answer")))


def work_conversations(classified: DataFrame, feedback_convs: DataFrame | None = None,
                       include_irrelevant: bool = False) -> DataFrame:
    """Work conversations with messages, and the curated cases."""
    kept = classified.filter(F.size("messages") > 0)
    if not include_irrelevant:
        kept = kept.filter("relevance = 1")
    return kept if feedback_convs is None else kept.unionByName(feedback_convs, allowMissingColumns=True)


def corpus_rows(work: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Search rows: id, title, project, text of all messages."""
    clean = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "\t", " ")
    text = F.translate(joined_text(F.col("messages")), "\t\n", "  ")
    return work.select("id", clean("title").alias("title"), clean("project_title").alias("project"),
                       head(text, text_chars).alias("text"))


# --- numbers -----------------------------------------------------------------------------------

def _chars(role_is_user: bool) -> Column:
    return F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.when(
        (m["role"] == "user") == F.lit(role_is_user), F.char_length(m["text"])).otherwise(0))


def corpus_stats(work: DataFrame, polite: str = D.POLITE_REPLY) -> DataFrame:
    """Characters by side (every role but user counts as assistant), conversations with a polite
    reply, curated cases."""
    has_polite = F.exists("messages", lambda m: (m["role"] == "assistant") & m["text"].rlike(polite))
    return work.agg(F.coalesce(F.sum(_chars(True)), F.lit(0)).alias("user_chars"),
                    F.coalesce(F.sum(_chars(False)), F.lit(0)).alias("assistant_chars"),
                    F.count_if(has_polite).alias("polite_conversations"),
                    F.count_if(F.startswith("id", F.lit("feedback_"))).alias("feedback_cases"))


def top_projects(work: DataFrame, order: str, top: int = 12) -> DataFrame:
    """Most common projects; ties by first appearance."""
    name = F.coalesce(F.nullif(F.col("project_title"), F.lit("")), F.lit(D.NO_PROJECT))
    counted = work.groupBy(name.alias("project")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(top).select("project", "n")


def top_phrases(work: DataFrame, phrases: list[str] | None = None, top: int = 10) -> DataFrame:
    """Assistant messages that contain each phrase. Counted per conversation row first, so only the
    handful of phrase counts is shuffled."""
    words = D.PHRASES if phrases is None else phrases
    listed = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("ord")) for i, p in enumerate(words)])
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    counts = F.transform(listed, lambda p: F.struct(
        p["phrase"].alias("phrase"), p["ord"].alias("ord"),
        F.size(F.filter(said, lambda m: F.contains(m["text"], p["phrase"]))).cast("long").alias("n")))
    return (work.select(F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c"))
            .groupBy("c.phrase", "c.ord").agg(F.sum("c.n").alias("n"))
            .orderBy(F.desc("n"), "ord").limit(top).select("phrase", "n"))


def corpus_summary(files: DataFrame, classified: DataFrame, work: DataFrame, pairs: DataFrame) -> DataFrame:
    """raw_files, work_conversations, feedback_cases, template_pairs, irrelevant_skipped, total_messages."""
    is_feedback = F.startswith("id", F.lit("feedback_"))
    return side_by_side(
        files.agg(F.count(F.lit(1)).alias("raw_files")),
        work.agg(F.count_if(~is_feedback).alias("work_conversations"), F.count_if(is_feedback).alias("feedback_cases"),
                 F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("total_messages")),
        pairs.agg(F.count(F.lit(1)).alias("template_pairs")),
        classified.agg(F.count_if((F.col("relevance") == 0) & (F.size("messages") > 0)).alias("irrelevant_skipped")))


# --- import state ------------------------------------------------------------------------------

def latest_payloads(payloads: DataFrame, order: list[str]) -> DataFrame:
    """Per id the last payload of the batch. An aggregate, so copies of one hot id combine before
    the shuffle."""
    rest = [c for c in payloads.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return payloads.groupBy("id").agg(last.alias("b")).select("id", "b.*")


def import_decisions(state: DataFrame, batch: DataFrame, order: str, block: int = 100_000) -> DataFrame:
    """Adds ``imported``: whether the update time differs from the one last seen for the id, be it
    in the stored state or earlier in the batch. ``order`` numbers the batch."""
    seen = state.select("id", F.col("update_time").alias("_seen"))
    prior = running_last(batch, ["id"], F.floor(F.col(order) / block), [order], "_prev",
                         F.col("update_time"), inclusive=False)
    same = F.coalesce(F.coalesce("_prev", "_seen") == F.col("update_time"), F.lit(False))
    return prior.join(seen, "id", "left").withColumn("imported", ~same).drop("_prev", "_seen")


def upsert_conversations(state: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Stored conversations after a batch: of the imported payloads of an id the last one replaces
    what is stored; everything else stays."""
    newest = latest_payloads(import_decisions(state, batch, order).filter("imported"), [order])
    kept = state.join(newest.select("id"), "id", "left_anti")
    return kept.unionByName(newest.select(*state.columns))


def judged_imports(state: DataFrame, batch: DataFrame, order: str, project: str | None = None, force: bool = False) -> DataFrame:
    """Adds ``outcome``: imported, skipped (its update time is the one last seen) or failed (no payload can be read). With a
    ``project`` only payloads whose folder or title holds it count at all, with ``force`` none is skipped."""
    if project is not None:
        inside = F.contains(F.coalesce("folder", F.lit("")), F.lit(project)) | F.contains(F.coalesce("title", F.lit("")), F.lit(project))
        batch = batch.filter(inside)
    failed = batch.filter("payload IS NULL").withColumn("outcome", F.lit("failed"))
    readable = batch.filter("payload IS NOT NULL")
    if force:
        return readable.withColumn("outcome", F.lit("imported")).unionByName(failed)
    judged = import_decisions(state, readable, order)
    outcome = F.when(F.col("imported"), "imported").otherwise("skipped")
    return judged.withColumn("outcome", outcome).drop("imported").unionByName(failed)


def pending_after_import(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Imported ids leave the pending list."""
    return pending.join(decisions.filter("imported").select("id").distinct(), "id", "left_anti")


def import_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count_if("imported").alias("imported"), F.count_if(~F.col("imported")).alias("skipped"))


def incremental_worklist(listed: DataFrame, state: DataFrame, pending: DataFrame, on_disk: DataFrame,
                         max_items: int | None = None, work_only: bool = False) -> DataFrame:
    """What to fetch: pending ids first, then listed items whose update time changed; one per id.

    ``listed``: id, title, update_time, ord; ``state``: id, update_time; ``pending``: id, ord;
    ``on_disk``: id. Items on disk without state count as seen. Returns id, update_time, source, ord."""
    items = listed.filter(classify_title(F.col("title"))) if work_only else listed
    first = items.groupBy("id").agg(F.min_by(F.struct("update_time", "ord"), "ord").alias("b")).select("id", "b.*")
    seen = state.select("id", F.col("update_time").alias("_seen"))
    disk = on_disk.select("id", F.lit(True).alias("_disk")).distinct()
    changed = (first.join(seen, "id", "left").join(disk, "id", "left")
               .filter(F.when(F.col("_seen").isNotNull(), F.col("_seen") != F.col("update_time"))
                       .otherwise(F.col("_disk").isNull()))
               .select("id", "update_time", F.lit("listed").alias("source"), "ord"))
    first_pending = pending.groupBy("id").agg(F.min("ord").alias("ord"))
    due = first_pending.select("id", F.lit("").alias("update_time"), F.lit("pending").alias("source"), "ord")
    queue = due.unionByName(changed.join(first_pending.select("id"), "id", "left_anti"))
    if max_items is not None:
        queue = queue.orderBy(F.when(F.col("source") == "pending", 0).otherwise(1), "ord", "id").limit(max_items)
    return queue
