"""Review loop: candidates, decisions, approved cases, source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportkb.functions.text import fingerprint, norm, redact_pii
from supportkb.operators.chat import head
from supportkb.operators.summary import side_by_side

CASE_TEXTS = ["product", "issue", "chinese_logic", "japanese_reply"]


def new_candidates(drafts: DataFrame) -> DataFrame:
    """Redact the four texts, fingerprint them, set status pending. Other columns are kept."""
    clean = drafts.select(*[c for c in drafts.columns if c not in CASE_TEXTS],
                          *[redact_pii(F.col(c)).alias(c) for c in CASE_TEXTS])
    return (clean.withColumn("fingerprint", fingerprint(*[F.col(c) for c in CASE_TEXTS]))
            .withColumn("status", F.lit("pending")))


def _id(c: str = "candidate_id") -> Column:
    return F.lower(F.col(c))


def first_candidate(candidates: DataFrame, order: str = "ord") -> DataFrame:
    """First record per candidate id (case-insensitive) over all roots. An aggregate, so copies of
    one hot id combine before the shuffle."""
    cols = F.struct(*candidates.columns)
    return (candidates.filter("candidate_id <> ''").groupBy(_id().alias("_id"))
            .agg(F.min_by(cols, order).alias("b")).select("b.*"))


def latest_decision(events: DataFrame, order: str = "ord") -> DataFrame:
    """Newest event per candidate; of equal times the first read stays."""
    cols = F.struct(*events.columns)
    newest = F.struct(F.col("created_at").alias("t"), (-F.col(order)).alias("o"))
    return (events.filter("candidate_id <> ''").groupBy(_id().alias("_id"))
            .agg(F.max_by(cols, newest).alias("b")).select("b.*"))


def approved_cases(candidates: DataFrame, events: DataFrame, order: str = "ord") -> DataFrame:
    """Candidates whose latest decision is approve, one per fingerprint - the earliest - with the
    name and text they are searched by."""
    ok = (latest_decision(events, order).filter(F.lower(F.col("action")) == "approve")
          .select(_id().alias("_id")))
    return searchable_cases(first_candidate(candidates, order).withColumn("_id", _id()).join(ok, "_id", "left_semi").drop("_id"))


def searchable_cases(kept: DataFrame) -> DataFrame:
    """The earliest approved candidate of each fingerprint with the name and text it is searched by."""
    one = (kept.groupBy("fingerprint")
           .agg(F.min_by(F.struct(*kept.columns), F.struct("created_at", "candidate_id")).alias("b")).select("b.*"))
    return (one.withColumn("name", F.concat_ws("|", "product", "candidate_id"))
            .withColumn("blob", norm(F.concat_ws(" ", *CASE_TEXTS))))


def learning_summary(candidates: DataFrame, approved: DataFrame, events: DataFrame) -> DataFrame:
    """candidates, approved_cases, deduplicated (all others), undecided."""
    undecided = pending(candidates, events)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (side_by_side(one(first_candidate(candidates), "candidates"), one(approved, "approved_cases"), one(undecided, "undecided"))
            .select("candidates", "approved_cases",
                    (F.col("candidates") - F.col("approved_cases")).alias("deduplicated"), "undecided"))


def pending(candidates: DataFrame, events: DataFrame) -> DataFrame:
    decided = events.filter("candidate_id <> ''").select(_id().alias("_id")).distinct()
    return first_candidate(candidates).withColumn("_id", _id()).join(decided, "_id", "left_anti").drop("_id")


def pending_candidates(candidates: DataFrame, events: DataFrame, limit: int = 10, high_only: bool = False,
                       chars: int | None = None) -> DataFrame:
    """The review list: oldest undecided candidates with their replies, whole or the first ``chars`` characters."""
    open_ = pending(candidates, events)
    if high_only:
        open_ = open_.filter(F.lower(F.col("value")) == "high")
    return (open_.orderBy("created_at", "candidate_id").limit(limit)
            .select("candidate_id", "created_at", "product", "issue",
                    head(F.col("japanese_reply"), chars).alias("reply")))


def apply_decisions(requested: DataFrame, candidates: DataFrame, action: str, reason: str = "") -> DataFrame:
    """One row per requested id: the action where the candidate exists, NOT_FOUND where not."""
    known = candidates.select(_id().alias("_id")).distinct()
    asked = requested.withColumn("_id", _id())
    found = asked.join(known, "_id", "left_semi").withColumn("action", F.lit(action.lower())).withColumn("reason", F.lit(reason))
    lost = asked.join(known, "_id", "left_anti").withColumn("action", F.lit("NOT_FOUND")).withColumn("reason", F.lit(""))
    return found.unionByName(lost).drop("_id")


def last_candidate(candidates: DataFrame, device_id: str) -> DataFrame:
    """What a review without ids decides: the device's most recent candidate."""
    own = candidates.filter(F.col("device_id") == device_id)
    return own.agg(F.max_by("candidate_id", F.struct("created_at", "candidate_id")).alias("candidate_id")).filter(
        "candidate_id IS NOT NULL")


# Source kinds by priority, best first.
SOURCE_PRIORITY = ["sheet", "approved", "manual", "online"]


def resolve_sources(statements: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One answer per (product, issue): the more specific, then newer, then by source kind. Flags
    issues whose sources disagree. ``statements``: product, issue, kind, specificity, updated, answer."""
    order = kinds or SOURCE_PRIORITY
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")), F.lit(0)),
                       F.lit(len(order) + 1))
    best = F.max_by(F.struct("kind", "answer", "specificity", "updated"),
                    F.struct("specificity", "updated", (-place).alias("p"), "answer"))
    return (statements.groupBy("product", "issue")
            .agg(best.alias("b"), (F.min("answer") != F.max("answer")).alias("conflict"),
                 F.count(F.lit(1)).alias("sources"))
            .select("product", "issue", "b.kind", "b.answer", "conflict", "sources"))
