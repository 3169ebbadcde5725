"""Screening, verdicts and decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import (
    APPROVE_MIN, DISAGREEMENT_TEXT, EXCLUDING_FLAGS, FRESHNESS_HOURS, PROMPT_VERSION,
    RED_FLAG_PREFIX, REJECT_PREFIX, REVIEW_MIN, RULES_VERSION, SIGNAL_KEYWORDS,
)
from leadmerge.functions import age_hours, clamp, decode_verdict, error_text, is_blank, stale_text
from leadmerge.operators.latest import latest_per_key

RESULT_COLUMNS = (
    "dedup_key", "job_id", "decision", "score", "confidence", "lead_type", "intent",
    "business_status", "contact_status", "is_residential", "is_promotional",
    "requires_manual_review", "reasons", "extracted", "layer", "rules_version",
    "prompt_version", "model", "prompt_tokens", "completion_tokens", "ai_cost_usd", "raw",
)


# -- deterministic layer -----------------------------------------------------------

def keyword_flags(
    message: Column, location: Column, keywords: Mapping[str, Sequence[str]] = SIGNAL_KEYWORDS
) -> Column:
    """Names of the keyword sets that occur in message and location, in order."""
    text = F.lower(
        F.concat(F.coalesce(message, F.lit("")), F.lit(" "), F.coalesce(location, F.lit("")))
    )
    hits = []
    for flag, words in keywords.items():
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        hits.append(F.when(found, F.lit(flag)))
    return F.array_compact(F.array(*hits))


def reject_reason(
    permalink: Column,
    message: Column,
    post_timestamp: Column,
    as_of,
    freshness_hours: float = FRESHNESS_HOURS,
) -> Column:
    """First deterministic reason to reject, else null. A null or future post time
    is never stale."""
    stale = age_hours(post_timestamp, as_of) > freshness_hours
    return (
        F.when(F.coalesce(permalink, F.lit("")) == "", F.lit("missing_or_invalid_proof"))
        .when(is_blank(message), F.lit("missing_message"))
        .when(stale, stale_text(post_timestamp, as_of))
    )


def screen(
    masters: DataFrame,
    as_of,
    *,
    freshness_hours: float = FRESHNESS_HOURS,
    keywords: Mapping[str, Sequence[str]] = SIGNAL_KEYWORDS,
) -> DataFrame:
    """Adds ``reject_reason`` and ``flags`` (empty for rejected leads)."""
    reason = reject_reason(
        F.col("norm_permalink"), F.col("message"), F.col("post_timestamp"), as_of, freshness_hours
    )
    flags = keyword_flags(F.col("message"), F.col("location"), keywords)
    none = F.array().cast("array<string>")
    return masters.withColumn("reject_reason", reason).withColumn(
        "flags", F.when(F.col("reject_reason").isNull(), flags).otherwise(none)
    )


# -- decision ----------------------------------------------------------------------

def with_decision(
    df: DataFrame,
    *,
    approve_min: int = APPROVE_MIN,
    review_min: int = REVIEW_MIN,
    excluding: Sequence[str] = EXCLUDING_FLAGS,
) -> DataFrame:
    """Adds the decision columns for rows with ``verdict`` (struct), ``flags``,
    ``business_name``, ``phone`` and ``postcode``."""
    v = F.col("verdict")
    word = F.upper(F.coalesce(F.nullif(v["verdict"], F.lit("")), F.lit("UNCLEAR")))
    scored = df.withColumn("_word", word).withColumn(
        "score", F.round(clamp(v["opportunity_score"], 0, 100)).cast("int")
    )
    by_score = (
        F.when(F.col("score") >= approve_min, F.lit("APPROVED"))
        .when(F.col("score") >= review_min, F.lit("REVIEW_REQUIRED"))
        .otherwise(F.lit("REJECTED"))
    )
    first = (
        F.when(F.col("_word") == "BAD", F.lit("REJECTED"))
        .when(F.col("_word") == "UNCLEAR", F.lit("REVIEW_REQUIRED"))
        .otherwise(by_score)
    )
    judged = scored.withColumn("_first", first).withColumn(
        "disagreement",
        (F.col("_first") == "APPROVED")
        & F.arrays_overlap("flags", F.array(*[F.lit(f) for f in excluding])),
    )
    judged = judged.withColumn(
        "decision", F.when(F.col("disagreement"), F.lit("REVIEW_REQUIRED")).otherwise(F.col("_first"))
    )
    opening = v["has_opening_keywords"] | v["has_relocation_keywords"] | v["has_ownership_keywords"]
    return judged.select(
        *df.columns,
        "decision",
        "disagreement",
        "score",
        (F.when(v["confidence"].isNotNull(), clamp(v["confidence"], 0, 100)) / 100).alias("confidence"),
        F.when(opening, F.lit("COMMERCIAL_COT")).otherwise(F.lit("UNKNOWN")).alias("lead_type"),
        F.when(F.col("score") >= approve_min, F.lit("HIGH"))
        .when(F.col("score") >= review_min, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
        .alias("intent"),
        F.when(F.col("_word") == "GOOD", F.lit("TRADING")).otherwise(F.lit("UNKNOWN")).alias("business_status"),
        contact_status(F.col("phone")).alias("contact_status"),
        F.lit(False).alias("is_residential"),
        F.coalesce(v["has_minor_update_keywords"], F.lit(False)).alias("is_promotional"),
        (F.col("decision") == "REVIEW_REQUIRED").alias("requires_manual_review"),
        decision_reasons(v, F.col("disagreement")).alias("reasons"),
        extracted().alias("extracted"),
    )


def decision_reasons(verdict: Column, disagreement: Column) -> Column:
    """Key factors, marked red flags, the reasoning, then the disagreement text."""
    none = F.array().cast("array<string>")
    marked = F.transform(verdict["red_flags"], lambda r: F.concat(F.lit(RED_FLAG_PREFIX), r))
    tail = F.array(
        F.nullif(verdict["reasoning"], F.lit("")),
        F.when(disagreement, F.lit(DISAGREEMENT_TEXT)),
    )
    return F.concat(
        F.coalesce(verdict["key_factors"], none),
        F.coalesce(marked, none),
        F.array_compact(tail),
    )


def contact_status(phone: Column) -> Column:
    has = F.coalesce(phone, F.lit("")) != ""
    return F.when(has, F.lit("CONTACT_FOUND")).otherwise(F.lit("NO_CONTACT"))


def extracted() -> Column:
    return F.struct(
        "business_name", "phone", F.lit(None).cast("string").alias("email"), "postcode"
    )


# -- result records ----------------------------------------------------------------

def _provenance(layer: str, prompt_version: str, raw: Column, rules_version: str) -> list[Column]:
    null = F.lit(None)
    return [
        F.lit(layer).alias("layer"),
        F.lit(rules_version).alias("rules_version"),
        F.lit(prompt_version).alias("prompt_version"),
        null.cast("string").alias("model"),
        null.cast("int").alias("prompt_tokens"),
        null.cast("int").alias("completion_tokens"),
        null.cast("decimal(10,6)").alias("ai_cost_usd"),
        raw.alias("raw"),
    ]


def reject_records(
    rejected: DataFrame,
    *,
    rules_version: str = RULES_VERSION,
    prompt_version: str = PROMPT_VERSION,
) -> DataFrame:
    """Result rows of the deterministic layer: score 0, confidence 1."""
    return rejected.select(
        "dedup_key",
        "job_id",
        F.lit("REJECTED").alias("decision"),
        F.lit(0).alias("score"),
        F.lit(1.0).alias("confidence"),
        F.lit("UNKNOWN").alias("lead_type"),
        F.lit("LOW").alias("intent"),
        F.lit("UNKNOWN").alias("business_status"),
        contact_status(F.col("phone")).alias("contact_status"),
        F.lit(False).alias("is_residential"),
        F.lit(False).alias("is_promotional"),
        F.lit(False).alias("requires_manual_review"),
        F.array(F.concat(F.lit(REJECT_PREFIX), F.col("reject_reason"))).alias("reasons"),
        extracted().alias("extracted"),
        *_provenance("deterministic", prompt_version, F.lit(None).cast("string"), rules_version),
    )


def result_records(
    decided: DataFrame,
    *,
    rules_version: str = RULES_VERSION,
    prompt_version: str = PROMPT_VERSION,
) -> DataFrame:
    """Decided rows as result records with provenance; absent values are null."""
    own = RESULT_COLUMNS[: RESULT_COLUMNS.index("layer")]
    return decided.select(
        *own, *_provenance("ai", prompt_version, F.col("response_json"), rules_version)
    )


# -- evidence ----------------------------------------------------------------------

EVIDENCE_SCHEMA = (
    "success boolean, status string, postDate string, postUrl string, postText string,"
    " previousPosts array<string>, rawData struct<author:string>"
)


def evidence_records(responses: DataFrame, provider: str = "validator") -> DataFrame:
    """Evidence responses ``(dedup_key, evidence_json)`` as evidence rows.

    A post counts as existing unless the response says otherwise. A response that is
    missing or no JSON object is no evidence: it makes no row, so it is fetched again.
    """
    kind = F.schema_of_variant(F.try_parse_json("evidence_json"))
    readable = responses.where(kind.startswith("OBJECT"))
    parsed = readable.withColumn("_e", F.from_json("evidence_json", EVIDENCE_SCHEMA))
    e = F.col("_e")
    exists = ~e["success"].eqNullSafe(F.lit(False)) & ~e["status"].eqNullSafe(F.lit("not_found"))
    return parsed.select(
        "dedup_key",
        F.lit(provider).alias("provider"),
        exists.alias("post_exists"),
        e["postText"].alias("post_text"),
        e["rawData"]["author"].alias("author"),
        e["postDate"].alias("post_date"),
        F.coalesce(e["previousPosts"], F.array().cast("array<string>")).alias("previous_posts"),
        F.col("evidence_json").alias("raw"),
    )


def needs_evidence(masters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Masters for which no evidence is stored yet."""
    return masters.join(evidence.select("dedup_key"), "dedup_key", "left_anti")


def attach_evidence(masters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Masters with their stored evidence, null where there is none."""
    return masters.join(evidence, "dedup_key", "left")


# -- whole batch ---------------------------------------------------------------------

def validate_batch(
    jobs: DataFrame,
    masters: DataFrame,
    verdicts: DataFrame,
    as_of,
    *,
    freshness_hours: float = FRESHNESS_HOURS,
    keywords: Mapping[str, Sequence[str]] = SIGNAL_KEYWORDS,
    approve_min: int = APPROVE_MIN,
    review_min: int = REVIEW_MIN,
    excluding: Sequence[str] = EXCLUDING_FLAGS,
) -> DataFrame:
    """All claimed jobs through the layers, one row per job.

    ``jobs``: ``job_id, dedup_key, attempt_count``; ``verdicts``: ``dedup_key,
    response_json, error`` with at most one row per lead. Adds ``outcome``:
    ``missing`` (no such lead), ``rejected`` (deterministic layer), ``decided`` or
    ``failed`` with ``error_text``.
    """
    joined = jobs.join(masters.withColumn("_found", F.lit(True)), "dedup_key", "left").join(
        verdicts.select("dedup_key", "response_json", "error"), "dedup_key", "left"
    )
    screened = screen(joined, as_of, freshness_hours=freshness_hours, keywords=keywords)
    decoded = screened.withColumn(
        "verdict",
        F.when(
            F.col("reject_reason").isNull() & F.col("error").isNull(),
            decode_verdict(F.col("response_json")),
        ),
    )
    outcome = (
        F.when(F.col("_found").isNull(), F.lit("missing"))
        .when(F.col("reject_reason").isNotNull(), F.lit("rejected"))
        .when(F.col("verdict").isNull(), F.lit("failed"))
        .otherwise(F.lit("decided"))
    )
    failure = F.coalesce(
        F.col("error"),
        F.when(F.col("response_json").isNull(), F.lit("no verdict")),
        F.lit("malformed verdict"),
    )
    labelled = decoded.withColumn("outcome", outcome).withColumn(
        "error_text", F.when(F.col("outcome") == "failed", error_text(failure))
    )
    return with_decision(
        labelled.drop("_found"),
        approve_min=approve_min,
        review_min=review_min,
        excluding=excluding,
    )


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """One evidence row per lead: the last collected."""
    return latest_per_key(evidence, ["dedup_key"], ["collected_at"])
