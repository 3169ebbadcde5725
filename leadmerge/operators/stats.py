"""Counts over masters, links, jobs and results.

Every table is read once: conditional counts share one pass instead of one
sub-query each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmerge.contract import BASE_SOURCE, LEAD_PENDING, SECONDARY_SOURCE
from leadmerge.functions import epoch_seconds_between, on_date
from leadmerge.operators.onerow import side_by_side


def found_by(links: DataFrame, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE) -> DataFrame:
    """Per master: ``in_base`` and ``in_secondary``.

    Two flags replace a distinct count per master, which would shuffle twice.
    """
    return links.groupBy("dedup_key").agg(
        F.max(F.col("source") == base).alias("in_base"),
        F.max(F.col("source") == secondary).alias("in_secondary"),
    )


def found_by_both(links: DataFrame, **names) -> DataFrame:
    """Masters with both sources."""
    return found_by(links, **names).where("in_base and in_secondary").select("dedup_key")


def only_in(links: DataFrame, source: str, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE) -> DataFrame:
    """Masters that one source alone found."""
    mine, other = ("in_base", "in_secondary") if source == base else ("in_secondary", "in_base")
    return found_by(links, base=base, secondary=secondary).where(f"{mine} and not {other}").select("dedup_key")


def link_counts(links: DataFrame, as_of_date, *, base: str = BASE_SOURCE, secondary: str = SECONDARY_SOURCE) -> DataFrame:
    """Totals, totals of the day, and masters by the sources that found them.

    One pass: per master the counts of its links, then one global sum.
    """
    is_base, is_secondary = F.col("source") == base, F.col("source") == secondary
    today = on_date(F.col("first_seen"), as_of_date)
    per_master = links.groupBy("dedup_key").agg(
        F.count_if(is_base).alias("nb"),
        F.count_if(is_secondary).alias("ns"),
        F.count_if(is_base & today).alias("tb"),
        F.count_if(is_secondary & today).alias("ts"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_master.agg(
        total("nb").alias("base_total"),
        total("ns").alias("secondary_total"),
        total("tb").alias("base_today"),
        total("ts").alias("secondary_today"),
        F.count_if((F.col("nb") > 0) & (F.col("ns") > 0)).alias("found_by_both"),
        F.count_if((F.col("nb") > 0) & (F.col("ns") == 0)).alias("base_only"),
        F.count_if((F.col("nb") == 0) & (F.col("ns") > 0)).alias("secondary_only"),
    )


def overview(masters: DataFrame, raw: DataFrame, links: DataFrame, as_of_date, **names) -> DataFrame:
    """Overview and source comparison in one row."""
    parts = side_by_side(
        masters.agg(
            F.count("*").alias("combined_unique"),
            F.count("possible_duplicate_of").alias("flagged_possible_duplicates"),
        ),
        raw.agg(F.count("*").alias("total_occurrences")),
        link_counts(links, as_of_date, **names),
    )
    removed = F.col("total_occurrences") - F.col("combined_unique")
    return parts.withColumn("duplicates_removed", removed)


def latency(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row ``avg_validation_seconds``: whole seconds from queueing to result.

    Results are summed per job before the join, so a job with very many results
    costs one row.
    """
    per_job = results.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        F.sum(F.unix_micros("validated_at").cast("decimal(38,0)")).alias("_sum"),
        F.count("validated_at").alias("_n"),
    )
    joined = per_job.join(jobs.select("job_id", "created_at"), "job_id")
    spent = F.col("_sum") - F.col("_n") * F.unix_micros("created_at").cast("decimal(20,0)")
    mean = F.sum(spent).cast("double") / F.sum("_n") / 1e6
    return joined.agg(F.round(mean).alias("avg_validation_seconds"))


def validation_counts(status: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Decision, queue, layer and cost figures in one row.

    ``status``: current status per lead; ``jobs``: current state per job.
    """
    is_status = lambda *s: F.col("status").isin(*s)
    parts = side_by_side(
        status.agg(
            F.count_if(is_status("APPROVED")).alias("approved"),
            F.count_if(is_status("REVIEW_REQUIRED")).alias("review_required"),
            F.count_if(is_status("REJECTED")).alias("rejected"),
            F.count_if(is_status(*LEAD_PENDING)).alias("pending"),
        ),
        jobs.agg(F.count_if(is_status("FAILED")).alias("validation_failures")),
        results.agg(
            F.count_if(F.col("layer") == "deterministic").alias("rejected_before_ai"),
            F.count_if(F.col("layer") == "ai").alias("ai_calls"),
            F.coalesce(F.sum("ai_cost_usd").cast("double"), F.lit(0.0)).alias("total_ai_cost_usd"),
        ),
        latency(results, jobs),
    )
    return parts.withColumn(
        "cost_per_approved_lead", cost_per_approved(F.col("total_ai_cost_usd"), F.col("approved"))
    )


def cost_per_approved(cost: Column, approved: Column) -> Column:
    """Null unless both are positive."""
    return F.when((approved > 0) & (cost > 0), cost / approved)
