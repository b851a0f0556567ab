"""Costs and usage of API requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.functions.exprs import round_up_half


def once(requests: DataFrame, columns: list[str]) -> DataFrame:
    """id and columns of each request, copies counted once."""
    return requests.where("id is not null").select("id", *columns).dropDuplicates(["id"])


def cost_rollup(requests: DataFrame) -> DataFrame:
    """Totals of the requests' cost entries: level ('all', 'provider', 'stage'), name, usd, measured_usd, estimated_usd, calls, n.

    One pass over the entries by grouping sets; dollars have 6 digits; an entry without calls is one call.
    """
    entries = once(requests, ["cost_breakdown"]).select(F.explode("cost_breakdown").alias("e")).select("e.*")
    sets = entries.groupingSets([[], ["provider"], ["stage"]], "provider", "stage")
    usd = lambda kind: F.round(F.sum(F.when(F.col("accuracy") == kind, F.col("usd")).otherwise(0.0)), 6)
    agg = sets.agg(F.round(F.sum("usd"), 6).alias("usd"), usd("measured").alias("measured_usd"), usd("estimated").alias("estimated_usd"), F.sum(F.coalesce("calls", F.lit(1))).alias("calls"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "provider").otherwise("stage")
    return agg.select(level.alias("level"), F.when(F.col("g") == 1, F.col("provider")).when(F.col("g") == 2, F.col("stage")).alias("name"), "usd", "measured_usd", "estimated_usd", "calls", "n")


def usage_totals(requests: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_ok, n_failed, cost_micro_usd, input_tokens, output_tokens, avg_duration_ms (whole, of done requests)."""
    rows = once(requests, [*by, "status", "duration_ms", "cost_micro_usd", "input_tokens", "output_tokens"])
    done = F.col("status") == "complete"
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(done).alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cost_micro_usd", "input_tokens", "output_tokens")),
        round_up_half(F.avg(F.when(done & (F.col("duration_ms") >= 0), F.col("duration_ms")))).alias("avg_duration_ms"),
    )


def usage_by_day(requests: DataFrame) -> DataFrame:
    """day, n, n_users, cost_micro_usd by the day of creation."""
    rows = once(requests, ["user_id", "created_at", "cost_micro_usd"])
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.sum("cost_micro_usd").alias("cost_micro_usd"))
