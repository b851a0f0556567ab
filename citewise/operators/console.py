"""Roll-ups of search-console rows: totals, queries, pages, cannibalisation, momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.exprs import round_up_half, safe_ratio
from citewise.operators.rolling import latest_pull, read_day


def console_rows(gsc: DataFrame) -> DataFrame:
    """day, page, query, clicks, impressions, position of each date-page-query by its latest pull (of equal ones the greatest numbers).

    The rows of the site's totals (page and query '') are left out; position is that of the greatest pull.
    """
    rows = gsc.where((F.col("page") != "") & (F.col("query") != "")).select(read_day(F.col("date")).alias("day"), "page", "query", "clicks", "impressions", "position", "pulled_at").where("day is not null")
    best = F.max(F.struct("pulled_at", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "position")).alias("b")
    return rows.groupBy("day", "page", "query").agg(best).select("day", "page", "query", "b.clicks", "b.impressions", "b.position")


def page_key(page: Column) -> Column:
    """A page without its fragment."""
    return F.regexp_replace(page, "#.*$", "")


def is_brand(query: Column, brand: str) -> Column:
    """The brand is in the query, written together or apart."""
    return F.regexp_replace(F.lower(query), "[^\\p{L}\\p{N}]", "").contains(brand)


def _sums() -> list[Column]:
    weight = F.when(F.col("position").isNotNull(), F.col("impressions")).otherwise(0)
    return [F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.coalesce(F.col("position"), F.lit(0.0)) * F.col("impressions")).alias("pw"), F.sum(weight).alias("w")]


def _metrics() -> list[Column]:
    return [F.col("clicks"), F.col("impressions"), F.coalesce(safe_ratio(F.col("clicks"), F.col("impressions")), F.lit(0.0)).alias("ctr"), round_up_half(F.round(F.try_divide(F.col("pw"), F.col("w")), 9), 1).alias("position")]


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, clicks, impressions, ctr (4 digits), position (weighted by impressions, 1 digit; null if no row has one)."""
    return rows.groupBy(*by).agg(*_sums()).select(*by, *_metrics())


def top_queries(rows: DataFrame, brand: str, top: int = 100) -> DataFrame:
    """The top queries by impressions, clicks and name, with the number of their pages and whether they name the brand."""
    seen = rows.where("impressions > 0")
    per_page = seen.withColumn("page", page_key(F.col("page"))).groupBy("query", "page").agg(*_sums())
    agg = per_page.groupBy("query").agg(*(F.sum(c).alias(c) for c in ("clicks", "impressions", "pw", "w")), F.count("*").alias("pages"))
    return agg.orderBy(F.desc("impressions"), F.desc("clicks"), "query").limit(top).select("query", *_metrics(), "pages", is_brand(F.col("query"), brand).alias("brand"))


def zero_click_pages(rows: DataFrame) -> DataFrame:
    """n_zero and n_pages: pages with impressions but no click, of all pages with impressions."""
    pages = rows.where("impressions > 0").groupBy(page_key(F.col("page")).alias("page")).agg(F.sum("clicks").alias("clicks"))
    return pages.agg(F.count_if(F.col("clicks") == 0).alias("n_zero"), F.count("*").alias("n_pages"))


def cannibalised(rows: DataFrame, brand: str, least: int = 20, share: int = 10, max_pages: int = 5, top: int = 30) -> DataFrame:
    """query, impressions, place, page, page_clicks, page_impressions of queries that split over pages.

    A query that doesn't name the brand with at least least impressions, of which two pages or more have at least one
    share-th each; per query the strongest max_pages, of the top queries by impressions.
    """
    p = rows.where((F.col("impressions") > 0) & ~is_brand(F.col("query"), brand)).groupBy("query", page_key(F.col("page")).alias("page")).agg(F.sum("clicks").alias("page_clicks"), F.sum("impressions").alias("page_impressions"))
    q = Window.partitionBy("query")
    p = p.withColumn("impressions", F.sum("page_impressions").over(q)).where((F.col("impressions") >= least) & (F.col("page_impressions") * share >= F.col("impressions")))
    p = p.withColumn("n", F.count("*").over(q)).withColumn("place", F.row_number().over(q.orderBy(F.desc("page_impressions"), F.desc("page_clicks"), "page"))).where((F.col("n") >= 2) & (F.col("place") <= max_pages))
    best = p.where("place = 1").orderBy(F.desc("impressions"), "query").limit(top).select("query")
    return p.join(best, "query", "left_semi").select("query", "impressions", "place", "page", "page_clicks", "page_impressions")


def momentum(rows: DataFrame, by: list[str], last_day: Column, days: int = 28) -> DataFrame:
    """by, clicks, clicks_before, score: the last days against as many before; score is clamp(50 + change/40*50) with one digit, null under 20 clicks.

    change is in percent of clicks_before, and 100 where that is 0.
    """
    age = F.datediff(last_day, F.col("day"))
    agg = rows.groupBy(*by).agg(F.sum(F.when(age.between(0, days - 1), F.col("clicks")).otherwise(0)).alias("clicks"), F.sum(F.when(age.between(days, 2 * days - 1), F.col("clicks")).otherwise(0)).alias("clicks_before"))
    change = F.when(F.col("clicks_before") == 0, 100.0).otherwise(F.try_divide((F.col("clicks") - F.col("clicks_before")) * 100.0, F.col("clicks_before")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + change / 40 * 50))
    return agg.select(*by, "clicks", "clicks_before", F.when(F.col("clicks") + F.col("clicks_before") >= 20, F.round(score, 1)).alias("score"))


def position_buckets(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and the number of queries per band of their weighted position."""
    q = totals(rows.where("impressions > 0"), [*by, "query"])
    bands = (("pos_1", 0, 1.5), ("pos_2_3", 1.5, 3.5), ("pos_4_10", 3.5, 10.5), ("pos_11_20", 10.5, 20.5), ("pos_21_50", 20.5, 50.5), ("pos_51_100", 50.5, 101))
    return q.groupBy(*by).agg(*(F.count_if((F.col("position") >= a) & (F.col("position") < b)).alias(n) for n, a, b in bands))
