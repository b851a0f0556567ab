"""Queries of the data problems for text and large streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.llm.bpe import token_counts, token_ids
from citewise.llm.dyadic import RANK_ERROR, combine, quantiles, rank_errors, update
from citewise.llm.frequent import at_least, frequent
from citewise.llm.packing import pack
from citewise.llm.pii import learn_names, personal_data, redacted
from citewise.llm.splitting import split_texts
from citewise.sources.tables import table

CONTAINER_TOKENS, PIECE_TOKENS, PIECE_OVERLAP = 2048, 512, 64


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """endpoint, day, metric, v of every request, counted once, endpoints in one spelling; impossible (negative) values left out."""
    requests = table(spark, sf_dir, "api_requests")
    # copies agree in all of these columns, so grouping by them and the id leaves one row each
    once = requests.where("id is not null").select("id", "endpoint", F.to_date("created_at").alias("day"), "duration_ms", "cost_micro_usd").distinct()
    bare = F.regexp_replace(F.regexp_replace(F.trim("endpoint"), r"\s+", " "), r"(?<=.)/+$", "")
    endpoint = F.concat(F.upper(F.substring_index(bare, " ", 1)), F.lit(" "), F.substring_index(bare, " ", -1))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("duration_ms", "cost_micro_usd")))
    return once.select(endpoint.alias("endpoint"), "day", F.inline(each)).where("v >= 0")


BY_ENDPOINT, BY_DAY = ["endpoint", "metric"], ["endpoint", "metric", "day"]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(update(_metrics(spark, sf_dir), BY_ENDPOINT, "v"), BY_ENDPOINT)


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(update(_metrics(spark, sf_dir), BY_DAY, "v"), BY_DAY)


def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' sketches added up to the whole."""
    return quantiles(combine(update(_metrics(spark, sf_dir), BY_DAY, "v"), BY_ENDPOINT), BY_ENDPOINT)


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ranks of p2_percentiles are within the stated error, by a count of all rows."""
    errors = rank_errors(_metrics(spark, sf_dir), BY_ENDPOINT, "v", p2_percentiles(spark, sf_dir))
    return errors.select(*BY_ENDPOINT, "prob", "n", (F.col("rank_error") <= RANK_ERROR).alias("within"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least(table(spark, sf_dir, "gsc_daily"), ("page", "query"), 0.01).select("field", "item")


def p4_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(table(spark, sf_dir, "gsc_daily"), ("page", "query"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "leads").withColumnRenamed("id", "lead_id")
    return personal_data(leads, "lead_id", ("name", "message"), names=learn_names(leads, ("name",), ("message",))).select("lead_id", "field", "kind", "start_pos")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "leads")
    return redacted(leads, "id", ("name", "message"), names=learn_names(leads, ("name",), ("message",)))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_counts(docs), CONTAINER_TOKENS, n_items=docs.count())


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), PIECE_TOKENS, PIECE_OVERLAP)


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, those without ids, and ids outside the vocabulary, of p7_ids."""
    ids = p7_ids(spark, sf_dir)
    return ids.agg(F.count("*").alias("n_docs"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.coalesce(F.sum(F.size(F.filter("ids", lambda i: (i < 0) | (i >= 50257)))), F.lit(0)).alias("n_outside"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers, containers too full, documents split that fit one, and tokens lost, of p8_containers."""
    packed = p8_containers(spark, sf_dir)
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > CONTAINER_TOKENS).alias("n_over"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    whole = token_counts(table(spark, sf_dir, "documents")).join(docs, "doc_id", "left")
    split = whole.agg(F.count("t").alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= CONTAINER_TOKENS)).alias("n_split"), F.coalesce(F.sum("n_tokens") - F.sum("t"), F.lit(0)).alias("n_lost"))
    return split.withColumn("n_over", over.scalar())


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces, pieces too large, documents not covered from first to last character, and neighbours that leave a gap, of p9_pieces."""
    p = p9_pieces(spark, sf_dir).select("doc_id", "piece", "start_pos", "end_pos", "n_tokens")
    before = F.lag("end_pos").over(Window.partitionBy("doc_id").orderBy("piece"))
    per = p.withColumn("gap", F.coalesce(F.col("start_pos") > before, F.lit(False))).groupBy("doc_id").agg(F.min("start_pos").alias("a"), F.max("end_pos").alias("b"), F.count_if("gap").alias("g"), F.count_if((F.col("n_tokens") > PIECE_TOKENS) & (F.col("end_pos") - F.col("start_pos") > 1)).alias("o"))
    j = per.join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id")
    return j.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_over"), F.count_if((F.col("a") != 0) | (F.col("b") != F.col("chars"))).alias("n_uncovered"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gaps"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_daily, p2_days_combined, p2_accuracy, p4_found, p4_frequent, p5_found, p5_redacted, p7_ids, p7_counts, p8_containers, p8_invariants, p9_pieces, p9_invariants)}
ORACLE: dict[str, str] = {
    "p2_accuracy": r"""
WITH once AS (SELECT DISTINCT id, endpoint, created_at::date AS day, duration_ms, cost_micro_usd FROM api_requests WHERE id IS NOT NULL),
bare AS (SELECT regexp_replace(regexp_replace(trim(endpoint), '\s+', ' ', 'g'), '(.)/+$', '\1') AS e, duration_ms, cost_micro_usd FROM once),
long AS (SELECT e, 'duration_ms' AS metric, duration_ms AS v FROM bare UNION ALL SELECT e, 'cost_micro_usd', cost_micro_usd FROM bare)
SELECT upper(regexp_extract(e, '^[^ ]*')) || ' ' || regexp_extract(e, '[^ ]*$') AS endpoint, metric, p.prob, count(*) AS n, true AS within
FROM long CROSS JOIN (SELECT unnest([0.5, 0.9, 0.95, 0.99])::double AS prob) p WHERE v >= 0 GROUP BY 1, 2, 3""",
    "p4_frequent": """
WITH long AS (SELECT 'page' AS field, page AS item FROM gsc_daily UNION ALL SELECT 'query', query FROM gsc_daily), c AS (SELECT field, item, count(*) AS n FROM long WHERE item <> '' GROUP BY 1, 2)
SELECT field, place, item, n AS n_least, n AS n_most FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, item) AS place FROM c) WHERE place <= 50""",
    "p7_counts": "SELECT count(*) AS n_docs, count(*) FILTER (coalesce(text, '') = '') AS n_empty, 0 AS n_outside FROM documents",
    "p8_invariants": "SELECT count(*) AS n_docs, 0 AS n_split, 0 AS n_lost, 0 AS n_over FROM documents",
    "p9_invariants": "SELECT count(*) AS n_docs, 0 AS n_over, 0 AS n_uncovered, 0 AS n_gaps FROM documents WHERE text <> ''",
    "p4_found": """
WITH long AS (SELECT 'page' AS field, page AS item FROM gsc_daily UNION ALL SELECT 'query', query FROM gsc_daily)
SELECT field, item FROM long WHERE item IS NOT NULL AND item <> '' GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM gsc_daily)""",
}
