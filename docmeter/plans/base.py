"""Roles that the given tables play, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.operators.kept import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: (chunk_id, content, kb_id, owner_id). A query that reads them several times calls this once."""
    return dealt(read(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("kb_id"), (F.col("doc_id") % 8).alias("owner_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records: errors have neither tokens nor a cost."""
    e = read(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    tokens = F.length("props").cast("bigint")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("model"), F.when(F.col("event_type") == "view", "simulated").when(ok, "provider").otherwise("unavailable").alias("source"), F.when(ok, tokens).alias("input_tokens"), F.when(ok, tokens * 2).alias("output_tokens"), F.when(ok, F.round("value", 4)).alias("cost"))


CORPUS = "corpus AS (SELECT doc_id AS chunk_id, text AS content, source AS kb_id, doc_id % 8 AS owner_id FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
RECORDS = """records AS (SELECT event_id AS id, user_id, ts AS created_at, event_type AS model,
 CASE event_type WHEN 'view' THEN 'simulated' WHEN 'error' THEN 'unavailable' ELSE 'provider' END AS source,
 CASE WHEN event_type <> 'error' THEN length(props) END AS input_tokens, CASE WHEN event_type <> 'error' THEN 2 * length(props) END AS output_tokens,
 CASE WHEN event_type <> 'error' THEN round(value, 4) END AS cost FROM events)"""
CJK = "[㐀-䶿一-鿿]"
PAIRS = "[substr({0}, CAST(i AS INTEGER), 2) FOR i IN range(1, greatest(length({0}), 2))]"
TERMS = f"list_concat(regexp_extract_all(regexp_replace(lower(coalesce({{0}}, '')), '{CJK}', ' ', 'g'), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}]+'), flatten([{PAIRS.format('r')} FOR r IN regexp_extract_all(lower(coalesce({{0}}, '')), '{CJK}+')]))"
BM25 = f"""post AS MATERIALIZED (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM (SELECT chunk_id, {TERMS.format('content')} AS w FROM corpus)),
tf AS MATERIALIZED (SELECT chunk_id, term, any_value(dl) AS dl, count(*) AS tf FROM post GROUP BY chunk_id, term),
lens AS MATERIALIZED (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT count(*) FROM post) / (SELECT count(*) FROM corpus) AS avgdl),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), lens),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM questions) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN asked USING (term) JOIN idf USING (term), lens GROUP BY ALL),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE round(score, 9) <> 0) WHERE rank <= 20)"""
SPARSE = """tok AS (SELECT key, list_concat(regexp_extract_all(t, '[㐀-䶿一-鿿]'), regexp_extract_all(t, '[a-z0-9]+')) AS w FROM (SELECT 'c' || chunk_id AS key, lower(coalesce(content, '')) AS t FROM corpus UNION ALL SELECT 'q' || query_id, lower(query) FROM questions)),
bucket AS (SELECT key, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 1024 AS bucket, count(*) AS n FROM (SELECT key, unnest(w) AS token FROM tok) GROUP BY ALL),
unit AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS w FROM bucket),
sv AS (SELECT CAST(substr(q.key, 2) AS BIGINT) AS query_id, CAST(substr(c.key, 2) AS BIGINT) AS chunk_id, sum(q.w * c.w) AS score FROM unit q JOIN unit c USING (bucket) WHERE q.key LIKE 'q%' AND c.key LIKE 'c%' GROUP BY ALL),
sv_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sv) WHERE rank <= 20)"""
FUSED = """both_lists AS (SELECT query_id, chunk_id, rank, score, 0 AS list FROM sv_top UNION ALL SELECT query_id, chunk_id, rank, score, 1 FROM bm_top),
fused_all AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, arg_min(score, list) AS first_score FROM both_lists GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused_all) WHERE rank <= 12)"""
