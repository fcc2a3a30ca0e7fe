"""Queries of hooks, judged scores, kept tables and single functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import text
from docmeter.operators import chunking, citation, conversation, evaluation, hooks, kept_index, observed, retrieval, tables, usage
from docmeter.operators.kept import shared_path, written
from docmeter.plans.accounts import AS_OF, TURNS
from docmeter.plans.base import BM25, CORPUS, FUSED, MESSAGES, QUESTIONS, RECORDS, SPARSE, corpus, messages, query, questions, read, records
from docmeter.plans.retrieval import NORM, _vectors
from docmeter.sources import chunk_sink, files
from docmeter.streaming import streams

# usage and visibility


@query(f"""WITH {RECORDS}, s AS (SELECT CASE WHEN grouping(user_id) = 0 THEN 'user' WHEN grouping(day) = 0 THEN 'day' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS "by", coalesce(CAST(user_id AS VARCHAR), day, source) AS key, sum(cost) AS cost
FROM (SELECT user_id, source, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN user_id % 7 > 0 THEN cost END AS cost FROM records) GROUP BY GROUPING SETS ((user_id), (day), (source), ()))
SELECT "by", key, round(cost, 4) AS cost, row_number() OVER (PARTITION BY "by" ORDER BY round(cost, 8) DESC NULLS LAST, key) AS position FROM s""")
def t8_costs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Each breakdown's rows by cost, unknown costs last; nothing of every seventh user is priced."""
    r = records(spark, d).withColumn("cost", F.when(F.col("user_id") % 7 > 0, F.col("cost")))
    return usage.in_cost_order(usage.summary(r)).select("by", "key", F.round("cost", 4).alias("cost"), "position")


@query(f"""WITH {RECORDS} SELECT 'own' AS seen_by, user_id, count(*) AS records, round(sum(cost), 4) AS cost FROM records WHERE user_id = 3 GROUP BY user_id
UNION ALL SELECT 'admin', user_id, count(*), round(sum(cost), 4) FROM records GROUP BY user_id""")
def p7_visible_records(spark: SparkSession, d: str) -> DataFrame:
    """What user 3 sees, and what an admin sees."""
    r = records(spark, d)
    seen = tables.visible(r, 3, False).withColumn("seen_by", F.lit("own")).unionByName(tables.visible(r, 3, True).withColumn("seen_by", F.lit("admin")))
    return seen.groupBy("seen_by", "user_id").agg(F.count("*").alias("records"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"WITH {RECORDS} SELECT user_id, count(*) AS records, count(*) FILTER (created_at IS NULL) AS untimed FROM (SELECT user_id, CASE WHEN id % 9 > 0 THEN created_at END AS created_at FROM records) WHERE created_at IS NULL OR created_at >= {AS_OF} - INTERVAL 5 DAY GROUP BY user_id")
def f19_rolling_window(spark: SparkSession, d: str) -> DataFrame:
    """The last five days; every ninth time is unknown and passes."""
    r = records(spark, d).withColumn("created_at", F.when(F.col("id") % 9 > 0, F.col("created_at")))
    return r.where(text.within_days(F.col("created_at"), F.expr(AS_OF), 5)).groupBy("user_id").agg(F.count("*").alias("records"), F.count_if(F.col("created_at").isNull()).alias("untimed"))


@query(f"""WITH {RECORDS} SELECT count(*) AS records, count(*) FILTER (input_tokens IS NULL) AS tokens_unknown, count(*) FILTER (input_tokens IS NOT NULL AND model NOT IN ('click', 'purchase')) AS price_unknown FROM records""")
def q2_observed_costs(spark: SparkSession, d: str) -> DataFrame:
    """Q2, Q3: what a job that writes costs counts on its way."""
    price, _ = usage.prices(spark, spark.createDataFrame([("click", '{"input": 0.002, "output": 0.006}'), ("purchase", '{"input": 0.01, "output": 0.03}')], "model string, value string"))
    rows, counts = observed.priced(records(spark, d).drop("cost"), price)
    written(rows.select("id", "cost"), "costs")
    return spark.createDataFrame([tuple(counts.get[c] for c in ("records", "tokens_unknown", "price_unknown"))], "records long, tokens_unknown long, price_unknown long")


@query("SELECT count(*) AS vectors, count(*) FILTER (vec_id % 11 = 0 AND vec_id % 13 > 0) AS wrong, count(*) FILTER (vec_id % 13 = 0) AS missing, count(*) FILTER (vec_id % 11 > 0 AND vec_id % 13 > 0) AS kept FROM embeddings")
def v5_observed_sizes(spark: SparkSession, d: str) -> DataFrame:
    """V5: vectors of the wrong size are left out and counted in the job that writes the others."""
    v = read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 13 > 0, F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))).alias("vector"))
    dim = v.agg(F.max(F.size("vector"))).first()[0] or 0
    rows, counts = observed.sized_vectors(v, "vector", dim)
    kept = written(rows, "vectors").count()
    return spark.createDataFrame([(*(counts.get[c] for c in ("vectors", "wrong", "missing")), kept)], "vectors long, wrong long, missing long, kept long")


# conversation


@query(f"""WITH {TURNS.replace("WHERE role IN ('user', 'assistant')", "WHERE role IN ('user', 'assistant') AND seq IN (SELECT seq FROM recent r WHERE r.session_id = messages.session_id)").replace(MESSAGES, MESSAGES + ", recent AS (SELECT session_id, seq FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3)")}
SELECT session_id, turn_no, user_text AS "user", assistant, last_id FROM turns""")
def w2_recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each session's last three messages."""
    return conversation.turns(conversation.last_messages(messages(spark, d), 3))


SIZED = f"""{TURNS}, t AS (SELECT *, list_count(list_filter(regexp_split_to_array(regexp_replace('用户：' || user_text || chr(10) || '助手：' || assistant, '[㐀-䶿一-鿿]', ' ', 'g'), '[\\s ]+'), lambda x: x <> '')) + 4 AS tokens,
 list_count(list_filter(regexp_split_to_array(user_text, '[\\s ]+'), lambda x: x <> '')) AS asked FROM sized)"""


@query(f"""WITH {SIZED}, s AS (SELECT session_id, count(*) AS n, sum(tokens) AS tokens, CAST(count(*) FILTER (back > 1) AS VARCHAR) || ': ' || string_agg(user_text, ' | ' ORDER BY turn_no) FILTER (back > 1) || '.' AS said FROM t GROUP BY ALL)
SELECT session_id, CASE WHEN n > 1 AND tokens > 60 AND length(said) <= 400 THEN said END AS summary, CASE WHEN n <= 1 THEN 'few turns' WHEN tokens <= 60 THEN 'within budget' WHEN length(said) > 400 THEN 'no summary' END AS skip_reason FROM s""")
def x4_summarised(spark: SparkSession, d: str) -> DataFrame:
    """A summariser is plugged in that refuses long texts; then every turn stays."""

    def summarize(parts: list[str]) -> str:
        said = f"{len(parts)}: {' | '.join(parts)}."
        if len(said) > 400:
            raise ValueError("too long")
        return said

    return conversation.plan(conversation.turns(messages(spark, d)), 60, 1, summarize=summarize).select("session_id", "summary", "skip_reason")


@query(f"""WITH {SIZED}, s AS (SELECT session_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) FILTER (back = 1) AS BIGINT) AS late, CAST(sum(asked) FILTER (back > 1) AS BIGINT) AS early FROM t GROUP BY ALL)
SELECT session_id, CASE WHEN n > 1 AND tokens > 60 THEN tokens END AS before, CASE WHEN n > 1 AND tokens > 60 THEN late + early END AS after, CASE WHEN NOT (n > 1 AND tokens > 60) THEN 'nothing compressed' END AS reason FROM s""")
def g5_tokens_saved(spark: SparkSession, d: str) -> DataFrame:
    """One turn stays, a budget of 60 tokens."""
    return conversation.token_report(conversation.plan(conversation.turns(messages(spark, d)), 60, 1)).select("session_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), "reason")


PREVIOUS = "previous AS (SELECT session_id, 'said before' AS summary, min(last_id) AS cursor FROM turns WHERE session_id % 2 = 0 GROUP BY session_id)"


def _previous(turn_rows: DataFrame) -> DataFrame:
    """Even sessions have a summary up to their first turn."""
    return turn_rows.where("session_id % 2 = 0").groupBy("session_id").agg(F.min("last_id").alias("cursor")).withColumn("summary", F.lit("said before"))


@query(f"""WITH {TURNS}, {PREVIOUS} SELECT t.session_id, p.summary, count(*) AS kept, min(t.turn_no) AS first_kept FROM turns t LEFT JOIN previous p USING (session_id) WHERE p.cursor IS NULL OR t.last_id > p.cursor GROUP BY ALL""")
def g3_exempt_plan(spark: SparkSession, d: str) -> DataFrame:
    """No new summary; only turns after the cursor where there is one."""
    t = conversation.turns(messages(spark, d))
    return conversation.exempt_plan(t, _previous(t)).select("session_id", "summary", F.size("kept").cast("long").alias("kept"), F.col("kept")[0]["turn_no"].alias("first_kept"))


@query(f"""WITH {SIZED}, {PREVIOUS}, l AS (SELECT t.*, p.summary AS old, p.cursor FROM t LEFT JOIN previous p USING (session_id) WHERE p.cursor IS NULL OR t.last_id > p.cursor),
s AS (SELECT session_id, any_value(old) AS old, count(*) AS n, sum(tokens) AS tokens, string_agg(user_text, chr(10) ORDER BY turn_no) FILTER (back > 1) AS said, max(cursor) AS cursor, max(last_id) FILTER (back > 1) AS last FROM l GROUP BY session_id)
SELECT session_id, CASE WHEN n > 1 AND tokens > 30 THEN CASE WHEN old IS NOT NULL THEN old || chr(10) ELSE '' END || said ELSE old END AS summary, CASE WHEN n > 1 AND tokens > 30 THEN last ELSE cursor END AS cursor FROM s""")
def g4_rolling_summary(spark: SparkSession, d: str) -> DataFrame:
    """The earlier summary is the first thing that a new one says."""
    t = conversation.turns(messages(spark, d))
    return conversation.plan(t, 30, 1, previous=_previous(t)).select("session_id", "summary", "cursor")


@query(f"""WITH {TURNS}, r AS (SELECT session_id, turn_no, assistant <> '' AS ok, [trim(regexp_replace(trim(x), '^(?:[-•*]|\\d+[.、)）])\\s*', '')) FOR x IN string_split(replace(user_text, '. ', chr(10)) || chr(10) || assistant, chr(10))] AS l FROM turns),
u AS (SELECT session_id, turn_no, unnest(l) AS fact, unnest(range(len(l))) AS i FROM r WHERE ok), f AS (SELECT session_id, turn_no, fact, min(i) AS i FROM u WHERE fact <> '' GROUP BY ALL)
SELECT session_id, turn_no, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, fact, CAST(NULL AS VARCHAR) AS error FROM f WINDOW w AS (PARTITION BY session_id, turn_no ORDER BY i) QUALIFY row_number() OVER w <= 5
UNION ALL SELECT session_id, turn_no, NULL, NULL, 'ValueError: no answer' FROM r WHERE NOT ok""")
def x5_extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """A table function of an extraction model, called from SQL; a turn without an answer fails."""

    def extract(user: str, assistant: str) -> str:
        if not assistant:
            raise ValueError("no answer")
        return user.replace(". ", "\n") + "\n" + assistant

    spark.udtf.register("extract_facts", hooks.fact_function(extract))
    return spark.sql("SELECT session_id, turn_no, f.pos, f.fact, f.error FROM {t} AS t, LATERAL extract_facts(t.user, t.assistant) f", t=conversation.turns(messages(spark, d)))


CACHE = """a AS (SELECT * FROM (SELECT vec_id AS query_id, label AS kb_id, vec_id * 2 AS tick, CASE WHEN vec_id % 5 > 0 THEN 'answer ' || vec_id END AS answer, CAST(embedding AS DOUBLE[]) AS v, vec_id % 7 = 0 AS own_key, vec_id % 11 = 0 AS named FROM embeddings
 UNION ALL SELECT vec_id + 1000000, label, vec_id * 2 + 61, CASE WHEN vec_id % 5 > 0 THEN 'again ' || vec_id END, list_concat([embedding[1] + 0.1 * (vec_id % 6)], CAST(embedding AS DOUBLE[])[2:]), vec_id % 7 = 3, false FROM embeddings) WHERE NOT own_key AND NOT named),
n AS (SELECT *, count(answer) OVER (ORDER BY tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(answer) OVER (ORDER BY tick, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth FROM a)
SELECT q.query_id, h.query_id AS hit_id, round(list_cosine_similarity(q.v, h.v), 6) AS score, h.answer AS hit_answer FROM n q JOIN n h ON q.kb_id = h.kb_id AND h.answer IS NOT NULL AND h.nth < q.before AND h.nth >= q.before - {}
 WHERE round(list_cosine_similarity(q.v, h.v), 9) >= 0.92 QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, h.v), 9) DESC, h.query_id) = 1"""


def _asked_again(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks, and asks again 61 ticks later a little changed; labels are knowledge bases, every eleventh question names a table."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("kb_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("embedding")[0].alias("head"))
    answer = lambda word: F.when(F.col("vec_id") % 5 > 0, F.concat(F.lit(word), F.col("vec_id").cast("string"))).alias("answer")
    first = v.select(F.col("vec_id").alias("query_id"), "kb_id", (F.col("vec_id") * 2).alias("at"), F.when(F.col("vec_id") % 11 == 0, "表3.1").otherwise("what").alias("question"), answer("answer "), "vector", (F.col("vec_id") % 7 == 0).alias("own_key"))
    changed = F.concat(F.array((F.col("head") + (F.lit(0.1) * (F.col("vec_id") % 6)).cast("float")).cast("double")), F.slice("vector", 2, 1 << 20)).alias("vector")
    again = v.select((F.col("vec_id") + 1000000).alias("query_id"), "kb_id", (F.col("vec_id") * 2 + 61).alias("at"), F.lit("what").alias("question"), answer("again "), changed, (F.col("vec_id") % 7 == 3).alias("own_key"))
    return first.unionByName(again)


@query(f"WITH {CACHE.format(2000)}")
def g12_cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """G12, J17, T7, W11 at the real threshold of 0.92 and 2,000 entries."""
    return conversation.cache_matches(_asked_again(spark, d))


@query(f"WITH {CACHE.format(24)}")
def w11_evicted_answers(spark: SparkSession, d: str) -> DataFrame:
    """A cache of 24 entries has lost most answers when their question comes back."""
    return conversation.cache_matches(_asked_again(spark, d), newest=24)


# hooks


@query("SELECT item_id AS query_id, CAST(length(text) AS DOUBLE) AS size, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS letters FROM benchmark")
def e2_model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers by index, out of order."""

    def model(texts: list[str]) -> list[dict]:
        return [{"index": i, "embedding": [float(len(t)), float(t.count("a"))]} for i, t in reversed(list(enumerate(texts)))]

    return retrieval.embed(questions(spark, d), "query_id", "query", model, 2).select("query_id", F.col("vector")[0].alias("size"), F.col("vector")[1].alias("letters"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {SPARSE}, {FUSED},
c AS (SELECT query_id, chunk_id, rank, list_distinct(regexp_extract_all(query, '(?s).')) AS a, list_distinct(regexp_extract_all(content, '(?s).')) AS b, length(query) % 5 = 0 AS busy, length(content) % 4 = 0 AS silent FROM fused JOIN corpus USING (chunk_id) JOIN questions USING (query_id)),
s AS (SELECT query_id, chunk_id, busy AS degraded, CASE WHEN busy THEN 1.0 / (60 + rank) WHEN silent THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score, CASE WHEN busy THEN 0 ELSE count(*) FILTER (silent) OVER (PARTITION BY query_id) END AS unscored FROM c)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(degraded AS INTEGER) AS degraded, CASE WHEN degraded THEN 'TimeoutError: busy' END AS note, CAST(unscored AS INTEGER) AS unscored, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 3""")
def h5_rerank_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A model of shared characters that is busy for some questions and silent on some texts."""
    chunks = corpus(spark, d)
    q, c = _vectors(spark, d, chunks)
    top = retrieval.fuse([retrieval.sparse_top_k(q, c, 20), retrieval.bm25(questions(spark, d), chunks)])
    rows = retrieval.with_chunks(top, chunks.select("chunk_id", "content")).join(questions(spark, d), "query_id")

    def model(asked: str, texts: list[str]) -> list[float | None]:
        if len(asked) % 5 == 0:
            raise TimeoutError("busy")
        return [None if len(t) % 4 == 0 else len(set(asked) & set(t)) / len(set(asked) | set(t)) for t in texts]

    out, _ = observed.reranked(rows, model, 3)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("degraded").cast("int").alias("degraded"), "note", "unscored", "rank")


@query("""WITH s AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents), c AS (SELECT doc_id, text, unnest(list_distinct(l[1:4])) AS claim FROM s WHERE doc_id % 6 > 0)
SELECT doc_id AS answer_id, claim, CAST(contains(substr(text, 1, 500), claim) AS INTEGER) AS supported FROM c""")
def x6_verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """A judge that sees 500 characters of a source; where it fails (every sixth answer) verdicts are unknown."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.array_distinct(F.slice(F.filter(F.split("text", "\n"), lambda x: x != ""), 1, 4)).alias("claims"), F.array(F.when(F.col("doc_id") % 6 > 0, F.col("text")).otherwise("")).alias("sources"))

    def judge(claims: list[str], sources: list[str]) -> list[bool]:
        if not sources[0]:
            raise ValueError("no source")
        return [c in sources[0] for c in claims]

    return citation.verify(rows, judge).withColumn("supported", F.col("supported").cast("int"))


@query("""SELECT doc_id AS item, CASE WHEN q % 3 > 0 THEN round(q / 7.0, 6) END AS score, CASE WHEN q % 3 = 0 THEN 'ValueError: unclear' END AS error FROM (SELECT doc_id, doc_id % 7 AS q, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL) WHERE toxic = 0""")
def m20_judged_items(spark: SparkSession, d: str) -> DataFrame:
    """Positives alone are judged; a failure stays with its item."""
    items = read(spark, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("item"), (F.col("toxic") == 1).alias("negative")).where("negative is not null")

    def score(row: dict) -> float:
        if row["item"] % 7 % 3 == 0:
            raise ValueError("unclear")
        return row["item"] % 7 / 7

    return evaluation.judge(items, "item", score).withColumn("score", F.round("score", 6))


@query("""WITH j AS (SELECT doc_id, 'g' || (doc_id % 3) AS grp, toxic = 1 AS negative, CASE WHEN doc_id % 4 > 0 THEN quality / 2.0 END AS faithfulness, CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 / 10.0 END AS answer_relevancy, CAST(NULL AS DOUBLE) AS context_precision, doc_id % 2 AS context_recall, doc_id % 10 > 0 AS judged FROM labels)
SELECT grp AS "group", count(*) FILTER (NOT negative) AS positives, count(*) FILTER (NOT negative AND judged) AS scored, round(avg(faithfulness) FILTER (NOT negative AND judged), 6) AS faithfulness, round(avg(answer_relevancy) FILTER (NOT negative AND judged), 6) AS answer_relevancy, CAST(NULL AS DOUBLE) AS context_precision, round(avg(context_recall) FILTER (NOT negative AND judged), 6) AS context_recall FROM j GROUP BY grp""")
def a13_judged_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of judged positives, each over the items that have the figure."""
    c = F.col
    figures = F.when(c("doc_id") % 10 > 0, F.struct(F.when(c("doc_id") % 4 > 0, c("quality") / 2.0).alias("faithfulness"), F.when(c("doc_id") % 5 > 0, c("doc_id") % 9 / 10.0).alias("answer_relevancy"), F.lit(None).cast("double").alias("context_precision"), (c("doc_id") % 2).cast("double").alias("context_recall")))
    rows = read(spark, d, "labels").select(F.concat(F.lit("g"), (c("doc_id") % 3).cast("string")).alias("group"), (c("toxic") == 1).alias("negative"), figures.alias("judged"))
    found = evaluation.judged_means(rows, ["group"])
    return found.select("group", "positives", "scored", *(F.round(m, 6).alias(m) for m in evaluation.JUDGED))


@query("""WITH o AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL), m AS (SELECT avg(quality / 2.0) AS x, avg(toxic / 2.0) AS y, bool_and(quality = toxic) AS same FROM o)
SELECT round(x, 6) AS before, round(y, 6) AS after, CAST(same AS INTEGER) AS identical, CASE WHEN x IS NULL OR y IS NULL THEN 'undecidable' WHEN x = 0 AND y = 0 THEN 'no information' WHEN y < x THEN 'fail' ELSE 'pass' END AS verdict FROM m""")
def m15_memory_guardrail(spark: SparkSession, d: str) -> DataFrame:
    """Quality stands for coverage and answer without memory, toxic with it."""
    one = read(spark, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    side = lambda c: one.select(F.col("doc_id").alias("item"), F.col(c).cast("string").alias("answer"), (F.col(c) / 2.0).alias("coverage"))
    return evaluation.memory_guardrail(side("quality"), side("toxic")).select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.col("identical").cast("int").alias("identical"), "verdict")


# scopes


@query(f"""WITH {CORPUS}, {QUESTIONS}, {SPARSE}, s AS (SELECT sv.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sv JOIN corpus USING (chunk_id) WHERE query_id % 4 = 0 OR kb_id = 'src' || (query_id % 20))
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM s WHERE rank <= 10""")
def v3_scoped_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Sparse vectors inside the question's knowledge base; every fourth question sees all."""
    kb = F.when(F.col("query_id") % 4 > 0, F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).alias("kb_id")
    chunks = corpus(spark, d)
    q, c = _vectors(spark, d, chunks)
    found = retrieval.sparse_scoped(questions(spark, d).select("*", kb), chunks, q, c, 10, ["kb_id"])
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT source AS kb_id, doc_id % 8 AS owner_id, count(*) AS chunks FROM documents WHERE source = 'src3' AND doc_id % 8 = 2 GROUP BY ALL UNION ALL SELECT source, NULL, count(*) FROM documents WHERE source = 'src4' GROUP BY ALL")
def p1_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Equality on what a scope names; what it leaves open is no constraint."""
    c = corpus(spark, d)
    both = retrieval.scope_filter(c, kb_id="src3", owner_id=2).groupBy("kb_id", "owner_id").agg(F.count("*").alias("chunks"))
    one = retrieval.scope_filter(c, kb_id="src4").groupBy("kb_id").agg(F.count("*").alias("chunks"))
    return both.unionByName(one.withColumn("owner_id", F.lit(None).cast("long")))


# kept tables and files


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm_top")
def b2_kept_index(spark: SparkSession, d: str) -> DataFrame:
    """An index that was written with stale texts, mended, and lost and regained a fifth of its chunks."""
    c, path = corpus(spark, d), shared_path(spark, "keywords")
    stale = c.withColumn("content", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("stale "), "content")).otherwise(F.col("content")))
    kept_index.change(spark, path, "0", stale, buckets=4)
    kept_index.change(spark, path, "1", c.where("chunk_id % 3 = 0"))
    kept_index.change(spark, path, "2", removed=c.where("chunk_id % 5 = 0"))
    kept_index.change(spark, path, "3", c.where("chunk_id % 5 = 0"))
    return kept_index.search(questions(spark, d), path).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT 'c' || doc_id AS chunk_id, source AS kb_id, CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE '' END || text AS content FROM documents WHERE doc_id % 9 > 0")
def s10_chunk_sink(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are written, half of them again and twice over, and every ninth is deleted."""
    c, path = corpus(spark, d), shared_path(spark, "chunks")
    rows = c.select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "kb_id", "content", F.col("chunk_id").alias("n"))
    chunk_sink.upsert(rows.drop("n"), path)
    for _ in range(2):
        chunk_sink.upsert(rows.where("n % 2 = 0").withColumn("content", F.concat(F.lit("new "), "content")).drop("n"), path)
    chunk_sink.delete(rows.where("n % 9 = 0"), path)
    return chunk_sink.read_chunks(spark, path).select("chunk_id", "kb_id", "content")


@query("SELECT 'one' AS run, 'quality' AS metric, round(avg(quality), 6) AS value FROM labels UNION ALL SELECT 'two', 'toxic', round(avg(toxic), 6) FROM labels")
def s18_metric_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' metrics in one table, the first written again after a wrong value."""
    labels, path = read(spark, d, "labels"), shared_path(spark, "metrics")
    mean = lambda c, more=0: labels.agg((F.round(F.avg(c), 6) + more).alias("value")).select(F.lit(c).alias("metric"), "value")
    files.write_metrics(mean("quality", 1), path, "one")
    files.write_metrics(mean("toxic"), path, "two")
    files.write_metrics(mean("quality"), path, "one")
    return spark.read.parquet(path).select("run", "metric", "value")


@query("SELECT item_id, text FROM benchmark")
def s6_benchmark_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items written as JSON lines and read back by byte ranges."""
    path = shared_path(spark, "items")
    read(spark, d, "benchmark").select("item_id", "text").write.json(path)
    return files.benchmark(spark, path).select(F.variant_get("item", "$.item_id", "bigint").alias("item_id"), F.variant_get("item", "$.text", "string").alias("text"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) ELSE trim(text) || chr(10) || trim(text) END AS texts FROM benchmark")
def s7_flat_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts, lists with a blank, and lists of lists."""
    t = F.col("text")
    value = F.when(F.col("item_id") % 3 == 0, t).when(F.col("item_id") % 3 == 1, F.to_json(F.array(t, F.lit(" ")))).otherwise(F.to_json(F.array(F.array(t), F.array(t))))
    return read(spark, d, "benchmark").select("item_id", F.array_join(files.flat_texts(value), "\n").alias("texts"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'free' AS plan, 0 AS visits, CAST(NULL AS DOUBLE) AS balance FROM customer")
def s17_back_filled(spark: SparkSession, d: str) -> DataFrame:
    """A customer table of an earlier version."""
    old = read(spark, d, "customer").drop("c_acctbal")
    target = old.selectExpr("*", "'' AS plan", "0 AS visits", "0.5D AS balance").schema
    return tables.back_filled(old, target, {"plan": "free", "visits": 0})[0]


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1 AS page_num, string_agg(x, chr(10) ORDER BY doc_id || '_p1_' || i) AS text, count(*) AS children FROM l GROUP BY doc_id""")
def a10_rebuilt_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for parents, each with a child."""
    lines = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "content")).select("doc_id", F.lit(1).alias("page_num"), F.concat("doc_id", F.lit("_p1_"), F.col("i").cast("string")).alias("id"), "content")
    parents = lines.select(F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), "doc_id", "page_num", F.lit("parent").alias("chunk_type"), "content")
    children = lines.select(F.concat("id", F.lit("_c0")).alias("chunk_id"), F.col("id").alias("parent_id"), "doc_id", "page_num", F.lit("child").alias("chunk_type"), "content")
    counted = chunking.with_parents(children, parents).groupBy("doc_id", "page_num").agg(F.count("generation_text").alias("children"))
    return chunking.page_texts(parents.unionByName(children)).join(counted, ["doc_id", "page_num"])


# spellings


@query(f"""WITH s AS (SELECT doc_id, '第十四次 ' || text AS t, CASE doc_id % 4 WHEN 0 THEN '表 3.1 ' WHEN 1 THEN ' fig. 2' WHEN 2 THEN 'Table-7' ELSE '' END || split_part(text, chr(10), 1) AS line,
 replace(text, '$', '') || '$a+b$ and $$c' || chr(10) || 'd$$ but $ no' AS f, CASE doc_id % 5 WHEN 0 THEN '不支持。' WHEN 1 THEN 'YES!' WHEN 2 THEN '**No**' WHEN 3 THEN '' ELSE text END AS reply, '{{' || text AS broken FROM documents)
SELECT doc_id, replace({NORM.format('t')}, '第十四次', '第14次') AS normal, regexp_matches(regexp_replace(line, '[\\s  -     　]+', '', 'g'), '(?i)^(表|图|table|fig)[.\\-]?\\d') AS caption,
 array_to_string(regexp_extract_all(f, '\\$\\$[^$]+\\$\\$|\\$[^$\\n]+\\$'), '|') AS formulas, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS reply, '{{"a": ' || doc_id || '}}' AS json FROM s""")
def f2_spelled(spark: SparkSession, d: str) -> DataFrame:
    """F2b, F11, F12, F15, F16 over whole texts."""
    text.small_batches(spark)
    t, k = F.col("text"), F.col("doc_id")
    line = F.concat(F.when(k % 4 == 0, "表 3.1 ").when(k % 4 == 1, " fig. 2").when(k % 4 == 2, "Table-7").otherwise(""), F.substring_index(t, "\n", 1))
    formula = F.concat(F.replace(t, F.lit("$"), F.lit("")), F.lit("$a+b$ and $$c\nd$$ but $ no"))
    reply = F.when(k % 5 == 0, "不支持。").when(k % 5 == 1, "YES!").when(k % 5 == 2, "**No**").when(k % 5 == 3, "").otherwise(t)
    return read(spark, d, "documents").select("doc_id", text.normalized(F.concat(F.lit("第十四次 "), t)).alias("normal"), text.is_caption(line).alias("caption"), F.array_join(text.formulas(formula), "|").alias("formulas"), text.reply_to_bool(reply).cast("int").alias("reply"), text.first_json(F.concat(F.lit('so {"a": '), k.cast("string"), F.lit("} "), t)).alias("json"))


@query(r"""WITH s AS (SELECT doc_id, '\quad  x \, { ' || replace(text, ' ', '  ') || ' }\hspace*{2em} \textcircled{=}' AS t FROM documents)
SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(t, '[ \t]*(?:(?:\\q?quad|\\hspace\*?\{[^}]*\})[ \t]*)+|[ \t]{2,}', ' ', 'g'), '\s*([{}])\s*', '\1', 'g'), '\textcircled{=}', '@'), '^\s+|\s+$', '', 'g') AS latex FROM s""")
def f13_clean_latex(spark: SparkSession, d: str) -> DataFrame:
    """whole texts with doubled blanks between spacing macros."""
    t = F.concat(F.lit(r"\quad  x \, { "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit(r" }\hspace*{2em} \textcircled{=}"))
    return read(spark, d, "documents").select("doc_id", text.clean_latex(t).alias("latex"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT query_id, string_agg('[' || rank || '] ' || coalesce(content, '') || ' (来源: ' || coalesce(CASE WHEN chunk_id % 2 = 0 THEN kb_id END, '未知文档') || ', 第' || (chunk_id % 3) || '页, chunk_id: ' || chunk_id || ')', chr(10) || chr(10) ORDER BY rank) AS context FROM bm_top JOIN corpus USING (chunk_id) WHERE rank <= 3 GROUP BY query_id""")
def f21_context_text(spark: SparkSession, d: str) -> DataFrame:
    """the three best chunks as numbered context."""
    chunks = corpus(spark, d)
    top = retrieval.with_chunks(retrieval.bm25(questions(spark, d), chunks, 3), chunks)
    item = F.struct("rank", "content", F.when(F.col("chunk_id") % 2 == 0, F.col("kb_id")).alias("doc_name"), (F.col("chunk_id") % 3).alias("page_num"), F.col("chunk_id").cast("string").alias("chunk_id"))
    return top.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c")).select("query_id", text.context_text(F.col("c")).alias("context"))


# streams


@query(f"""WITH {RECORDS}, w AS (SELECT id, user_id % 50 = 0 OR id % 40 = 0 AS exempt, round(coalesce(sum(cost) OVER o, 0), 4) AS spent_before, count(*) FILTER (cost IS NULL) OVER o AS unknown_before FROM records WINDOW o AS (PARTITION BY user_id, date_trunc('day', created_at) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, spent_before, unknown_before, CAST(spent_before >= 100 AND NOT exempt AS INTEGER) AS blocked FROM w""")
def st5_quota_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST5: the events as a stream; every fiftieth user is an admin, every fortieth request has its own key."""
    schema = read(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    ok = F.col("event_type") != "error"
    rows = e.select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.when(ok, F.round("value", 4)).alias("cost"), F.when(F.col("user_id") % 50 == 0, "admin").alias("role"), (F.col("event_id") % 40 == 0).alias("own_key"))
    found = streams.drained(streams.quota_stream(rows, 100.0), "append")
    return found.select(F.col("request_id").alias("id"), F.round("spent_before", 4).alias("spent_before"), "unknown_before", F.col("blocked").cast("int").alias("blocked"))
