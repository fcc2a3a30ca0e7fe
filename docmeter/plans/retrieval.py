"""Queries of retrieval, chunking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmeter.functions import intents, text
from docmeter.operators import chunking, evaluation, retrieval, vector_index
from docmeter.operators.kept import shared_path, written
from docmeter.plans.base import BM25, CORPUS, FUSED, PAIRS, QUESTIONS, SPARSE, TERMS, corpus, query, questions, read


def _vectors(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    chunks = corpus(spark, d) if chunks is None else chunks
    return retrieval.hash_weights(questions(spark, d), "query_id", "query"), retrieval.hashed(chunks, "chunk_id", "content")


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def b1_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """B1, A7, F6."""
    c = corpus(spark, d)
    idf, _ = retrieval.term_stats(retrieval.postings(c), c)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH w AS (SELECT regexp_replace(lower('表3.1 数据 ' || coalesce(text, '')), '[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+', '', 'g') AS t FROM documents),
r AS (SELECT t, regexp_replace(t, '[a-z0-9]+', '', 'g') AS rest FROM w), u AS (SELECT unnest(list_concat(regexp_extract_all(t, '[a-z0-9]+'), CASE WHEN rest = '' THEN [] ELSE {PAIRS.format('rest')} END)) AS term FROM r)
SELECT term, count(*) AS n FROM u GROUP BY term""")
def f6_fused_terms(spark: SparkSession, d: str) -> DataFrame:
    """the terms without word breaks of all documents, each after a Chinese caption."""
    t = read(spark, d, "documents").select(F.concat(F.lit("表3.1 数据 "), F.coalesce("text", F.lit(""))).alias("t"))
    return t.select(F.explode(text.terms("t", "fused")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT '表 3.1 数据库 été ' || coalesce(text, '') AS t FROM documents) SELECT term, count(*) AS n FROM (SELECT unnest({TERMS.format('t')}) AS term FROM w) GROUP BY term")
def f6_word_terms(spark: SparkSession, d: str) -> DataFrame:
    """the terms with word breaks of all documents, each after a Chinese and a French word."""
    t = read(spark, d, "documents").select(F.concat(F.lit("表 3.1 数据库 été "), F.coalesce("text", F.lit(""))).alias("t"))
    return t.select(F.explode(text.terms("t")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm_top")
def b2_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """B2, B3, J6, P2, T1, W1."""
    return retrieval.bm25(questions(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25},
s AS (SELECT bm.query_id, chunk_id, score FROM bm JOIN corpus USING (chunk_id) WHERE kb_id = 'src' || (query_id % 20)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE round(score, 9) <> 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM t WHERE rank <= 5""")
def p1_scoped_bm25(spark: SparkSession, d: str) -> DataFrame:
    """A question sees one knowledge base, scores use the statistics of all."""
    q = questions(spark, d).withColumn("kb_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return retrieval.bm25(q, corpus(spark, d), 5, scope=["kb_id"]).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {CORPUS}, {QUESTIONS}, {SPARSE} SELECT CAST(substr(key, 2) AS BIGINT) AS chunk_id, bucket, round(w, 6) AS w FROM unit WHERE key LIKE 'c%'")
def e1_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """E1, E3, F7."""
    return retrieval.hash_weights(corpus(spark, d), "chunk_id", "content").select("chunk_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("w"))


@query(f"WITH {CORPUS}, {QUESTIONS}, {SPARSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sv_top")
def v3_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    """V3."""
    return retrieval.sparse_top_k(*_vectors(spark, d), 20).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


DENSE = """SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
(SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


@query(DENSE)
def v1_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector asks, all answer."""
    v = read(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    return retrieval.vector_top_k(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
(SELECT q.vec_id AS query_id, 'c' || c.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c
 WHERE q.vec_id % 20 = 0 AND c.label <> 0 AND c.label <> 1 AND (q.vec_id % 40 = 0 OR c.label % 3 = q.label % 3))) WHERE rank <= 7""")
def v2_scoped_child_topk(spark: SparkSession, d: str) -> DataFrame:
    """V1, V2: child chunks with a vector alone; every second question sees one knowledge base (a third of the labels)."""
    v = read(spark, d, "embeddings").withColumn("kb_id", F.concat(F.lit("kb"), (F.col("label") % 3).cast("string")))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 40 != 0, F.col("kb_id")).alias("kb_id"))
    chunks = v.select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.when(F.col("label") != 1, F.col("embedding")).alias("vector"), "kb_id", F.when(F.col("label") == 0, "parent").otherwise("child").alias("kind"))
    return retrieval.vector_top_k(q, chunks.where("kind = 'child'"), 7, scope=["kb_id"]).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def v4_approximate_topk(spark: SparkSession, d: str) -> DataFrame:
    """V4: an inverted file, built and searched; tests measure its recall against V1."""
    v = read(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    index = vector_index.build(v.withColumnRenamed("vec_id", "chunk_id"), shared_path(spark, "vectors"))
    return vector_index.search(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), index, 10)


@query("SELECT len(embedding) AS size, count(*) AS n FROM embeddings WHERE len(embedding) <> 32 GROUP BY ALL")
def v5_wrong_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """V5: held against a dimension of 32, which the vectors do not have."""
    return retrieval.bad_dimensions(read(spark, d, "embeddings"), "embedding", 32)


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25}, {SPARSE}, {FUSED} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM fused")
def h1_rrf(spark: SparkSession, d: str) -> DataFrame:
    """H1, J8, F22."""
    chunks = corpus(spark, d)
    q, c = _vectors(spark, d, chunks)
    return retrieval.fuse([retrieval.sparse_top_k(q, c, 20), retrieval.bm25(questions(spark, d), chunks)]).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {SPARSE}, {FUSED},
words AS (SELECT query_id, chunk_id, first_score, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')))) AS shared FROM fused JOIN corpus USING (chunk_id) JOIN questions USING (query_id)),
r AS (SELECT query_id, chunk_id, first_score, round(first_score + 0.05 * shared + 0.15, 4) AS score FROM words)
SELECT query_id, chunk_id, rank, score, round(first_score, 6) AS first_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r) WHERE rank <= 3""")
def h2_hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The flagship."""
    chunks = corpus(spark, d)
    return retrieval.hybrid(questions(spark, d), chunks, *_vectors(spark, d, chunks)).withColumn("first_score", F.round("first_score", 6))


@query()
def h4_model_rerank(spark: SparkSession, d: str) -> DataFrame:
    """H4, H5, J9, X2 with a deterministic model: shared characters."""
    chunks = corpus(spark, d)
    q, c = _vectors(spark, d, chunks)
    top = retrieval.fuse([retrieval.sparse_top_k(q, c, 20), retrieval.bm25(questions(spark, d), chunks)])
    rows = retrieval.with_chunks(top, chunks.select("chunk_id", "content")).join(questions(spark, d), "query_id")
    return retrieval.model_rerank(rows, lambda q, texts: [len(set(q) & set(t)) / len(set(q) | set(t)) for t in texts], 3)


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT query_id, count(*) AS candidates, [{{'chunk_id': x.chunk_id}} FOR x IN list_sort(list({{'rank': rank, 'chunk_id': chunk_id}}))][1:5] AS top FROM bm_top GROUP BY query_id".replace("SELECT query_id, count(*) AS candidates, [{'chunk_id': x.chunk_id} FOR x IN list_sort(list({'rank': rank, 'chunk_id': chunk_id}))][1:5] AS top", "SELECT query_id, count(*) AS candidates, array_to_string([x.chunk_id FOR x IN list_sort(list({'rank': rank, 'chunk_id': chunk_id}))][1:5], ',') AS top"))
def h9_trace(spark: SparkSession, d: str) -> DataFrame:
    """H9."""
    t = retrieval.trace(retrieval.bm25(questions(spark, d), corpus(spark, d)))
    return t.select("query_id", "candidates", F.array_join(F.transform("top", lambda x: x["chunk_id"].cast("string")), ",").alias("top"))


@query(r"""WITH c AS (SELECT doc_id, regexp_matches(text, '\$|\\begin\{|\\\(') OR (contains(lower(text), 'formula') AND contains(text, '<!--')) AS formula,
 len(regexp_extract_all(text, '(?m)^[ \t]*\|')) >= 2 OR regexp_matches(trim(text), '(?i)^(表|Table)\s*\d') AS is_table,
 contains(text, '```') OR contains(lower(text), '<!-- code') AS code, contains(text, '<!-- image -->') OR contains(lower(text), '<!-- figure') OR regexp_matches(ltrim(text), '(?i)^(图|Fig)') AS figure FROM documents)
SELECT doc_id, is_table, figure, formula, code FROM c""")
def p10_chunk_kinds(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    return read(spark, d, "documents").select("doc_id", *(intents.is_kind(F.col("text"), k).alias("is_table" if k == "table" else k) for k in ("table", "figure", "formula", "code")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every third question names a table, every other third wants formulas listed."""
    q = questions(spark, d).withColumn("question", F.when(F.col("query_id") % 3 == 0, F.lit("列出所有公式 all formula")).when(F.col("query_id") % 3 == 1, F.concat(F.lit("表"), (F.col("query_id") % 9).cast("string"), F.lit(" . 1 的内容"))).otherwise(F.col("query")))
    return q.withColumn("kb_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).withColumn("owner_id", (F.col("query_id") % 8).cast("long"))


ASKED = "asked_q AS (SELECT query_id, query, CASE query_id % 3 WHEN 0 THEN '列出所有公式 all formula' WHEN 1 THEN '表' || (query_id % 9) || ' . 1 的内容' ELSE query END AS question, 'src' || (query_id % 20) AS kb_id, query_id % 8 AS owner_id FROM questions)"


@query(f"""WITH {QUESTIONS}, {ASKED},
r AS (SELECT query_id, question, regexp_extract_all(question, '(表|表格|图|公式)\\s*(\\d+)\\s*(?:[.\\-]\\s*(\\d+))?', 1) AS p, regexp_extract_all(question, '(表|表格|图|公式)\\s*(\\d+)\\s*(?:[.\\-]\\s*(\\d+))?', 2) AS n, regexp_extract_all(question, '(表|表格|图|公式)\\s*(\\d+)\\s*(?:[.\\-]\\s*(\\d+))?', 3) AS m FROM asked_q),
e AS (SELECT query_id, CASE WHEN regexp_matches(question, '所有|全部|列出|列举|有哪些|哪些|都有|给出|给我|汇总|统计') THEN CASE
 WHEN regexp_matches(question, '(?i)表|表格|table') AND NOT regexp_matches(question, '(?i)(表|表格)\\s*\\d|table\\s*\\d') THEN 'table'
 WHEN regexp_matches(question, '(?i)图|图片|图像|figure|fig') AND NOT regexp_matches(question, '(?i)图\\s*\\d|figure\\s*\\d') THEN 'figure'
 WHEN regexp_matches(question, '(?i)公式|equation|formula') AND NOT regexp_matches(question, '(?i)公式\\s*[（(]?\\s*\\d|equation\\s*\\d') THEN 'formula'
 WHEN regexp_matches(question, '(?i)代码|code|程序') THEN 'code' END END AS kind FROM asked_q)
SELECT r.query_id, kind, coalesce(array_to_string([p[i] || n[i] || CASE WHEN coalesce(m[i], '') <> '' THEN '.' || m[i] ELSE '' END FOR i IN range(1, len(p) + 1)], ','), '') AS refs, kind IS NOT NULL OR len(p) > 0 AS exempt FROM r JOIN e USING (query_id)""")
def p9_question_intents(spark: SparkSession, d: str) -> DataFrame:
    """P9, P11, P12."""
    q = F.col("question")
    return _asked(spark, d).select("query_id", intents.enumeration(q).alias("kind"), F.array_join(intents.references(q), ",").alias("refs"), intents.exempt(q).alias("exempt"))


def _chunks(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    """Documents as child chunks of one page, every fifth with a table caption."""
    return (corpus(spark, d) if chunks is None else chunks).withColumn("chunk_type", F.lit("child")).withColumn("page_num", (F.col("chunk_id") % 5 + 1).cast("int")).withColumn("content", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("表"), (F.col("chunk_id") % 9).cast("string"), F.lit(".1 $x$ "), F.col("content"))).otherwise(F.col("content")))


CHUNKS = "chunks AS (SELECT chunk_id, kb_id, owner_id, 'child' AS chunk_type, chunk_id % 5 + 1 AS page_num, CASE WHEN chunk_id % 5 = 0 THEN '表' || (chunk_id % 9) || '.1 $x$ ' || content ELSE content END AS content FROM corpus)"


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {ASKED}, {CHUNKS},
f AS (SELECT query_id, chunk_id, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY page_num, chunk_id) AS n, 1.0 AS rank_score FROM chunks JOIN asked_q USING (kb_id, owner_id)
 WHERE query_id % 3 = 0 AND (regexp_matches(content, '\\$|\\\\begin\\{{|\\\\\\(') OR (contains(lower(content), 'formula') AND contains(content, '<!--')))),
a AS (SELECT * FROM f WHERE n <= 40 UNION ALL SELECT query_id, chunk_id, 1, rank, NULL FROM bm_top),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list, n) = 1)
SELECT query_id, chunk_id, CAST(rank_score AS DOUBLE) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY list, n, chunk_id) AS rank FROM o""")
def h6_typed_first(spark: SparkSession, d: str) -> DataFrame:
    """H6, U1, U3."""
    chunks = corpus(spark, d)
    return retrieval.typed_first(_asked(spark, d), _chunks(spark, d, chunks), retrieval.bm25(questions(spark, d), chunks))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {ASKED}, {CHUNKS},
k AS (SELECT query_id, kb_id, owner_id, '表' || (query_id % 9) || '.1' AS key FROM asked_q WHERE query_id % 3 = 1),
h AS (SELECT query_id, chunk_id, contains(content, '|') OR len(regexp_extract_all(content, '(?m)^[ \\t]*\\|')) >= 2 OR regexp_matches(trim(content), '(?i)^(表|Table)\\s*\\d') AS tbl FROM chunks JOIN k USING (kb_id, owner_id) WHERE contains(regexp_replace(content, '\\s+', '', 'g'), key)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, tbl ORDER BY chunk_id) AS r FROM h),
f AS (SELECT query_id, chunk_id, 0 AS list, CASE WHEN tbl THEN r ELSE r + 2 END AS n, 2.0 AS rank_score FROM n WHERE r <= CASE WHEN tbl THEN 2 ELSE 1 END),
b AS (SELECT query_id, chunk_id, 1 AS list, rank AS n, CAST(NULL AS DOUBLE) AS rank_score FROM bm_top JOIN chunks USING (chunk_id) LEFT JOIN (SELECT query_id, key FROM k) USING (query_id) WHERE key IS NULL OR contains(regexp_replace(content, '\\s+', '', 'g'), key)),
o AS (SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list, n) = 1),
z AS (SELECT query_id, chunk_id, CAST(rank_score AS DOUBLE) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY list, n, chunk_id) AS rank FROM o)
SELECT * FROM z WHERE rank <= 20""")
def h7_named_first(spark: SparkSession, d: str) -> DataFrame:
    """H7, U2."""
    chunks = corpus(spark, d)
    return retrieval.named_first(_asked(spark, d), _chunks(spark, d, chunks), retrieval.bm25(questions(spark, d), chunks))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25} SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, CAST(chunk_id % 7 AS BIGINT) AS doc_id, '未知文档' AS doc_name, 0 AS page, content AS text, round(score, 6) AS score FROM bm_top JOIN corpus USING (chunk_id)""")
def p6_public_sources(spark: SparkSession, d: str) -> DataFrame:
    """P6."""
    chunks = corpus(spark, d)
    top = retrieval.with_chunks(retrieval.bm25(questions(spark, d), chunks), chunks.select("chunk_id", F.concat(F.lit("[文档概要] short\n"), "content").alias("content")))
    rows = top.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("chunk_id") % 7).alias("doc_id"), F.lit(None).cast("string").alias("doc_name"), F.lit(None).cast("int").alias("page_num"), "content", F.lit(None).cast("double").alias("rank_score"), F.round("score", 6).alias("rrf_score"))
    return retrieval.to_sources(rows)


# chunking


@query("""SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, CAST(i * 96 + 1 AS BIGINT), 128) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 128) / 96.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)""")
def k1_windows(spark: SparkSession, d: str) -> DataFrame:
    """K1."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("pos", "part"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+$'), lambda x: trim(x, E' \n\t\r') <> '') AS s FROM documents),
p AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN {'done': CAST([] AS VARCHAR[]), 'open': ''} ELSE list_reduce(list_transform(s, lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x}), lambda a, b: {'done': CASE WHEN length(a.open) > 0 AND length(a.open) + length(b.open) > 512 THEN list_append(a.done, a.open) ELSE a.done END, 'open': CASE WHEN length(a.open) > 0 AND length(a.open) + length(b.open) > 512 THEN b.open ELSE a.open || b.open END}) END AS r FROM s)
SELECT doc_id, pos, part FROM (SELECT doc_id, unnest(list_append(r.done, r.open)) AS part, unnest(range(len(r.done) + 1)) AS pos FROM p WHERE r.open <> '')""")
def k3_packed_parents(spark: SparkSession, d: str) -> DataFrame:
    """K3, F8."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunking.packed(F.col("text"))).alias("pos", "part")).select("doc_id", F.col("pos").cast("long").alias("pos"), "part")


@query()
def k5_chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """K2, K4, K5."""
    return chunking.chunks(read(spark, d, "documents").select("doc_id", F.lit(1).alias("page_num"), "text"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS page_num, x AS text FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM p) WHERE regexp_replace(x, '\\s+', '', 'g') <> ''""")
def s4_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for pages."""
    return chunking.pages(read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("p")), "p")


@query()
def a10_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """A10 and J18 over the chunk table."""
    made = k5_chunk_table(spark, d)
    children = chunking.with_parents(made.where("chunk_type = 'child'"), made).groupBy("doc_id", "page_num").agg(F.count("generation_text").alias("children"))
    return chunking.page_texts(made).join(children, ["doc_id", "page_num"])


# evaluation


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the item's text as the fact, wanted of every document."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("all").alias("doc"), F.col("text").alias("expect"), F.lit(None).cast("int").alias("page"))


NORM = "regexp_replace(lower(regexp_replace({}, '[\\s  -     　]+', '', 'g')), '(\\d),(\\d)', '\\1\\2', 'g')"
GOLD = f"gold AS (SELECT item_id AS question_id, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains({NORM.format('d.text')}, {NORM.format('b.text')}))"


def _gold(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    chunks = (corpus(spark, d) if chunks is None else chunks).select("chunk_id", F.lit("all").alias("doc"), F.lit(1).alias("page_num"), "content")
    return evaluation.gold_chunks(retrieval.small(_golden(spark, d)), chunks, numerals=False)


@query(f"WITH {GOLD} SELECT question_id, chunk_id FROM gold")
def m6_gold_chunks(spark: SparkSession, d: str) -> DataFrame:
    """M6, J11, F1, F2a, F3."""
    return _gold(spark, d)


def _ranks(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Four rank lists."""
    q, c = _vectors(spark, d, chunks)
    dense, words = written(retrieval.sparse_top_k(q, c, 20), "dense"), written(retrieval.bm25(questions(spark, d), chunks), "words")
    fused = written(retrieval.fuse([dense, words], top=20), "fused")
    texts = retrieval.with_chunks(fused, chunks.select("chunk_id", "content")).join(questions(spark, d), "query_id")
    label = lambda df, name: df.select(F.lit(name).alias("label"), F.col("query_id").alias("question_id"), "chunk_id", "rank")
    return label(dense, "vector").union(label(words, "bm25")).union(label(fused, "hybrid")).union(label(retrieval.lexical_rerank(texts, 20), "hybrid+rerank"))


FOUR = f"""{FUSED.replace('<= 12', '<= 20')},
words AS (SELECT query_id, chunk_id, first_score, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')))) AS shared FROM fused JOIN corpus USING (chunk_id) JOIN questions USING (query_id)),
rr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(round(first_score + 0.05 * shared + 0.15, 4), 9) DESC, chunk_id) AS rank FROM words),
ranks AS (SELECT 'vector' AS label, query_id AS question_id, chunk_id, rank FROM sv_top UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM bm_top UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fused UNION ALL SELECT 'hybrid+rerank', query_id, chunk_id, rank FROM rr)"""


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {SPARSE}, {FOUR}, {GOLD},
n AS (SELECT question_id, count(*) AS n_gold FROM gold GROUP BY ALL),
e AS (SELECT label, question_id, n_gold FROM (SELECT DISTINCT label FROM ranks), n),
h AS (SELECT label, question_id, min(rank) AS f, count(*) FILTER (rank <= 3) AS i3, count(*) FILTER (rank <= 5) AS i5, count(*) FILTER (rank <= 10) AS i10 FROM ranks JOIN gold USING (question_id, chunk_id) GROUP BY ALL)
SELECT label, count(*) AS questions, round(avg(CASE WHEN coalesce(i3, 0) > 0 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(coalesce(i3, 0) / n_gold), 6) AS recall_3, round(avg(CASE WHEN coalesce(i5, 0) > 0 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(i5, 0) / n_gold), 6) AS recall_5,
 round(avg(CASE WHEN coalesce(i10, 0) > 0 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(coalesce(i10, 0) / n_gold), 6) AS recall_10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM e LEFT JOIN h USING (label, question_id) GROUP BY label""")
def m7_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M7, M11, U4, W6."""
    chunks = corpus(spark, d)
    found = evaluation.retrieval_scores(_ranks(spark, d, chunks), written(_gold(spark, d, chunks), "gold"))
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


@query(f"WITH {GOLD} SELECT item_id AS question_id FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM gold)")
def m8_questions_without_gold(spark: SparkSession, d: str) -> DataFrame:
    """M8."""
    return evaluation.without_gold(_golden(spark, d), _gold(spark, d)).select("question_id")


@query(f"WITH {GOLD} SELECT question_id, count(*) AS n_gold, round(1.0 / count(*), 6) AS ceiling FROM gold GROUP BY ALL HAVING count(*) > 1")
def m9_recall_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """M9 at k = 1."""
    return evaluation.recall_ceilings(_gold(spark, d), 1).withColumn("ceiling", F.round("ceiling", 6))


@query(f"WITH {CORPUS}, {QUESTIONS}, {SPARSE} SELECT query_id, round(score, 6) AS top1, round(score, 9) < 0.4 AS rejected FROM questions LEFT JOIN (SELECT * FROM sv_top WHERE rank = 1) USING (query_id)")
def m10_negative_check(spark: SparkSession, d: str) -> DataFrame:
    """M10."""
    return evaluation.negatives(retrieval.sparse_top_k(*_vectors(spark, d), 1), questions(spark, d)).withColumn("top1", F.round("top1", 6))


def _answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Golden items, and answers made from the best document: every fourth refuses, every third of the others names the fact."""
    golden = read(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("expect"), F.when(F.col("item_id") % 5 > 0, (F.col("item_id") % 3 + 1).cast("int")).alias("page"), (F.col("item_id") % 4 == 0).alias("negative"), F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string")).alias("group"))
    chunks = corpus(spark, d)
    best = retrieval.with_chunks(retrieval.bm25(questions(spark, d), chunks, 2), chunks.select("chunk_id", "content"))
    sources = best.groupBy(F.col("query_id").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.struct(x["content"].alias("text"), x["rank"].alias("page"))).alias("sources"))
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.when(F.col("item_id") % 4 == 0, F.lit("根据现有资料 无法确定。")).when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.lit("?")).alias("answer"))
    return golden, items.join(sources, "item", "left")


VERDICTS = f"""g AS (SELECT item_id AS item, {NORM.format('text')} AS want, CASE WHEN item_id % 5 > 0 THEN item_id % 3 + 1 END AS page, item_id % 4 = 0 AS negative, 'g' || (item_id % 3) AS grp, CASE WHEN item_id % 4 = 0 THEN '根据现有资料 无法确定。' WHEN item_id % 3 = 0 THEN text ELSE '?' END AS answer FROM benchmark),
s AS (SELECT query_id AS item, count(*) AS n, string_agg(content, ' ' ORDER BY rank) AS t, list(rank) AS pages FROM bm_top JOIN corpus USING (chunk_id) WHERE rank <= 2 GROUP BY ALL),
v AS (SELECT g.item, grp, negative, page, coalesce(n, 0) AS source_count, contains({NORM.format('answer')}, want) AS fact_hit, contains({NORM.format("coalesce(t, '')")}, want) AS grounded, CASE WHEN page IS NOT NULL THEN coalesce(list_contains(pages, page), false) END AS page_hit, contains(answer, '无法确定') AS refused FROM g LEFT JOIN s USING (item))"""


@query(f"WITH {CORPUS}, {QUESTIONS}, {BM25}, {VERDICTS} SELECT item, grp AS \"group\", negative, CAST(source_count AS INTEGER) AS source_count, fact_hit, grounded, CAST(page_hit AS INTEGER) AS page_hit, refused FROM v")
def m1_item_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """M1, F4."""
    return evaluation.verdicts(*_answered(spark, d), numerals=False).select("item", "group", "negative", "source_count", "fact_hit", "grounded", F.col("page_hit").cast("int").alias("page_hit"), "refused")


@query(f"""WITH {CORPUS}, {QUESTIONS}, {BM25}, {VERDICTS} SELECT grp AS "group", count(*) AS items, count(*) FILTER (negative) AS negatives, round(count(*) FILTER (fact_hit AND NOT negative) / nullif(count(*) FILTER (NOT negative), 0), 6) AS fact_rate, round(count(*) FILTER (grounded AND NOT negative) / nullif(count(*) FILTER (NOT negative), 0), 6) AS grounded_rate,
 round(count(*) FILTER (page_hit AND NOT negative AND page IS NOT NULL) / nullif(count(*) FILTER (NOT negative AND page IS NOT NULL), 0), 6) AS page_rate, round(count(*) FILTER (refused AND negative) / nullif(count(*) FILTER (negative), 0), 6) AS refusal_rate, count(*) FILTER (source_count = 0) AS without_sources, 0 AS without_expect, count(*) FILTER (NOT negative AND page IS NULL) AS without_page FROM v GROUP BY grp""")
def m5_report_by_ability(spark: SparkSession, d: str) -> DataFrame:
    """M2, M3, M5, A11, A12."""
    found = evaluation.report(evaluation.verdicts(*_answered(spark, d), numerals=False), ["group"])
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status, value AS retrieval, CASE WHEN event_id % 7 > 0 THEN value * 2 END AS rerank, event_id % 11 = 0 AS degraded FROM events),
o AS (SELECT unnest(['retrieval', 'rerank']) AS stage, unnest([retrieval, rerank]) AS v FROM s WHERE status = 200 AND rerank IS NOT NULL)
SELECT stage, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY v) AS p95, (SELECT count(*) FROM s WHERE status = 429) AS limited, (SELECT count(*) FROM s WHERE degraded) AS degraded FROM o GROUP BY stage""")
def m12_latency(spark: SparkSession, d: str) -> DataFrame:
    """M12, A14."""
    s = read(spark, d, "events").select(F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.col("value").alias("retrieval"), F.when(F.col("event_id") % 7 > 0, F.col("value") * 2).alias("rerank"), (F.col("event_id") % 11 == 0).alias("degraded"))
    return evaluation.latency(s, ["retrieval", "rerank"])


@query("""WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS run, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS fact, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS grounded, CAST(NULL AS DOUBLE) AS refusal FROM events GROUP BY ALL),
l AS (SELECT run, unnest(['fact', 'grounded', 'refusal']) AS metric, unnest([fact, grounded, refusal]) AS v FROM r), p AS (SELECT metric, max(v) FILTER (run = 'a') AS x, max(v) FILTER (run = 'b') AS y FROM l GROUP BY metric)
SELECT metric, round(x, 6) AS before, round(y, 6) AS after, round((y - x) * 100, 6) AS points, CASE WHEN x IS NULL OR y IS NULL THEN 'undecidable' WHEN x = 0 AND y = 0 THEN 'no information' WHEN y < x THEN 'fail' ELSE 'pass' END AS verdict FROM p""")
def m13_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs are users with even and odd ids."""
    share = lambda k: F.avg((F.col("event_type") == k).cast("double"))
    runs = read(spark, d, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("run")).agg(share("click").alias("fact"), share("view").alias("grounded"), F.max(F.lit(None).cast("double")).alias("refusal"))
    found = evaluation.compare(runs, "a", "b", ["fact", "grounded", "refusal"])
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("before", "after", "points")), "verdict")


@query("SELECT a.doc_id AS item, CASE WHEN b.toxic = 1 THEN 'gained' ELSE 'lost' END AS move FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL) a JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL) b USING (doc_id) WHERE a.quality <> b.toxic")
def m14_lost_and_gained(spark: SparkSession, d: str) -> DataFrame:
    """Quality stands for the first run's hits, toxic for the second's."""
    one = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    hit = lambda c: one.select(F.col("doc_id").alias("item"), (F.col(c) == 1).alias("fact_hit"))
    return evaluation.moves(hit("quality"), hit("toxic"))


@query("SELECT vec_id % 10 AS grp, round(avg(p), 6) AS precision FROM (SELECT vec_id % 10 AS vec_id, CASE WHEN sum(u) OVER w > 0 AND u = 1 THEN sum(u) OVER w / row_number() OVER w END AS p FROM (SELECT vec_id, CAST(label % 2 AS INTEGER) AS u FROM embeddings) WINDOW w AS (PARTITION BY vec_id % 10 ORDER BY vec_id)) GROUP BY ALL")
def m19_context_precision(spark: SparkSession, d: str) -> DataFrame:
    """Odd labels stand for useful contexts."""
    rows = read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("grp"), F.col("vec_id").alias("rank"), (F.col("label") % 2 == 1).alias("useful"))
    return evaluation.context_precision(rows, ["grp"]).withColumn("precision", F.round("precision", 6))


@query("SELECT a.label AS grp, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS relevancy FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY ALL")
def m18_answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    """The next vector stands for a generated question's."""
    v = read(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("label").alias("grp"), F.col("embedding").alias("question_vector")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("generated_vector")), "vec_id")
    return evaluation.relevancy(pairs, ["grp"]).withColumn("relevancy", F.round("relevancy", 6))


@query("WITH m AS (SELECT round(avg(quality), 6) AS fact, round(avg(toxic), 6) AS grounded FROM labels) SELECT 'fact' AS metric, 0.8 AS target, fact AS value, CAST(fact >= 0.8 AS INTEGER) AS reached FROM m UNION ALL SELECT 'grounded', 0.8, grounded, CAST(grounded >= 0.8 AS INTEGER) FROM m UNION ALL SELECT 'refusal', 0.8, NULL, NULL UNION ALL SELECT 'faithfulness', 0.8, NULL, NULL")
def m16_target_lines(spark: SparkSession, d: str) -> DataFrame:
    """Shares of labels stand for the rates."""
    one = read(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("fact"), F.round(F.avg("toxic"), 6).alias("grounded"))
    return evaluation.against_targets(one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")).withColumn("reached", F.col("reached").cast("int"))


@query("SELECT CAST(l.doc_id % 6 AS BIGINT) AS grp, round(count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(CASE WHEN quality = 1 THEN 1 END), 0), 6) AS ratio FROM labels l GROUP BY ALL")
def m17_supported_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A label of quality 1 is a claim, supported unless toxic."""
    rows = read(spark, d, "labels").select((F.col("doc_id") % 6).alias("grp"), F.when(F.col("quality") == 1, F.lit("c")).alias("claim"), (F.col("toxic") == 0).alias("supported"))
    return evaluation.supported_ratio(rows, ["grp"]).withColumn("ratio", F.round("ratio", 6))


@query("WITH s AS (SELECT doc_id, length(text) AS before, CASE WHEN doc_id % 3 > 0 THEN length(text) // 2 END AS after, doc_id % 5 = 0 AS negative FROM documents) SELECT count(*) AS n, round(1 - sum(after) / sum(before), 6) AS reduction, CAST(NULL AS VARCHAR) AS reason FROM s WHERE NOT negative AND before > 0 AND after IS NOT NULL")
def m4_token_reduction(spark: SparkSession, d: str) -> DataFrame:
    """M4: characters stand for tokens."""
    s = read(spark, d, "documents").select(F.length("text").alias("before"), F.when(F.col("doc_id") % 3 > 0, F.expr("length(text) div 2")).alias("after"), (F.col("doc_id") % 5 == 0).alias("negative"))
    return evaluation.token_reduction(s).withColumn("reduction", F.round("reduction", 6))
