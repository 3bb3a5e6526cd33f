"""Retrieval queries over documents, embeddings and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.functions.text import words
from tallyloom.operators import retrieval as R
from tallyloom.operators.vector_index import VectorIndex
from tallyloom.store import files_digest, shared_folder

QUESTION = "Licensed under the Apache License, Version 2.0. erth tion"
QUERY_VECTOR = 0

TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')"
ASKED = "(" + " UNION ALL ".join(f"SELECT '{w}' AS term" for w in QUESTION.split()) + ")"
BM25 = f"""
tok AS (SELECT doc_id, {TOKENS} AS tokens FROM documents),
sz AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_len FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term),
idf AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM df, sz),
mi AS (SELECT avg(idf) AS mean FROM idf),
q AS {ASKED},
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term FROM tok) GROUP BY doc_id, term),
bm AS (SELECT doc_id, sum(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean_len))) AS score
       FROM q JOIN tf USING (term) JOIN idf USING (term), mi, sz GROUP BY doc_id),
bmr AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 15)"""
VEC = """
qv AS (SELECT embedding::DOUBLE[64] AS q FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, qv),
vr AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs QUALIFY rank <= 15)"""
RRF = "rrf AS (SELECT doc_id, sum(0.5 / (60 + rank)) AS score FROM (SELECT vec_id AS doc_id, rank FROM vr UNION ALL SELECT doc_id, rank FROM bmr) GROUP BY doc_id)"
N_ASKED = len(set(QUESTION.lower().split()))
ASKED_LOWER = "[" + ", ".join(f"'{w}'" for w in sorted(set(QUESTION.lower().split()))) + "]"
OVERLAP = f"len(list_intersect({ASKED_LOWER}, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) / {float(N_ASKED)}"
RERANK = f"""
rr AS (SELECT d.doc_id, round({OVERLAP}, 6) AS rerank_score FROM rrf JOIN documents d USING (doc_id)),
rk AS (SELECT doc_id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, doc_id) AS id FROM rr QUALIFY id <= 8)"""


def query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()[0])


def bm25_index(spark, sf_dir) -> R.Bm25Index:
    """The stored index of the documents; built at its first question, and again when the files change."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/bm25-{files_digest(spark, docs.inputFiles())}"
    try:
        return R.Bm25Index.load(spark, path)
    except FileNotFoundError:
        return R.Bm25Index.build(docs, path)


def bm25_ranked(spark, sf_dir, question=QUESTION):
    scored = bm25_index(spark, sf_dir).search(question).withColumn("_s", F.round("score", 9))
    return R.ranked(R.top(scored, "_s", "doc_id", R.CANDIDATES), "_s", "doc_id").drop("_s")


def vec_ranked(spark, sf_dir):
    scored = R.cosine(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)).select("vec_id", "label", F.round("score", 9).alias("_s"), "score")
    return R.ranked(R.top(scored, "_s", "vec_id", R.CANDIDATES), "_s", "vec_id").drop("_s")


@query(r"SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, length(text) AS n_chars, sha256(text) AS sha FROM documents WHERE lang IN ('de', 'en')")
def doc_load(spark, sf_dir):
    """Directory load: files of chosen kinds, one row each."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "en"))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


CHUNKS = "(SELECT doc_id, k AS chunk_no, substring(text, k * 384 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 384.0))::BIGINT + 1)) AS k FROM documents WHERE length(text) > 0))"


@query(f"SELECT doc_id, chunk_no, chunk FROM {CHUNKS}")
def chunk_fixed(spark, sf_dir):
    return R.chunk_fixed(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, chunk_no, 'passage: ' || chunk AS passage FROM {CHUNKS}")
def chunk_prefix(spark, sf_dir):
    return chunk_fixed(spark, sf_dir).select("doc_id", "chunk_no", F.concat(F.lit("passage: "), "chunk").alias("passage"))


@query()
def chunk_recursive(spark, sf_dir):
    return R.chunk_recursive(table(spark, sf_dir, "documents"))


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vec_index(spark, sf_dir):
    """What a vector index stores beside the vectors."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(R.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {VEC} SELECT vec_id, label, rank, round(score, 6) AS score FROM vr")
def vec_topk(spark, sf_dir):
    return vec_ranked(spark, sf_dir).select("vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 15""")
def vec_index_topk(spark, sf_dir):
    """The fifteen nearest of every vector whose id is divisible by 100, by an index that is built first."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(vectors, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    found, _ = index.search(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), R.CANDIDATES)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {VEC} SELECT vec_id, round(score, 6) AS score FROM vs WHERE vec_id <> 0 ORDER BY round(vs.score, 9) DESC, vec_id LIMIT 10")
def vec_most_similar(spark, sf_dir):
    scored = R.cosine(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)).where(F.col("vec_id") != QUERY_VECTOR).withColumn("_s", F.round("score", 9))
    return R.top(scored, "_s", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT vec_id, round(score, 6) AS score FROM vs WHERE vec_id <> 0 ORDER BY round(vs.score, 9), vec_id LIMIT 10")
def vec_least_similar(spark, sf_dir):
    scored = R.cosine(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)).where(F.col("vec_id") != QUERY_VECTOR).withColumn("_s", -F.round("score", 9))
    return R.top(scored, "_s", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, rank, round(score, 6) AS score FROM bmr")
def bm25_topk(spark, sf_dir):
    return bm25_ranked(spark, sf_dir).select("doc_id", "rank", F.round("score", 6).alias("score"))


def fused(spark, sf_dir):
    vectors = vec_ranked(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "rank")
    return R.fuse([(vectors, 0.5), (bm25_ranked(spark, sf_dir), 0.5)], "doc_id")


@query(f"WITH {BM25}, {VEC}, {RRF} SELECT doc_id, round(score, 9) AS score FROM rrf")
def rag_rrf(spark, sf_dir):
    return fused(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {BM25}, {VEC}, {RRF} SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS id, doc_id, d.source, d.text AS page_content FROM rrf JOIN documents d USING (doc_id)")
def rag_retrieve(spark, sf_dir):
    """Context and metadata, numbered from 1."""
    found = fused(spark, sf_dir).withColumn("_s", F.round("score", 9)).join(table(spark, sf_dir, "documents"), "doc_id")
    return R.ranked(found, "_s", "doc_id", "id").select("id", "doc_id", "source", F.col("text").alias("page_content"))


def reranked(spark, sf_dir, question=QUESTION):
    found = fused(spark, sf_dir).join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "text", F.round(R.overlap_score(F.col("text"), question), 6).alias("rerank_score"))
    return R.ranked(R.top(found, "rerank_score", "doc_id", R.KEPT), "rerank_score", "doc_id", "id")


@query(f"WITH {BM25}, {VEC}, {RRF}, {RERANK} SELECT id, doc_id, rerank_score FROM rk")
def rag_rerank(spark, sf_dir):
    return reranked(spark, sf_dir).select("id", "doc_id", "rerank_score")


@query(f"WITH {BM25}, {VEC}, {RRF}, {RERANK} SELECT r::BIGINT AS retries, best, CASE WHEN coalesce(best, 0) >= 0.3 OR r >= 3 THEN 'generate' ELSE 'reformulate' END AS route FROM (SELECT max(rerank_score) AS best FROM rk), range(0, 4) t(r) UNION ALL SELECT 0, 0.29, 'reformulate' UNION ALL SELECT 3, 0.29, 'generate'")
def rag_gate(spark, sf_dir):
    best = reranked(spark, sf_dir).agg(F.max("rerank_score").alias("best")).crossJoin(spark.range(4).withColumnRenamed("id", "retries"))
    fixed = spark.createDataFrame([(0, 0.29), (3, 0.29)], "retries long, best double")
    return best.unionByName(fixed).select("retries", "best", R.gate(F.col("best"), F.col("retries")).alias("route"))


#: Attempts of the loop: the question, and what each reformulation makes of it.
ATTEMPTS = ("qqqq zzzz wwww", "qqqq zzzz wwww license apache", "qqqq zzzz wwww license apache the", "the of and to")


def _best_sql(question: str) -> str:
    asked = sorted(set(question.split()))
    return f"(SELECT max(round(len(list_intersect([{', '.join(repr(w) for w in asked)}], list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) / {float(len(asked))}, 6)) FROM documents)"


@query("WITH a(attempt, question, best) AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT, '{q}', {_best_sql(q)}" for k, q in enumerate(ATTEMPTS)) + "), f AS (SELECT min(attempt) AS stop FROM a WHERE best >= 0.3 OR attempt >= 3) SELECT attempt, question, best, CASE WHEN attempt = stop THEN 'generate' ELSE 'reformulate' END AS route FROM a, f WHERE attempt <= stop")
def rag_loop(spark, sf_dir):
    """Bounded loop of question, gate and reformulation."""
    docs = table(spark, sf_dir, "documents").select("text")

    def best(question: str) -> float | None:
        return docs.agg(F.max(F.round(R.overlap_score(F.col("text"), question), 6))).first()[0]

    rows = R.retrieval_loop(ATTEMPTS[0], lambda _, k: ATTEMPTS[k + 1], best)
    return spark.createDataFrame([(r["attempt"], r["question"], r["best"], r["route"]) for r in rows], "attempt long, question string, best double, route string")


@query(f"WITH {BM25}, {VEC}, {RRF}, {RERANK} SELECT string_agg('[' || id || '] ' || d.source || ': ' || substring(d.text, 1, 200), chr(10) ORDER BY id) AS context FROM rk JOIN documents d USING (doc_id)")
def rag_context(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "source", F.lit(": "), F.substring("text", 1, 200))
    rows = reranked(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    return rows.select(F.array_join(F.col("x.line"), "\n").alias("context"))


@query(f"WITH {BM25}, {VEC}, {RRF}, {RERANK} SELECT id, rk.doc_id, d.source, rerank_score, printf('%.3f', rerank_score) AS shown, len({TOKENS})::INTEGER AS n_words FROM rk JOIN documents d USING (doc_id)")
def rag_report(spark, sf_dir):
    return reranked(spark, sf_dir).select("id", "doc_id", "source", "rerank_score", F.format_string("%.3f", "rerank_score").alias("shown"), F.size(words(F.col("text"))).alias("n_words"))


@query("SELECT conv_id, right(string_agg(role || ': ' || left(text, 1500), chr(10) ORDER BY turn), 4000) AS log FROM conversations GROUP BY conv_id")
def conv_tail(spark, sf_dir):
    """The last 4000 characters of each log, messages cut to 1500."""
    return R.log_tail(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, lag(text) OVER w AS previous, lag(role) OVER w AS previous_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conv_prev_turn(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.lag("role").over(w).alias("previous_role"))


@query(f"SELECT role, sum(n)::BIGINT AS tokens, round(sum(n) / 1e6 * CASE WHEN role = 'assistant' THEN 0.6 ELSE 0.15 END, 9) AS cost FROM (SELECT role, len({TOKENS}) AS n FROM conversations) GROUP BY role")
def token_cost(spark, sf_dir):
    used = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.size(words(F.col("text")))).cast("long").alias("tokens"))
    return used.withColumn("cost", F.round(F.col("tokens") / 1e6 * F.when(F.col("role") == "assistant", 0.6).otherwise(0.15), 9))


@query("SELECT doc_id, round(0.6 * greatest(0, least(1, coalesce(quality * 1.5 - 0.2, 0.5))) + 0.4 * greatest(0, least(1, n_chars / 4000.0)), 6) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def quality_score(spark, sf_dir):
    """Weighted completeness and depth, clamped; 0.5 where a part is missing."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.round(0.6 * clamp(F.col("quality") * 1.5 - 0.2) + 0.4 * clamp(F.col("n_chars") / 4000.0), 6).alias("score"))


def clamp(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.5))))


@query("SELECT doc_id, (doc_id % 5)::BIGINT AS revisions, CASE WHEN n_chars / 4000.0 >= 0.7 OR doc_id % 5 >= 3 THEN 'done' ELSE 'revise' END AS route FROM documents")
def quality_gate(spark, sf_dir):
    score, revisions = F.col("n_chars") / 4000.0, F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select("doc_id", revisions.alias("revisions"), F.when((score >= 0.7) | (revisions >= 3), "done").otherwise("revise").alias("route"))
