"""The operators' queries over the whole test tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import alignment, ball_tree, bpe, katz, longest_match, mixing, ordinal, signature_tree, suffix_array, tiff, toxicity, transducer, weak
from tallyloom.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per text: its bytes stored as TIFF and read back; see tiff.document_media()."""
    return tiff.document_media(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document has too; see suffix_array.repeated_passages()."""
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method's verdict, behind the two fixed base rules."""
    from pyspark.sql import functions as F

    scored = weak.weak_quality(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "quality")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 4-word shingle sets, similarity 0.85 or more; see signature_tree.jaccard_components()."""
    return signature_tree.jaccard_components(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded bytes; see bpe.encoded()."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of greedy pieces by the same vocabulary; see longest_match.piece_counts()."""
    pieces = longest_match.rank_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return longest_match.piece_counts(table(spark, sf_dir, "documents"), pieces)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores learned from labels outside the held-out fold; see toxicity.toxicity()."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mixture; see mixing.mixed_sources()."""
    return mixing.mixed_sources(table(spark, sf_dir, "documents"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of grade 1 or better; see ordinal.ordinal_quality()."""
    labels = table(spark, sf_dir, "labels")
    return ordinal.ordinal_quality(table(spark, sf_dir, "documents"), labels.select("doc_id", ordinal.graded().alias("grade")))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores beside the base's; see katz.katz_scores()."""
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op11_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against sentencepiece; see alignment.aligned()."""
    a, b = (Path(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(table(spark, sf_dir, "documents"), a.read_text("utf-8"), b.read_bytes())


def op12_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See transducer.streamed()."""
    raw = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text("utf-8")
    return transducer.streamed(table(spark, sf_dir, "documents"), raw)


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters, 5 rounds; see ball_tree.ball_tree_clusters()."""
    return ball_tree.ball_tree_clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_tiff_media, op2_suffix_dedup, op3_weak_supervision, op4_jaccard_join, op5_byte_bpe, op6_longest_match, op7_toxicity, op8_mixing, op9_ordinal_quality, op10_katz, op11_group_alignment, op12_streaming_bpe, op13_ball_tree)}


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(doc_id::VARCHAR, '') || ':0') AS k FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM d GROUP BY source),
m AS (SELECT max(total)::DOUBLE AS top, min(total) FILTER (WHERE total > 0)::DOUBLE AS least FROM t),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(least / top, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(least / top, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM b, m WHERE i < 45),
a AS (SELECT round((lo + hi) / 2, 9) AS a FROM b WHERE i = 45),
g AS (SELECT source, total, CASE WHEN total > 0 THEN floor(total * pow(total / top, a - 1))::BIGINT ELSE 0 END AS target FROM t, m, a),
h AS (SELECT d.*, g.total, g.target, coalesce(sum(n_tokens) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n_tokens) OVER (PARTITION BY d.source, k) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, n_tokens, (CASE WHEN total > 0 THEN target // total + CASE WHEN before < target % total THEN 1 ELSE 0 END ELSE 1 END)::BIGINT AS copies FROM h
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i, md5(array_to_string(words[i + 1:i + 50], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
h AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
v AS (SELECT doc_id, i, min(first) AS first FROM g JOIN h USING (g) GROUP BY 1, 2),
s AS (SELECT *, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM v)),
c AS (SELECT doc_id, n, sum(least(50, coalesce(i - low_before, 50))) AS copied FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS low_before FROM s WHERE first < doc_id) GROUP BY 1, 2)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + 50)::BIGINT AS end_word, (max(i) + 50 - min(i))::BIGINT AS n_words, coalesce(any_value(copied), 0)::BIGINT AS copied_words, min(first) AS first_doc_id FROM s LEFT JOIN c USING (doc_id, n) GROUP BY doc_id, n
"""


def op13_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """As the query, with every distance computed."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT row, vec_id, v.e, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.e[i] - c{n}.e[i]) * (v.e[i] - c{n}.e[i])))::BIGINT AS d
  FROM v, c{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)""")
        if n < rounds:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, c{n}.e) AS e FROM c{n} LEFT JOIN (
  SELECT c, list(x ORDER BY i) AS e FROM (SELECT c, i, floor(sum(e[i])::DOUBLE / count(*))::BIGINT AS x FROM a{n}, range(1, {dims + 1}) AS r(i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.e, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op8_mixing": OP8_SQL, "op13_ball_tree": op13_sql()}
