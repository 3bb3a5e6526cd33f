"""State over several batches: a log that is taken back, a checkpoint, rolling lines, a pool of terms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.operators import state as S
from tallyloom.store import shared_folder


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, turn, text AS source, role AS target FROM conversations WHERE conv_id % 4 = 1")
def oplog_pop(spark, sf_dir):
    """Four batches are logged, the third of them twice; two are taken back: the last one returned is replayed from its end."""
    log = S.OperationLog(spark, fresh(spark, "oplog"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("source"), F.col("text").alias("target"))
    for k in (0, 1, 2, 2, 3):
        log.append(rows.where(f"conv_id % 4 = {k}"), f"batch {k}")
    log.pop("first")
    log.pop("second")
    return S.replay(log.last(), "conv_id", "turn")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 = 2")
def ckpt_resume(spark, sf_dir):
    """After a reset, two batches and one of them again, what is not done yet."""
    docs = table(spark, sf_dir, "documents")
    done = S.Checkpoint(spark, fresh(spark, "checkpoint"), "doc_id long")
    done.save(docs.where("doc_id % 3 = 2").select("doc_id"), "before the reset")
    done.reset()
    for k in (0, 1, 1):
        done.save(docs.where(f"doc_id % 3 = {k}").select("doc_id"), f"batch {k}")
    return done.pending(docs, "doc_id").select("doc_id", "source")


@query("""WITH l AS (SELECT conv_id, turn, unnest(range(0, len(s)))::BIGINT AS line_no, unnest(s) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations))
SELECT conv_id, turn, line_no, line FROM l WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, line_no DESC) <= 20""")
def conv_last_lines(spark, sf_dir):
    """The last twenty lines of each log, which comes in three batches, one of them twice."""
    tail = S.RollingTail(spark, fresh(spark, "lines"))
    lines = S.line_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"))
    for k, part in enumerate(("turn < 2", "turn between 2 and 4", "turn between 2 and 4", "turn > 4")):
        tail.add(lines.where(part), "conv_id", ["turn", "line_no"], "line", f"{part}")
    return tail.lines()


@query("""WITH p AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT count(*) AS n, greatest(1, count(*) // 12) AS turns FROM p),
d AS (SELECT p_brand, r, turns, row_number() OVER (PARTITION BY r ORDER BY md5('7:' || r || ':' || p_brand), p_brand) - 1 AS k FROM p, s, range(0, 7) t(r))
SELECT (r * turns + k // 12)::BIGINT AS round, p_brand FROM d WHERE k // 12 < turns AND r * turns + k // 12 < 7""")
def rotate_pool(spark, sf_dir):
    """Seven rounds of twelve brands; the pool is dealt anew when fewer are left."""
    return S.rotating_picks(table(spark, sf_dir, "part"), "p_brand", 12, 7, "7")
