"""The stream extensions give what the batch queries give."""

from pyspark.sql import functions as F

from tallyloom.operators import sequences as S
from tallyloom.streaming.events import machine_states, windowed_counts

SF = "/root/testdata/sf0.001"
BIT = "CASE WHEN event_type IN ('click', 'purchase') THEN '1' ELSE '0' END"


def source(spark, tmp_path, parts=3):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    rows = batch.orderBy("ts", "event_id").collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], batch.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_windows(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(windowed_counts(stream, "1 day", "40 days"), "win", "update", tmp_path)
    got = {(r.window_start, r.kind): r.n for r in spark.table("win").groupBy("window_start", "kind").agg(F.max("n").alias("n")).collect()}
    want = {(r.d, r.event_type): r.n for r in batch.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_machine(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(machine_states(stream, S.PARITY, F.expr(BIT)), "fsm", "update", tmp_path)
    got = {r.user_id: r.s.state for r in spark.table("fsm").groupBy("user_id").agg(F.max_by(F.struct("state", "read"), "read").alias("s")).collect()}
    inputs = S.sequences(batch, "user_id", ["ts", "event_id"], F.expr(BIT))
    want = {r.user_id: r.r.state for r in inputs.select("user_id", S.run(S.PARITY, F.col("inputs")).alias("r")).collect()}
    assert got == want
