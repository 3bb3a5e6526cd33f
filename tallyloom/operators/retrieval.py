"""Hybrid retrieval: chunks, vector and BM25 candidates, rank fusion, reranking, the relevance gate."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tallyloom.functions.text import words
from tallyloom.session import ship_package
from tallyloom.store import shared_folder
from tallyloom.versions import Versions

CANDIDATES, KEPT, RRF_K, RELEVANT, MOST_RETRIES = 15, 8, 60, 0.3, 3
WORD = re.compile(r"[^ \t\n\r\f]+")  # as words()
K1, B, EPSILON = 1.5, 0.75, 0.25


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_no (from 0), chunk: windows of `size` characters, each `overlap` into the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    at = F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    cut = docs.where(F.length(text) > 0).select(F.col(doc_id), F.col(text), at)
    return cut.select(doc_id, F.col("chunk_no").cast("long").alias("chunk_no"), F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def split_recursive(text: str, size: int = 512, overlap: int = 128, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that is in the text."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = list(text) if mark == "" else text.split(mark)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        piece = mark.join(held).strip()
        if piece:
            out.append(piece)

    for p in parts:
        if len(p) > size and finer:
            if held:
                flush()
                held = []
            out += split_recursive(p, size, overlap, finer)
            continue
        while held and len(mark.join([*held, p])) > size:
            flush()
            keep = held[:]
            while keep and (len(mark.join(keep)) > overlap or len(mark.join([*keep, p])) > size):
                keep.pop(0)
            if keep == held:
                keep = []
            held = keep
            if not held:
                break
        held.append(p)
    if held:
        flush()
    return out


def chunk_recursive(docs: DataFrame, size: int = 512, overlap: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_no, chunk: separator-aware pieces; each text is cut where it is read."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, numbers, chunks = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, piece in enumerate(split_recursive(t or "", size, overlap)):
                    ids.append(k)
                    numbers.append(n)
                    chunks.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(chunks, pa.string())], names=["doc_id", "chunk_no", "chunk"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, chunk_no long, chunk string")


def write_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Store chunks in place of older ones, and read them back."""
    chunks.write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "chunk", prefix: str = "passage: ", batch: int = 64) -> DataFrame:
    """chunks with `embedding`, by a model that encodes lists of prefixed texts; nulls are the empty text.

    The model is called in the tasks, on `batch` texts at a time; it travels with them
    or loads itself there.
    """
    ship_package(chunks.sparkSession)

    def run(batches):
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            vectors = [list(map(float, v)) for k in range(0, len(texts), batch) for v in encode(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def write_vectors(chunks: DataFrame, path: str, vector: str = "embedding") -> DataFrame:
    """Store chunks with their vectors and the vectors' lengths in place of an older index, and read them back."""
    return write_chunks(chunks.withColumn("norm", norm(F.col(vector))), path)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """vectors with `score`, their cosine with one query vector (0 for a zero vector)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = float(sum(x * x for x in query)) ** 0.5
    length = norm(F.col(vector)) * size
    return vectors.withColumn("score", F.when(length > 0, dot(F.col(vector), q) / length).otherwise(0.0))


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best rows, ties by key: a partial top-n per task, then one of n rows each."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(n)


def ranked(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """Rank from 1 in a small table of candidates."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).cast("long"))


@dataclass(frozen=True)
class Bm25Index:
    """Stored postings, so that a question reads the words it has and nothing else.

    postings: term, doc_id, tf, n (words of the document); terms: term, df, idf; both in
    folders by a hash of the term. stats: documents, their mean length, the mean idf.
    """

    path: str
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int = 64

    @staticmethod
    def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", buckets: int = 64) -> Bm25Index:
        """Write the index of docs to path, in place of an older one once it is complete.

        Words are split at white space, case-sensitive; a null text is an empty document.
        A document's words are counted where it is read, and cross the network once.
        Postings are dealt by bucket and a hash of the document, so a word that all
        documents have is written by several tasks.
        """
        spark = docs.sparkSession
        at = Versions(spark, path)
        folder = at.fresh()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        counts = _counted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():
            counts = counts.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.first("n").alias("n"))
        slices = max(4, -(-parts // 16))
        dealt = counts.select("term", "doc_id", "tf", "n", bucket, F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("_slice")).repartition(parts, "bucket", "_slice").drop("_slice")
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
        df = _stored(spark, f"{folder}/postings", POSTINGS).groupBy("bucket", "term").agg(F.count("*").alias("df"))
        sizes = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(words(F.col(text)))).alias("mean_len"))
        sizes.write.mode("overwrite").parquet(f"{folder}/sizes")
        n_docs = spark.read.parquet(f"{folder}/sizes")
        idf = df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"), "bucket")
        idf.repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
        mean = _stored(spark, f"{folder}/terms", TERMS).agg(F.avg("idf").alias("mean_idf"))
        n_docs.crossJoin(F.broadcast(mean)).write.mode("overwrite").parquet(f"{folder}/stats")
        at.commit(folder)
        return Bm25Index.load(spark, path, buckets)

    @staticmethod
    def load(spark: SparkSession, path: str, buckets: int = 64) -> Bm25Index:
        """The last index that was published at path; FileNotFoundError without one."""
        folder = Versions(spark, path).current()
        if folder is None:
            raise FileNotFoundError(path)
        stats = spark.read.parquet(f"{folder}/stats")
        return Bm25Index(path, _stored(spark, f"{folder}/postings", POSTINGS), _stored(spark, f"{folder}/terms", TERMS), stats, buckets)

    def search(self, question: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
        """doc_id, score > or < 0 for each document with a word of the question.

        Okapi BM25; a repeated word of the question counts as often. A negative idf is
        replaced by `epsilon` times the mean idf over the whole vocabulary.
        """
        asked = question.split()
        if not asked:
            return self.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        here = F.col("bucket").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in dict.fromkeys(asked)]) & F.col("term").isin(asked)
        times = F.element_at(F.create_map(*[F.lit(x) for w in dict.fromkeys(asked) for x in (w, float(asked.count(w)))]), F.col("term"))
        raw = F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))
        # One row per word of the question, and one row of statistics.
        weights = self.terms.where(here).crossJoin(F.broadcast(self.stats)).select("term", (raw * times).alias("weight"), "mean_len")
        part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean_len")))
        return self.postings.where(here).join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.sum(part).alias("score"))


POSTINGS, TERMS = "term string, doc_id long, tf long, n int, bucket int", "term string, df long, idf double, bucket int"


def _counted(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, n of rows doc_id, text: each text's words, counted where it is read."""
    ship_package(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = [Counter(WORD.findall(t or "")) for t in batch.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                n = pa.array([f.total() for f in found], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), batch.column(0).take(rows), pa.array([x for f in found for x in f.values()], pa.int64()), n.take(rows)], names=["term", "doc_id", "tf", "n"])

    return docs.mapInArrow(run, f"term string, doc_id {dict(docs.dtypes)['doc_id']}, tf long, n int")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)  # an empty table may have no file to read it from


def bm25(docs: DataFrame, question: str, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """Scores of one question, without an index to keep: it is built in the shared folder."""
    path = f"{shared_folder(docs.sparkSession)}/bm25-{uuid.uuid4().hex}"
    return Bm25Index.build(docs, path, doc_id, text).search(question, k1, b, epsilon)


def log_tail(turns: DataFrame, chars: int = 4000, message_chars: int = 1500) -> DataFrame:
    """conv_id, log: the last `chars` characters of each conversation, messages cut to `message_chars`.

    Turns in order, a null one last, those alike by their lines. A null line takes no
    room; without any other the log is null. Every line takes its line end at least, so no more
    than the last `chars` + 1 lines of a conversation can be in its tail; what is
    before them doesn't leave its task.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("line").isNull(), F.desc_nulls_first("turn"), F.desc("line"))
    lines = turns.select("conv_id", "turn", F.concat("role", F.lit(": "), F.substring("text", 1, message_chars)).alias("line"))
    rows = lines.withColumn("_k", F.row_number().over(by)).where(f"_k <= {chars + 1}")
    after = Window.partitionBy("conv_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    # A line that all `chars` are behind still has its line end among them.
    rows = rows.withColumn("_after", F.coalesce(F.sum(F.length(F.coalesce("line", F.lit(""))) + 1).over(after), F.lit(0))).where(f"_after <= {chars}")
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct((-F.col("_k")).alias("at"), "line")))).alias("x"))
    return joined.select("conv_id", F.expr(f"CASE WHEN size(x) > 0 THEN right(array_join(x.line, '\n'), {chars}) END").alias("log"))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """key, score: weighted reciprocal ranks of ranked lists, summed."""
    parts = [df.select(key, (F.lit(weight) / (k + F.col("rank"))).alias("part")) for df, weight in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def overlap_score(text: Column, question: str, most_words: int | None = None) -> Column:
    """Share of the question's distinct lower-case words that the text has; most_words: what the scorer reads of a text, all of it where None."""
    asked = sorted({w for w in question.lower().split() if w})
    wanted = F.array(*[F.lit(w) for w in asked])
    read = words(F.lower(text))
    return F.size(F.array_intersect(wanted, F.slice(read, 1, most_words) if most_words else read)) / F.lit(float(max(1, len(asked))))


def gate(best: Column, retries: Column) -> Column:
    """generate where the best score is high enough or the retries are used up, else reformulate."""
    return F.when(F.coalesce(best, F.lit(0.0)) >= RELEVANT, "generate").when(retries < MOST_RETRIES, "reformulate").otherwise("generate")


def retrieval_loop(question: str, reformulate: Callable[[str, int], str], best_score: Callable[[str], float | None]) -> list[dict]:
    """Ask, and reformulate at most MOST_RETRIES times; one scalar per pass reaches the driver."""
    out = []
    for retry in range(MOST_RETRIES + 1):
        score = best_score(question)
        done = (score or 0.0) >= RELEVANT or retry >= MOST_RETRIES
        out.append({"attempt": retry, "question": question, "best": score, "route": "generate" if done else "reformulate"})
        if done:
            break
        question = reformulate(question, retry)
    return out
