"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.optim import lbfgs
from tallyloom.llm.quality_stats import text_counts
from tallyloom.llm.textkit import Hasher, Words, mix, rows_and_texts
from tallyloom.session import ship_package

#: Shape tokens: ratios of counts, cut into bins; each (ratio, bin) is a feature.
RATIOS = (("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_symbols", "n_words"), ("n_upper", "n_letters"), ("n_bangs", "n_words"), ("word_chars", "n_words"), ("n_distinct_words", "n_words"), ("n_stops", "n_words"), ("n_digits", "word_chars"))
CUTS = np.array([1e-9, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 2.0, 3.0, 4.0, 6.0, 9.0, 14.0])
BINS = len(CUTS) + 1
SIZES = np.array([1, 5, 10, 20, 50, 100, 300, 1000, 5000])
SHAPES = len(RATIOS) * BINS + len(SIZES) + 1
NGRAM_BITS = 11
WIDTH = (1 << NGRAM_BITS) + SHAPES


HALF = 65_535.0  # training features, 0 to 1, travel in 16 bits


def trigram_ids(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigram at each position, and whether it lies within one text."""
    d = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint64)
    code = d[:-2] << np.uint64(16) | d[1:-1] << np.uint64(8) | d[2:]
    valid = np.ones(len(data), bool)
    for back in (1, 2):
        at = off[1:] - back
        valid[at[at >= off[:-1]]] = False
    return (mix(code) >> np.uint64(64 - NGRAM_BITS)).astype(np.int64), valid


def shape_ids(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, ratios + 1) features beyond the trigrams."""
    cols = []
    for k, (above, below) in enumerate(RATIOS):
        ratio = counts[above] / np.maximum(counts[below], 1)
        cols.append((1 << NGRAM_BITS) + k * BINS + np.searchsorted(CUTS, ratio, "right"))
    cols.append((1 << NGRAM_BITS) + len(RATIOS) * BINS + np.searchsorted(SIZES, counts["n_words"], "right"))
    return np.stack(cols, axis=1)


def dense_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) float32: square roots of relative trigram frequencies, and shape tokens.

    The roots keep a text that repeats a few words from outweighing all others.
    """
    n = len(off) - 1
    counts = text_counts(data, off, Words(data, off), Hasher(data))
    ids, valid = trigram_ids(data, off)
    owner = np.repeat(np.arange(n), np.diff(off))[valid]
    table = np.zeros((n, WIDTH), np.float32)
    grams = np.bincount(owner * (1 << NGRAM_BITS) + ids[valid], minlength=n << NGRAM_BITS).reshape(n, -1)
    table[:, : 1 << NGRAM_BITS] = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    table[np.arange(n)[:, None], shape_ids(counts)] = 1
    return table


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - thresholds[k - 1]); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return (dense_features(data, off) @ self.weights.astype(np.float32)).astype(np.float64)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = 1e-3, rounds: int = 200) -> OrdinalModel:
    """Proportional odds: one weight vector for all grades, thresholds t1 < t1 + exp(g2) < ...

    Features are scaled by their spread for the ridge. Grades without a rating
    keep a threshold between their neighbours'; without rows, every score is 0
    and the grades are equally likely.
    """
    n, width = x.shape
    base = np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades)))
    if n == 0:
        return OrdinalModel(np.zeros(width), base)
    share = np.array([(np.sum(grades >= k) + 0.5) / (n + 1) for k in range(1, n_grades)])
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / n - mean * mean, 0))
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 0.1), 0.0)
    def cuts(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[:width], cuts(p[width:])
        z = x @ (w * scale).astype(np.float32)
        z = z.astype(np.float64)
        above = np.concatenate([[-np.inf], t])[grades]  # P(y >= grade) = s(z - above)
        below = np.concatenate([t, [np.inf]])[grades]
        s = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        pa_, pb = s(z - above), s(z - below)
        like = np.maximum(pa_ - pb, 1e-12)
        da, db = pa_ * (1 - pa_), pb * (1 - pb)
        value = -float(np.mean(np.log(like))) + ridge / 2 * float(w @ w)
        dz = -(da - db) / like / n
        grad_t = np.zeros(n_grades - 1)
        for k in range(1, n_grades):
            grad_t[k - 1] = np.sum((da / like)[grades == k]) / n - np.sum((db / like)[grades == k - 1]) / n
        grad_p = np.cumsum(grad_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(p[width + 1 :])])
        return value, np.concatenate([(x.T @ dz.astype(np.float32)).astype(np.float64) * scale + ridge * w, grad_p])

    p = lbfgs(loss, np.concatenate([np.zeros(width), start[:1], gaps]), rounds)
    return OrdinalModel(p[:width] * scale, cuts(p[width:]))


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from two marks: 0 low quality, 1 good but toxic, 2 good; null where either is missing."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def fit_on_labels(docs: DataFrame, ratings: DataFrame, n_grades: int, doc_id: str = "doc_id", text: str = "text", most_rows: int = 8_000, **fit) -> OrdinalModel:
    """Fit on the first `most_rows` rated ids in hash order, a bounded sample; ratings: doc_id, grade.

    An id that is rated twice counts once, by its greatest grade; one that has
    several texts gives its smallest. Null ids, grades and texts are left out.
    """
    ship_package(docs.sparkSession)
    chosen = ratings.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where(f"doc_id is not null and grade between 0 and {n_grades - 1}")
    chosen = chosen.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            table = dense_features(data, off)
            small = np.round(table * HALF).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in small], pa.binary())], names=["grade", "x"])

    got = rows.mapInArrow(run, "grade int, x binary").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    x = np.empty((got.num_rows, WIDTH), np.float32)
    at = 0
    for chunk in got.column("x").chunks:
        for v in chunk:
            x[at] = np.frombuffer(v.as_buffer(), np.uint16)
            x[at] /= HALF
            at += 1
    del got
    return fit_ordinal(x, grades, n_grades, **fit)


def ordinal_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, doc_id: str = "doc_id", text: str = "text", select_from: int = 1, least: float = 0.5, **fit) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability, kept of every text.

    tail_probability is P(grade >= select_from); kept where it is `least` or
    more. Every whole text is read, of any length. Null and empty texts are scored
    as texts without words; repeated rows are scored alike; a null id stays null;
    extra columns of either table are ignored; an empty table gives an empty one.
    Without ratings every grade is equally likely.
    """
    model = fit_on_labels(docs, ratings, n_grades, doc_id, text, **fit)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            score = sent.value.scores(data, off)
            tails = sent.value.tails(score)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(tails.sum(axis=1)), pa.array(tails[:, select_from - 1])], names=["doc_id", "score", "expected_grade", "tail_probability"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= least)


def keep_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, text: str = "text", select_from: int = 1, least: float = 0.5, **fit) -> DataFrame:
    """The rows of docs that ordinal_quality keeps, all their columns, without a shuffle.

    Null and empty texts are judged as texts without words, repeated rows alike, a
    row without an id like any other; an empty table gives an empty one, of the same
    columns. Nothing is added to the rows, so no column name can clash.
    """
    model = fit_on_labels(docs, ratings, n_grades, text=text, **fit)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, off in rows_and_texts(batches, text):
            tails = sent.value.tails(sent.value.scores(data, off))
            kept = part.filter(pa.array(tails[:, select_from - 1] >= least))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
