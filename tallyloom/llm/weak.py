"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.quality_stats import NAMES, text_counts
from tallyloom.store import store
from tallyloom.llm.textkit import rows_and_texts
from tallyloom.session import ship_package


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where its SQL condition holds, bad first; abstains elsewhere."""

    name: str
    bad: str
    good: str


#: Conditions over quality_stats.NAMES. Lacking one defect says little, so most
#: rules vote bad or abstain; each defect is seen by two rules, which lets
#: expectation-maximisation confirm one by the other.
RULES = (
    Rule("length", "n_words < 50", "false"),
    Rule("symbols", "n_symbols * 10 > n_words", "false"),
    Rule("symbol_chars", "n_symbols * 60 > word_chars", "false"),
    Rule("duplicate_lines", "n_dup_lines * 10 > n_lines * 3", "false"),
    Rule("repeated_words", "n_repeat_words * 10 > n_words * 3", "false"),
    Rule("variety", "n_words >= 50 and n_distinct_words * 4 < n_words and n_repeat_words * 5 > n_words", "false"),
    Rule("capitals", "n_letters > 0 and n_upper * 10 > n_letters * 4", "false"),
    Rule("exclamation", "n_bangs * 10 > n_words", "false"),
    Rule("word_length", "n_words > 0 and (word_chars > 14 * n_words or word_chars < 2.5 * n_words)", "n_words >= 50 and word_chars between 3.5 * n_words and 9 * n_words and n_symbols * 50 <= n_words and n_bangs * 50 <= n_words and n_repeat_words * 5 <= n_words"),
    Rule("prose", "false", "n_words >= 50 and n_symbols * 50 <= n_words and n_upper * 100 <= n_letters * 15 and n_repeat_words * 5 <= n_words and n_bangs * 50 <= n_words"),
    Rule("lines", "n_lines >= 10 and n_dup_lines * 2 > n_lines", "n_words >= 50 and n_dup_lines * 10 <= n_lines and n_repeat_words * 5 <= n_words and n_symbols * 50 <= n_words"),
)

ABSTAIN, GOOD, BAD = 0, 1, 2


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and quality_stats.NAMES of every text; null counts as empty."""
    ship_package(docs.sparkSession)

    def run(batches):
        for rows, data, off in rows_and_texts(batches):
            counts = text_counts(data, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[n].astype(np.int64)) for n in NAMES)], names=["doc_id", *NAMES])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), BAD).when(F.expr(r.good), GOOD).otherwise(ABSTAIN).alias(f"vote_{r.name}") for r in rules]


@dataclass
class VoteModel:
    """Share of good texts, and how often each rule is right when it votes."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        weight = np.log(self.accuracy / (1 - self.accuracy))
        odds = np.log(self.prior / (1 - self.prior)) + ((patterns == GOOD).astype(float) - (patterns == BAD)) @ weight
        return 1 / (1 + np.exp(-odds))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.5, accuracy: float = 0.85, strength: float = 10.0) -> VoteModel:
    """EM over counted vote patterns (one row each).

    `strength` pseudo-votes at the starting values keep a rule that hardly votes
    where it began. An accuracy stays within 0.55 and 0.99: a rule is better than
    a coin, which fixes what the two classes mean, and none is beyond doubt.
    Without patterns the starting values come back.
    """
    m = VoteModel(prior, np.full(patterns.shape[1], accuracy))
    w = counts.astype(float)
    said_good, said_bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
    n_votes = w @ (said_good + said_bad)
    for _ in range(rounds if len(w) else 0):
        good = m.posterior(patterns) * w
        before = m
        right = good @ said_good + (w - good) @ said_bad
        m = VoteModel(float(np.clip((good.sum() + strength * prior) / (w.sum() + strength), 0.05, 0.95)), np.clip((right + strength * accuracy) / (n_votes + strength), 0.55, 0.99))
        if max(abs(m.prior - before.prior), np.abs(m.accuracy - before.accuracy).max()) < 1e-9:
            break
    return m


def weak_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, quality_stats.NAMES, a vote per rule, quality (posterior probability of good), kept.

    The counts are written once to the shared folder. Only the numbers of equal
    vote patterns reach the driver: at most 3 to the number of rules, whatever
    the size of the input. Null and empty texts are texts without words; texts of any
    length are counted whole; repeated rows are kept as they are and count as often;
    a null id stays null; extra columns are ignored, so no name can clash; an empty
    table gives an empty one.
    """
    counted = store(document_counts(docs, doc_id, text).select("*", *votes(rules)), "votes").df
    names = [f"vote_{r.name}" for r in rules]
    found = sorted(tuple(r) for r in counted.groupBy(*names).count().collect())
    table = np.array([r[:-1] for r in found], dtype=np.int64).reshape(len(found), len(rules))
    m = fit_votes(table, np.array([r[-1] for r in found]))
    logit = F.lit(float(np.log(m.prior / (1 - m.prior))))
    for name, a in zip(names, m.accuracy.tolist()):
        weight = float(np.log(a / (1 - a)))
        logit = logit + F.when(F.col(name) == GOOD, weight).when(F.col(name) == BAD, -weight).otherwise(0.0)
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return counted.withColumn("quality", quality).withColumn("kept", F.col("quality") >= threshold)
