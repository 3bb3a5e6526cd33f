"""Sentences by full stops, with abbreviations learned from the corpus.

A word that is an abbreviation stands before a full stop almost every time, is short, and
is often followed by a small letter. The first is a ratio of likelihoods over counts of
all texts (Kiss and Strunk, 2006); the words that pass are a table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator, Set
from math import log
from unicodedata import category

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship_package
from tallyloom.store import store

LEAST, ALWAYS = 0.3, 0.99
ENDS = re.compile(r"[.!?…][\"'»«“”)\]]*(?!\S)")
OPENS = "\"'»«„“([‚"
AFTER = re.compile(r"\s*[\"'»«„“(\[‚]*(\S?)")  # the first character of the next token that opens nothing
TOKENS = re.compile(r"[^ \t\n\x0b\f\r]+")
LETTERS = re.compile(r"[^\W\d_]+")


def _written(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """w, times, small (of those, before a small letter, where it ends with a full stop): tokens as they stand in the texts, counted by task, `most` or so at once."""
    ship_package(docs.sparkSession)

    def rows(seen: Counter, small: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([small[w] for w in seen], pa.int64())], names=["w", "times", "small"])

    def run(batches):
        seen, small = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = TOKENS.findall(t or "")
                seen.update(tokens)
                small.update(w for w, after in zip(tokens, tokens[1:]) if w[-1] == "." and category(after[0]) == "Ll")
                if len(seen) >= most:
                    yield rows(seen, small)
                    seen, small = Counter(), Counter()
        yield rows(seen, small)

    return docs.mapInArrow(run, "w string, times long, small long")


def abbreviations(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """word (lower case, without its full stop), n, n_stop, n_small, score of each abbreviation.

    n counts the word, n_stop those with a full stop, n_small those of them before a
    small letter. It is one if the weighted ratio of likelihoods is at least `least`, or
    if a small letter follows at least half of two full stops or more. Words of letters
    and inner stops only. Null texts have no words. One row per token as it is written is shuffled.
    """
    written = store(_written(docs.select(text)).groupBy("w").agg(F.sum("times").alias("times"), F.sum("small").alias("small")), "tokens").df  # the texts are read once, and shapes looked at once a token
    shape = F.lower(F.regexp_replace("w", r"^[\"'»«„“(\[‚]+", ""))
    stop = shape.rlike(r"^\p{L}[\p{L}.]*\.$")
    word = F.when(stop, F.regexp_replace(shape, r"\.$", "")).otherwise(F.regexp_replace(shape, r"[,;:!?…\"'»«“”)\].]+$", ""))
    counts = written.select(word.alias("word"), "times", *[F.when(stop, F.col(c)).otherwise(0).alias(f"of_{c}") for c in ("times", "small")]).where(F.col("word").rlike(r"^\p{L}[\p{L}.]*$"))
    counts = counts.groupBy("word").agg(F.sum("times").alias("n"), F.sum("of_times").alias("n_stop"), F.sum("of_small").alias("n_small"))
    totals = counts.agg(F.sum("n").alias("_n"), F.sum("n_stop").alias("_stop"))
    p = F.least(F.col("_stop") / F.col("_n"), F.lit(1 - 1e-9))
    with_stop, without = F.col("n_stop"), F.col("n") - F.col("n_stop")
    ratio = 2 * (with_stop * (log(ALWAYS) - F.log(p)) + without * (log(1 - ALWAYS) - F.log(1 - p)))
    letters, stops = F.length(F.replace("word", F.lit("."))), F.length("word") - F.length(F.replace("word", F.lit("."))) + 1
    score = ratio * F.exp(-letters) * stops * F.pow(letters, -without)
    # One row of totals beside every word that has a stop.
    scored = counts.where("n_stop > 0").crossJoin(F.broadcast(totals)).withColumn("score", score)
    return scored.where((F.col("score") >= least) | ((F.col("n_small") >= 2) & (2 * F.col("n_small") >= F.col("n_stop")))).select("word", "n", "n_stop", "n_small", "score")


def marks(text: str) -> Iterator[tuple[int, str | None]]:
    """Where sentences end, behind a token that ends one, and the word that makes it none if it is an abbreviation. Only tokens with a mark at their end are looked at."""
    last = 0
    for m in ENDS.finditer(text):
        at = m.end()
        word = None
        if text[at - 1] == ".":
            bare = text[last:at].rsplit(None, 1)[-1].lstrip(OPENS)[:-1]
            after = AFTER.match(text, at)[1]
            if after.islower() or bare.isdigit():
                last = at
                continue  # ordinals and dates; behind the last token the text ends anyway
            word = bare.lower()
        last = at
        yield at, word


def ends(text: str, known: Set[str], more: Collection[str] = ()) -> list[int]:
    """Where sentences end; more: abbreviations beside the known ones."""
    return [at for at, word in marks(text) if word is None or word not in known and word not in more]


def spans(text: str, known: Set[str], more: Collection[str] = ()) -> list[str]:
    """Sentences as parts of the text."""
    cuts = [0, *ends(text, known, more), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def split_sentences(text: str | None, known: Set[str]) -> list[list[str]]:
    """Sentences as tokens between white space."""
    return [t for s in spans(text or "", known) if (t := s.split())]


def small_words(sentence: str) -> list[str]:
    """Words of letters in small letters; each by itself, since the form of a sigma and an i hang on what is beside them."""
    found = LETTERS.findall(sentence)
    return "\n".join(found).lower().split("\n") if found else []


def _others(docs: DataFrame, known: DataFrame, sent: Broadcast) -> DataFrame:
    """key, more: by the hash of each text, the abbreviations that it asks for and that were not sent."""

    def unsent(batches):
        for batch in batches:
            yield batch.filter(pa.array([w not in sent.value for w in batch.column(0).to_pylist()], pa.bool_()))

    def asked(batches):
        for batch in batches:
            keys, words = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {w for _, w in marks(t) if w is not None and w not in sent.value}
                keys += [key] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["key", "word"])

    rest = known.select(F.col("word").cast("string").alias("word")).where("word IS NOT NULL").mapInArrow(unsent, "word string").distinct()
    wanted = docs.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "text").mapInArrow(asked, "key string, word string").distinct()
    return wanted.join(rest, "word").groupBy("key").agg(F.collect_list("word").alias("more"))


def sentences(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 100_000) -> DataFrame:
    """doc_id, sentence (from 0), words: the sentences' words of letters in small letters; sentences without one are dropped.

    known: word of every abbreviation. The `most` of the greatest score, some 5 MB, go
    to every task. Where there are more, texts ask for the others in a join: a text gets
    those of its own words.
    """
    spark = ship_package(docs.sparkSession)
    first = [r[0] for r in known.orderBy(F.desc("score"), "word").limit(most + 1).select("word").collect()]
    sent = spark.sparkContext.broadcast(frozenset(first[:most]))
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    if len(first) > most:
        others = _others(rows, known, sent).withColumnRenamed("key", "_text")
        rows = rows.join(others, F.sha2("text", 256) == F.col("_text"), "left").select("key", "text", "more")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("array<string>"))

    def run(batches):
        for batch in batches:
            owners, numbers, words, places = [], [], [], [0]
            for row, (t, more) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                n = 0
                for s in spans(t or "", sent.value, frozenset(more or ())):
                    kept = small_words(s)
                    if kept:
                        owners.append(row)
                        numbers.append(n)
                        words += kept
                        places.append(len(words))
                        n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(words, pa.string()))], names=["key", "sentence", "words"])

    return rows.mapInArrow(run, f"key {kind}, sentence long, words array<string>").withColumnRenamed("key", doc_id)
