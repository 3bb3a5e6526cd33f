"""Toxicity: a hashed-word classifier whose score must not hang on identity terms.

Labelled texts are learned together with counterfactual copies: where a text has
identity terms, each is swapped for another of its group; where it has none, a neutral
mention is put in, and that is swapped. The loss has the mean squared change of the score
over all such pairs, taken from the features of both texts of a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.optim import lbfgs
from tallyloom.llm.textkit import LOWER, SALT, Hasher, Words, mix, rows_and_texts
from tallyloom.session import ship_package

#: Everything but letters, digits and bytes of other scripts separates words here.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = False

#: Groups of interchangeable identity terms, in the languages of the corpus.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "citizen", "refugee"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("schwul", "lesbisch", "heterosexuell"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch"),
    ("migrant", "bürger", "flüchtling"),
    ("behindert", "blind", "gehörlos"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("lesbienne", "homosexuel", "hétérosexuel"),
    ("musulman", "chrétien", "juif", "bouddhiste"),
    ("noir", "blanc", "asiatique", "arabe"),
    ("immigré", "citoyen", "réfugié"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("lesbiana", "homosexual", "heterosexual"),
    ("musulmán", "cristiano", "judío", "budista"),
    ("negro", "blanco", "asiático", "árabe"),
    ("inmigrante", "ciudadano", "refugiado"),
)


#: Lengths in bytes of the word beginnings that are features beside whole words: they meet inflected and made-up forms.
BEGINNINGS = (3, 5, 7)


class Features:
    """Numbers of features: identity terms have one each, above all hashed words and beginnings."""

    def __init__(self, bits: int = 20, groups: Sequence[Sequence[str]] = IDENTITY_TERMS):
        self.bits = bits
        self.terms, self.group = [], []
        for g, group in enumerate(groups):
            new = [t.encode() for t in group if t.encode() not in self.terms]  # a term of two groups is of the first
            self.terms += new
            self.group += [g] * len(new)
        self.size = (1 << bits) + len(self.terms)
        self.members = [[k for k, h in enumerate(self.group) if h == g] for g in range(len(groups))]
        ends = np.cumsum([0, *map(len, self.terms)])
        hashed = Hasher(np.frombuffer(b"".join(self.terms), np.uint8)).spans(ends[:-1], ends[1:])
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]

    def term_numbers(self, hashed: np.ndarray) -> np.ndarray:
        """The identity term that each hashed word is; -1 for none."""
        if not len(self.hashed):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        return np.where(self.hashed[at] == hashed, self.order[at], -1)

    def hashes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each lower-case word and each of its longer beginnings, as they come."""
        low = LOWER[data]
        words = Words(low, off, SEPARATORS)
        hasher, owner, mask = Hasher(low), words.owner(), np.uint64((1 << self.bits) - 1)
        hashed = hasher.spans(words.starts, words.ends)
        term = self.term_numbers(hashed)
        owners, ids = [owner], [np.where(term >= 0, (1 << self.bits) + term, (hashed & mask).astype(np.int64))]
        for n in BEGINNINGS:
            long = words.ends - words.starts > n
            starts = words.starts[long]
            owners.append(owner[long])
            ids.append((mix(hasher.spans(starts, starts + n) + SALT[3]) & mask).astype(np.int64))
        return np.concatenate(owners), np.concatenate(ids)

    def values(self, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) sorted, each pair once; the value grows with the logarithm of the count."""
        pairs, counts = np.unique(owner * self.size + ids, return_counts=True)
        return pairs // self.size, pairs % self.size, np.log2(1.0 + counts)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.values(*self.hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))

    def pairs(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """(text, one text, another) that should be scored alike.

        With identity terms, the text and its copy with each of them swapped for
        another of its group, as often as it occurs. Without, the text and its copy
        with a neutral mention put in between two words, and the latter with that
        mention swapped. Group, term and place follow from the text's hash.
        """
        if not self.terms:
            return []
        low = LOWER[data]
        words = Words(low, off, SEPARATORS)
        hasher = Hasher(low)
        term = self.term_numbers(hasher.spans(words.starts, words.ends))
        whole = hasher.spans(off[:-1], off[1:]).tolist()
        out = []

        def other(k: int, turn: int) -> bytes:
            mine = self.members[self.group[k]]
            return self.terms[mine[(mine.index(k) + 1 + turn % max(1, len(mine) - 1)) % len(mine)]]

        for text, h in enumerate(whole):
            raw, lo = data[off[text] : off[text + 1]].tobytes(), int(off[text])
            span = slice(words.first[text], words.first[text + 1])
            starts, ends, mine = (x[span] for x in (words.starts, words.ends, term))
            if (mine >= 0).any():
                parts, at = [], 0
                for k in np.flatnonzero(mine >= 0).tolist():
                    parts += [raw[at : starts[k] - lo], other(int(mine[k]), h)]
                    at = int(ends[k]) - lo
                out.append((text, raw, b"".join([*parts, raw[at:]])))
            else:
                k = h % len(self.terms)
                at = int(starts[(h >> 16) % len(starts)]) - lo if len(starts) else 0
                named = [raw[:at] + t + b" " + raw[at:] for t in (self.terms[k], other(k, h >> 32))]
                out += [(text, raw, named[0]), (text, *named)]
        return out

    def changes(self, pairs: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, feature, value in the second text less that in the first), where they differ."""
        first, second = self.of_texts([a for _, a, _ in pairs]), self.of_texts([b for _, _, b in pairs])
        owner, ids, values = (np.concatenate(x) for x in zip(first, second))
        sign = np.where(np.arange(len(owner)) < len(first[0]), -1.0, 1.0)
        keys, where = np.unique(owner * self.size + ids, return_inverse=True)
        change = np.bincount(where, sign * values, minlength=len(keys))
        some = np.abs(change) > 1e-9
        return keys[some] // self.size, keys[some] % self.size, change[some]


@dataclass
class ToxicityModel:
    """A weight for each feature, 0 for most; pairs: how many counterfactual pairs it was held to."""

    features: Features
    weights: np.ndarray
    bias: float
    pairs: int = 0

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        owner, ids = self.features.hashes(data, off)
        weighs = self.weights[ids] != 0
        owner, ids, values = self.features.values(owner[weighs], ids[weighs])
        return self.bias + np.bincount(owner, self.weights[ids] * values, minlength=len(off) - 1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability for each text."""
        return 1 / (1 + np.exp(-np.clip(self.logits(data, off), -500, 500)))


@dataclass
class Sample:
    """Sorted features of labelled texts, and the changes between the texts of counterfactual pairs."""

    owner: np.ndarray
    ids: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    pair: np.ndarray
    pair_ids: np.ndarray
    change: np.ndarray
    n_pairs: int


def objective(s: Sample, ridge: float, fairness: float, width: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient of weights and a bias (last): mean log loss + ridge / 2 * |w|^2 + fairness * mean squared change of the logit over pairs."""
    n, y = len(s.labels), s.labels.astype(float)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        z = np.bincount(s.owner, w[s.ids] * s.values, minlength=n) + x[-1]
        value = float(np.mean(np.logaddexp(0, z) - y * z)) + ridge / 2 * float(w @ w)
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.append(np.bincount(s.ids, r[s.owner] * s.values, minlength=width) + ridge * w, r.sum())
        if s.n_pairs and fairness:
            d = np.bincount(s.pair, w[s.pair_ids] * s.change, minlength=s.n_pairs)
            value += fairness / s.n_pairs * float(d @ d)
            grad[:-1] += np.bincount(s.pair_ids, (2 * fairness / s.n_pairs * d)[s.pair] * s.change, minlength=width)
        return value, grad

    return loss


def fit_toxicity(s: Sample, features: Features, least_lean: float = 2.0, ridge: float = 3e-5, fairness: float = 1.0, rounds: int = 150) -> ToxicityModel:
    """Logistic regression with a ridge and a counterfactual penalty.

    Features may weigh that lean to label 1 by `least_lean` standard deviations of
    their sums (shrunk by one), and all that the texts of a pair differ in. One
    class only, or no text: a constant score.
    """
    n, labels = len(s.labels), s.labels
    rate = (labels.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    if n == 0 or labels.min() == labels.max():
        return ToxicityModel(features, np.zeros(features.size), bias, s.n_pairs)
    p, size = labels.mean(), features.size
    lean = (np.bincount(s.ids, s.values * labels[s.owner], size) - p * np.bincount(s.ids, s.values, size)) / np.sqrt(p * (1 - p) * np.bincount(s.ids, s.values * s.values, size) + 1.0)
    keep = np.union1d(np.flatnonzero(lean >= least_lean), s.pair_ids)
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))
    at = place[s.ids]
    some = at >= 0
    small = Sample(s.owner[some], at[some], s.values[some], labels, s.pair, place[s.pair_ids], s.change, s.n_pairs)
    x = lbfgs(objective(small, ridge, fairness, len(keep)), np.append(np.zeros(len(keep)), bias), rounds)
    weights = np.zeros(size)
    weights[keep] = np.where(np.abs(x[:-1]) > 1e-4, x[:-1], 0.0)
    return ToxicityModel(features, weights, float(x[-1]), s.n_pairs)


def training_sample(rows: DataFrame, features: Features) -> Sample:
    """Features, labels and counterfactual changes of a bounded table (text, label), gathered on the driver."""
    names = ("ids", "values", "pair", "pair_ids", "change")
    types = (np.int32, np.float32, np.int8, np.int32, np.float32)

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            n = len(off) - 1
            owner, ids, values = features.values(*features.hashes(data, off))
            pairs = features.pairs(data, off)
            text = np.array([k for k, _, _ in pairs], np.int64)
            pair, pair_ids, change = features.changes(pairs) if pairs else (np.zeros(0, np.int64),) * 3
            number = np.arange(len(text)) - np.searchsorted(text, text)  # 0 or 1 within its text
            lists = []
            for whose, columns in ((owner, (ids, values)), (text[pair], (number[pair], pair_ids, change))):
                cut = pa.array(np.searchsorted(whose, np.arange(n + 1)).astype(np.int32))
                lists += [pa.ListArray.from_arrays(cut, pa.array(c.astype(t))) for c, t in zip(columns, types[len(lists) :])]
            count = pa.array(np.bincount(text, minlength=n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), count, *lists], names=["label", "n_pairs", *names])

    schema = "label int, n_pairs int, ids array<int>, values array<float>, pair array<byte>, pair_ids array<int>, change array<float>"
    got = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, schema).toArrow()
    labels = got.column("label").to_numpy().astype(np.int64)
    flat = {c: pc.list_flatten(got.column(c)).to_numpy() for c in names}
    owners = lambda c: np.repeat(np.arange(len(labels), dtype=np.int32), pc.list_value_length(got.column(c)).to_numpy() if len(labels) else 0)
    before = np.cumsum([0, *got.column("n_pairs").to_pylist()])
    return Sample(owners("ids"), flat["ids"], flat["values"], labels, before[owners("pair")] + flat["pair"], flat["pair_ids"], flat["change"], int(before[-1]))


def fit_on_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int = 5, most_rows: int = 10_000, bits: int = 20, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, **fit) -> ToxicityModel:
    """The model of toxicity(), from its bounded sample."""
    chosen = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(f"label in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % {fold} <> 0")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    both = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    sample = both.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    features = Features(bits, groups)
    return fit_toxicity(training_sample(sample, features), features, **fit)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int = 5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every text.

    Learns only from labelled ids whose crc32(doc_id as text) mod `fold` is not 0,
    from the first `most_rows` of them in hash order: a bounded sample, so the model
    is fitted on the driver. An id that is labelled twice counts once, by its
    greatest label; one that has several texts gives its smallest. The score reads
    nothing but the text, all of it. Null and empty texts get the score of a text
    without words, null labels are left out, repeated rows are scored alike, extra
    columns of either table are ignored. Without labels the score is constant; an
    empty table of documents gives an empty one.
    """
    spark = ship_package(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit_on_labels(docs, labels, doc_id, text, label, fold, **fit))

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(data, off))], names=["doc_id", "score"])

    return (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .select("doc_id", F.expr(f"crc32(coalesce(cast(doc_id as string), '')) % {fold} = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
