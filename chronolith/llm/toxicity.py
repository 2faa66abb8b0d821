"""Toxic documents by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic function of its different words and their beginnings; a document's is the noisy-or of its sentences, one
minus the product of what each leaves: it is toxic if any sentence is. A leak, the same for every document, takes up
labels that no sentence explains, so the number of sentences alone doesn't make a long text toxic. The weights are
fitted to document labels through that product, so they learn which sentences offend, and scoring also tells where
those stand. Words count whose documents are labelled toxic more often than chance explains (binomial tail, one half
false word expected in the whole vocabulary): labels are noisy, and rare words would learn the noise by heart.

The fit reads a bounded sample of labelled rows (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` documents, at most ``SAMPLE_CHARS``
characters), chosen by a hash of their ids; a document whose rows don't fit what is left of the characters is passed over,
the next ones are not; rows whose crc32(id) mod 3 is 1 are never read. Scores see nothing but the
text. Null and empty texts have no sentence and score the leak. Where nothing toxic is labelled, all scores are 0. Of several
labels for an id, the largest counts; rows of one id are scored one by one; extra columns are passed by.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, map_arrow

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_000, 4_000, 30_000_000
#: Words that fewer sampled toxic documents have tell nothing.
LEAST_DOCUMENTS = 3
STEPS, RATE, DECAY = 300, 0.1, 1e-4
#: Score of a sentence without a telling word, on the logistic scale; fixed, and low enough for thousands of sentences.
PLAIN = -14.0
THRESHOLD = 0.7

#: Lengths of the beginnings that count as features, and words whose weight a worker remembers.
STEMS, REMEMBERED = (5, 6, 7, 8), 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, and its beginnings of a few lengths (stems of inflected and compound words)."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    weights: dict[str, float]
    leak: float
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def weigh(self, words: set[str]) -> float:
        """Sum of the features' weights of different words."""
        known, z = self.known, 0.0
        for w in words:
            x = known.get(w)
            if x is None:
                x = math.fsum(self.weights.get(f, 0.0) for f in features(w))
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = x
            if x:
                z += x
        return round(z, 9)  # whatever the order of a set

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence with a telling word."""
        out = []
        lower = text.lower()
        if len(lower) != len(text):  # some capitals grow; places are those of the text itself
            lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(lower):
            z = self.weigh(set(WORD.findall(m[0])))
            if z > 0:
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-PLAIN - z))))
        return out

    def score(self, text: str) -> float:
        """Noisy-or over the sentences and the leak."""
        if self.leak == -math.inf:
            return 0.0
        left, plain = math.log1p(math.exp(self.leak)), math.log1p(math.exp(PLAIN))
        for s in SENTENCE.findall(text.lower()):
            z = self.weigh(set(WORD.findall(s)))
            left += math.log1p(math.exp(PLAIN + z)) if z else plain
        return -math.expm1(-left)


def _bag(text: str, shared: dict[str, str]) -> list[list[str]]:
    """Different words of each sentence; equal words of all texts are one object."""
    return [sorted(shared.setdefault(w, w) for w in words) for s in SENTENCE.findall(text.lower()) if (words := set(WORD.findall(s)))]


def _features_of(bag: list[list[str]]) -> set[str]:
    return {f for w in {w for s in bag for w in s} for f in features(w)}


def telling(bags: list[list[list[str]]], y: np.ndarray) -> list[str]:
    """Words that stand in more toxic documents than their number of documents explains."""
    toxic: dict[str, int] = {}
    for bag, label in zip(bags, y.tolist(), strict=True):
        for f in _features_of(bag) if label else ():
            toxic[f] = toxic.get(f, 0) + 1
    tried = [f for f, k in toxic.items() if k >= LEAST_DOCUMENTS]
    total = dict.fromkeys(tried, 0)  # only those are counted in all documents
    for bag in bags:
        for f in _features_of(bag) & total.keys():
            total[f] += 1
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    found = []
    for w in tried:
        n, k = total[w], toxic[w]
        if k > n * rate:
            i = np.arange(k, n + 1)
            choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
            if np.exp(choose + i * math.log(rate) + (n - i) * math.log1p(-rate)).sum() < 0.5 / len(tried):
                found.append(w)
    return sorted(found)


def fit(rows: list[tuple[str, int, float]]) -> Model:
    """Weights from (text, label, weight of the row), by full-batch Adam on the noisy-or's likelihood."""
    y = np.array([label for _, label, _ in rows], float)
    if not y.any():
        return Model({}, -math.inf)
    shared: dict[str, str] = {}
    bags = [_bag(text, shared) for text, _, _ in rows]
    ids = {w: i for i, w in enumerate(telling(bags, y))}
    word, sentence, document, size = [], [], [], np.zeros(len(rows))
    for d, bag in enumerate(bags):
        size[d] = len(bag)
        for s in bag:
            known = [ids[f] for w in s for f in features(w) if f in ids]
            if known:
                word += known
                sentence += [len(document)] * len(known)
                document.append(d)
    word, sentence, document = (np.array(x, np.int64) for x in (word, sentence, document))
    row_weight = np.array([w for _, _, w in rows])
    row_weight /= row_weight.sum()
    plain = math.log1p(math.exp(PLAIN)) * (size - np.bincount(document, minlength=len(rows)))
    theta = np.append(np.full(len(ids), 10.0), math.log(0.05))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = PLAIN + np.bincount(sentence, theta[word], len(document))
        left = plain + np.bincount(document, np.logaddexp(0, z), len(rows)) + np.logaddexp(0, theta[-1])
        odds = np.exp(-left) / np.maximum(-np.expm1(-left), 1e-12)
        pull = row_weight * np.where(y > 0, -odds, 1.0)
        g = pull[document] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, g[sentence], len(ids)) + DECAY * theta[:-1] / max(1, len(ids)), pull.sum() / (1 + math.exp(-theta[-1])))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Model({w: float(theta[i]) for w, i in ids.items() if theta[i] > 0}, float(theta[-1]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.select(F.col("doc_id"), F.col("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    counts = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    some = known.where("toxic > 0").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).union(known.where("toxic <= 0").orderBy("h", "doc_id").limit(SAMPLE_CLEAN))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids: the broadcast is bounded
    joined = texts.join(F.broadcast(some), "doc_id")
    sizes = joined.groupBy("h", "doc_id").agg(F.sum(F.length("text")).alias("n")).collect()
    total, chosen = 0, []
    for r in sorted(sizes):
        if total + r.n <= SAMPLE_CHARS:
            total += r.n
            chosen.append(r.doc_id)
    rows = joined.where(F.col("doc_id").isin(chosen)) if len(chosen) < len(sizes) else joined
    rows = sorted(tuple(r) for r in rows.select("h", "doc_id", "toxic", "text").collect())
    sampled = {k: sum((t > 0) == k for _, _, t, _ in rows) for k in (False, True)}
    scale = {k: counts.get(k, 0) / max(1, sampled[k]) for k in sampled}
    return fit([(text, int(t > 0), scale[t > 0]) for _, _, t, text in rows])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending)`` for every row of ``docs``.

    ``offending``: start, end (characters) and score of the sentences that score at least a half, for rejected rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        scores, found = [], []
        for text in batch.column(2):
            text = text.as_py()
            scores.append(m.score(text))
            found.append([{"start": a, "end": b, "score": s} for a, b, s in m.sentences(text) if s >= 0.5] if scores[-1] >= threshold else [])
        predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
        arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted, pa.array(found, spans)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "offending"])

    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    return map_arrow(rows, fn, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    spark = docs.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.value.score
        return batch.filter(pa.array([score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, fn, docs.schema)
