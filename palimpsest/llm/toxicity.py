"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's logit is a bias and the weights of its distinct words' features: the word, and its parts of a
few letters. Features are those that toxic documents hold more often than chance explains. A document is toxic if one of its sentences is: its probability is the noisy-or
``1 - prod(1 - p)`` over sentences, and the weights are fitted to document labels through it. Afterwards
each sentence has a probability of its own, which locates what offends.

The model is fitted on a bounded sample of labelled rows, in one task; everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.work import Batches, cut_lineage, map_arrow, texts

# Bound of the sample: documents of each label, and characters of all of them that one task holds.
SAMPLE_PER_LABEL = 4000
# Values of the hash that documents are sampled by.
PLACES = 1 << 30
GRAMS = (4, 5)
# Features that speak for a label by this many standard errors are learned, the strongest up to a bound.
LEAST_Z = 4.0
MOST_FEATURES = 8192
EPOCHS = 200
RATE = 0.5
L2 = 1e-4
# Longer words are not remembered.
LONG_WORD = 40
REMEMBERED = 400_000
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Where the sentences of a text begin and end; those without a word are none."""
    at = 0
    for mark in _SENTENCE.finditer(text):
        if text[at : mark.start()].strip():
            yield at, mark.end()
        at = mark.end()
    if text[at:].strip():
        yield at, len(text)


def features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its parts, each once."""
    marked = f"<{word}>"
    if len(word) > LONG_WORD:
        # hashes alone are held, as a word may be a whole text
        parts = (marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))
        return sorted({zlib.crc32(marked.encode()), *(zlib.crc32(p.encode()) for p in parts)})
    parts = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return [zlib.crc32(p.encode()) for p in parts]


class Model(NamedTuple):
    """A bias and a weight per feature that was learned."""

    bias: float
    names: np.ndarray
    weights: np.ndarray


def _chosen(docs: list[np.ndarray], of_word: list[np.ndarray], positive: np.ndarray, n: int) -> np.ndarray:
    """Features more frequent in positive documents than chance explains, the strongest first."""
    seen = np.zeros((2, n))
    for words, label in zip(docs, positive, strict=True):
        if len(words):
            seen[int(label), np.unique(np.concatenate([of_word[w] for w in words]))] += 1
    ones, zeros = positive.sum(), (~positive).sum()
    share = (seen.sum(axis=0) + 1) / (ones + zeros + 2)
    z = (seen[1] / ones - seen[0] / zeros) / np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    strong = np.flatnonzero(z > LEAST_Z)
    return strong[np.argsort(-z[strong], kind="stable")][:MOST_FEATURES]


def fit(bodies: list[str], labels: list[int]) -> Model:
    """Choose features by documents, then fit their weights by gradient steps through the noisy-or."""
    nothing = Model(-6.0, np.zeros(0, np.int64), np.zeros(0))
    numbers: dict[str, int] = {}
    words, sentence_ends, doc_ends, by_doc = [], [], [], []
    for body in bodies:
        low, start = body.lower(), len(words)
        for a, b in sentences(low):
            words += [numbers.setdefault(w, len(numbers)) for w in dict.fromkeys(_WORD.findall(low, a, b))]
            sentence_ends.append(len(words))
        doc_ends.append(len(sentence_ends))
        by_doc.append(np.unique(np.array(words[start:], np.int32)))
    positive = np.array(labels, bool)
    if not words or positive.all() or not positive.any():
        return nothing
    raw = [np.array(features(w), np.int64) for w in numbers]
    names, number = np.unique(np.concatenate(raw), return_inverse=True)
    of_word = np.split(number, np.cumsum([len(r) for r in raw])[:-1])
    chosen = _chosen(by_doc, of_word, positive, len(names))
    if not len(chosen):
        return nothing
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    # a row per chosen feature of a word's occurrence: few words have any
    kept = [p[p >= 0] for p in (place[f] for f in of_word)]
    held = np.array([len(k) for k in kept])
    word = np.array(words, np.int64)
    of_sentence = np.repeat(np.arange(len(sentence_ends)), np.diff([0, *sentence_ends]))
    telling = held[word] > 0
    feature = np.concatenate([kept[w] for w in word[telling]])
    sentence = np.repeat(of_sentence[telling], held[word[telling]])
    of_doc = np.repeat(np.arange(len(doc_ends)), np.diff([0, *doc_ends]))
    balance = np.where(positive, 1.0, positive.sum() / (~positive).sum())
    weights = np.zeros(len(chosen) + 1)
    weights[-1] = nothing.bias
    squares = np.zeros_like(weights)
    for _ in range(EPOCHS):
        logit = weights[-1] + np.bincount(sentence, weights[feature], len(sentence_ends))
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # -log(1 - p) of a document is the sum over its sentences
        none = np.bincount(of_doc, np.logaddexp(0, logit), len(doc_ends))
        miss = np.exp(-np.clip(none, 1e-6, 50))
        pull = np.where(positive, -miss / (1 - miss), 1.0) * balance
        step = pull[of_doc] * chance
        gradient = np.append(np.bincount(feature, step[sentence], len(chosen)), step.sum())
        gradient = gradient / len(doc_ends) + L2 * np.append(weights[:-1], 0)
        squares += gradient**2
        weights -= RATE * gradient / (np.sqrt(squares) + 1e-9)
    return Model(float(weights[-1]), names[chosen], weights[:-1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """The model from documents (``doc_id, text``) and labels (``doc_id, toxic``).

    Of each label the ``per_label`` documents that come first in a hash of their id are taken. Rows
    without a label, an id or a text are left out; of several labels of a document the higher counts.
    """
    labelled = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = labelled.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)))
    # twice as many as wanted are let through to the window, however many labels there are
    reach = {r["toxic"]: 1 + int(PLACES * min(1.0, 2 * per_label / r["n"])) for r in
             labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = F.lit(False)
    for label, end in reach.items():
        near |= (F.col("toxic") == label) & (F.col("place") < end)
    first = Window.partitionBy("toxic").orderBy("place", "doc_id")
    chosen = labelled.where(near).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_label)
    chosen = chosen.select("doc_id", "toxic")
    sample = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Batches) -> Batches:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))))
        model = fit([r[2] for r in rows], [r[1] for r in rows])
        columns = [pa.array([model.bias]), pa.array([model.names.tolist()]), pa.array([model.weights.tolist()])]
        kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], ["bias", "names", "weights"])

    # a bounded number of rows, which one task holds
    fitted = map_arrow(sample.repartition(1), run, "bias double, names array<long>, weights array<double>")
    rows = cut_lineage(fitted, "toxicity-weights").collect()
    if not rows:
        return fit([], [])
    return Model(rows[0]["bias"], np.array(rows[0]["names"], np.int64), np.array(rows[0]["weights"], float))


class Scorer:
    """Scores texts with fitted weights, remembering words up to a bound."""

    def __init__(self, model: Model) -> None:
        self.bias = model.bias
        self.weights = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
        self.words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        get = self.weights.get
        logit = sum(get(f, 0.0) for f in features(word))
        if len(self.words) < REMEMBERED and len(word) <= LONG_WORD:
            self.words[word] = logit
        return logit

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, logit)`` of each sentence, in characters of the text."""
        out, known = [], self.words.get
        low = text.lower()
        if len(low) != len(text):  # letters whose lower case is longer would shift the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for a, b in sentences(low):
            logit = self.bias
            for word in dict.fromkeys(_WORD.findall(low, a, b)):
                found = known(word)
                logit += self._word(word) if found is None else found
            out.append((a, b, logit))
        return out


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, offending`` per row.

    ``score`` is the noisy-or over sentences, 0 for texts without any and for NULL. ``offending`` lists
    ``start, end, score`` of the sentences with a probability of a half or more.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Batches) -> Batches:
        scorer = Scorer(model)
        for batch in batches:
            scores, offending = [], []
            for body in batch.column("text"):
                found = scorer.sentences(body.as_py() or "")
                logits = np.array([x for _, _, x in found])
                scores.append(float(-np.expm1(-np.logaddexp(0, logits).sum())))
                offending.append(
                    [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-min(x, 30.0))))} for a, b, x in found if x >= 0]
                )
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(offending, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "offending"])

    shape = "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"
    return map_arrow(texts(docs, doc_id, text), run, shape)
