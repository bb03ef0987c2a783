"""Toxicity: a linear classifier from confirmed toxic texts and unlabelled text, by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qvault.llm.features import Adam, Words, sampled, slices, split_words
from qvault.storage import materialize

#: Texts to fit on, about: confirmed toxic ones, and any others. Both are drawn by a hash of the row.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
#: Features of the classifier are words, and beginnings of words of these lengths.
PREFIXES = range(3, 9)


def word_features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if n <= len(word)]


def text_features(words: Words, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) numbers, each pair once, of the known features in each text."""
    lists = [[known[f] for f in word_features(w) if f in known] for w in words.words]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    hits = np.flatnonzero(n[words.index] > 0) if len(words.index) else np.empty(0, np.int64)
    texts = words.texts[hits]
    pairs = np.array([(t, f) for t, w in zip(texts.tolist(), words.index[hits].tolist(), strict=True) for f in lists[w]], np.int64).reshape(-1, 2)
    pairs = np.unique(pairs, axis=0)
    return pairs[:, 0], pairs[:, 1]


def _count_features(sample: DataFrame) -> DataFrame:
    """(feature, n_pos, n_unl): the texts of each kind that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            positive = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, n in slices(b.column(0)):
                words = split_words(b.column(0).slice(first, n), letters_only=True)
                known: dict[str, int] = {}
                for w in words.words:
                    for f in word_features(w):
                        known.setdefault(f, len(known))
                lists = [np.array([known[f] for f in word_features(w)]) for w in words.words]
                pairs = np.unique(words.texts * len(words.words) + words.index)  # each word of a text once
                pos, unl = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
                for t in range(n):
                    own = pairs[np.searchsorted(pairs, t * len(words.words)) : np.searchsorted(pairs, (t + 1) * len(words.words))] - t * len(words.words)
                    if len(own):
                        found = np.unique(np.concatenate([lists[w] for w in own.tolist()]))
                        (pos if positive[first + t] else unl)[found] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array(pos), pa.array(unl)], ["feature", "n_pos", "n_unl"])

    counted = sample.select("text", "positive").mapInArrow(run, "feature string, n_pos long, n_unl long")
    return counted.groupBy("feature").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_unl").alias("n_unl"))


def _evidence(n_p: int, n_u: int) -> Column:
    """The likelihood-ratio statistic of a feature's two shares of texts, against one share for both kinds."""
    pos, unl, n = F.col("n_pos"), F.col("n_unl"), n_p + n_u
    both = pos + unl

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (term(pos, both * n_p / n) + term(unl, both * n_u / n) + term(n_p - pos, (n - both) * n_p / n) + term(n_u - unl, (n - both) * n_u / n))


@dataclass
class Classifier:
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        words = split_words(texts, letters_only=True)
        row, feature = text_features(words, self.features)
        z = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def nn_pu(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, n_features: int, prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk estimate under logistic loss.

    risk = prior E_p[l(z)] + max(0, E_u[l(-z)] - prior E_p[l(-z)]), where p are
    the confirmed positives and u any texts. Where the second term is negative,
    the step goes up its gradient instead: the positives among the unlabelled
    are then being fitted as negatives.
    """
    weights, adam = np.zeros(n_features + 1), Adam(n_features + 1, rate)
    weights[-1] = np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    softplus = lambda z: np.logaddexp(0, z)
    for _ in range(steps):
        z = np.bincount(rows, weights=weights[columns], minlength=len(positive)) + weights[-1]
        negative_risk = softplus(z[~positive]).sum() / n_u - prior * softplus(z[positive]).sum() / n_p
        as_positive = np.where(positive, -prior * sigmoid(-z) / n_p, 0.0)
        as_negative = np.where(positive, -prior * sigmoid(z) / n_p, sigmoid(z) / n_u)
        g = as_positive + as_negative if negative_risk >= 0 else -as_negative
        gradient = np.append(np.bincount(columns, weights=g[rows], minlength=n_features), g.sum())
        gradient[:-1] += l2 * weights[:-1]
        adam.step(weights, gradient)
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Classifier:
    """Fit on the rows of ``docs`` for which ``learn`` holds; ``labels`` has doc_id and toxic.

    The class prior is the share of toxic rows among all labelled rows to learn
    from. Positives are rows with label 1; the unlabelled are drawn from all
    rows to learn from, whatever their label. Exact copies count once. A
    feature is used if its likelihood-ratio statistic exceeds twice the
    logarithm of the number of features, so the evidence asked for grows with
    what there is to choose from, and with nothing else; the drawn texts bound
    their number. Without positives, every text gets the score 0; without any
    feature that passes, the class prior.
    """
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.coalesce(learn, F.lit(False))).select("doc_id", "text")
    n_rows = rows.count()
    n_labelled, n_positive = rows.select("doc_id").join(marked, "doc_id").agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    if not n_positive:
        return Classifier({}, np.zeros(0), -np.inf)
    prior = n_positive / n_labelled
    drawn = marked.where("toxic = 1").where(sampled(min(1.0, MAX_POSITIVE / n_positive), "doc_id")).select("doc_id")  # about MAX_POSITIVE ids: small enough to send to the texts
    positives = rows.join(F.broadcast(drawn), "doc_id").select("text", F.lit(True).alias("positive"))
    unlabelled = rows.where(sampled(min(1.0, MAX_UNLABELLED / n_rows), "doc_id")).select("text", F.lit(False).alias("positive"))
    sample, _ = materialize(positives.union(unlabelled).dropDuplicates(), "toxic")
    n_u, n_p = sample.agg(F.count_if(~F.col("positive")), F.count_if("positive")).first()
    counted, _ = materialize(_count_features(sample), "features")
    evidence = _evidence(n_p, n_u)
    chosen = counted.where(evidence > 2 * math.log(max(2, counted.count()))).select("feature").orderBy("feature").collect()
    known = {r["feature"]: i for i, r in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(0)):
                row, feature = text_features(split_words(b.column(0).slice(first, n), letters_only=True), known)
                cuts = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feature)), b.column(1).slice(first, n)], ["found", "positive"])

    table = sample.select("text", "positive").mapInArrow(run, "found array<long>, positive boolean").toArrow()
    found, positive = table.column("found").combine_chunks(), table.column("positive").to_numpy().astype(bool)
    n = np.array([len(x) for x in found.to_pylist()])
    weights, bias = nn_pu(np.repeat(np.arange(len(n)), n), found.flatten().to_numpy(), positive, len(known), prior)
    return Classifier(known, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, learn: Column, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on) beside its own columns.

    ``score`` and ``predicted`` name the two columns; columns of ``docs`` with
    those names give way to them, so a caller that keeps all takes free names.
    Only texts enter a score; whole texts of any length, some megabytes at once.
    Null and empty texts get the score of a text without features. Rows that
    repeat a doc_id are scored one by one; of labels that repeat one the
    largest counts. An empty table stays empty.
    """
    model = fit(docs, labels, learn)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())]
    out = docs.select(kept).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        for b in batches:
            texts = b.column(at)
            scores = np.concatenate([sent.value.score(texts.slice(first, n)) for first, n in slices(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*kept, score])
            pa.default_memory_pool().release_unused()

    return docs.select(kept).mapInArrow(run, out).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
