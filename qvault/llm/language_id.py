"""Language identification: a linear-chain conditional random field labels words, also where a text switches languages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qvault.llm.features import Adam, Words, sampled, slices, split_words
from qvault.storage import materialize

#: Buckets of hashed affixes, n-grams and words.
BUCKETS = 1 << 16
#: About so many texts of each language, and so many windows of WINDOW words, as many of each language, are fitted on; both are drawn by a hash.
TEXTS_PER_LANGUAGE, MAX_WINDOWS, WINDOW = 400, 6000, 64
#: The label of texts without letters.
UNDETERMINED = "und"
CACHE_WORDS = 200_000


def word_features(word: str) -> list[int]:
    """Hashed numbers of the word itself (the lexicon), its affixes of one to four letters, and its 2- and 3-grams."""
    b = f"^{word}$".encode()
    found = {b"=" + b}
    for n in range(1, 5):
        w = word[:n].encode()
        found.add(b"<" + w)
        found.add(b">" + word[-n:].encode())
    marked = f"^{word}$"
    found.update(marked[i : i + n].encode() for n in (2, 3) for i in range(len(marked) - n + 1))
    return [zlib.crc32(f) % BUCKETS for f in found]


def forward_backward(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posterior label probabilities of every word, for many sequences at once.

    ``emission`` has a row of positive weights per word; sequences follow each
    other. Steps run over positions, with all sequences that still last. With
    ``pairs``, the expected number of each transition and the log-likelihood's
    normaliser come along.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n_at = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    alpha, scale = np.empty_like(emission), np.ones(len(emission), emission.dtype)
    for t, n in enumerate(n_at):
        at = starts[:n] + t
        a = (alpha[at - 1] @ move if t else first) * emission[at]
        scale[at] = s = a.sum(1)
        alpha[at] = a / s[:, None]
    beta, moved = np.ones_like(emission), np.zeros_like(move)
    for t in range(len(n_at) - 1, 0, -1):
        at = starts[: n_at[t]] + t
        b = emission[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = b @ move.T
        if pairs:
            moved += alpha[at - 1].T @ b
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return (gamma, moved * move, float(np.log(scale).sum())) if pairs else gamma


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray = field(repr=False)
    move: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    known: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of positive weights per word, the largest 1."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        if new:
            lists = [word_features(w) for w in new]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            z = np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0)
            e = np.maximum(np.exp(z - z.max(1, keepdims=True)), 1e-12)
            self.known.update(zip(new, e, strict=True))
        return np.array([self.known[w] for w in words]).reshape(-1, len(self.labels))

    def posteriors(self, words: Words) -> np.ndarray:
        """Label probabilities of every word of every text."""
        lengths = np.diff(words.bounds)
        full = lengths > 0
        emission = self.emissions(words.words)[words.index]
        return forward_backward(emission, words.bounds[:-1][full], lengths[full], self.first, self.move)

    def predict(self, words: Words) -> tuple[list[str], np.ndarray]:
        """The label with the most posterior mass in each text, and its share; texts without words get UNDETERMINED and 0."""
        lengths = np.diff(words.bounds)
        labels, shares = np.array([UNDETERMINED] * len(lengths), object), np.zeros(len(lengths))
        full = np.flatnonzero(lengths > 0)
        if len(full) and self.labels:
            mass = np.add.reduceat(self.posteriors(words), words.bounds[:-1][full], axis=0) / lengths[full][:, None]
            labels[full] = np.array(self.labels, object)[mass.argmax(1)]
            shares[full] = mass.max(1)
        return labels.tolist(), np.clip(shares, 0.0, 1.0)


def fit_crf(windows: list[tuple[list[str], str]], *, steps: int = 60, rate: float = 0.1, l2: float = 1e-5, seed: int = 5) -> Crf:
    """Fit on windows of words with one label each.

    Windows of different labels are joined in pairs, so the transitions learn
    from switches, too. The gradient is that of the conditional log-likelihood:
    expected minus observed features and transitions, by forward-backward.
    """
    labels = sorted({lang for _, lang in windows})
    number = {lang: i for i, lang in enumerate(labels)}
    k = len(labels)
    order = np.random.default_rng(seed).permutation(len(windows))
    vocabulary: dict[str, int] = {}
    index, truth, lengths = [], [], []
    for pair in (order[i : i + 2] for i in range(0, len(order), 2)):
        own = [(w, number[windows[j][1]]) for j in pair for w in windows[j][0]]
        index += [vocabulary.setdefault(w, len(vocabulary)) for w, _ in own]
        truth += [y for _, y in own]
        lengths.append(len(own))
    index, truth, lengths = np.array(index, np.int64), np.array(truth, np.int64), np.array(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    lists = [word_features(w) for w in vocabulary]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
    cuts, of_word = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    weights, moves, first = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    adams = [Adam(x.shape, rate) for x in (weights, moves, first)]
    observed_words = np.stack([np.bincount(index[truth == y], minlength=len(n)) for y in range(k)], axis=1)
    inner = np.ones(len(index), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    observed_moves = np.bincount(truth[at - 1] * k + truth[at], minlength=k * k).reshape(k, k)
    observed_first = np.bincount(truth[starts], minlength=k)
    for _ in range(steps):
        z = np.add.reduceat(weights[flat], cuts, axis=0)
        e = np.exp(z - z.max(1, keepdims=True))
        gamma, moved, _ = forward_backward(np.maximum(e, 1e-30)[index], starts, lengths, np.exp(first), np.exp(moves), pairs=True)
        by_word = np.stack([np.bincount(index, weights=gamma[:, y], minlength=len(n)) for y in range(k)], axis=1) - observed_words
        gradient = np.stack([np.bincount(flat, weights=by_word[of_word, y], minlength=BUCKETS) for y in range(k)], axis=1) / len(index)
        for a, x, g in zip(adams, (weights, moves, first), (gradient + l2 * weights, (moved - observed_moves) / len(index) + l2 * moves, (gamma[starts].sum(0) - observed_first) / len(index)), strict=True):
            a.step(x, g)
    return Crf(labels, weights.astype(np.float32), np.exp(moves).astype(np.float32), np.exp(first).astype(np.float32))


def training_windows(docs: DataFrame, learn: Column) -> list[tuple[list[str], str]]:
    """A bounded sample of windows of words, about as many texts of each language."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, TEXTS_PER_LANGUAGE / n)))])[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(1)):
                words = split_words(b.column(1).slice(first, n), letters_only=True)
                names, langs = np.array(words.words, object), b.column(0).slice(first, n).to_pylist()
                cut = [(langs[t], names[words.index[i : min(i + WINDOW, e)]].tolist()) for t, (s, e) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)) for i in range(s, e, WINDOW)]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.string()), pa.array([c[1] for c in cut], pa.list_(pa.string()))], ["lang", "words"])

    windows, _ = materialize(rows.where(sampled(share, "doc_id")).select("lang", "text").mapInArrow(run, "lang string, words array<string>"), "windows")
    made = {r["lang"]: r["n"] for r in windows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not made:
        return []
    each = MAX_WINDOWS / len(made)
    part = F.create_map(*[x for lang, n in made.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])[F.col("lang")]
    chosen = windows.where(sampled(part, "words"))
    return sorted(((r["words"], r["lang"]) for r in chosen.collect()), key=lambda x: (x[1], x[0]))


def identify_languages(docs: DataFrame, *, learn: Column) -> DataFrame:
    """The language of every text of ``docs`` (doc_id, text, lang; other columns are left out).

    Returns doc_id, lang_pred (a language among those learned) and score, the
    mean posterior of that language over the words. Learns from rows with a
    language for which ``learn`` holds. Texts that are null or have no letter
    are ``und`` with score 0, and so are all if there is nothing to learn from.
    Texts and words of any length count whole, also where a script has no
    blanks. Rows that repeat a doc_id are judged one by one.
    """
    windows = training_windows(docs, learn)
    model = fit_crf(windows) if windows else Crf([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(1)):
                labels, shares = sent.value.predict(split_words(b.column(1).slice(first, n), letters_only=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(labels, pa.string()), pa.array(shares.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(texts: DataFrame, model: Crf) -> DataFrame:
    """The label of every word of every text of ``texts`` (doc_id, text): doc_id, pos, word, label and its probability."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(1)):
                words = split_words(b.column(1).slice(first, n), letters_only=True)
                if not len(words.index):
                    continue
                gamma = sent.value.posteriors(words)
                ids = b.column(0).slice(first, n).take(pa.array(words.texts))
                pos = np.arange(len(words.index)) - words.bounds[:-1][words.texts]
                names = pa.array(words.words).take(pa.array(words.index))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos), names, pa.array([sent.value.labels[i] for i in gamma.argmax(1).tolist()]), pa.array(gamma.max(1).astype(np.float64))], ["doc_id", "pos", "word", "label", "probability"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pos long, word string, label string, probability double")
