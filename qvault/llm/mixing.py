"""Mixing sources to target weights: soft membership in domains, and document rates fitted by projected gradient."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qvault.llm.features import Adam, Words, sampled, slices, split_words
from qvault.llm.text import free_names
from qvault.storage import materialize

#: Buckets of hashed words and word ends; about so many labelled texts of each domain are fitted on, drawn by a hash.
BUCKETS, TEXTS_PER_DOMAIN = 1 << 12, 2000


def word_buckets(word: str) -> tuple[int, int, int]:
    """The word's bucket, that of its last two characters, and that of its kinds of characters."""
    kind = "".join(sorted({"A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word}))
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in ("=" + word.lower(), ">" + word[-2:], "~" + kind))


def shares(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight): each text's buckets, with the root of their share of its tokens."""
    own = np.array([word_buckets(w) for w in words.words], np.int64).reshape(-1, 3)
    code = (words.texts[:, None] * BUCKETS + own[words.index]).ravel()
    code, n = np.unique(code, return_counts=True)
    text = code // BUCKETS
    return text, code % BUCKETS, np.sqrt(n / np.diff(words.bounds)[text])


@dataclass
class Softmax:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, words: Words) -> np.ndarray:
        """A row of domain probabilities per text."""
        text, bucket, weight = shares(words)
        n = len(words.bounds) - 1
        z = np.stack([np.bincount(text, weights=weight * self.weights[bucket, j], minlength=n) for j in range(len(self.domains))], axis=1) + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_softmax(text: np.ndarray, bucket: np.ndarray, weight: np.ndarray, truth: np.ndarray, domains: list[str], prior: np.ndarray, *, steps: int = 200, rate: float = 0.05, l2: float = 1e-4) -> Softmax:
    """Multinomial logistic regression; each text weighs as its domain's share of all labelled rows."""
    k, n = len(domains), len(truth)
    model = Softmax(domains, np.zeros((BUCKETS, k)), np.log(np.maximum(prior, 1e-9)))
    adams = Adam((BUCKETS, k), rate), Adam(k, rate)
    importance = (prior / np.maximum(1, np.bincount(truth, minlength=k)))[truth]
    goal = np.eye(k)[truth]
    for _ in range(steps):
        z = np.stack([np.bincount(text, weights=weight * model.weights[bucket, j], minlength=n) for j in range(k)], axis=1) + model.bias
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - goal) * importance[:, None]
        gradient = np.stack([np.bincount(bucket, weights=weight * g[text, j], minlength=BUCKETS) for j in range(k)], axis=1)
        adams[0].step(model.weights, gradient + l2 * model.weights)
        adams[1].step(model.bias, g.sum(0))
    return model


def fit_domains(docs: DataFrame, labelled: DataFrame) -> Softmax | None:
    """A classifier of domains from ``labelled`` (doc_id, domain); None if nothing is labelled."""
    marked = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["n"] for r in marked.join(docs.select("doc_id").distinct(), "doc_id").groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row per domain
    if not counts:
        return None
    domains = sorted(counts)
    share = F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(min(1.0, TEXTS_PER_DOMAIN / n)))])[F.col("domain")]
    drawn = marked.where(sampled(share, "doc_id"))  # about TEXTS_PER_DOMAIN ids of each domain: small enough to send to the texts
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(1)):
                text, bucket, weight = shares(split_words(b.column(1).slice(first, n), letters_only=False))
                cuts = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.ListArray.from_arrays(cuts, pa.array(bucket)), pa.ListArray.from_arrays(cuts, pa.array(weight))], ["domain", "bucket", "weight"])

    table = rows.select("domain", "text").mapInArrow(run, "domain string, bucket array<long>, weight array<double>").toArrow()
    bucket, weight = table.column("bucket").combine_chunks(), table.column("weight").combine_chunks()
    n = np.array([len(x) for x in bucket.to_pylist()])
    truth = np.array([domains.index(d) for d in table.column("domain").to_pylist()])
    prior = np.array([counts[d] for d in domains], float)
    return fit_softmax(np.repeat(np.arange(len(n)), n), bucket.flatten().to_numpy(), weight.flatten().to_numpy(), truth, domains, prior / prior.sum())


def memberships(docs: DataFrame, model: Softmax | None, domains: list[str]) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p): tokens and domain probabilities of every row, p in the order of ``domains``.

    Without a classifier, every text belongs to all domains in equal parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(2)):
                words = split_words(b.column(2).slice(first, n), letters_only=False)
                p = np.full((n, len(domains)), 1 / len(domains))
                if sent.value:
                    p = np.zeros((n, len(domains)))
                    p[:, [domains.index(d) for d in sent.value.domains]] = sent.value.posteriors(words)
                cuts = pa.array(np.arange(0, p.size + 1, len(domains), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(cuts, pa.array(p.ravel()))], ["doc_id", "text_hash", "n_tokens", "p"])

    hashed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, p array<double>")


def rates_after(p: np.ndarray, path: list[np.ndarray], start: float) -> np.ndarray:
    """The rates of texts after the steps so far: each goes down its gradient and back to zero or more."""
    r = np.full(len(p), start)
    for move in path:
        r = np.maximum(0.0, r - p @ move)
    return r


def fit_rates(table: DataFrame, targets: np.ndarray, start: float, *, max_steps: int = 30, tolerance: float = 1e-6) -> list[np.ndarray]:
    """Steps of projected gradient for least squares of sum_d r_d n_d p_d against ``targets``, with r >= 0.

    The squares are weighed by the inverse of G = sum n_d p_d p_d' over the
    texts, and a text's gradient by 1 / n_d; then the largest curvature is 1,
    and so is the step. A text's rate depends on the steps and on its own p
    alone, so only vectors of one number per domain travel: the steps out with
    the job, and the expected tokens and G of each batch back into one sum.
    """
    k = len(targets)
    path: list[np.ndarray] = []
    inverse = None
    for _ in range(max_steps):

        def run(batches: Iterator[pa.RecordBatch], path: list[np.ndarray] = list(path)) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for b in batches:
                if b.num_rows:
                    n = b.column(0).to_numpy(zero_copy_only=False)
                    p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    r = rates_after(p, path, start)
                    sums = np.concatenate(((r * n) @ p, (p * n[:, None]).T.dot(p).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "x"])

        got = np.zeros(k + k * k)
        for row in table.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            got[row["i"]] = row["x"]
        off = got[:k] - targets
        if inverse is None:
            inverse = np.linalg.pinv(got[k:].reshape(k, k), rcond=1e-9, hermitian=True)
        if np.abs(off).max() <= tolerance * max(1.0, targets.sum()):
            break
        path.append(inverse @ off)
    return path


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, budget: float | None = None, **options) -> DataFrame:
    """Rates at which to take each text so that the domains' expected tokens match target weights.

    ``docs`` has doc_id and text, ``labelled`` doc_id and domain; other columns
    are left out. ``targets`` has a weight per domain; domains that are not in
    it get none. ``budget`` is the number of tokens wanted, as many as there
    are if not given. Returns doc_id, text_hash, n_tokens, p (domain
    probabilities by name), rate, and copies: the rate's whole part, and one
    more with the rest as probability, by a hash of the row.

    Targets that no rates reach, because domains overlap in most texts, are met
    as nearly as least squares allow. A token is a word, parted by blanks; texts
    of any length are read whole, some megabytes of them at once. Null and empty
    texts have no token and the rate of their posterior. Rows that repeat a doc_id with the
    same text get equal rates. Of labels that repeat a doc_id the smallest
    domain counts. An empty table gives an empty result.
    """
    model = fit_domains(docs, labelled)
    domains = sorted({*targets, *(model.domains if model else ())})
    weights = np.array([targets.get(d, 0.0) for d in domains])
    table, _ = materialize(memberships(docs, model, domains), "memberships")
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    start = 1.0 if budget is None or not total else budget / total
    path = fit_rates(table, weights / weights.sum() * total * start, start, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(domains))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates_after(p, path, start))], ["doc_id", "text_hash", "n_tokens", "p", "rate"])

    rated = table.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, p array<double>, rate double")
    uniform = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    named = F.map_from_arrays(F.array(*map(F.lit, domains)), F.col("p"))
    return rated.select("doc_id", "text_hash", "n_tokens", named.alias("p"), "rate", F.floor(F.col("rate") + uniform).cast("int").alias("copies"))


def take_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says. Rows with a null doc_id are taken as they are.

    Columns of any name are kept as they are.
    """
    rates = mix(docs, labelled, targets, **options).where("doc_id is not null").select("doc_id", "text_hash", "copies").dropDuplicates(["doc_id", "text_hash"])
    own, doc, text, copies, each = free_names(docs.columns, "own_hash", "of_doc", "of_text", "copies", "each")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(rates.toDF(doc, text, copies), (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(text)), "left")
    times = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.coalesce(copies, F.lit(0)))
    return keyed.withColumn(each, F.explode(F.array_repeat(F.lit(0), times))).select(docs.columns)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains from ``labels`` (doc_id, quality): good and low; null where quality is."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low").alias("domain"))
