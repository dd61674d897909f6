"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence is what stands between full stops, exclamation or question marks and line ends, if it has a word.  Its
probability is p = sigmoid(bias + sum of the weights of its features); a document's score is the noisy-or of its
sentences, 1 - prod(1 - p): one offending sentence is enough, and none is labelled for it.  The weights are learnt from
document labels alone, by gradient descent on the likelihood of the noisy-or; the gradient of a toxic document falls on
the sentences that explain it.  ``offending_sentences`` returns where they stand.

* **Features** of a word (letters, A-Z in lower case, and all bytes beyond ASCII): its first 3 to 10 bytes, and the
  whole word, as 64-bit hashes.  Stems of inflected languages are found by their beginnings.
* **Selection** (Spark): each document counts a feature once; of those in at least ``SUPPORT`` toxic documents and
  ``LIFT`` times as frequent there as in the others, the ``FEATURES`` with the largest log-likelihood ratio are kept, if it is ``RATIO`` or
  more (what chance alone gives one feature in 2,000).
* **Fit**: bags hold the selected features only.  Labelled rows are a sample of at most ``SAMPLE`` documents (those with
  the smallest hash of the id), so one task fits them; this bound is a parameter and the same at every size.
* **Scoring** reads every whole text once, in one narrow pass; the model (at most ``FEATURES`` pairs of numbers) goes
  along with the tasks.

Defined cases: a null or empty text, and one without words, has no sentence and scores 0; a document without id is never
held out and never labelled; an id that stands in several rows is learnt from its smallest text; of conflicting labels the
largest counts, null labels do not; without toxic (or without any) labels every score is 0; an empty table gives no rows.
Other columns, whatever their names, are not read; very long texts are read whole.  Equal features are told apart by
hash where their ratios tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import (LOWER, ROLL1, Texts, batch, documents_of, i64, runs, small_batches, stored,
                                  text_chunks, words)

SAMPLE = 30_000
FEATURES = 8192
SUPPORT, RATIO, LIFT = 3, 6.0, 4
PREFIXES = range(3, 11)
THRESHOLD = 0.7
STEPS, RATE, SHRINK, BIAS = 200, 0.1, 3e-5, -4.0
WHOLE = np.uint64(0xA5A5F00D5EED1234)
TABLE_BITS = 20

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


# ---------------------------------------------------------------- sentences and features

class Sentences:
    """The sentences of a run of documents; those of document i are first[i]:first[i + 1]."""

    def __init__(self, t: Texts):
        starts, ends, of_doc = words(t, NOT_LETTER)
        self.starts, self.ends = starts, ends
        doc = np.repeat(np.arange(len(t)), np.diff(of_doc))
        stops = np.concatenate([[0], np.cumsum(STOP[t.data])])
        cut = runs(stops[starts] + doc)
        self.n = len(cut) - 1
        self.of_word = np.repeat(np.arange(self.n), np.diff(cut))
        self.word0, self.doc = cut[:-1], doc[cut[:-1]]
        self.first = np.searchsorted(self.doc, np.arange(len(t) + 1))
        self.stops, self.offs = stops, t.offs
        self.prefix = ROLL1.prefix(LOWER[t.data])

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash, word) of every feature, kind by kind."""
        size = self.ends - self.starts
        for k in PREFIXES:
            w = np.flatnonzero(size >= k)
            yield ROLL1.ranges(self.prefix, self.starts[w], self.starts[w] + k), w
        yield ROLL1.ranges(self.prefix, self.starts, self.ends) ^ WHOLE, np.arange(len(size))

    def span(self, s: int) -> tuple[int, int]:
        """Byte range of a sentence in its document, from its first word to its last byte before the stop."""
        lo, at = int(self.starts[self.word0[s]]), self.offs[self.doc[s]]
        hi = int(np.searchsorted(self.stops, self.stops[lo], side="right")) - 1
        return int(lo - at), int(min(hi, self.offs[self.doc[s] + 1]) - at)


@dataclass
class Model:
    """Sorted feature hashes with their weights."""
    features: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.features & np.uint64((1 << TABLE_BITS) - 1)] = True

    def hits(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, word) of the words' features that the model knows, by word."""
        out = []
        for h, w in s.features():
            some = np.flatnonzero(self.table[h & np.uint64((1 << TABLE_BITS) - 1)])
            h, w = h[some], w[some]
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1) if len(self.features) else h[:0]
            ok = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
            out.append((at[ok].astype(np.int64), w[ok]))
        f, w = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        order = np.lexsort((f, w))
        return f[order], w[order]

    def probabilities(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(p, log(1 - p)) of each sentence."""
        f, w = self.hits(s)
        z = self.bias + np.bincount(s.of_word[w], weights=self.weights[f], minlength=s.n)[:s.n]
        return sigmoid(z), -np.logaddexp(0, z)


def sigmoid(z):
    return np.exp(-np.logaddexp(0, -z))


def noisy_or(log_none: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - product over each bag, from log(1 - p) of its sentences; 0 for an empty bag."""
    total = np.concatenate([[0.0], np.cumsum(log_none)])
    return -np.expm1(np.minimum(0.0, total[first[1:]] - total[first[:-1]]))


# ---------------------------------------------------------------- training

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of at most ``sample`` labelled ids that are not held out, one text for each, written once."""
    known = (labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("labelled").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("labelled")))
             .groupBy("labelled").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("labelled"), "labelled").limit(sample))
    return stored(documents_of(docs, id_col, text_col)
                  .join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))  # at most ``sample`` pairs of numbers
                  .groupBy("labelled", "label").agg(F.min("text").alias("text"))
                  .select("text", (F.col("label") > 0).cast("int").alias("label")), "toxicity-train")


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1).to_numpy()
        for t in text_chunks(b.column(0)):
            s = Sentences(t)
            doc = s.doc[s.of_word]
            found = [(h, doc[w]) for h, w in s.features()]
            h, d = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = runs(h, d)[:-1]  # a document counts a feature once
            h, y = h[once], label[t.rows][d[once]]
            cut = runs(h)
            pos = np.add.reduceat(y, cut[:-1]) if len(h) else np.empty(0, np.int64)
            yield batch(feature=i64(h[cut[:-1]]), pos=pos.astype(np.int64), neg=(np.diff(cut) - pos).astype(np.int64))


def select_features(train: DataFrame, n_pos: int, n_neg: int, size: int = FEATURES, support: int = SUPPORT,
                    least: float = RATIO) -> np.ndarray:
    """Hashes of the features that tell toxic documents best, sorted."""
    counts = (train.mapInArrow(count_features, "feature long, pos long, neg long").groupBy("feature")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    n = float(n_pos + n_neg)
    seen = F.col("pos") + F.col("neg")

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / expected)).otherwise(0.0)

    ratio = (term(F.col("pos"), seen * (n_pos / n)) + term(F.col("neg"), seen * (n_neg / n))
             + term(n_pos - F.col("pos"), (n - seen) * (n_pos / n)) + term(n_neg - F.col("neg"), (n - seen) * (n_neg / n)))
    best = (counts.where((F.col("pos") >= support) & (F.col("pos") * n_neg > LIFT * F.col("neg") * n_pos) & (ratio >= least))
            .orderBy(F.desc(F.round(ratio, 9)), "feature").limit(size).select("feature"))
    return np.sort(np.array([r[0] for r in best.collect()], np.int64).view(np.uint64))


def bags(batches: Iterator[pa.RecordBatch], features: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per document: label, number of sentences, and the known features with their sentence's number."""
    model = Model(features, np.zeros(len(features)), 0.0)
    for b in batches:
        for t in text_chunks(b.column(0)):
            s = Sentences(t)
            f, w = model.hits(s)
            at = s.of_word[w]
            cut = np.searchsorted(s.doc[at], np.arange(len(t) + 1)).astype(np.int32)
            yield batch(label=b.column(1).slice(t.rows.start, len(t)).cast(pa.int32()),
                        sentences=np.diff(s.first).astype(np.int32),
                        sentence=pa.ListArray.from_arrays(cut, pa.array((at - s.first[s.doc[at]]).astype(np.int32))),
                        feature=pa.ListArray.from_arrays(cut, pa.array(f.astype(np.int32))))


def fit(label: np.ndarray, sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray,
        n_features: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias: full-batch descent with per-weight step sizes on the noisy-or's negative log-likelihood.

    Sentences without a known feature share one probability, so they enter by their number only.
    """
    key = doc.astype(np.int64) * (int(sentences.max(initial=0)) + 1) + sentence
    order = np.argsort(key, kind="stable")
    cut = runs(key[order])
    row = np.empty(len(key), np.int64)
    row[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    owner = doc[order][cut[:-1]] if len(key) else np.empty(0, np.int64)
    n, n_rows = len(label), len(cut) - 1
    plain = sentences - np.bincount(owner, minlength=n)[:n]
    w, bias = np.zeros(n_features), BIAS
    grads, squares = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[feature], minlength=n_rows)[:n_rows]
        p, p0 = sigmoid(z), sigmoid(bias)
        none = -np.bincount(owner, weights=np.logaddexp(0, z), minlength=n)[:n] - plain * np.logaddexp(0, bias)
        some = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(label > 0, -np.exp(none) / some, 1.0)  # times p: slope of a sentence's z
        slope = pull[owner] * p
        g = np.empty(n_features + 1)
        g[:-1] = np.bincount(feature, weights=slope[row], minlength=n_features)[:n_features] / n + SHRINK * w
        g[-1] = (slope.sum() + (pull * plain).sum() * p0) / n
        grads = 0.9 * grads + 0.1 * g
        squares = 0.99 * squares + 0.01 * g * g
        move = RATE * (grads / (1 - 0.9 ** step)) / (np.sqrt(squares / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def fit_batches(batches: Iterator[pa.RecordBatch], n_features: int, steps: int) -> Iterator[pa.RecordBatch]:
    parts = pa.Table.from_batches(list(batches), pa.schema([
        ("label", pa.int32()), ("sentences", pa.int32()), ("sentence", pa.list_(pa.int32())),
        ("feature", pa.list_(pa.int32()))])).combine_chunks()
    if not parts.num_rows:
        return
    lists = parts["sentence"].combine_chunks()
    doc = np.repeat(np.arange(parts.num_rows), np.diff(lists.offsets.to_numpy()))
    w, bias = fit(parts["label"].to_numpy(), parts["sentences"].to_numpy().astype(np.int64), doc,
                  lists.flatten().to_numpy(), parts["feature"].combine_chunks().flatten().to_numpy(), n_features, steps)
    yield batch(weights=pa.array([w.tolist()], pa.list_(pa.float64())), bias=[bias])


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
                support: int = SUPPORT, steps: int = STEPS, **columns) -> Model | None:
    """The model learnt from the labelled rows that are not held out; None without toxic and clean documents.

    ``columns``: ``id_col``, ``text_col``, ``label_col``.
    """
    small_batches(docs.sparkSession)
    train = training_rows(docs, labels, sample, **columns)
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    chosen = select_features(train, sizes[1], sizes[0], features, support)
    found = (train.mapInArrow(lambda it: bags(it, chosen), "label int, sentences int, sentence array<int>, feature array<int>")
             .orderBy(F.xxhash64("label", "sentences", "sentence", "feature")).coalesce(1)  # bounded by the sample
             .mapInArrow(lambda it: fit_batches(it, len(chosen), steps), "weights array<double>, bias double").first())
    return Model(chosen, np.array(found["weights"], float), float(found["bias"]))


# ---------------------------------------------------------------- scoring

def score_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in text_chunks(b.column(1)):
            s = Sentences(t)
            if model is None:
                p, none = np.zeros(s.n), np.zeros(s.n)
            else:
                p, none = model.probabilities(s)
            yield batch(doc_id=b.column(0).slice(t.rows.start, len(t)), score=noisy_or(none, s.first),
                        n_sentences=np.diff(s.first).astype(np.int64),
                        n_offending=np.bincount(s.doc, weights=p >= 0.5, minlength=len(t)).astype(np.int64))


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_sentences, n_offending (p of 0.5 or more)."""
    small_batches(docs.sparkSession)
    scored = documents_of(docs, id_col, text_col).mapInArrow(
        lambda it: score_batches(it, model), "doc_id long, score double, n_sentences long, n_offending long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "n_offending")


def sentence_batches(batches: Iterator[pa.RecordBatch], model: Model | None, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for t in text_chunks(b.column(1)):
            if model is None:
                continue
            s = Sentences(t)
            p, _ = model.probabilities(s)
            rows = []
            for k in np.flatnonzero(p >= least).tolist():
                d = int(s.doc[k])
                raw = t.raw(d)
                lo, hi = s.span(k)
                before, text = len(raw[:lo].decode()), raw[lo:hi].decode()
                rows.append((ids[t.rows.start + d], k - int(s.first[d]), before, before + len(text), float(p[k]), text))
            if rows:
                yield batch(**{c: list(x) for c, x in zip(("doc_id", "sentence", "start", "stop", "p", "text"), zip(*rows))})


def offending_sentences(docs: DataFrame, model: Model | None, least: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Sentences with probability ``least`` or more: doc_id, sentence (its number), start, stop (code points), p, text."""
    small_batches(docs.sparkSession)
    return documents_of(docs, id_col, text_col).mapInArrow(
        lambda it: sentence_batches(it, model, least),
        "doc_id long, sentence long, start long, stop long, p double, text string")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **train) -> DataFrame:
    """``train_model`` on the labelled rows, then ``score_documents`` of all."""
    return score_documents(docs, train_model(docs, labels, **train), threshold)
