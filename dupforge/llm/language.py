"""Operator 8, language by a linear-chain conditional random field over words.

Each word (a run of letters) gets a label. Its emission score is a sum of learned weights of hashed features: affixes, character
n-grams with word ends, and the word itself (the lexicon). Transitions between the labels of neighbouring words are learned with
them, from sequences that are in part put together from two languages, so that a text may switch. Forward-backward gives each
word the probabilities of its labels; a document's language is the label with most probability over its words, and the score is
its mean over them.

The model is fitted on the driver, in numpy, on TRAIN_DOCS documents of each language at most (those whose hashed doc_id is
lowest, and whose texts have at most TRAIN_CHARS characters); everything else covers all rows and whole texts.

Defined results: a text that is null or has no letter gives und with score 0; rows that repeat give rows that repeat, and are learnt
from once, though they may take others' places in the choice; a null
doc_id is held out, as if it were an empty text; extra columns are ignored; an empty table gives an empty table; without any
row to learn from, every text is und.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import documents, lowest

TRAIN_DOCS, TRAIN_CHARS = 400, 20_000
#: The choice of rows to learn from has TRAIN_DOCS * MAX_LANGS rows at most, so it is broadcast.
MAX_LANGS = 256
BUCKETS = 1 << 16
SEGMENT = 24
STEPS, BATCH, RATE = 250, 192, 0.3
#: Words whose scores a worker remembers, and words for which forward-backward runs at once.
CACHE, AT_ONCE = 300_000, 400_000
UND = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    w = word.encode()
    h = zlib.crc32
    out = [h(b"w" + w)]
    out += [h(b"p" + w[:k]) for k in range(1, min(6, len(w)) + 1)]
    out += [h(b"s" + w[-k:]) for k in range(1, min(6, len(w)) + 1)]
    b = b"^" + w + b"$"
    out += [h(b[k : k + 3]) for k in range(len(b) - 2)]
    return out


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        lists = [features(w) for w in words]
        flat = np.fromiter((f for x in lists for f in x), np.int64) & (BUCKETS - 1)
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        return np.add.reduceat(self.weights[flat], starts, axis=0).astype(np.float32)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emissions: longest x sequences x labels, sequences from longest to shortest; lengths: theirs. Posterior of each word, and the expected count of each transition."""
    n, m, k = emissions.shape
    scores = np.exp(emissions - emissions.max(2, keepdims=True))
    t = np.exp(transitions).astype(emissions.dtype)
    alpha, beta = np.zeros_like(scores), np.ones_like(scores)
    alive = np.searchsorted(-lengths, -np.arange(1, n + 1), "right")  # sequences with so many words
    a = scores[0] / scores[0].sum(1, keepdims=True)
    alpha[0] = a
    for i in range(1, n):
        c = alive[i]
        a = (a[:c] @ t) * scores[i, :c]
        a /= a.sum(1, keepdims=True)
        alpha[i, :c] = a
    pairs = np.zeros((k, k))
    for i in range(n - 2, -1, -1):
        c = alive[i + 1]
        after = scores[i + 1, :c] * beta[i + 1, :c]
        b = after @ t.T
        beta[i, :c] = b / b.sum(1, keepdims=True)
        norm = (alpha[i, :c] * b).sum(1, keepdims=True)
        pairs += t * (alpha[i, :c].T @ (after / norm))
    posterior = alpha * beta
    posterior /= np.maximum(posterior.sum(2, keepdims=True), 1e-30)
    return posterior, pairs


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Crf:
    labels = sorted({*langs})
    k, rng = len(labels), np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in LETTERS.findall(t.lower())], np.int64) for t in texts]
    lab = np.array([labels.index(x) for x in langs])
    of = [[d for d, y in zip(docs, lab, strict=True) if y == c and len(d)] for c in range(k)]
    lists = [np.array(features(w), np.int64) & (BUCKETS - 1) for w in vocab]
    model = Crf(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32))
    full = [c for c in range(k) if of[c]]
    if not full:
        return Crf([], model.weights, model.transitions)
    weight_sq, trans_sq = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3)

    def piece(c: int, n: int) -> np.ndarray:
        d = of[c][rng.integers(len(of[c]))]
        at = rng.integers(max(1, len(d) - n + 1))
        return d[at : at + n]

    for _ in range(steps):
        rows = []
        for _ in range(BATCH):
            c = full[rng.integers(len(full))]
            if rng.random() < 0.3 and len(full) > 1:  # switches from one language to another
                cut, other = int(rng.integers(4, SEGMENT - 3)), full[rng.integers(len(full))]
                parts = [(piece(c, cut), c), (piece(other, SEGMENT - cut), other)]
            else:
                parts = [(piece(c, SEGMENT), c)]
            rows.append((np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), y) for p, y in parts])))
        rows.sort(key=lambda r: -len(r[0]))
        lengths = np.array([len(r[0]) for r in rows])
        n = int(lengths[0])
        there = np.arange(n)[:, None] < lengths
        words, gold = np.zeros((n, len(rows)), np.int64), np.zeros((n, len(rows)), np.int64)
        for j, (w, y) in enumerate(rows):
            words[: len(w), j], gold[: len(w), j] = w, y
        at = words[there]
        flat, sizes = np.concatenate([lists[w] for w in at]), np.array([len(lists[w]) for w in at])
        emissions = np.zeros((n, len(rows), k), np.float32)
        emissions[there] = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        posterior, pairs = marginals(emissions, lengths, model.transitions)
        wrong = posterior[there]
        wrong[np.arange(len(at)), gold[there]] -= 1
        gradient = np.stack([np.bincount(flat, np.repeat(wrong[:, c], sizes), BUCKETS) for c in range(k)], 1) / len(at)
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:-1][there[1:]], gold[1:][there[1:]]), 1)
        weight_sq += gradient**2
        model.weights -= RATE * gradient / np.sqrt(weight_sq)
        step = (pairs - seen) / len(at)
        trans_sq += step**2
        model.transitions -= (RATE * step / np.sqrt(trans_sq)).astype(np.float32)
    return model


class Labeller:
    """A worker's model, with the scores of words it has met."""

    def __init__(self, model: Crf):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def places(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known, self.scores = {}, self.scores[:0]
        known = self.known
        was = len(known)
        out = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)) for words in docs]
        if len(known) > was:
            new = list(known)[was:]
            self.scores = np.concatenate([self.scores, *(self.model.emissions(new[k : k + 20_000]) for k in range(0, len(new), 20_000))])
        return out

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """For each text with a letter its place, its words, and each word's probabilities, in any order."""
        at = 0
        while at < len(texts):
            docs, end, n = [], at, 0
            while end < len(texts) and n < AT_ONCE:
                docs.append(LETTERS.findall((texts[end] or "").lower()))
                n += len(docs[-1])
                end += 1
            places = self.places(docs)
            lengths = np.array([len(p) for p in places])
            order = [j for j in np.argsort(-lengths, kind="stable").tolist() if lengths[j]]
            while order:
                # sequences of like length, so that little is padding
                longest = int(lengths[order[0]])
                some = [j for j in order[: max(1, AT_ONCE // longest)] if lengths[j] * 2 > longest]
                order = order[len(some) :]
                sizes = lengths[some]
                emissions = np.zeros((longest, len(some), self.scores.shape[1]), np.float32)
                for c, j in enumerate(some):
                    emissions[: sizes[c], c] = self.scores[places[j]]
                posterior, _ = marginals(emissions, sizes, self.model.transitions)
                for c, j in enumerate(some):
                    yield at + j, docs[j], posterior[: sizes[c], c]
            at = end

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if self.model.labels:
            for j, _, p in self.posteriors(texts):
                mean = p.mean(0, dtype=np.float64)
                langs[j], scores[j] = self.model.labels[int(mean.argmax())], float(min(1.0, mean.max()))
        return langs, scores


def fold(docs_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(docs_id.cast("string"), F.lit(""))) % n


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, text: str = "text", lang: str = "lang") -> Crf:
    """docs: rows to learn from. First the rows are chosen, without their texts; then those texts are read."""
    docs = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    chosen = lowest(labelled, "lang", train_docs).orderBy("h", "lang").limit(train_docs * MAX_LANGS).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    same = (docs["doc_id"] == F.col("_id")) & (docs["lang"] == F.col("_lang"))
    rows = docs.join(F.broadcast(chosen), same).filter(F.length("text") <= train_chars).select("doc_id", "text", F.col("_lang").alias("lang"))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()  # train_docs a language, however often a doc_id is there
    rows.sort(key=lambda r: (str(r["lang"]), str(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _predict(batches: Iterator[pa.RecordBatch], model: Crf) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            langs, scores = labeller.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def _label(batches: Iterator[pa.RecordBatch], model: Crf) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model)
    for batch in batches:
        words, labels = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for j, w, p in labeller.posteriors(batch.column("text").to_pylist()) if model.labels else ():
            words[j], labels[j] = w, [model.labels[c] for c in p.argmax(1).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))], names=["doc_id", "words", "labels"])


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels weights
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _predict(b, spread.value), "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, words, labels: the language of each word."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _label(b, spread.value), "doc_id long, words array<string>, labels array<string>")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs.filter(fold(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
