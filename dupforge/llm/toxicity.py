"""Operator 2, toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed embeddings: of the word, of its prefixes and of its ending. Filters of several widths run
over the words, each filter's largest value in the text is kept (max pooling), and a logistic layer gives a probability. All of
it is trained in numpy. A score is that probability, stretched so that the threshold of the text's language lies at 0.3.

The language is guessed from the text alone: the training texts' profiles of character trigrams are clustered without any label
(spherical k-means, from seeds that are far from each other), and a text belongs to the cluster under whose trigram frequencies
it is likeliest. No column says what a cluster is, and none has to: it only chooses a threshold.

The model is fitted on every labelled row, however many there are and however long their texts. Which rows those are is found out by
doc_id and a hash of the text; then their texts are dealt to blocks, the only time that they are shuffled, and packed (words as
numbers). Marks keep most other texts from being dealt, and a join drops those that they let through. Everything fitted is made of passes over all blocks, whose results are sums of whole numbers, so
that it doesn't matter how blocks are dealt to tasks: clusters by means of all rows, the network by epochs in which each block
goes on from the same model and the changes are averaged (those of an embedding over the blocks that changed it), thresholds by
counts of all scores of a fifth of each block, from which the network doesn't learn. The driver has the model and such sums, whose
size doesn't depend on the rows. A single block is fitted on the driver, by the same functions.

When scoring, each distinct word is led through embedding and filters once (what it gives at each place of each filter is
remembered); a text takes lookups, sums and a maximum.

Defined results: a text that is null or has no word gets the score that the model gives to no word at all; rows that repeat give
rows that repeat; a null doc_id counts as an empty text for the fold; extra columns are ignored; an empty table gives an empty
table; without rows of both labels to learn from, every score is 0.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import Scratch, documents, steady
from dupforge.llm.language import fold
from dupforge.operators.content import maybe_in

#: Rows and characters of a block, about; there are as many blocks as it takes.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 24
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.05
CUT = 0.3
#: Words that a worker remembers, and words pooled at once.
CACHE, AT_ONCE = 200_000, 200_000

#: Rows of padding behind each text: enough for the widest window of a text without words.
PADDING = max(WIDTHS)

WORDS = re.compile(r"\w+")
PAD = ""
#: Checksums of what stands before words, prefixes and endings when they are hashed.
OF_WORD, OF_PREFIX, OF_END = (zlib.crc32(x) for x in (b"w", b"p", b"s"))
#: Trigrams are hashed to so many numbers; texts of fewer words don't found a cluster; one that is nearer than NEAR to another is part of it; a cluster has this share of the texts at least.
GRAMS, SEED_WORDS, NEAR, MOST, LEAST_SHARE = 1 << 12, 30, 0.6, 16, 0.01
#: Units in which changes, squares and unit vectors are summed up; pieces in which embeddings are; steps by which scores are counted for thresholds.
UNIT, FINE, PIECES, STEPS = 2.0**24, 2.0**40, 16, 8192
#: Texts that a pass brings as candidates for seeds; another pass is made when one that wasn't brought may come next.
KEPT = 32


def grams(word: str) -> list[int]:
    b = b"^" + word.encode() + b"$"
    return [zlib.crc32(b[k : k + 3]) & (GRAMS - 1) for k in range(len(b) - 2)]


def features(word: str) -> list[int]:
    h, b = zlib.crc32, word.encode()
    out = [h(b, OF_WORD)]
    if len(word) > 3:
        if len(b) == len(word):
            parts, end = [b[:3], b[3:4], b[4:5], b[5:6], b[6:7], b[7:8]], b[-3:]
        else:
            parts, end = [word[:3].encode(), *(c.encode() for c in word[3:8])], word[-3:].encode()
        last = OF_PREFIX
        for part in parts[: min(len(word) - 3, 6)]:  # prefixes of 3 to 8 letters, but for the word itself
            last = h(part, last)
            out.append(last)
        out.append(h(end, OF_END))
    return out


class Numbers(dict):
    """Words and their numbers: a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Lists:
    """Lists of numbers, end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes, dtype=np.int64) - sizes

    @classmethod
    def of(cls, lists: list) -> Lists:
        return cls(np.fromiter(chain.from_iterable(lists), np.int64), np.array([*map(len, lists)], np.int64))

    def __getitem__(self, j: int) -> np.ndarray:
        return self.flat[self.starts[j] : self.starts[j] + self.sizes[j]]

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some lists, end to end, and how many each has."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - ends + sizes, sizes)
        return self.flat[at], sizes


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ (out & 1) * np.uint32(0xEDB88320)
    return out


#: CRC-32 by bytes, for many words at once; what a checksum is inverted by before and after; words of more bytes are hashed one by one.
CRC, ONES, SHORT = _crc_table(), 0xFFFFFFFF, 32


def _step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(crc ^ byte) & 255] ^ (crc >> 8)


def grams_of(words: list[str]) -> Lists:
    """grams() of many words."""
    coded = [b"^%b$" % w.encode() for w in words]
    sizes, flat = np.array([*map(len, coded)], np.int64), np.frombuffer(b"".join(coded), np.uint8)
    n = max(len(flat) - 2, 0)
    crc, inside, ends = np.full(n, ONES, np.uint32), np.ones(len(flat), bool), np.cumsum(sizes)
    for k in range(3):
        crc = _step(crc, flat[k : n + k])
    inside[ends - 1] = inside[ends - 2] = False  # windows don't go on into the next word
    return Lists((crc[inside[:n]] ^ ONES).astype(np.int64) & (GRAMS - 1), sizes - 2)


def features_of(words: list[str]) -> Lists:
    """features() of many words: of short ASCII ones all at once, of others by that function."""
    coded = [w.encode() for w in words]
    n = np.array([*map(len, coded)], np.int64)
    plain = (n == np.array([*map(len, words)], np.int64)) & (n <= SHORT)
    some, others = np.flatnonzero(plain), [features(words[j]) for j in np.flatnonzero(~plain)]
    letters, long = np.array([coded[j] for j in some], f"S{SHORT}").view(np.uint8).reshape(-1, SHORT), n[some]
    found = np.empty((len(some), 8), np.int64)  # by word: itself, prefixes of 3 to 8 letters, ending
    crc = np.full(len(some), OF_WORD ^ ONES, np.uint32)
    for k in range(long.max(initial=0)):
        crc = np.where(k < long, _step(crc, letters[:, k]), crc)
    found[:, 0] = crc ^ ONES
    crc = np.full(len(some), OF_PREFIX ^ ONES, np.uint32)
    for k in range(8):
        crc = _step(crc, letters[:, k])
        if k >= 2:
            found[:, k - 1] = crc ^ ONES
    crc = np.full(len(some), OF_END ^ ONES, np.uint32)
    for k in range(3):
        crc = _step(crc, letters[np.arange(len(some)), np.maximum(long - 3 + k, 0)])
    found[:, 7] = crc ^ ONES
    at = np.arange(8)
    there = (at == 0) | (at < 7) & (at <= long[:, None] - 3) | (at == 7) & (long[:, None] > 3)
    sizes = np.empty(len(words), np.int64)
    sizes[some], sizes[~plain] = there.sum(1), [*map(len, others)]
    flat, of_plain = np.empty(sizes.sum(), np.int64), np.repeat(plain, sizes)
    flat[of_plain], flat[~of_plain] = found[there], [*chain.from_iterable(others)]
    return Lists(flat, sizes)


@dataclass
class Block:
    """Labelled texts, packed."""

    number: int
    y: np.ndarray
    docs: Lists  # by text: its words' places in the list of the block's words
    features: Lists  # by word: buckets
    grams: Lists  # by text: its distinct trigrams
    counts: np.ndarray  # how often each of those is there

    @classmethod
    def pack(cls, number: int, texts: list[str], labels: list[int]) -> Block:
        vocab = Numbers()
        docs = [vocab.of(WORDS.findall(t.lower())) for t in texts]
        of_words, found, counts = grams_of([*vocab]), [], []
        for d in docs:
            words, n = np.unique(d, return_counts=True)
            flat, sizes = of_words.take(words)
            times = np.bincount(flat, np.repeat(n, sizes), GRAMS)
            found.append(np.flatnonzero(times).astype(np.int16))
            counts.append(times[found[-1]].astype(np.int32))
        joined = lambda x, t: Lists(np.concatenate([np.zeros(0, t), *x]), np.array([len(d) for d in x], np.int64))
        by_word = features_of([*vocab])
        by_word.flat = (by_word.flat & (BUCKETS - 1)).astype(np.int32)
        return cls(number, np.array(labels, np.int8), joined(docs, np.int32), by_word, joined(found, np.int16), np.concatenate([np.zeros(0, np.int32), *counts]))

    def cells(self) -> dict[str, int | bytes]:
        arrays = {"y": self.y, "docs": self.docs.flat, "doc_sizes": self.docs.sizes, "features": self.features.flat, "feature_sizes": self.features.sizes, "grams": self.grams.flat, "gram_sizes": self.grams.sizes, "counts": self.counts}
        return {"number": self.number, "hits": int(self.y.sum())} | {k: v.astype(CELLS[k]).tobytes() for k, v in arrays.items()}

    @classmethod
    def of(cls, cells: dict) -> Block:
        """Of the columns that a pass reads: the others are empty."""
        get = lambda k: np.frombuffer(cells.get(k, b""), CELLS[k])
        lists = lambda k, sizes: Lists(get(k), get(sizes).astype(np.int64))
        return cls(cells["number"], get("y"), lists("docs", "doc_sizes"), lists("features", "feature_sizes"), lists("grams", "gram_sizes"), get("counts"))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts that set thresholds, a fifth, and those that the network learns from."""
        held = np.random.default_rng((6, self.number)).permutation(len(self.y))
        return held[: len(held) // 5], held[len(held) // 5 :]

    def profiles(self, which: np.ndarray) -> np.ndarray:
        """Trigram counts of texts."""
        out = np.zeros((len(which), GRAMS), np.float32)
        found, sizes = self.grams.take(which)
        out[np.repeat(np.arange(len(which)), sizes), found] = Lists(self.counts, self.grams.sizes).take(which)[0]
        return out


#: The columns of a packed block, besides its number and its texts of label 1.
CELLS = {"y": np.int8, "docs": np.int32, "doc_sizes": np.int64, "features": np.int32, "feature_sizes": np.int32, "grams": np.int16, "gram_sizes": np.int32, "counts": np.int32}
PROFILES = ("number", "grams", "gram_sizes", "counts", "doc_sizes")
AT_A_TIME = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Where this is false, tables that are dealt by some of a join's columns are joined as they lie.
BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
DEALT = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
#: Marks for each labelled row, and at most: 8 MB. Beyond it more of the other texts are dealt in vain.
MARKS_A_ROW, MOST_MARKS = 16, 1 << 26
SCHEMA = "number int, hits int, " + ", ".join(f"{c} binary" for c in CELLS)


def merged(a, b):
    """Results of two blocks: arrays are summed up, of lists the least KEPT stay."""
    return sorted(a + b)[:KEPT] if isinstance(a, list) else a + b


class Here:
    """Blocks on the driver."""

    def __init__(self, blocks: list[Block]):
        self.blocks, self.hits = blocks, sum(int(b.y.sum()) for b in blocks)

    @classmethod
    def of(cls, texts: list[str], labels: list[int]) -> Here:
        n = max(1, -(-len(texts) // BLOCK_ROWS))
        return cls([Block.pack(k, texts[k::n], labels[k::n]) for k in range(n)])

    def __len__(self) -> int:
        return sum(len(b.y) for b in self.blocks)

    def each(self, work: Callable, state: object, columns: tuple[str, ...]) -> dict:
        """The merged results of all blocks. work: from a block and the state to results by number."""
        out: dict = {}
        for block in self.blocks:
            for k, v in work(block, state).items():
                out[k] = merged(out[k], v) if k in out else v
        return out


def _dump(x: object) -> bytes:
    """An array goes without its rows of zeros."""
    if isinstance(x, list):
        return pickle.dumps(x)
    some = np.flatnonzero(x.any(1)).astype(np.int32)
    return pickle.dumps((x.shape, some, x[some]))


def _load(cell: bytes) -> object:
    x = pickle.loads(cell)
    if isinstance(x, list):
        return x
    out = np.zeros(x[0], x[2].dtype)
    out[x[1]] = x[2]
    return out


def _cells(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([_dump(v) for v in found.values()], pa.binary())], names=["key", "cell"])


def _each(batches: Iterator[pa.RecordBatch], work: Callable, state: object) -> Iterator[pa.RecordBatch]:
    """A task sums up its blocks before it passes anything on."""
    blocks = (Block.of({c: batch.column(c)[j].as_py() for c in batch.schema.names}) for batch in batches for j in range(batch.num_rows))
    out: dict = {}
    for block in blocks:
        for k, v in work(block, state).items():
            out[k] = merged(out[k], v) if k in out else v
    yield _cells(out)


def _gather(table: pa.Table) -> pa.Table:
    out = None
    for cell in table.column("cell"):
        x = _load(cell.as_py())
        out = x if out is None else merged(out, x)
    return pa.Table.from_batches([_cells({table.column("key")[0].as_py(): out})])


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


class There:
    """Blocks in a table."""

    def __init__(self, table: DataFrame, rows: int, hits: int):
        self.table, self.rows, self.hits = table.coalesce(table.sparkSession.sparkContext.defaultParallelism), rows, hits  # a task sums up what it has: few tasks, small sums

    def __len__(self) -> int:
        return self.rows

    def each(self, work: Callable, state: object, columns: tuple[str, ...]) -> dict:
        spark = self.table.sparkSession
        spread = spark.sparkContext.broadcast((work, state))
        found = self.table.select(*columns).mapInArrow(lambda b: _each(b, *spread.value), "key int, cell binary")
        with _setting(spark, AT_A_TIME, "1"):  # blocks are large: one goes to Python at a time, however many a task has
            rows = found.groupBy("key").applyInArrow(_gather, "key int, cell binary").collect()  # sums: their size is that of the model
        spread.destroy()
        return {r["key"]: _load(r["cell"]) for r in rows}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _profiles(block: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: which; of their trigrams the text, trigram and count; the square roots of counts as unit vectors, in an array that the next ones overwrite."""
    space = np.empty((512, GRAMS), np.float32)
    for at in range(0, len(block.grams.sizes), 512):
        sizes = block.grams.sizes[at : at + 512]
        first = block.grams.starts[at]
        inside = slice(first, first + sizes.sum())
        text, gram, counts = np.repeat(np.arange(len(sizes)), sizes), block.grams.flat[inside].astype(np.int64), block.counts[inside]
        rows = space[: len(sizes)]
        rows.fill(0)
        rows.ravel()[text * GRAMS + gram] = np.sqrt(counts / np.bincount(text, counts, len(sizes))[text])
        yield slice(at, at + len(sizes)), text, gram, counts, rows


def _mean(block: Block, _: object) -> dict:
    out = np.zeros((2, GRAMS), np.int64)
    for which, *_, rows in _profiles(block):
        long = block.docs.sizes[which] >= SEED_WORDS
        out[0] += np.rint((long.astype(np.float32) @ rows) * UNIT).astype(np.int64)
        out[1, 0] += long.sum()
    return {0: out}


def _furthest(block: Block, state: tuple[np.ndarray, int]) -> dict:
    """The texts that are least like the one of the targets that they are most like (sign 1), or most like it (-1)."""
    targets, sign = state
    found: list = []
    for which, *_, rows in _profiles(block):
        near = np.where(block.docs.sizes[which] >= SEED_WORDS, sign * (rows @ targets.T).max(1), np.inf)
        least = [j for j in np.argsort(near, kind="stable")[:KEPT].tolist() if near[j] < np.inf]
        found = merged(found, [(float(near[j]), block.number, which.start + j, rows[j].tobytes()) for j in least])
    return {0: found} if found else {}


def _assign(block: Block, state: tuple[np.ndarray, bool]) -> dict:
    """By cluster, and how many texts it has: sums of unit vectors, or at the end of counts."""
    centres, last = state
    k = len(centres)
    sums, sizes = np.zeros((k, GRAMS), np.int64), np.zeros((k, 1), np.int64)
    for _, text, gram, counts, rows in _profiles(block):
        of = (rows @ centres.T).argmax(1)
        sizes[:, 0] += np.bincount(of, minlength=k)
        if last:
            sums += np.rint(np.bincount(of[text] * GRAMS + gram, counts, k * GRAMS)).astype(np.int64).reshape(k, GRAMS)
        else:
            sums += np.rint(((np.arange(k)[:, None] == of).astype(np.float32) @ rows) * UNIT).astype(np.int64)
    return {0: sums, 1: sizes}


def _seeds(data: Here | There, mean: np.ndarray) -> np.ndarray:
    """First the text that is most like the mean, then always the one that is furthest from those before, of all texts: candidates are those that a pass found furthest, for as long as none besides them can be further."""
    far = lambda *state: data.each(_furthest, state, PROFILES)[0]
    seeds = [np.frombuffer(far(mean[None], -1)[0][3], np.float32)]
    while len(seeds) < MOST:
        found = far(np.stack(seeds), 1)
        near, rows = np.array([x[0] for x in found]), np.stack([np.frombuffer(x[3], np.float32) for x in found])
        others = near[-1] if len(found) == KEPT else np.inf
        while len(seeds) < MOST and near.min() <= others:
            if near.min() >= NEAR:
                return np.stack(seeds)
            seeds.append(rows[near.argmin()])
            near = np.maximum(near, rows @ seeds[-1])
    return np.stack(seeds)


def fit_languages(data: Here | There, steps: int = 8) -> np.ndarray:
    """GRAMS x clusters: logarithms of the frequencies of trigrams in each cluster of texts."""
    mean, n_long = data.each(_mean, None, PROFILES)[0]
    if not n_long[0]:
        return np.zeros((GRAMS, 1), np.float32)
    centres = _seeds(data, (mean / UNIT / n_long[0]).astype(np.float32))
    for _ in range(steps):
        found = data.each(_assign, (centres, False), PROFILES)
        sums, sizes = found[0] / UNIT, found[1][:, 0]
        there = [c for c in range(len(centres)) if sizes[c] >= LEAST_SHARE * len(data)] or [int(sizes.argmax())]
        centres = _unit(sums[there]).astype(np.float32)
    sums = data.each(_assign, (centres, True), PROFILES)[0] + 0.5
    return np.log(sums / sums.sum(1, keepdims=True)).T.astype(np.float32)


@dataclass
class Cnn:
    embedding: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # by width: width x dim x filters
    bias: np.ndarray  # of all filters
    output: np.ndarray
    offset: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((GRAMS, 1), np.float32))
    thresholds: dict[int, float] = field(default_factory=dict)  # by cluster; -1: of all together

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """What each word adds to the likelihood of each language."""
        lists = grams_of(words)
        flat, sizes = lists.flat, lists.sizes
        out = np.zeros((len(words), self.languages.shape[1]), np.float32)
        some = sizes > 0
        out[some] = np.add.reduceat(self.languages[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        return out

    def embed(self, words: list[str]) -> np.ndarray:
        lists = features_of(words)
        out = np.add.reduceat(self.embedding[lists.flat & (BUCKETS - 1)], lists.starts, axis=0)
        out[[not w for w in words]] = 0
        return out

    def by_place(self, words: list[str]) -> np.ndarray:
        """What each word gives to each filter at each of its places."""
        e = self.embed(words)
        return np.concatenate([e @ f[k] for f in self.filters for k in range(len(f))], axis=1).astype(np.float32)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.output + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def calibrated(self, p: float, language: int) -> float:
        t = self.thresholds.get(language, self.thresholds.get(-1, CUT))
        return float(CUT * p / t if p < t else CUT + (1 - CUT) * (p - t) / max(1 - t, 1e-9))


def _pool(given: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """given: rows by place for words in a row, each text followed by PADDING rows of padding. Maxima by text and filter."""
    out, at = [], 0
    n = len(given)
    for width in WIDTHS:
        total = given[:, at : at + FILTERS].copy()
        for k in range(1, width):
            total[: n - k] += given[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
        # windows begin at words only; in a text shorter than the filter the one window holds padding
        ends = starts + np.maximum(sizes - width + 1, 1)
        cuts = np.stack([starts, ends], 1).ravel()
        inside = np.minimum(cuts, n - 1)
        out.append(np.maximum.reduceat(total, inside, axis=0)[::2])
        at += width * FILTERS
    return np.concatenate(out, axis=1)


def forward(model: Cnn, docs: list[np.ndarray], lists: Lists) -> tuple[np.ndarray, ...] | None:
    """The distinct words of texts, their embeddings and a row of zeros for padding; by place the row of its word; by text and filter the place where the window with the largest value begins, and that value. None: there is no word."""
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes + PADDING) - (sizes + PADDING)
    n, count = int((sizes + PADDING).sum()), model.filters[0].shape[2]
    place = np.zeros(len(lists.sizes), np.int32)
    for d in docs:
        place[d] = 1
    words = np.flatnonzero(place)
    if not len(words):
        return None
    place[words] = np.arange(len(words))
    row = np.full(n, len(words), np.int32)
    for d, s in zip(docs, starts, strict=True):
        row[s : s + len(d)] = place[d]
    flat, k = lists.take(words)
    e_words = np.add.reduceat(np.take(model.embedding, flat, axis=0), np.cumsum(k) - k, axis=0)
    e_words = np.concatenate([e_words, np.zeros((1, model.embedding.shape[1]), e_words.dtype)])
    turned = np.ascontiguousarray(e_words.T)
    by_place = np.concatenate([f[0].T for f in model.filters] + [of.T for f in model.filters for of in f[1:]])
    best, pooled = np.zeros((len(docs), len(model.bias)), np.int64), np.full((len(docs), len(model.bias)), -np.inf, e_words.dtype)
    for lo in range(0, n, AT_ONCE):
        hi = min(lo + AT_ONCE, n)
        given = by_place @ np.take(turned, row[lo : hi + PADDING], axis=1)
        conv, at, width = given[: len(model.bias)], len(model.bias), given.shape[1]
        for q, f in enumerate(model.filters):
            for k in range(1, len(f)):
                conv[q * count : (q + 1) * count, : width - k] += given[at : at + count, k:]
                at += count
                over = (starts + sizes - k)[sizes > k]  # windows that would hold padding, but for the one of a text shorter than the filter
                conv[q * count : (q + 1) * count, over[(over >= lo) & (over < hi)] - lo] = -np.inf
        for j in range(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)):
            s, t = max(starts[j], lo), min(starts[j] + max(sizes[j], 1), hi)
            if s < t:
                part = conv[:, s - lo : t - lo]
                at = part.argmax(1)
                top = part[np.arange(len(part)), at]
                better = top > pooled[j]
                best[j, better], pooled[j, better] = (at + s)[better], top[better]
    return words, e_words, row, best, pooled


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(rows[order], first, axis=0) if len(found) else rows


def gradients(model: Cnn, docs: list[np.ndarray], lists: Lists | list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict] | None:
    """The weighted loss of texts, and its gradient: filters, bias, output, offset, and in words the gradient of each word's embedding. None: there is no word."""
    found = forward(model, docs, lists if isinstance(lists, Lists) else Lists.of(lists))
    if not found:
        return None
    words, e_words, row, best, pooled = found
    raw = pooled + model.bias
    hidden = np.maximum(raw, 0)
    z = np.clip(hidden @ model.output + model.offset, -40, 40)
    loss = float((weight * np.where(y == 1, np.logaddexp(0, -z), np.logaddexp(0, z))).sum() / len(docs))
    dz = (1 / (1 + np.exp(-z)) - y) * weight / len(docs)
    d_hidden = dz[:, None] * model.output * (raw > 0)
    count, at_all, d_all, of_filters = model.filters[0].shape[2], [], [], []
    for q, f in enumerate(model.filters):
        d, arg = d_hidden[:, q * count : (q + 1) * count], best[:, q * count : (q + 1) * count]
        g = np.zeros(f.shape)
        for place in range(len(f)):
            at = row[arg + place]
            g[place] = np.einsum("bf,bfd->df", d, e_words[at])
            some = (d != 0) & (at < len(words))
            at_all.append(at[some])
            d_all.append((d[:, :, None] * f[place].T[None])[some])
        of_filters.append(g)
    at, d = _summed(np.concatenate(at_all), np.concatenate(d_all))
    of_words = np.empty(len(at), [("word", np.int64), ("gradient", np.float64, e_words.shape[1])])
    of_words["word"], of_words["gradient"] = words[at], d
    return loss, {"filters": of_filters, "bias": d_hidden.sum(0), "output": hidden.T @ dz, "offset": float(dz.sum()), "words": of_words}


def new_model(seed: int = 5) -> Cnn:
    rng, total = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    return Cnn((rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32), [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS], np.zeros(total), rng.standard_normal(total) * 0.3, 0.0)


@dataclass
class State:
    """The model between two epochs, and AdaGrad's sums of squares: by bucket, and of the numbers in dense."""

    model: Cnn
    buckets: np.ndarray
    squares: np.ndarray

    def dense(self) -> np.ndarray:
        m = self.model
        return np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.output, [m.offset]]).astype(np.float64)

    def put(self, x: np.ndarray) -> None:
        m, at = self.model, 0
        for f in m.filters:
            f[:] = x[at : at + f.size].reshape(f.shape)
            at += f.size
        n = len(m.bias)
        m.bias[:], m.output[:], m.offset = x[at : at + n], x[at + n : at + 2 * n], float(x[-1])


def _epoch(block: Block, given: tuple[State, float, tuple[float, float], tuple[int, int]]) -> dict:
    """One epoch over a block's texts, by AdaGrad over shuffled batches: by piece what it changes in embeddings, in their squares, and 1 if it changes them; then the same of all other numbers."""
    state, rate, weights, seed = given
    was = state.model
    model = Cnn(was.embedding.copy(), [f.copy() for f in was.filters], was.bias.copy(), was.output.copy(), was.offset)
    now = State(model, state.buckets.copy(), state.squares.copy())
    _, use = block.parts()
    np.random.default_rng((*seed, block.number)).shuffle(use)
    weight = np.where(block.y == 1, weights[1], weights[0])
    dense = now.dense()
    for first in range(0, len(use), BATCH):
        some = use[first : first + BATCH]
        found = gradients(model, [block.docs[j] for j in some], block.features, block.y[some], weight[some])
        if not found:
            continue
        g = found[1]
        d = np.concatenate([*(f.ravel() for f in g["filters"]), g["bias"], g["output"], [g["offset"]]])
        now.squares += d**2
        dense -= rate * d / np.sqrt(now.squares)
        now.put(dense)
        flat, sizes = block.features.take(g["words"]["word"])
        d = np.repeat(g["words"]["gradient"], sizes, axis=0)
        buckets, d = _summed(flat, np.concatenate([d, (d**2).mean(1, keepdims=True)], axis=1))
        d, squares = d[:, :-1], d[:, -1]
        now.buckets[buckets] += squares
        model.embedding[buckets] -= (rate * d / np.sqrt(now.buckets[buckets])[:, None]).astype(np.float32)
    changed = np.concatenate([np.rint((model.embedding - was.embedding).astype(np.float64) * UNIT), np.rint((now.buckets - state.buckets) * FINE)[:, None], (now.buckets > state.buckets)[:, None]], axis=1).astype(np.int64)
    others = np.stack([np.rint((dense - state.dense()) * UNIT), np.rint((now.squares - state.squares) * FINE), np.full(len(dense), (now.squares > state.squares).any())], 1).astype(np.int64)
    return dict(enumerate(np.array_split(changed, PIECES))) | {PIECES: others}


def fit(texts: list[str] | Here | There, labels: list[int] | None = None, seed: int = 5, epochs: int = EPOCHS) -> Cnn | None:
    """texts: with their labels, or blocks of both. A fifth of each block sets the thresholds."""
    data = Here.of(texts, labels) if isinstance(texts, list) else texts
    if data.hits in (0, len(data)):
        return None
    model, share = new_model(seed), data.hits / len(data)
    model.languages = fit_languages(data)
    state = State(model, np.full(BUCKETS, 1e-4), np.empty(0))
    state.squares = np.full(len(state.dense()), 1e-4)
    for epoch in range(epochs):
        light = State(Cnn(model.embedding, model.filters, model.bias, model.output, model.offset), state.buckets, state.squares)
        found = data.each(_epoch, (light, RATE * (1 - epoch / epochs), (0.5 / (1 - share), 0.5 / share), (seed, epoch)), ("number", "y", "docs", "doc_sizes", "features", "feature_sizes"))
        changed, others = np.concatenate([found[k] for k in range(PIECES)]), found[PIECES]
        times, n = np.maximum(changed[:, -1], 1), np.maximum(others[:, -1], 1)
        model.embedding += (changed[:, :-2] / UNIT / times[:, None]).astype(np.float32)
        state.buckets += changed[:, -2] / FINE / times
        state.put(state.dense() + others[:, 0] / UNIT / n)
        state.squares += others[:, 1] / FINE / n
    model.thresholds = thresholds(data.each(_counts, model, ("number", *CELLS)))
    return model


def best_threshold(hits: np.ndarray, totals: np.ndarray) -> float:
    """Halfway in the widest of the gaps between scores where F1 is highest. hits, totals: texts by score, in steps from 0 to 1; of label 1, and all."""
    there = np.flatnonzero(totals)[::-1]
    p, found = there / (len(totals) - 1), np.cumsum(hits[there])
    f1 = 2 * found / (np.cumsum(totals[there]) + hits.sum())
    edge = np.append(p[1:], 0.0)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    j = top[np.argmax((p - edge)[top])]
    return float(np.clip((p[j] + edge[j]) / 2, 0.02, 0.98))


def _counts(block: Block, model: Cnn) -> dict:
    """By cluster (-1: no word to tell by) and label: how many of the texts that set thresholds have which score."""
    dev, _ = block.parts()
    out: dict = {}
    for at in range(0, len(dev), 64):
        some = dev[at : at + 64]
        found = forward(model, [block.docs[j] for j in some], block.features)
        pooled = found[4] if found else np.zeros((len(some), len(model.bias)), np.float32)
        clusters = np.where(block.docs.sizes[some] > 0, (block.profiles(some).astype(np.float64) @ model.languages).argmax(1), -1)
        steps = np.rint(model.probability(pooled) * STEPS).astype(int)
        for c, y, p in zip(clusters.tolist(), block.y[some].tolist(), steps.tolist(), strict=True):
            out.setdefault(c, np.zeros((STEPS + 1, 2), np.int64))[p, y] += 1
    return out


def thresholds(counts: dict[int, np.ndarray]) -> dict[int, float]:
    """By cluster, where it has 5 texts of label 1; -1: of all together."""
    total = sum(counts.values(), np.zeros((STEPS + 1, 2), np.int64))
    if not total[:, 1].sum():
        return {-1: CUT}
    known = {-1: total} | {c: n for c, n in counts.items() if n[:, 1].sum() >= 5 and c >= 0}
    return {c: best_threshold(n[:, 1], n.sum(1)) for c, n in known.items()}


class Scorer:
    """A worker's model, with what it has worked out for words."""

    def __init__(self, model: Cnn):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers({PAD: 0})
        self.given = self.model.by_place([PAD])
        self.like = np.zeros((1, self.model.languages.shape[1]), np.float32)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return self.judged(texts)[0]

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and the clusters that stand for languages (-1: no word to tell by)."""
        out, languages, at, pad = np.zeros(len(texts)), np.full(len(texts), -1), 0, PADDING
        while at < len(texts):
            if len(self.known) > CACHE:
                self._forget()
            known, parts, sizes, n, end, was = self.known, [], [], 0, at, len(self.known)
            while end < len(texts) and n < AT_ONCE:
                words = WORDS.findall((texts[end] or "").lower())
                parts += [known.of(words), np.zeros(pad, np.int32)]
                sizes.append(len(words))
                n += len(words) + pad
                end += 1
            if len(known) > was:
                new = list(known)[was:]
                parted = [new[k : k + 20_000] for k in range(0, len(new), 20_000)]
                self.given = np.concatenate([self.given, *map(self.model.by_place, parted)])
                self.like = np.concatenate([self.like, *map(self.model.likelihoods, parted)])
            lengths = np.array(sizes)
            starts = np.cumsum(lengths + pad) - (lengths + pad)
            places = np.concatenate(parts)
            out[at:end] = self._in_parts(places, starts, lengths)
            sums = np.add.reduceat(self.like[places], starts, axis=0, dtype=np.float64)
            languages[at:end] = np.where(lengths > 0, sums.argmax(1), -1)
            at = end
        return out, languages

    def _in_parts(self, places: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Texts over AT_ONCE words are pooled in overlapping pieces, whose maxima are joined."""
        if len(places) <= 2 * AT_ONCE:
            return self.model.probability(_pool(self.given[places], starts, sizes))
        pad = PADDING
        pooled = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        for j, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            cuts = range(0, max(n - pad, 1), AT_ONCE)
            got = []
            for c in cuts:
                size = min(AT_ONCE + pad, n - c) if c + AT_ONCE < n - pad else n - c
                rows = self.given[places[s + c : s + c + size + (pad if c + size >= n else 0)]]
                got.append(_pool(rows, np.array([0]), np.array([size]))[0])
            pooled[j] = np.max(got, axis=0)
        return self.model.probability(pooled)

    def scores(self, texts: list[str | None]) -> list[float]:
        p, languages = self.judged(texts)
        return [self.model.calibrated(*x) for x in zip(p.tolist(), languages.tolist(), strict=True)]


def _pack(table: pa.Table) -> pa.Table:
    rows = sorted(zip(map(str, table.column("doc_id").to_pylist()), table.column("text").to_pylist(), table.column("toxic").to_pylist(), strict=True))
    block = Block.pack(table.column("number")[0].as_py(), [r[1] for r in rows], [r[2] for r in rows])
    return pa.table({k: pa.array([v], pa.int32() if k in ("number", "hits") else pa.binary()) for k, v in block.cells().items()})


def train(docs: DataFrame, labels: DataFrame) -> Cnn | None:
    """labels: doc_id, toxic, rows to learn from: all of them, with whole texts (null: empty); rows that repeat are learnt from once."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.filter("toxic in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    rows = steady(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scratch).withColumn("h", F.xxhash64("text"))
    found = rows.select("doc_id", "h", F.length("text").alias("chars")).join(known, F.col("doc_id") == F.col("_id"))
    keys = scratch.save(found.groupBy("doc_id", "h", "toxic").agg(F.max("chars").alias("chars")), "keys")
    n, chars = keys.agg(F.count("*"), F.sum("chars")).first()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), math.ceil((chars or 0) / BLOCK_CHARS))
    number = F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int").alias("number")
    parts = max(blocks, *(int(spark.conf.get(c, None) or 1) for c in DEALT))  # fewer than Spark's own, and it would deal anew for the join
    deal = lambda df, *columns: df.select(number, "doc_id", "h", *columns).repartition(parts, "number")
    maybe = maybe_in(rows, keys, "doc_id", "h", places=min(MARKS_A_ROW << max(n - 1, 0).bit_length(), MOST_MARKS)).filter("maybe")
    dealt = deal(maybe, "text").join(deal(keys, "toxic"), ["number", "doc_id", "h"]).select("number", "doc_id", "text", "toxic").distinct()
    packed = dealt.groupBy("number").applyInArrow(_pack, SCHEMA)
    with _setting(spark, BY_ALL_KEYS, "false"):
        if blocks == 1:
            data = Here([Block.of(r.asDict()) for r in packed.collect()])
        else:
            table = scratch.save(packed, "blocks")
            data = There(table, *table.agg(F.sum(F.length("y")), F.sum("hits")).first())
    for name in ("keys", "docs"):
        scratch.drop(name)
    model = fit(data)
    if blocks > 1:
        scratch.drop("blocks")
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Cnn | None) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model) if model else None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer.scores(texts) if scorer else [0.0] * len(texts), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """doc_id, score for each row of docs."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _score(b, spread.value), "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = fold(F.col("doc_id"), 4) != 2
    out = score(docs, train(docs.filter(learnt), labels.filter(learnt)))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
