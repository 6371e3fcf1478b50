"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, trained in numpy, predicts every word of a text
from three words on either side; the sum of the conditional log-probabilities
scores the document.

Words fall into classes: the ``top`` most frequent ones each have their own, the rest
share buckets by hash, within which a word has its share of the bucket's count.
Classes in order of frequency form groups of 48, and the network predicts the group
and then the class within it, both from the context (a softmax of two levels). Counts
come from every word of the corpus and shuffle as (word, count). The most frequent
``table`` words, and each bucket's totals, go to executors; all other words of the
texts meet their counts in a join, so every word has its own share. The network
learns on every window of every document, a ``stride``-th of them a round with as
many rounds at least, so each word is a target: each round sends the weights out,
each task takes its own steps, and the weights' mean over tasks (by windows seen) is
the next round's start. Means are taken piece by piece in the order of the tasks, so
reruns over the same files agree. So both what is counted and what is learned from
grow with the corpus.

Edge cases: null and empty texts have 0 words, a score of 0 and a null mean; a text
of one word is predicted from padding alone; rows are scored one by one, so
repeated rows agree; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text
from .decontaminate import Lookup

REACH = 3
TOP = 2048
BUCKETS = 256
GROUP = 48
HIDDEN = 16
TABLE = 1 << 16
BATCH = 8192
PIECES = 256


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), n: of every word of every text."""

    def count(batches):
        held: list[np.ndarray] = []
        n = 0

        def out():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["word", "n"])

        for b in batches:
            for w in text.words(b.column(0)):
                held.append(w.hash)
                n += len(w.hash)
                if n > 4_000_000:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most frequent words and their counts, equal counts in the order of the words.

    Sorting on the cluster would send ``k`` rows of every task to the driver. Counts of
    words by the size of their count, then by count, then by the word's first bits tell
    instead where the cut is; what is above it and at most 4 * k rows around it are gathered.
    """
    above, edge, need = [], counts, k
    keys = ((F.floor(F.log2("n") * 16).cast("long"), True), (F.col("n"), True), (F.floor(F.col("word") / 2.0**54).cast("long"), False), (F.floor(F.col("word") / 2.0**44).cast("long"), False))
    for key, down in keys:
        groups = sorted(edge.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=down)  # 16 an octave, or a bucket's counts, or 1,024
        cut = None
        for r in groups:
            if r.words > need:
                cut = r
                break
            need -= r.words
        if cut is None:
            above.append(edge)
            edge = None
            break
        above.append(edge.where(key > cut.key if down else key < cut.key))
        edge = edge.where(key == cut.key)
        if cut.words <= 4 * k or not need:
            break
    parts = above + ([edge] if edge is not None and need else [])
    rows = [r for part in parts for r in part.select("word", "n").collect()]
    rows = sorted(rows, key=lambda r: (-r.n, r.word))[:k]
    return np.array([r.word for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.float64)


class Vocabulary:
    """Classes of words and log shares within classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, distinct: np.ndarray, top: int):
        # words: by count, most frequent first; totals and distinct: of the words of each bucket outside the top.
        top = min(top, len(words))
        order = np.argsort(words[:top]) if top else np.zeros(1, np.int64)
        self.top = Lookup(words[order] if top else np.zeros(1, np.uint64))
        self.size, self.buckets = len(order), len(totals)
        self.rank = np.append(order, self.size).astype(np.int32)
        rest, n = words[top:], counts[top:]
        order = np.argsort(rest)
        self.table = Lookup(rest[order]) if len(rest) else None
        bucket = self.bucket(rest, self.buckets)
        self.below = np.log(np.maximum(totals + distinct, 1) + 1)
        self.share = np.append((np.log(n + 1) - self.below[bucket])[order], 0.0).astype(np.float32)
        freq = np.concatenate([counts[:top] if top else [0], totals]) + 1.0
        self.frequency = freq / freq.sum()

    @staticmethod
    def bucket(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        return (text.mix(h) & np.uint64(buckets - 1)).astype(np.int64)

    @property
    def classes(self) -> int:
        return self.size + self.buckets

    def class_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, and which words have a bucket, and which."""
        c = self.rank[self.top(h)]
        rest = np.flatnonzero(c == self.size)
        b = self.bucket(h[rest], self.buckets)
        c[rest] = self.size + b
        return c, rest, b

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log share within it, and whether log(count + 1) is still to be added as the word is not in the table."""
        c, rest, b = self.class_of(h)
        share, open_ = np.zeros(len(h), np.float32), np.zeros(len(h), bool)
        k = self.table(h[rest]) if self.table else np.zeros(len(rest), np.int32)
        known = k < len(self.table.known) if self.table else np.zeros(len(rest), bool)
        share[rest] = np.where(known, self.share[k], -self.below[b])
        open_[rest] = ~known
        return c, share, open_


def start_weights(v: Vocabulary, hidden: int, seed: int) -> list[np.ndarray]:
    """Context embeddings (position, class or padding, hidden), then output weights and biases of groups, and of classes
    by group; what fills the last group up has no probability."""
    rng = np.random.default_rng(seed)
    groups = -(-v.classes // GROUP)
    freq = np.append(v.frequency, np.zeros(groups * GROUP - v.classes)).reshape(groups, GROUP)
    of_group = freq.sum(axis=1)
    return [
        (rng.standard_normal((2 * REACH, v.classes + 1, hidden)) * 0.1).astype(np.float32),
        (rng.standard_normal((hidden, groups)) * 0.1).astype(np.float32),
        np.log(of_group).astype(np.float32),
        (rng.standard_normal((groups, hidden, GROUP)) * 0.1).astype(np.float32),
        np.where(freq > 0, np.log(np.maximum(freq, 1e-30) / of_group[:, None]), -1e4).astype(np.float32),
    ]


def contexts(c: np.ndarray, first: np.ndarray, pad: int, begin: int = 0, step: int = 1) -> np.ndarray:
    """Classes around each word, or each ``step``-th from ``begin`` on, (2 * REACH, words); ``pad`` beyond a text's ends."""
    n = np.diff(first)
    # Texts with pads between them: what is around a word is where it is, shifted.
    at = np.arange(len(c)) + REACH * (1 + np.repeat(np.arange(len(n)), n))
    padded = np.full(len(c) + REACH * (len(n) + 1), pad, np.intp)
    padded[at] = c
    at = at[begin::step]
    return np.stack([padded[at + off] for off in (*range(-REACH, 0), *range(1, REACH + 1))])


def forward(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    """Hidden values and group scores of windows; the order of windows by group of ``y``, the groups there and where
    each begins, and scores of the classes of its own group for each window in that order."""
    e, out, bias, inner, inner_bias = weights
    h = e[0].take(x[0], axis=0)
    for k in range(1, len(x)):
        h += e[k].take(x[k], axis=0)
    np.tanh(h, out=h)
    z = h @ out
    z += bias
    order, g, begin = runs(y // GROUP)
    hs = h.take(order, axis=0)
    z2 = np.empty((len(y), GROUP), np.float32)
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(y)], strict=True):
        np.matmul(hs[lo:hi], inner[g[lo]], out=z2[lo:hi])
        z2[lo:hi] += inner_bias[g[lo]]
    return h, z, order, g[begin], begin, hs, z2


def runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts small numbers, the sorted numbers, and where each begins."""
    c = c.astype(np.uint16)  # sorted by counting
    order = np.argsort(c, kind="stable")
    g = c[order]
    return order, g, np.flatnonzero(np.append(True, g[1:] != g[:-1]))


def exponentials(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, as scores stay far from where it overflows but for what the bound cuts."""
    np.minimum(z, 80, out=z)
    return np.exp(z, out=z)


def log_probabilities(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P(class y | context), in blocks."""

    def own(z, at):
        chosen = np.minimum(z[np.arange(len(z)), at], 80)
        return chosen - np.log(exponentials(z).sum(axis=1))

    parts = []
    for lo in range(0, len(y), BATCH):
        c = y[lo : lo + BATCH]
        _, z, order, _, _, _, z2 = forward(weights, x[:, lo : lo + BATCH], c)
        p = own(z, c // GROUP)
        p[order] += own(z2, c[order] % GROUP)
        parts.append(p)
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


class Learner:
    """Adagrad on the cross entropy of minibatches of windows."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.w, self.rate = [w.copy() for w in weights], rate
        # Rare classes have small gradients: only a small start lets them move.
        self.sq = [np.full_like(w, 0.1 if k in (1, 2) else 1e-6) for k, w in enumerate(weights)]
        self.seen = 0

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        n = len(y)
        h, z, order, groups, begin, hs, z2 = forward(self.w, x, y)
        for v, at in ((z, y // GROUP), (z2, y[order] % GROUP)):
            exponentials(v)
            v *= (1 / (n * v.sum(axis=1)))[:, None]
            v[np.arange(n), at] -= 1 / n
        gh = z @ self.w[1].T
        of_inner, back = np.empty((len(groups), *self.w[3].shape[1:]), np.float32), np.empty_like(gh)
        for k, (lo, hi) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True)):
            of_inner[k] = hs[lo:hi].T @ z2[lo:hi]
            back[lo:hi] = z2[lo:hi] @ self.w[3][groups[k]].T
        gh[order] += back
        gh *= 1 - h * h
        self._move(1, slice(None), h.T @ z)
        self._move(2, slice(None), z.sum(axis=0))
        self._move(3, groups, of_inner)
        self._move(4, groups, np.add.reduceat(z2, begin, axis=0))
        for k in range(len(x)):
            order, c, at = runs(x[k])
            self._move(0, (k, c[at]), np.add.reduceat(gh.take(order, axis=0), at, axis=0))
        self.seen += n

    def _move(self, i: int, at, g: np.ndarray) -> None:
        self.sq[i][at] += g * g * 100
        self.w[i][at] -= self.rate * g * 10 / np.sqrt(self.sq[i][at])


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32))
        at += w.size
    return out


def train(docs: DataFrame, vocabulary, weights: list[np.ndarray], rounds: int, stride: int, rate: float) -> list[np.ndarray]:
    """Rounds of local steps and averaging. Weights are averaged in pieces, one place a piece; one model reaches the driver."""
    like = [np.empty(w.shape, np.float32) for w in weights]
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(weights)

        def learn(batches, sent=sent, turn=turn):
            learner, v = Learner(sent.value, rate / (1 + turn)), vocabulary.value
            kept: list = []
            held = 0
            for b in batches:
                for w in text.words(b.column(0)):
                    c = v.class_of(w.hash)[0]
                    x = contexts(c, w.first, v.classes, turn % stride, stride)
                    kept.append((x, c[turn % stride :: stride]))
                    held += x.shape[1]
                    if held >= 8 * BATCH:
                        x, y = np.concatenate([k[0] for k in kept], axis=1), np.concatenate([k[1] for k in kept])
                        for lo in range(0, len(y), BATCH):
                            learner.step(x[:, lo : lo + BATCH], y[lo : lo + BATCH])
                        kept, held = [], 0
            if held:
                x, y = np.concatenate([k[0] for k in kept], axis=1), np.concatenate([k[1] for k in kept])
                for lo in range(0, len(y), BATCH):
                    learner.step(x[:, lo : lo + BATCH], y[lo : lo + BATCH])
            if learner.seen:
                total, part = _flat(learner.w) * np.float32(learner.seen), TaskContext.get().partitionId()
                pieces = np.array_split(total, PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array([learner.seen] * PIECES, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "part", "seen", "sums"])

        def merge(batches):
            at, n, total = None, 0, None

            def out():
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["piece", "mean"])

            for b in batches:
                for piece, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if piece != at:
                        if n:
                            yield out()
                        at, n, total = piece, 0, 0.0
                    n, total = n + k, total + np.frombuffer(s, np.float32).astype(np.float64)
            if n:
                yield out()

        learned = docs.select("text").mapInArrow(learn, "piece int, part int, seen long, sums binary").repartition("piece").sortWithinPartitions("piece", "part")
        means = {r.piece: bytes(r["mean"]) for r in learned.select("piece", "seen", "sums").mapInArrow(merge, "piece int, mean binary").collect()}
        if means:
            weights = _shaped(np.concatenate([np.frombuffer(means[k], np.float32) for k in range(PIECES)]), like)
    return weights


def fit(docs: DataFrame, top: int = TOP, table: int = TABLE, hidden: int = HIDDEN, rounds: int = 2, stride: int = 2, rate: float = 0.05, seed: int = 11) -> tuple[store.Shared, list[np.ndarray], DataFrame]:
    """``docs``: (text). Returns the vocabulary, shared with executors, and the network's weights, and (word, n)."""
    if rounds < stride:
        raise ValueError("with fewer rounds than stride, some words are never learned from")
    counts = store.write(count_words(docs), "words")
    words, n = most_frequent(counts, top + table)

    def sums(batches):
        frequent = np.sort(words[:top])
        total, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            own = ~np.isin(h, frequent)
            k = Vocabulary.bucket(h[own])
            total += np.bincount(k, b.column(1).to_numpy()[own], BUCKETS)
            distinct += np.bincount(k, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(total), pa.array(distinct)], ["bucket", "n", "words"])

    total, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.mapInArrow(sums, "bucket int, n double, words double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        total[r.bucket], distinct[r.bucket] = r.n, r.words
    v = store.Shared(docs.sparkSession, Vocabulary, words, n, total, distinct, top)
    return v, train(docs, v, start_weights(v.value, hidden, seed), rounds, stride, rate), counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, pll (sum of log-probabilities), mean_pll, for every document, by a network fitted on all of them."""
    store.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary, fitted, counts = fit(docs.select("text"), **options)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def measure(batches):
        v, weights = vocabulary.value, model.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for w in text.words(b.column(1)):
                c, share, open_ = v(w.hash)
                p = log_probabilities(weights, contexts(c, w.first, v.classes), c) + share
                n = np.diff(w.first)
                of = np.repeat(np.arange(len(n)), n)
                ends = np.cumsum(np.bincount(of[open_], minlength=len(n)))
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(w.hash[open_].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.rows.start, len(w.rows)), pa.array(row + np.arange(len(n))), pa.array(n), pa.array(np.bincount(of, p, len(n))), rare], ["doc_id", "row", "n_words", "pll", "rare"])
                row += len(n)

    # Written, so that row numbers stay what they are when a task is repeated.
    part = store.write(docs.mapInArrow(measure, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, n_words long, pll double, rare array<long>"), "scores")
    more = part.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.sum(F.log(F.col("n") + 1)).alias("more"))
    pll = F.col("pll") + F.coalesce("more", F.lit(0.0))
    return part.drop("rare").join(more, "row", "left").select("doc_id", "n_words", pll.alias("pll"), F.when(F.col("n_words") > 0, pll / F.col("n_words")).alias("mean_pll"))
