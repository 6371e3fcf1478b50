"""Toxicity by a counterfactually regularised classifier.

Features are the words of a text (marks at both ends taken off, A-Z as a-z) and
the first 3 to 7 bytes of longer words, hashed; a document has a feature or not.
A logistic model is fitted on labelled texts with a second penalty: sentences of
labelled texts that name a group are copied with the group's name swapped for each
other one of its kind, and the squared change of the score between a sentence and
its copies is penalised. Naming a group so cannot by itself move a score, which cuts
false alarms on neutral mentions.

Labelled texts are a sample of bounded size (``MAX_TRAIN`` rows by hash order), of each
of which up to ``MAX_SENTENCES`` sentences that name a group are swapped (in the order
of a hash); candidate features are chosen on all whole texts of it; every whole text
is scored.
Edge cases: null and empty texts have no features and get the model's base score;
without labels of both classes every score is the smoothed share of label 1;
repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text
from .decontaminate import bare
from .labelled import MAX_TRAIN, fold, sample

PREFIXES = (3, 4, 5, 6, 7)
MAX_FEATURES = 8192
MAX_SENTENCES = 8
PARTS = 16  # more than the terms of any kind

# Group terms that may stand for each other, one line a kind and language.
GROUP_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes"),
)


def _features(w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows (within ``w``) and hashes of all features, with repeats."""
    start, end = bare(w)
    solid = np.zeros(256, bool)
    solid[48:58] = solid[65:91] = solid[97:123] = solid[128:] = True
    some = np.flatnonzero(solid[w.data[start]]) if len(start) else start  # words of marks only are no features
    row, start, end = np.repeat(np.arange(len(w.rows)), np.diff(w.first))[some], start[some], end[some]
    h, rows = [w.low.hashes(start, end)], [row]
    for p in PREFIXES:
        k = end - start > p
        h.append(w.low.hashes(start[k], start[k] + p, p))
        rows.append(row[k])
    return np.concatenate(rows), np.concatenate(h)


def swapped(words: list[str], terms=GROUP_TERMS, by: int = 1) -> list[str] | None:
    """The words with each group term replaced by the one ``by`` places on in its kind; None if nothing changes."""
    out, place = [], {t: kind[(i + by) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    for word in words:
        bare = word.strip(".,;:!?\"'()").lower()
        out.append(word.lower().replace(bare, place[bare]) if bare in place else word)
    return out if out != words else None


def sentences_and_swaps(text_: str, terms=GROUP_TERMS) -> list[list[str]]:
    """Each sentence of a text that names a group, followed by its copies with every other term of the kind."""
    named, out = {t for kind in terms for t in kind}, {}
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text_):
        words = sentence.split()
        if any(w.strip(".,;:!?\"'()").lower() in named for w in words):
            out.setdefault(" ".join(words), words)
    most = max(map(len, terms), default=1)
    chosen = sorted(out, key=lambda x: zlib.crc32(x.encode()))[:MAX_SENTENCES]
    return [[x, *dict.fromkeys(" ".join(c) for by in range(1, most) if (c := swapped(out[x], terms, by)))] for x in chosen]


@dataclass
class ToxicModel:
    features: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        out = []
        for w in text.words(col):
            total = np.full(len(w.rows), self.bias)
            if len(self.features):
                row, h = _features(w)
                p = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                hit = self.features[p] == h
                pair = np.unique(row[hit] * len(self.features) + p[hit])
                total += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], len(w.rows))
            out.append(1 / (1 + np.exp(-total)))
        return np.concatenate(out) if out else np.zeros(0)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, d: int, pairs: np.ndarray, ridge: float = 0.1, counter: float = 5.0, steps: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of binary features given as (row, column) entries.

    ``pairs``: (a sentence's row, a copy's row); neither has a label (their y is nan). The
    loss is logistic (both labels weigh the same in sum) + ridge * |w|^2 / 2 +
    counter * sum((score - score of copy)^2) / 2, minimised by Newton steps with
    conjugate gradients and step halving.
    """
    n, known = len(y), ~np.isnan(y)
    target = np.where(known, y, 0)
    share = target[known].mean()
    weight = np.where(known, np.where(target > 0, 0.5 / share, 0.5 / (1 - share)), 0.0)
    one, two = (pairs[:, 0], pairs[:, 1]) if len(pairs) else (np.zeros(0, np.int64),) * 2

    def forward(v):
        return np.bincount(rows, v[:-1][cols], n) + v[-1]

    def back(r, v):
        out = np.empty(d + 1)
        out[:-1] = np.bincount(cols, r[rows], d) + ridge * v[:-1]
        out[-1] = r.sum()
        return out

    def spread(gap):
        return counter * (np.bincount(one, gap, n) - np.bincount(two, gap, n))

    def loss(v):
        s = forward(v)
        return (weight * (np.logaddexp(0, s) - target * s)).sum() + ridge * (v[:-1] ** 2).sum() / 2 + counter * ((s[one] - s[two]) ** 2).sum() / 2

    v, at = np.zeros(d + 1), None
    for _ in range(steps):
        s = forward(v)
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = back(weight * (p - target) + spread(s[one] - s[two]), v)
        curve = weight * p * (1 - p) + 1e-9
        x, r = np.zeros(d + 1), -g
        q, rr = r.copy(), r @ r
        stop = min(0.25, np.sqrt(np.linalg.norm(g))) * np.linalg.norm(g)
        for _ in range(60):
            f = forward(q)
            hq = back(curve * f + spread(f[one] - f[two]), q)
            k = rr / (q @ hq)
            x += k * q
            r -= k * hq
            if np.linalg.norm(r) < stop:
                break
            rr, old = r @ r, rr
            q = r + rr / old * q
        at, step = loss(v) if at is None else at, 1.0
        while (new := loss(v + step * x)) > at + 1e-4 * step * (g @ x) and step > 1e-4:
            step /= 2
        v, done, at = v + step * x, at - new < 1e-6 * (1 + abs(at)), new
        if done:
            break
    return v[:-1], float(v[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held_out: int = 1, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, least_docs: int = 3, counter: float = 5.0, terms=GROUP_TERMS) -> ToxicModel:
    """``docs``: (doc_id, text). Features: the ``max_features`` that tell the labels apart best among those that
    ``least_docs`` labelled texts of label 1 have; counts come from all sampled texts."""
    spark = docs.sparkSession
    chosen = sample(labels, label_col, folds, held_out, max_train)

    def extract(batches):
        # Part 0 is a labelled text; part PARTS * k is a sentence that names a group, the parts after it are its copies.
        for batch in batches:
            ids, texts, marks = (c.to_pylist() for c in batch.columns)
            rows = [(i, t or "", float(m), 0) for i, t, m in zip(ids, texts, marks, strict=True)]
            rows += [(i, x, None, PARTS * k + j) for i, t, _, _ in list(rows) for k, same in enumerate(sentences_and_swaps(t, terms), 1) for j, x in enumerate(same)]
            found: list[bytes] = []
            for w in text.words(pa.array([r[1] for r in rows], pa.string())):
                row, h = _features(w)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h = row[new], h[new]
                cut = np.searchsorted(row, np.arange(len(w.rows) + 1))
                found += [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32()), pa.array(found, pa.binary())], ["doc_id", "label", "part", "features"])

    # The sample's bound is the broadcast's.
    rows = store.write(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(extract, "doc_id long, label double, part int, features binary"), "labelled")
    share = {r[0]: r[1] for r in rows.where("part = 0").groupBy("label").count().collect()}
    n1, n0 = share.get(1.0, 0), share.get(0.0, 0)
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))

    def count(batches):
        parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
        held = 0

        def out():
            ids, inv = np.unique(np.concatenate(parts[True] + parts[False]), return_inverse=True)
            k = sum(map(len, parts[True]))
            one = np.bincount(inv[:k], minlength=len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(one), pa.array(np.bincount(inv, minlength=len(ids)) - one)], ["feature", "one", "zero"])

        for b in batches:
            for label, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(f, np.uint64)
                parts[label == 1.0].append(x)
                held += len(x)
                if held > 4_000_000:
                    yield out()
                    parts, held = {True: [], False: []}, 0
        if held:
            yield out()

    counts = rows.where("part = 0").select("label", "features").mapInArrow(count, "feature long, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).where(F.col("one") >= least_docs)
    # The lower bound, two standard errors down, of the log odds of having the feature; surer features first.
    odds = F.abs(F.log((F.col("one") + 0.5) / (n1 + 1.0)) - F.log((F.col("zero") + 0.5) / (n0 + 1.0)))
    ranked = counts.withColumn("rank", odds * F.sqrt("one"))
    top = ranked.orderBy(F.desc("rank"), "feature").limit(max_features).select("feature").collect()
    features = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    if not len(features):
        p = (n1 + 1) / (n1 + n0 + 2)
        return ToxicModel(features, np.zeros(0), float(np.log(p / (1 - p))))
    known = spark.sparkContext.broadcast(features)

    def narrow(batches):
        f = known.value
        for b in batches:
            out = []
            for x in b.column(3).to_pylist():
                h = np.frombuffer(x, np.uint64)
                p = np.minimum(np.searchsorted(f, h), len(f) - 1)
                out.append(p[f[p] == h].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["doc_id", "label", "part", "features"])

    data = rows.mapInArrow(narrow, "doc_id long, label double, part int, features binary").toPandas().sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
    y = data["label"].to_numpy(float)
    lists = [np.frombuffer(f, np.uint16) for f in data["features"]]
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    first = {(d, p): i for i, (d, p) in enumerate(zip(data["doc_id"], data["part"], strict=True)) if p % PARTS == 0}
    pairs = np.array([(first[d, p - p % PARTS], i) for i, (d, p) in enumerate(zip(data["doc_id"], data["part"], strict=True)) if p % PARTS], np.int64).reshape(-1, 2)
    w, b = fit_logistic(at, np.concatenate(lists).astype(np.int64), y, len(features), pairs, counter=counter)
    keep = w != 0
    return ToxicModel(features[keep], w[keep], b)


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document. Labels of the held-out fold are never read."""
    store.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = fit(docs, labels, label_col, folds, held_out, **options)
    model = store.Shared(docs.sparkSession, ToxicModel, found.features, found.weights, found.bias)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.scores(b.column(1)))], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double").select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
