"""Quality classifier: a sparse ensemble of rules.

Boosted shallow trees over document statistics give candidate rules (the
conjunctions along their paths); a lasso logistic fit keeps few of them; the kept
rules are compiled into one Spark column expression over the statistics.

Labels are gathered as a sample of bounded size (``MAX_TRAIN`` rows by hash
order); statistics and scores cover every whole text. Edge cases: null and empty
texts have statistics of 0 and are scored like any other; without labels of both
classes every score is the smoothed share of label 1; repeated rows score alike;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text
from .labelled import MAX_TRAIN, fold, sample

STATS = (
    "log_words", "log_chars", "mean_word", "upper", "lower", "digit", "symbol", "bang", "stop", "other_mark", "white", "wide",
    "distinct_words", "same_as_last", "distinct_runs", "distinct_lines", "long_words", "line_words", "marked_words", "capital_words",
)


def _classes() -> np.ndarray:
    """Byte to class: 0 upper, 1 lower, 2 digit, 3 symbol, 4 bang, 5 stop, 6 other mark, 7 white, 8 wide, 9 continuation."""
    c = np.full(256, 6, np.uint8)
    c[65:91], c[97:123], c[48:58] = 0, 1, 2
    c[list(b"#*$%&|<>")] = 3
    c[list(b"!?")] = 4
    c[list(b".,;:")] = 5
    c[list(b" \t\n\r\x0b\x0c")] = 7
    c[192:256] = 8
    c[128:192] = 9
    return c


def statistics(col: pa.Array) -> np.ndarray:
    """One row of ``STATS`` for each text."""
    kind, out = _classes(), []
    for w, ln in zip(text.words(col), text.lines(col), strict=True):
        b, rows = w.data, len(w.rows)
        ends = np.append(ln.lo[ln.first[:-1]], len(b))
        k = kind[b]
        each = np.empty((10, rows))
        for c in range(10):
            total = np.zeros(len(b) + 1, np.int64)
            np.cumsum(k == c, out=total[1:])
            each[c] = total[ends[1:]] - total[ends[:-1]]
        chars = each[:9].sum(axis=0)
        n = np.diff(w.first)
        share = lambda x, of: np.divide(x, of, out=np.zeros(rows), where=of > 0)  # noqa: E731, B023
        row = np.repeat(np.arange(rows), n)
        count = lambda mask: np.bincount(row, mask, rows)  # noqa: E731, B023
        same = np.zeros(len(row), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        length = w.end - w.start
        runs, first = text.shingles(w, 8)
        distinct = np.array([len(np.unique(w.hash[x:y])) for x, y in zip(w.first[:-1], w.first[1:], strict=True)])
        distinct_runs = np.array([len(np.unique(runs[x:y])) for x, y in zip(first[:-1], first[1:], strict=True)])
        distinct_lines = np.array([len(np.unique(ln.hash[x:y])) for x, y in zip(ln.first[:-1], ln.first[1:], strict=True)])
        last, head = k[w.end - 1], k[w.start]
        out.append(
            np.stack(
                [np.log1p(n), np.log1p(chars), share(chars - each[7], n)]
                + [share(each[c], chars) for c in range(9)]
                + [share(distinct, n), share(count(same), n), share(distinct_runs, np.diff(first)), share(distinct_lines, np.diff(ln.first)), share(count(length > 20), n), share(n, np.diff(ln.first)), share(count((last == 3) | (last == 4)), n), share(count(head == 0), n)],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a double for each of ``STATS``."""

    def measure(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(len(STATS)))], ["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold) of each condition


def _tree(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray, least: int) -> None:
    """Grow on gradients; every node but the root adds its path to ``rules``, every leaf its step."""
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            sums = [np.bincount(binned[rows, j], v, len(c) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = best[1]
    left = binned[rows, j] <= k
    for side, sub in ((True, rows[left]), (False, rows[~left])):
        rule = (*path, (j, side, float(cuts[j][k])))
        rules.append(rule)
        _tree(x, cuts, binned, g, h, sub, depth - 1, rule, rules, step, least)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, t in rule:
        out &= (x[:, j] <= t) if low else (x[:, j] > t)
    return out


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for j, low, t in rule:
                c = F.col(STATS[j]) <= F.lit(t) if low else F.col(STATS[j]) > F.lit(t)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 48, rate: float = 0.3, lasso: float = 2e-4, steps: int = 800) -> RuleModel:
    """Rules from boosted trees, then FISTA on the logistic loss with an L1 penalty on the rules' weights."""
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return RuleModel([], [], float(np.log(prior / (1 - prior))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    f, found = np.full(n, np.log(prior / (1 - prior))), []
    least = max(2, min(20, n // 50))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(n)
        _tree(x, cuts, binned, p - y, p * (1 - p), np.arange(n), depth, (), found, step, least)
        f += rate * step
    rules, columns, seen = [], [], set()
    for rule in found:
        v = _holds(rule, x)
        key = v.tobytes()
        if 0 < v.sum() < n and key not in seen and (~v).tobytes() not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(v)
    a = np.stack(columns, axis=1).astype(np.float32) if rules else np.zeros((n, 0), np.float32)
    mean = a.mean(axis=0)
    a -= mean
    w, z, b, bz, t = np.zeros(a.shape[1], np.float32), np.zeros(a.shape[1], np.float32), 0.0, 0.0, 1.0
    top = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # the Lipschitz bound by power iteration
        top = a.T @ (a @ top)
        top /= np.linalg.norm(top) + 1e-12
    pace = 1 / (0.25 * max(float(np.linalg.norm(a @ top) ** 2) / n, 1.0))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ z + bz))) - y
        w2 = z - pace * (a.T @ r.astype(np.float32)) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - pace * lasso, 0)
        b2 = bz - pace * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2, t2
        z = z.astype(np.float32)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([rules[k] for k in kept], [float(w[k]) for k in kept], float(b - (w * mean).sum()))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document. Labels of the held-out fold are never read."""
    store.small_batches(docs.sparkSession)
    stats = store.write(with_statistics(docs, id_col, text_col), "stats")
    chosen = sample(labels, label_col, folds, held_out, max_train)
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATS).limit(max_train).toPandas()  # the sample's bound holds for both
    model = fit(rows[list(STATS)].to_numpy(float), rows["label"].to_numpy(float))
    return stats.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), model.column().alias("score")).select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
