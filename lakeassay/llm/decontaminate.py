"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the benchmark's words. Their weights are inverse document frequencies
   counted over every whole document, in one scan.
2. The TF-IDF passages of the benchmark form a matrix whose leading right singular
   vectors come from a distributed randomised SVD: tasks multiply their passages
   with a random test matrix, and small products are summed, as in subspace
   iteration. A space holds ``block_items`` items, as more would crowd its rank; a
   larger benchmark has several.
3. Documents are cut into overlapping windows, of 24 words for every item and of
   sizes near their own for shorter and longer ones; windows and items meet in the
   latent space, and pairs with enough cosine similarity, and of lengths there that
   are not too far apart, are candidates. Windows whose terms' lengths do not add up
   to the least that any item needs are not multiplied out.
   The words that a candidate shares with the item must carry enough of its weight.
4. A candidate is confirmed by the longest common subsequence of words between the
   item and the text around the window (one word more than ``min_lcs`` of the item, so
   that short items need a larger share; below six words in ten the common words, in
   their order, must also carry ``min_ordered`` of the item's weight), or by a shorter one together with the
   item's answer. Items of ``min_exact`` to ``min_words`` - 1 words have no window
   worth the name; they are found where all their words stand in a row.

One scan searches for the spaces of ``scan_bytes`` (their terms and items, counted
before they are sent), in the task that reads the document, so no text shuffles and
no pair of rows is made.

Edge cases: null and empty texts match nothing; items with fewer than ``min_exact``
words stand in clean texts too and match nothing; repeated items and rows
are reported each; an item without an answer column has its last fifth as answer;
an empty table, or benchmark, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

WINDOW = 24
STRIDE = 8
SHORT = ((8, 1), (12, 1), (16, 2))  # sizes and strides of windows for items shorter than WINDOW
RANK = 64
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 256  # four times the rank: more items would crowd the latent space
SCAN_BYTES = 96 << 20
SURE_LCS = 0.6  # of an item's words; a shorter common subsequence must carry enough of its weight as well
TABLE_BITS = 18


def bare(w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end without marks at both ends (a word of marks only keeps them)."""
    solid = np.zeros(256, bool)
    solid[48:58] = solid[65:91] = solid[97:123] = solid[128:] = True
    start, end = w.start, w.end
    if not len(start):
        return start, end
    # Most words have no marks; the others are looked at.
    odd = np.flatnonzero(~(solid[w.data[start]] & solid[w.data[end - 1]]))
    if len(odd):
        at = np.append(np.flatnonzero(solid[w.data]), len(w.data))
        i, j = np.searchsorted(at, start[odd]), np.searchsorted(at, end[odd])
        some = j > i
        start, end = start.copy(), end.copy()
        start[odd[some]], end[odd[some]] = at[i[some]], at[j[some] - 1] + 1
    return start, end


def terms(w: text.Words) -> np.ndarray:
    """Hashes of words without marks at both ends."""
    start, end = bare(w)
    odd = np.flatnonzero((start != w.start) | (end != w.end))
    h = w.hash.copy()
    h[odd] = w.low.hashes(start[odd], end[odd])
    return h


def _words(col: pa.Array, chunk: int = text.CHUNK):
    """Words with letters of every script in lower case."""
    return text.words(pc.utf8_lower(col), chunk)


class Lookup:
    """Term numbers of hashes; len(terms) for other words. A table of marks, 2**18 or 16 a term, skips most searches."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.shift = np.uint64(64 - max(TABLE_BITS, (16 * len(known)).bit_length()))
        self.mark = np.zeros(1 << 64 - int(self.shift), bool)
        self.mark[(known >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.known), np.int32)
        some = np.flatnonzero(self.mark[(h >> self.shift).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
        hit = self.known[p] == h[some]
        out[some[hit]] = p[hit]
        return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = place.get(y)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def weighted_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """The most weight that a common subsequence of terms has; a term of ``b`` without a weight matches nothing."""
    row = np.zeros(len(b) + 1)
    for x in a.tolist():
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + weight[x], 0.0)))
    return float(row[-1])


def document_frequencies(docs: DataFrame, lookup, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all."""

    def count(batches):
        total, n = np.zeros(size, np.int64), 0
        for b in batches:
            for w in _words(b.column(0)):
                t = lookup.value(terms(w))
                n += len(w.rows)
                step = max(1, 8_000_000 // (size + 1))
                for lo in range(0, len(w.rows), step):  # a table of marks, documents by terms
                    at = w.first[lo : lo + step + 1]
                    marks = np.zeros((len(at) - 1, size + 1), bool)
                    marks[np.repeat(np.arange(len(at) - 1), np.diff(at)), t[at[0] : at[-1]]] = True
                    total += marks.sum(axis=0)[:size]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, size), pa.int32()), pa.array(np.append(total[k], n), pa.int64())], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    # One row a term of the benchmark's block.
    for t, n in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[t] = n
    return out[:size], int(out[size])


def randomised_svd(passages: DataFrame, idf: np.ndarray, lookup, rank: int, seed: int = 7, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF passages in ``passages.text``.

    Y = A'(A Q) is a sum over tasks of products of their own rows; each round sends
    Q out and sums Y by blocks of terms.
    """
    size, step = len(idf), 1024
    spark = passages.sparkSession
    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((q, idf))

        def multiply(batches, sent=sent):
            q, idf = sent.value
            y = np.zeros(q.shape, np.float32)
            for b in batches:
                for w in _words(b.column(0)):
                    t = lookup.value(terms(w))
                    row = np.repeat(np.arange(len(w.rows)), np.diff(w.first))
                    row, t = row[t < len(idf)], t[t < len(idf)]
                    pair, tf = np.unique(row * len(idf) + t, return_counts=True)
                    row, t = pair // len(idf), pair % len(idf)
                    v = tf * idf[t]
                    norm = np.sqrt(np.bincount(row, v * v, len(w.rows)))
                    v = (v / np.maximum(norm[row], 1e-9)).astype(np.float32)
                    aq = np.zeros((len(w.rows), q.shape[1]), np.float32)
                    np.add.at(aq, row, v[:, None] * q[t])
                    np.add.at(y, t, v[:, None] * aq[row])
            for lo in range(0, len(y), step):
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([y[lo : lo + step].tobytes()], pa.binary())], ["block", "y"])

        def merge(batches):
            kept: dict[int, np.ndarray] = {}
            for b in batches:
                for lo, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    y = np.frombuffer(y, np.float32)
                    kept[lo] = kept[lo] + y if lo in kept else y
            for lo, y in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["block", "y"])

        y = np.zeros_like(q)
        for lo, part in passages.select("text").mapInArrow(multiply, "block int, y binary").repartition("block").mapInArrow(merge, "block int, y binary").collect():
            y[lo : lo + step] = np.frombuffer(bytes(part), np.float32).reshape(-1, q.shape[1])
        # Directions that no passage has would only let noise in.
        u, sigma, _ = np.linalg.svd(y, full_matrices=False)
        q = u[:, sigma > 1e-4 * max(float(sigma[0]), 1e-12)].astype(np.float32)
    return q


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, min_cosine: float = 0.9, min_norm: float = 0.15, min_weight: float = 0.4, min_lcs: float = 0.45, min_lcs_with_answer: float = 0.4, min_ordered: float = 0.45, min_words: int = 8, min_exact: int = 4, rank: int = RANK, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, answer_found), a row for each benchmark item found in a document."""
    spark = docs.sparkSession
    store.small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    total, n, longest = items.agg(F.sum(F.octet_length("text") + 64), F.count(F.lit(1)), F.max(F.octet_length("text"))).first()
    parts = max(-(-(total or 0) // block_bytes), -(-n // block_items))
    # Blocks by range of a hash: their items and bytes are counted below, before any is collected.
    items = store.write(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts)))), "items")
    found = None
    for scan in _scans(items, 4 * block_bytes + (longest or 0), scan_bytes, rank):
        some = _find(docs, items, scan, *kinds, min_cosine, min_norm, min_weight, min_lcs, min_lcs_with_answer, min_ordered, min_words, min_exact, rank)
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs long, item_words long, answer_found boolean")
    return found


def _scans(items: DataFrame, most: int, scan_bytes: int, rank: int) -> list[list[int]]:
    """Blocks by the scan that searches for them. One row a block; a block's model is its terms, each of ``rank`` numbers."""
    out, room = [], 0
    for r in items.groupBy("block").agg(F.sum(F.octet_length("text") + 64).alias("size")).orderBy("block").collect():
        if r["size"] > most:
            raise ValueError(f"benchmark items of one block have {r['size']} bytes, too many to gather; raise block_bytes")
        model = r["size"] // 6 * (4 * rank + 16)  # as if every word were a term
        if not out or model > room:
            out.append([])
            room = scan_bytes
        out[-1].append(r.block)
        room -= model
    return out


class Space:
    """What a task needs to search for the items of one block."""

    def __init__(self, latent, vec, item_terms, answer_terms, names, idf, least_norm, short, short_names):
        self.latent, self.vec, self.item_terms, self.names, self.least_norm = latent, vec, item_terms, names, least_norm
        self.idf = idf
        self.reach = np.linalg.norm(latent, axis=1)
        self.none, self.lens = len(latent) - 1, np.array([len(t) for t in item_terms], np.int64)
        self.answers = [a.tobytes() for a in answer_terms]
        bags = [np.unique(t, return_counts=True) for t in item_terms]
        self.bags = [(t, many, many * idf[t]) for t, many in bags]
        self.wide, self.narrow = _sizes(item_terms, self.none)
        # Short items by their number of words: sorted keys, and where each key's items are.
        self.short: dict[int, tuple] = {}
        for n in {len(t) for t in short}:
            of = [i for i, t in enumerate(short) if len(t) == n]
            keys = _row_keys([np.stack([short[i] for i in of])[:, j] for j in range(n)])
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], [(short[of[k]], short_names[of[k]]) for k in order]


def _row_keys(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = text.mix(out ^ c.astype(np.uint64))
    return out


def _find(docs, items, blocks, doc_kind, item_kind, min_cosine, min_norm, min_weight, min_lcs, min_lcs_with_answer, min_ordered, min_words, min_exact, rank):
    spark = docs.sparkSession
    hashes, answers, rows = {}, {}, {}
    for k in blocks:
        rows[k] = items.where(F.col("block") == k).select("item_id", "text", "answer").orderBy("item_id", "text").collect()  # counted by _scans
        hashes[k] = [np.concatenate([terms(w) for w in _words(pa.array([r.text]))]) for r in rows[k]]
        answers[k] = [np.concatenate([terms(w) for w in _words(pa.array([r.answer]))]) if r.answer else h[-max(3, len(h) // 5) :] for r, h in zip(rows[k], hashes[k], strict=True)]
    some = [h for k in blocks for h in hashes[k] if len(h) >= min_exact]
    known = np.unique(np.concatenate(some)) if some else np.zeros(1, np.uint64)
    lookup = store.Shared(spark, Lookup, known)
    df, n_docs = document_frequencies(docs, lookup, len(known))
    weights = np.log((n_docs + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    parts = []
    for k in blocks:
        keep = [i for i, h in enumerate(hashes[k]) if len(h) >= min_words]
        brief = [i for i, h in enumerate(hashes[k]) if min_exact <= len(h) < min_words]
        mine = [hashes[k][i] for i in keep + brief]
        if not mine:
            continue
        # The block's own terms, by their places among all terms of the scan.
        own = np.searchsorted(known, np.unique(np.concatenate(mine)))
        of_block = store.Shared(spark, Lookup, known[own])
        idf, q = weights[own], np.zeros((len(own), 1), np.float32)
        if keep:
            q = randomised_svd(items.where(F.col("block") == k), idf, of_block, rank, rounds=2)
        latent = idf[:, None] * q  # a term's contribution
        item_terms = [of_block.value(hashes[k][i]) for i in keep]
        vec = np.stack([latent[t].sum(axis=0) for t in item_terms]) if keep else np.zeros((0, q.shape[1]), np.float32)
        size_of = np.linalg.norm(vec, axis=1)
        vec /= np.maximum(size_of, 1e-9)[:, None]
        local = np.append(np.full(len(known), len(own), np.int32), np.int32(len(own)))
        local[own] = np.arange(len(own), dtype=np.int32)
        parts.append((local, np.vstack([latent, np.zeros((1, q.shape[1]), np.float32)]), vec, item_terms, [of_block.value(answers[k][i]) for i in keep], [rows[k][i].item_id for i in keep], idf, min_norm * size_of, [of_block.value(hashes[k][i]) for i in brief], [rows[k][i].item_id for i in brief]))
    sent = store.Shared(spark, lambda *x: [(p[0], Space(*p[1:])) for p in x], *parts)

    def search(batches):
        spaces, find = sent.value, lookup.value
        for b in batches:
            ids, out = b.column(0), []
            for w in _words(b.column(1)) if spaces else ():
                every = find(terms(w))
                for local, space in spaces:
                    t = local[every]
                    hits = _search(space, t, w.first, min_cosine, min_weight, min_lcs, min_lcs_with_answer, min_ordered)
                    out += [(ids[w.rows.start + d], name, *v) for (d, name), v in hits]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([v.as_py() for v in cols[0]], ids.type), pa.array(cols[1]), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5])], ["doc_id", "item_id", "cosine", "lcs", "item_words", "answer_found"])

    return docs.mapInArrow(search, f"doc_id {doc_kind}, item_id {item_kind}, cosine double, lcs long, item_words long, answer_found boolean")


def _search(s: Space, t: np.ndarray, first: np.ndarray, min_cosine: float, min_weight: float, min_lcs: float, min_lcs_with_answer: float, min_ordered: float) -> list:
    """((row, item), (cosine, lcs, item_words, answer_found)) of what some rows hold, ``t`` being their words' terms."""
    short = []
    for size, (keys, of) in s.short.items():
        short += [((d, name), (1.0, size, size, True)) for d, name in _in_a_row(t, first, size, keys, of, s.none)]
    if not len(s.vec):
        return short
    n = np.diff(first)
    blocks = -(-n // STRIDE)
    # Sums of 8 words each; a window is some of them in a row within one text.
    last = np.cumsum(blocks)
    start = np.repeat(first[:-1], blocks) + (np.arange(blocks.sum()) - np.repeat(last - blocks, blocks)) * STRIDE
    if not len(start):
        return short
    stop = np.repeat(last, blocks)
    reach = np.concatenate([[0.0], np.cumsum(np.add.reduceat(s.reach[t], start, dtype=np.float64))])
    ends = {size: np.minimum(np.arange(len(start)) + size // STRIDE, stop) for size, _ in s.wide}
    # Terms' lengths bound a window's; one below what its items need is out for certain.
    live = {size: np.flatnonzero(reach[ends[size]] - reach[:-1] >= 0.999 * s.least_norm[of].min()) for size, of in s.wide}
    cover = np.zeros(len(start) + 1, np.int64)
    for size, at in live.items():
        np.add.at(cover, at, 1)
        np.add.at(cover, ends[size][at], -1)
    used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    sums = np.zeros((len(start) + 1, s.latent.shape[1]))
    if len(used):
        to = np.append(start[1:], len(t))
        many = (to - start)[used]
        begin = np.cumsum(many) - many
        words = np.repeat(start[used] - begin, many) + np.arange(many.sum())
        sums[used + 1] = np.add.reduceat(s.latent[t[words]], begin, axis=0)
        np.cumsum(sums, axis=0, out=sums)
    near = []
    for size, of in s.wide:
        at = live[size]
        near.append(_close((sums[ends[size][at]] - sums[at]).astype(np.float32), start[at], size, of, s.vec, s.least_norm, min_cosine))
    for size, stride, of, own in s.narrow:
        at = _narrow_starts(own[t], first, size, stride)
        win = s.latent[t[at]] if len(at) else np.zeros((0, s.latent.shape[1]), np.float32)
        for k in range(1, size if len(at) else 1):
            win += s.latent[t[at + k]]
        near.append(_close(win, at, size, of, s.vec, s.least_norm, min_cosine))
    x, y, c, size_at = (np.concatenate(v) for v in zip(*near, strict=True))
    if not len(x):
        return short
    # Windows of one text near the same item that stand close together are one candidate.
    order = np.lexsort((x, y))
    x, y, c, to = x[order], y[order], c[order], (x + size_at)[order]
    doc = np.searchsorted(first, x, "right") - 1
    new = np.ones(len(x), bool)
    new[1:] = (y[1:] != y[:-1]) | (doc[1:] != doc[:-1]) | (x[1:] - x[:-1] > STRIDE * (1 + s.lens[y[1:]] // STRIDE))
    begin = np.flatnonzero(new)
    best, to = np.maximum.reduceat(c, begin), np.maximum.reduceat(to, begin)
    hits: dict = {}
    for g in range(len(begin)):
        i, d = int(y[begin[g]]), int(doc[begin[g]])
        size = int(s.lens[i])
        a = max(int(first[d]), int(x[begin[g]]) - size)
        z = min(int(first[d + 1]), int(to[g]) + size)
        near = t[a:z]
        bag, many, weight = s.bags[i]
        p = np.searchsorted(bag, near)
        p[p == len(bag)] = 0
        both = np.bincount(p[bag[p] == near], minlength=len(bag))
        # The words that both have must carry enough of the item's weight.
        if (np.minimum(both, many) / many * weight).sum() < min_weight * float(weight.sum()):
            continue
        common = _best_lcs(s.item_terms[i], near, s.none)
        if common < SURE_LCS * size and weighted_lcs(s.item_terms[i], near, s.idf) < min_ordered * float(weight.sum()):
            continue
        answer = s.answers[i] in _aligned(near, s.answers[i])
        if common >= min_lcs * size + 1 or (answer and common >= min_lcs_with_answer * size):
            old = hits.get((d, i))
            if old is None or (common, best[g]) > (old[1], old[0]):
                hits[(d, i)] = (float(best[g]), common, size, answer)
    return short + [((d, s.names[i]), v) for (d, i), v in sorted(hits.items())]


def _in_a_row(t: np.ndarray, first: np.ndarray, size: int, keys: np.ndarray, of: list, none: int) -> list:
    """(row, item) where all words of an item of ``size`` words stand in a row, once a row."""
    if len(t) < size:
        return []
    m = len(t) - size + 1
    at = np.ones(m, bool)
    for j in range(size):
        at &= t[j : j + m] != none
    at = np.flatnonzero(at)
    at = at[at + size <= first[np.searchsorted(first, at, "right")]]
    have = _row_keys([t[at + j] for j in range(size)])
    p = np.searchsorted(keys, have)
    hit = np.flatnonzero((p < len(keys)) & (keys[np.minimum(p, len(keys) - 1)] == have))
    out = {}
    for k in hit.tolist():
        i = int(p[k])
        while i < len(keys) and keys[i] == have[k]:
            if (t[at[k] : at[k] + size] == of[i][0]).all():
                out[int(np.searchsorted(first, at[k], "right")) - 1, i] = of[i][1]
            i += 1
    return sorted(((d, name) for (d, _), name in out.items()), key=lambda x: x[0])


def _sizes(item_terms: list[np.ndarray], none: int) -> tuple[list, list]:
    """Windows by size: (size, items) in steps of 8 words, and (size, stride, items, their terms) for short items.

    An item meets windows of 24 words, and of 48, 96, ... as far as they are a
    quarter of its length to all of it, so that a copy fills some window.
    """
    lens = np.array([len(t) for t in item_terms], np.int64)
    wide, size = [(WINDOW, np.arange(len(lens)))], 2 * WINDOW
    while len(lens) and size <= lens.max():
        wide.append((size, np.flatnonzero((lens >= size) & (lens < 4 * size))))
        size *= 2
    narrow = []
    for k, (size, stride) in enumerate(SHORT):
        least, most = (size if k else 0), (SHORT[k + 1][0] if k + 1 < len(SHORT) else WINDOW)
        of = np.flatnonzero((lens >= least) & (lens < most))
        if len(of):
            own = np.zeros(none + 1, bool)
            own[np.concatenate([item_terms[i] for i in of])] = True
            narrow.append((size, stride, of, own))
    return [(n, of) for n, of in wide if len(of)], narrow


def _narrow_starts(own: np.ndarray, first: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Where windows of ``size`` words begin that lie in one text and have half of their words marked ``own``."""
    if len(own) < size:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(0, len(own) - size + 1, stride)
    at = at[2 * (total[at + size] - total[at]) >= size]
    return at[at + size <= first[np.searchsorted(first, at, "right")]]


def _close(win, start, size, of, vec, least_norm, min_cosine):
    """(start, item, cosine, size) of the windows that are near items ``of``."""
    norm = np.linalg.norm(win, axis=1)
    long = np.flatnonzero(norm >= least_norm[of].min())
    norm = norm[long]
    cos = (win[long] @ vec[of].T) / np.maximum(norm, 1e-9)[:, None]
    x, y = np.nonzero((cos >= min_cosine) & (norm[:, None] >= least_norm[of]))
    return start[long[x]], of[y], cos[x, y], np.full(len(x), size)


def _best_lcs(item: np.ndarray, near: np.ndarray, none: int) -> int:
    """The longest common subsequence of the item and a stretch of ``near`` half as long again: stretches begin a quarter
    of the item apart, so that each one a quarter longer than the item lies in one of them."""
    mine, size = item.tolist(), len(item)
    span = size + size // 2 + 4
    if len(near) <= span:
        return lcs(mine, [v for v in near.tolist() if v != none])
    step = max(1, (span - size) // 2)
    return max(lcs(mine, [v for v in near[k : k + span].tolist() if v != none]) for k in range(0, len(near) - span + step, step))


def _aligned(near: np.ndarray, key: bytes):
    """``key`` if it occurs in ``near`` at a whole number, else nothing."""
    raw, at = near.tobytes(), 0
    while (at := raw.find(key, at)) >= 0:
        if at % near.itemsize == 0:
            return (key,)
        at += 1
    return ()
