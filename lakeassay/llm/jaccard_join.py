"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct k-word shingles of whole texts, as 64-bit hashes under a seed
drawn for each run. Two sets link when den * |A & B| >= num * |A | B|. The join is
exact but for hashes that meet by chance; sets of fewer than 16 shingles, in which
one such chance could make or break a link, carry a second hash under another seed
wherever they are compared:

1. Equal sets collapse to one representative (a 128-bit sum and the size).
2. A count sketch of bounded size orders shingles, rare ones first; any common order
   is right, so its errors cost time only. Each representative puts the prefix of
   its set that any partner must meet into index lists (shingle, position, size).
3. Skipping by position: in a list, a pair can only link if what follows both
   positions is long enough, and if the sizes are near enough; lists are sorted,
   and blocks that fail are skipped without looking at their pairs.
4. Answers from answers: in each list the set with the least position (the one
   with the fewest shingles of its own) is compared with all others first. What
   it links with forms provisional classes, whose sets need no comparison among
   themselves to find the components: only pairs of different classes are still
   generated, in blocks, and confirmed on whole sets. Connected links give the
   components. Where every link is asked for, pairs within classes are generated too.

Lists stream from a sort, and the sketch tells which are long: those are dealt out
in parts with a leader each, and leaders meet the first of them. In stage 4's second
part a long list is dealt out as pairs of blocks of about ``LIST_ROWS`` rows. So
no list of any length needs one task or its memory.

Edge cases: a text with 1 to k-1 words has its whole sequence as one shingle; null
texts and texts without words have empty sets and link with nothing; rows that
share an id are one node; a row with a null id is its own class with a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text
from .components import components

SKETCH_BITS = (18, 26)  # least and most; about one cell for 16 shingles in between
SKETCH_BLOCK = 1 << 15
ID_FILTER_BITS = 1 << 26
HUB_ROWS = 256  # pairs of one hub in one place
PAIR_BLOCK = 2048
SHORT_LIST = 32
LIST_ROWS = 4096  # of an index list, or its part, in one place
SMALL = 16  # sets of fewer shingles carry two hashes


def _sets(col: pa.Array, k: int, seed: int):
    for w in text.words(col, seed=seed):
        yield w.rows, *text.sorted_sets(*text.shingles(w, k))


def _double_sets(col: pa.Array, k: int, seed: int):
    """Rows, sorted hashes, where each row's begin, and {row: second hashes} of rows with few shingles."""
    for w in text.words(col, seed=seed):
        raw, at = text.shingles(w, k)
        h, first = text.sorted_sets(raw, at)
        n = np.diff(first)
        small, second = np.flatnonzero((n > 0) & (n < SMALL)), {}
        if len(small):
            # The words of small rows alone, hashed again.
            many = np.diff(w.first)[small]
            begin = np.cumsum(many) - many
            idx = np.repeat(w.first[small] - begin, many) + np.arange(many.sum())
            start, end = w.start[idx], w.end[idx]
            own = text.Words(range(len(small)), w.low.hashes(start, end, seed ^ 0x5DEECE66D), start, end, np.append(begin, many.sum()), w.data, w.low)
            other, to = text.shingles(own, k)
            for j, i in enumerate(small.tolist()):
                _, where = np.unique(raw[at[i] : at[i + 1]], return_index=True)
                second[i] = other[to[j] : to[j + 1]][where]
        yield w.rows, h, first, second


def signatures(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, n_shingles and two sums that tell sets apart."""

    def sign(batches):
        for b in batches:
            for rows, h, first, second in _double_sets(b.column(1), k, seed):
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                        sums.append(total[first[1:]] - total[first[:-1]])
                    for i, x in second.items():
                        sums[1][i] = text.mix(x).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), pa.array(np.diff(first)), *(pa.array(x.view(np.int64)) for x in sums)], ["doc_id", "n_shingles", "s1", "s2"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long")


def shingle_sketch(docs: DataFrame, k: int, bits: int, seed: int = 0) -> np.ndarray:
    """Documents by cell of their shingles' hashes: 2**bits counts."""
    shift, cells = np.uint64(64 - bits), 1 << bits

    def count(batches):
        import zstandard

        total = np.zeros(cells, np.uint32)
        for b in batches:
            for _, h, _ in _sets(b.column(0), k, seed):
                np.add.at(total, (h >> shift).astype(np.int64), 1)
        z = zstandard.ZstdCompressor(level=1)
        for at in np.flatnonzero(total.reshape(-1, SKETCH_BLOCK).any(axis=1)).tolist():
            part = total[at * SKETCH_BLOCK : (at + 1) * SKETCH_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], ["block", "counts"])

    def merge(batches):
        import zstandard

        z, kept = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for at, c in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = np.frombuffer(z.decompress(c), np.uint32)
                old = kept.get(at, c[:0])
                kept[at] = np.minimum(old.astype(np.uint64) + c, 0xFFFFFFFF).astype(np.uint32) if len(old) else c
        z = zstandard.ZstdCompressor(level=1)
        for at, c in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([z.compress(c.tobytes())], pa.binary())], ["block", "counts"])

    import zstandard

    z, out = zstandard.ZstdDecompressor(), np.zeros(cells, np.uint32)
    parts = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(merge, "block int, counts binary")
    for at, c in parts.collect():  # as large as the sketch at most
        out[at * SKETCH_BLOCK : (at + 1) * SKETCH_BLOCK] = np.frombuffer(z.decompress(bytes(c)), np.uint32)
    return out


def noise_of(sketch: np.ndarray) -> float:
    return float(sketch.mean() + 4 * np.sqrt(sketch.mean()) + 2)


def levels(sketch: np.ndarray) -> np.ndarray:
    """0 for cells within the noise of their mean, then one more for each doubling."""
    noise = noise_of(sketch)
    return np.where(sketch <= noise, 0, 1 + np.floor(np.log2(np.maximum(sketch, 1) / noise))).clip(0, 40).astype(np.uint8)


def need(n1, n2, num: int, den: int):
    """The intersection that sets of these sizes need."""
    return -(-num * (n1 + n2) // (num + den))


def id_filter(ids: DataFrame, bits: int = ID_FILTER_BITS) -> bytes:
    """One bit for each id of a column, at a place its hash gives; false marks cost work, never results."""

    def fill(batches):
        import zstandard

        marks = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            p = (text.mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(marks, p >> 3, (1 << (p & 7)).astype(np.uint8))
        z, step = zstandard.ZstdCompressor(level=1), bits >> 9
        for at in np.flatnonzero(marks.reshape(-1, step).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([z.compress(marks[at * step : (at + 1) * step].tobytes())], pa.binary())], ["block", "marks"])

    def merge(batches):
        import zstandard

        z, kept = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for at, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = np.frombuffer(z.decompress(m), np.uint8)
                kept[at] = kept[at] | m if at in kept else m
        z = zstandard.ZstdCompressor(level=1)
        for at, m in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([z.compress(m.tobytes())], pa.binary())], ["block", "marks"])

    import zstandard

    z, step, out = zstandard.ZstdDecompressor(), bits >> 9, np.zeros(bits >> 3, np.uint8)
    for at, m in ids.mapInArrow(fill, "block int, marks binary").repartition("block").mapInArrow(merge, "block int, marks binary").collect():
        out[at * step : (at + 1) * step] = np.frombuffer(z.decompress(bytes(m)), np.uint8)
    return out.tobytes()


def index_lists(docs: DataFrame, reps: DataFrame, shingles: int, k: int, num: int, den: int, seed: int = 0, list_rows: int = LIST_ROWS) -> DataFrame:
    """Rows (token, part, pos, n, doc, lead_pos, lead_n, lead) of index lists with two sets at least.

    ``part`` is 0, or one of the parts, dealt by document, of a list that the sketch
    says may be long; each part has its own leader.
    """
    spark = docs.sparkSession
    bits = min(max(int(shingles // 16).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    sketch = shingle_sketch(docs, k, bits, seed)
    # A level's cells hold fewer than noise * 2**level sets.
    parts = np.array([1] + [1 + int(noise_of(sketch) * 2.0**v / list_rows) for v in range(1, 42)], np.int64)
    level = spark.sparkContext.broadcast(levels(sketch))
    shift = np.uint64(64 - bits)

    def prefixes(batches):
        for b in batches:
            for rows, h, first in _sets(b.column(1), k, seed):
                lev = level.value[(h >> shift).astype(np.int64)]
                out = []
                for i in range(len(rows)):
                    s, v = h[first[i] : first[i + 1]], lev[first[i] : first[i + 1]]
                    n = len(s)
                    p = n - -(-num * n // den) + 1 if n else 0
                    out.append((s[np.argsort(v, kind="stable")[:p]] if v.any() else s[:p]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), pa.array(np.diff(first), pa.int32()), pa.array(out, pa.binary())], ["doc", "n", "prefix"])

    def explode(batches):
        for b in batches:
            doc, n, prefix = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_pylist()
            lens = np.array([len(p) >> 3 for p in prefix])
            lo = 0
            while lo < len(lens):  # a few hundred thousand rows at a time
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(lens[lo:]), 300_000, "right")))
                m = lens[lo:hi]
                pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                token, of = np.frombuffer(b"".join(prefix[lo:hi]), np.uint64), np.repeat(doc[lo:hi], m)
                # Parts are numbered from 1 where there are several.
                many = parts[level.value[(token >> shift).astype(np.int64)]]
                part = np.where(many > 1, 1 + (text.mix(of.astype(np.int64).view(np.uint64)) >> np.uint64(1)).astype(np.int64) % many, 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(np.repeat(n[lo:hi], m)), pa.array(of)], ["token", "part", "pos", "n", "doc"])
                lo = hi

    def lead(batches):
        """Streams lists sorted by (token, part, pos, n, doc): the first row leads its part; whole lists of one row go."""
        names = ["token", "part", "pos", "n", "doc"]
        last = None  # key and leader of the part that the last row seen belongs to
        held = None  # that row itself, while it is alone in its part so far
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, cols, strict=True)]
                last = None
            token, part = cols[:2]
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            leads = [c[head].copy() for c in cols[2:]]
            goes_on = last is not None and (token[0], part[0]) == last[0]
            if goes_on:
                end = int(np.flatnonzero(new[1:])[0]) + 1 if new[1:].any() else len(token)
                for c, v in zip(leads, last[1], strict=True):
                    c[:end] = v
            alone = new & np.append(new[1:], False) & (part == 0)
            if goes_on:
                alone[0] = False
            tail = bool(new[-1]) and part[-1] == 0 and not (len(token) == 1 and goes_on)
            show = ~alone
            if tail:
                show[-1] = False
            held = [c[-1] for c in cols] if tail else None
            last = (token[-1], part[-1]), [c[-1] for c in leads]
            if show.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[show]) for c in [*cols, *leads]], [*names, "lead_pos", "lead_n", "lead"])

    spread = docs.mapInArrow(prefixes, "doc long, n int, prefix binary").where("n > 0").join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi")
    rows = spread.select("doc", "n", "prefix").mapInArrow(explode, "token long, part int, pos int, n int, doc long")
    return store.write(rows.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "n", "doc").mapInArrow(lead, "token long, part int, pos int, n int, doc long, lead_pos int, lead_n int, lead long"), "lists")


def leaders(lists: DataFrame) -> DataFrame:
    """Rows (pos, n, doc, lead_pos, lead_n, lead): leaders of a list's parts with the first of them. Few rows a list."""
    each = lists.where("part > 0").groupBy("token", "part").agg(F.min(F.struct(F.col("lead_pos").alias("pos"), F.col("lead_n").alias("n"), F.col("lead").alias("doc"))).alias("r"))
    first = each.groupBy("token").agg(F.min("r").alias("lead"))
    return each.join(first, "token").select("r.pos", "r.n", "r.doc", F.col("lead.pos").alias("lead_pos"), F.col("lead.n").alias("lead_n"), F.col("lead.doc").alias("lead"))


def parity(h: np.ndarray) -> np.ndarray:
    """A set's parity bits, two or more for each element: bit ``h % B`` flips for each ``h``; B is a power of 2."""
    b = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little")


def parity_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of |A ^ B|: bits in which the parities differ, the longer one folded to the shorter."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _beside(docs: DataFrame, pairs: DataFrame, k: int, seed: int, form, test, columns: str) -> DataFrame:
    """Bring what ``form`` makes of both sets of each pair (a, b) together and emit what ``test`` returns, if anything.

    What is made of ``b`` goes to each of its pairs; that of ``a`` goes once to each
    256 pairs that it has, so a hub of any degree is split.
    """
    marks = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select("a").union(pairs.select("b"))))

    def items_of(batches):
        filt = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            p = (text.mix(ids.view(np.uint64)) & np.uint64(ID_FILTER_BITS - 1)).astype(np.int64)
            wanted = ((filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(wanted))
            for rows, h, first, second in _double_sets(b.column(1), k, seed):
                made = [form(h[x:y], second.get(i)).tobytes() for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), pa.array(np.diff(first), pa.int32()), pa.array(made, pa.binary())], ["doc", "n", "items"])

    names = [c.split()[0] for c in columns.split(", ")]

    def check(batches):
        hub, mine = None, []
        for batch in batches:
            out = []
            for a, salt, b, n, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hub != (a, salt):
                    hub, mine = (a, salt), []
                if b is None:
                    mine.append((n, items))
                    continue
                out += [(a, b, *found) for n_a, x in mine if (found := test(n_a, x, n, items)) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    items = docs.mapInArrow(items_of, "doc long, n int, items binary")
    # Written, so that the join below has two plain sides and a hub's pairs can be split there.
    hubs = store.write(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("salts")), "hubs")
    of_b = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b").join(items.withColumnRenamed("doc", "b"), "b")
    of_a = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b")).join(items.withColumnRenamed("doc", "a"), "a")
    rows = of_b.select("a", "salt", "b", "n", "items").union(of_a.select("a", "salt", "b", "n", "items"))
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(check, columns)


def both_have(n_a: int, x: np.ndarray, n_b: int, y: np.ndarray) -> int:
    """The size of the intersection of two sets in the form of ``whole``."""
    a, b = x[:n_a], y[:n_b]
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    if inter and n_a < SMALL and n_b < SMALL:
        return len(set(zip(a.tolist(), x[n_a:].tolist(), strict=True)) & set(zip(b.tolist(), y[n_b:].tolist(), strict=True)))
    return inter


def whole(h: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    return h if second is None else np.concatenate([h, second])


def confirm(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Those of the pairs (a, b) that link, with inter and the sizes, by their whole sets.

    Parity bits, a thirtieth of a set's bytes, go first: pairs whose bits differ in
    more places than linked sets can are out for certain. Whole sets shuffle for the rest.
    """

    def near(n_a, x, n_b, y):
        apart = parity_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
        return () if (n_a + n_b - apart) // 2 >= need(n_a, n_b, num, den) else None

    def linked(n_a, x, n_b, y):
        inter = both_have(n_a, np.frombuffer(x, np.uint64), n_b, np.frombuffer(y, np.uint64))
        return (inter, n_a, n_b) if inter and inter >= need(n_a, n_b, num, den) else None

    left = store.write(_beside(docs, pairs, k, seed, lambda h, _: parity(h), near, "a long, b long").distinct(), "near")
    return _beside(docs, left, k, seed, whole, linked, "a long, b long, inter long, n_a long, n_b long")


def cross_pairs(lists: DataFrame, classes: DataFrame | None, num: int, den: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """Pairs of sets of different classes, or of any sets, that meet in a list at positions and of sizes that let them link.

    A list of more than ``list_rows`` rows is dealt out by document into blocks; each
    pair of blocks is a group of its own, and each row goes to the groups of its block.
    """

    def pairs(batches):
        names = ["a", "b"]

        def of_list(cols):
            pos, n, doc, own, side = cols
            order = np.argsort(n, kind="stable")
            pos, n, doc, own, side = (c[order] for c in (pos, n, doc, own, side))
            size, two = len(n), side.min() != side.max()
            for lo in range(0, size, PAIR_BLOCK):
                hi = min(size, lo + PAIR_BLOCK)
                for lo2 in range(lo, size, PAIR_BLOCK):
                    hi2 = min(size, lo2 + PAIR_BLOCK)
                    if n[lo2] * num > n[hi - 1] * den:
                        break  # every further block is too large for every set of this one
                    rest = min((n[lo:hi] - pos[lo:hi]).max(), (n[lo2:hi2] - pos[lo2:hi2]).max())
                    if rest < need(int(n[lo]), int(n[lo2]), num, den):
                        continue  # skipped by position
                    a, b = np.arange(lo, hi)[:, None], np.arange(lo2, hi2)[None, :]
                    ok = (own[a] != own[b]) & (b > a) & (n[b] * num <= n[a] * den)
                    ok &= np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need(n[a], n[b], num, den)
                    if two:
                        ok &= side[a] != side[b]
                    x, y = np.nonzero(ok)
                    if len(x):
                        x, y = doc[lo + x], doc[lo2 + y]
                        yield np.minimum(x, y), np.maximum(x, y)

        def emit(found):
            if found:
                u = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names)

        def of_short_lists(cols, bounds):
            """Pairs of all lists up to ``SHORT_LIST`` rows at once: each row with the one 1, 2, ... places on."""
            size = np.diff(bounds)
            short = (size > 1) & (size <= SHORT_LIST) & (cols[1][bounds[:-1]] == 0)
            number = np.repeat(np.where(short, np.arange(len(size)), -1), size)
            keep = np.flatnonzero(number >= 0)
            number, pos, n, doc, own = number[keep], *(c[keep] for c in cols[2:6])
            for d in range(1, int(size[short].max(initial=1))):
                a = np.flatnonzero((number[d:] == number[:-d]) & (own[d:] != own[:-d]))
                b = a + d
                fits = (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need(n[a], n[b], num, den))
                a, b = doc[a[fits]], doc[b[fits]]
                if len(a):
                    yield np.minimum(a, b), np.maximum(a, b)

        carry = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if carry is not None:
                cols = [np.concatenate(c) for c in zip(carry, cols, strict=True)]
            token, group = cols[:2]
            cut = np.flatnonzero((token[1:] != token[:-1]) | (group[1:] != group[:-1])) + 1
            bounds = np.append(0, cut)
            found = list(of_short_lists([c[: bounds[-1]] for c in cols], bounds)) if len(cut) else []
            long = np.flatnonzero((np.diff(bounds) > SHORT_LIST) | ((group[bounds[:-1]] > 0) & (np.diff(bounds) > 1)))
            for lo, hi in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
                if (cols[5][lo:hi] != cols[5][lo]).any():
                    for f in of_list([c[lo:hi] for c in cols[2:]]):
                        found.append(f)
                        if sum(len(x[0]) for x in found) > 1_000_000:
                            yield from emit(found)
                            found = []
            yield from emit(found)
            carry = [c[bounds[-1] :] for c in cols]
        if carry is not None and len(carry[0]) > 1 and (carry[5] != carry[5][0]).any():
            for f in of_list(carry[2:]):
                yield from emit([f])

    if classes is None:
        rows = lists.select("token", "pos", "n", "doc", F.col("doc").alias("own"))
    else:
        rows = store.write(lists.select("token", "pos", "n", "doc").join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").select("token", "pos", "n", "doc", F.coalesce("component", "doc").alias("own")), "owned")
    # Long lists: how many blocks each has; none if all its sets are of one class already.
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("own").alias("lo"), F.max("own").alias("hi")).where(F.col("rows") > list_rows)
    long = store.write(counted.select("token", F.when(F.col("lo") < F.col("hi"), F.ceil(F.col("rows") / list_rows)).otherwise(F.lit(0)).alias("blocks")), "long")
    dealt = rows.join(long, "token", "left").where("blocks is null or blocks > 0").withColumn("side", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(F.lit(0)))
    to = F.when(F.col("blocks") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: 1 + F.least(F.col("side"), t) * F.col("blocks") + F.greatest(F.col("side"), t))).otherwise(F.array(F.lit(0).cast("long")))
    rows = dealt.select("token", F.explode(to).alias("group"), "pos", "n", "doc", "own", "side")
    return rows.repartition("token", "group").sortWithinPartitions("token", "group").mapInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, every_link: bool = True, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, rep, component_id) and confirmed links between representatives (a, b, inter, n_a, n_b).

    The links are all pairs of different sets that link, the square of a group in
    number. Without ``every_link``, for those who need the members only, they join
    every such pair into one component, and pairs that others already join are not
    all listed; members are the same.
    """
    store.small_batches(docs.sparkSession)
    seed = random.SystemRandom().getrandbits(62)  # results do not depend on it
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = store.write(signatures(docs, k, seed), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = store.write(some.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    shingles = signed.agg(F.sum("n_shingles")).first()[0] or 0
    lists = index_lists(docs, classes.select("rep").distinct(), shingles, k, num, den, seed, list_rows)

    n1, n2, p1, p2 = (F.col(c).cast("long") for c in ("n", "lead_n", "pos", "lead_pos"))
    near = (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (F.least(n1 - p1, n2 - p2) * (num + den) >= num * (n1 + n2))
    met = ["pos", "n", "doc", "lead_pos", "lead_n", "lead"]
    stars = store.write(lists.select(*met).union(leaders(lists).select(*met)).where((F.col("doc") != F.col("lead")) & near).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "stars")
    first = store.write(confirm(docs, stars, k, num, den, seed), "links1")
    # Rows that share an id are one node; their sets' representatives meet through it.
    twice = some.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    shared = some.join(twice, "doc_id", "left_semi").join(classes, ["n_shingles", "s1", "s2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    left = store.write(cross_pairs(lists, None if every_link else components(first), num, den, list_rows).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    store.drop(lists)
    # Two lists may have led by either set of a pair.
    swap = F.col("a") > F.col("b")
    either = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("inter", "inter"), ("n_a", "n_b"), ("n_b", "n_a"))]
    links = store.write(first.union(confirm(docs, left, k, num, den, seed)).select(*either).distinct(), "links")
    for t in (stars, first, left):
        store.drop(t)
    reached = components(links.select("a", "b").union(shared))
    members = (
        signed.join(classes, ["n_shingles", "s1", "s2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", "rep", F.coalesce("component", "rep").alias("component_id"))
    )
    return members, links
