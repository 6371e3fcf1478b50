"""Line dedup with two Bloom filters.

1. Every task puts the hashes of its lines into two filters, one for lines seen
   once and one for lines seen again. Filters merge without their lines: a bit is
   in the merged second filter if it is in either second filter or in both first
   ones. Merging is spread over blocks of the filters and streams.
2. A second scan holds the merged second filter (a fixed size, whatever the
   corpus) and lets only suspected repeats through. These alone shuffle, by their
   whole text, to count documents exactly and to choose the one that keeps them.
3. Lines to drop reach the documents as a broadcast table if it is measured to
   fit ``broadcast_bytes``, else by a join on the document id.

Filters have 16 bits, or a little more, for each line of the corpus, counted first,
between ``MIN_BITS`` and ``MAX_BITS`` (512 MiB a filter); ``filter_bits`` sets them by
hand. One too small for its corpus lets more lines through to the exact stage; it
never changes a result.

Edge cases: a null or empty text is one empty line; rows that share an id are one
document, and all keep what that id keeps; null ids are documents of their own each,
and keep a line only where no other id holds it; a text that loses every line
becomes empty; an empty table gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

MIN_BITS, MAX_BITS = 1 << 23, 1 << 31
PROBES = 2
BLOCK_BYTES = 1 << 16
BROADCAST_BYTES = 32 << 20


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a hash: a block by its upper half, then places in the whole filter."""
    return [(text.mix(h ^ np.uint64(0x5851F42D4C957F2D * (p + 1) & (1 << 64) - 1)) & np.uint64(bits - 1)).astype(np.int64) for p in range(PROBES)]


def _seen(filt: np.ndarray, probes: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(probes[0]), bool)
    for p in probes:
        out &= (filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0
    return out


def _put(filt: np.ndarray, probes: list[np.ndarray]) -> None:
    for p in probes:
        np.bitwise_or.at(filt, p >> 3, (1 << (p & 7)).astype(np.uint8))


def _distinct(x: text.Lines, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines long enough, each once a row: their numbers and rows."""
    k = np.flatnonzero(x.points >= min_chars)
    row = np.searchsorted(x.first, k, "right") - 1
    order = np.lexsort((x.hash[k], row))
    k, row = k[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (row[1:] != row[:-1]) | (x.hash[k[1:]] != x.hash[k[:-1]])
    return k[new], row[new]


def filter_size(docs: DataFrame) -> int:
    """Bits for a filter of all lines: a power of 2, 16 or more a line between the bounds."""
    broken = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = docs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(broken), F.lit(0))).first()[0]
    return min(max(1 << (16 * n).bit_length(), MIN_BITS), MAX_BITS)


def repeat_filter(docs: DataFrame, min_chars: int, filter_bits: int, seed: int = 0) -> bytes:
    """The merged filter of lines that at least two documents seem to hold."""

    def fill(batches):
        import zstandard

        once, twice = np.zeros(filter_bits >> 3, np.uint8), np.zeros(filter_bits >> 3, np.uint8)
        for b in batches:
            for x in text.lines(b.column(0), seed=seed):
                h, n = np.unique(x.hash[_distinct(x, min_chars)[0]], return_counts=True)
                probes = _probes(h, filter_bits)
                again = _seen(once, probes) | (n > 1)
                _put(twice, [p[again] for p in probes])
                _put(once, probes)
        z = zstandard.ZstdCompressor(level=1)
        step = min(BLOCK_BYTES, filter_bits >> 3)
        used = np.flatnonzero(once.reshape(-1, step).any(axis=1))
        for at in range(0, len(used), 64):
            ks = used[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), *(pa.array([z.compress(f[k * step : (k + 1) * step].tobytes()) for k in ks], pa.binary()) for f in (once, twice))], ["block", "once", "twice"])

    def merge(batches):
        import zstandard

        z, kept = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, t = (np.frombuffer(z.decompress(v), np.uint8) for v in (o, t))
                if k in kept:
                    o0, t0 = kept[k]
                    kept[k] = o0 | o, t0 | t | (o0 & o)
                else:
                    kept[k] = o, t
        z = zstandard.ZstdCompressor(level=1)
        for k, (_, t) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(t.tobytes())], pa.binary())], ["block", "twice"])

    import zstandard

    z, step = zstandard.ZstdDecompressor(), min(BLOCK_BYTES, filter_bits >> 3)
    out = np.zeros(filter_bits >> 3, np.uint8)
    merged = docs.select("text").mapInArrow(fill, "block int, once binary, twice binary").repartition("block").mapInArrow(merge, "block int, twice binary")
    for k, t in merged.collect():  # at most the filter's own fixed size
        out[k * step : (k + 1) * step] = np.frombuffer(z.decompress(bytes(t)), np.uint8)
    return out.tobytes()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: str = "largest", filter_bits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (what is left), n_lines (before), n_dropped, for every document.

    A line's key is the line without white space at both ends and with A-Z as a-z.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose all their lines except in the ``keep`` ("largest" or "smallest") id.
    """
    if filter_bits is not None and (filter_bits & (filter_bits - 1) or filter_bits < 64):
        raise ValueError("filter_bits is a power of 2")
    if min_docs < 2:
        raise ValueError("min_docs is at least 2")
    spark = docs.sparkSession
    store.small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    seed = random.SystemRandom().getrandbits(62)  # results do not depend on it
    filter_bits = filter_size(docs) if filter_bits is None else filter_bits
    seen = spark.sparkContext.broadcast(repeat_filter(docs, min_chars, filter_bits, seed))

    def suspects(batches):
        filt = np.frombuffer(seen.value, np.uint8)
        for b in batches:
            for x in text.lines(b.column(1), seed=seed):
                k = np.flatnonzero(x.points >= min_chars)
                k = k[_seen(filt, _probes(x.hash[k], filter_bits))]
                row = np.searchsorted(x.first, k, "right") - 1
                raw = x.data.tobytes()
                # Once a row, by the keys themselves.
                found = list(dict.fromkeys(zip(row.tolist(), (raw[s:e].lower() for s, e in zip(x.start[k].tolist(), x.end[k].tolist(), strict=True)), strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r + x.rows.start for r, _ in found], pa.int64())), pa.array([key for _, key in found], pa.binary())], ["doc_id", "key"])

    found = store.write(docs.mapInArrow(suspects, f"doc_id {kind}, key binary"), "suspects")
    choose = F.max if keep == "largest" else F.min
    # Repeated ids meet first; a key's rows are combined before they meet.
    each = found.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    sure = store.write(each.groupBy("key").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("n"), choose("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"), "repeats")
    size = sure.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(k): keeper for k, keeper in sure.collect()})
        return _drop(docs, kind, lambda: known.value, None)
    drops = found.join(sure, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull()).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    drops = drops.withColumnRenamed("doc_id", "to")
    return _drop(docs.join(drops, F.col("doc_id").eqNullSafe(F.col("to")), "left").select("doc_id", "text", "keys"), kind, None, "keys")


def _drop(docs: DataFrame, kind: str, known, keys: str | None) -> DataFrame:
    """Without the lines to drop: from a table of keys and keepers, or from each row's own keys."""

    def apply(batches):
        table = known() if known else {}
        hashes = np.sort(np.concatenate([x.hash for x in text.lines(pa.array([k.decode() for k in table]))])) if table else None
        for b in batches:
            ids = b.column(0)
            for x in text.lines(b.column(1)):
                n = np.diff(x.first)
                if known:
                    p = np.searchsorted(hashes, x.hash) if table else None
                    hit = np.flatnonzero(hashes[np.minimum(p, len(hashes) - 1)] == x.hash) if table else np.zeros(0, np.int64)
                    rows = set((np.searchsorted(x.first, hit, "right") - 1).tolist())
                else:
                    own = b.column(2).slice(x.rows.start, len(x.rows))
                    rows = set(np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist())
                raw = x.data.tobytes()
                texts, dropped = [], np.zeros(len(n), np.int64)
                for r in range(len(n)):
                    lo, hi = x.first[r], x.first[r + 1]
                    if r not in rows:
                        texts.append(raw[x.lo[lo] : x.hi[hi - 1]])
                        continue
                    doc = ids[x.rows.start + r].as_py()
                    mine = None if known else set(own[r].as_py())
                    left = []
                    for i in range(lo, hi):
                        key = raw[x.start[i] : x.end[i]].lower()
                        gone = (key in table and table[key] is not None and table[key] != doc) if known else key in mine
                        if not gone:
                            left.append(raw[x.lo[i] : x.hi[i]])
                    texts.append(b"\n".join(left))
                    dropped[r] = hi - lo - len(left)
                yield pa.RecordBatch.from_arrays([ids.slice(x.rows.start, len(x.rows)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped)], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.mapInArrow(apply, f"doc_id {kind}, text string, n_lines long, n_dropped long")
