"""Token-ID / binary output by bit-plane shuffling.

``write_tokens`` encodes every whole text, packs whole documents in ascending id
order into chunks, cuts a chunk's ids into fixed-size blocks, transposes each
block into byte or bit planes, compresses each plane of a chunk with zstandard
and stores a chunk index. ``read_tokens`` decodes them again.

Chunk bytes: magic ``LPL1``, one byte of plane width (8 or 1), uint32 block size,
uint32 documents, uint64 ids, then a uint32 length and
a zstandard frame each for document ids (int64), null marks (uint8), id counts
(uint64) and every plane (32 / width of them); a plane of zeros has length 0.
Chunks are rows of a Parquet table (shard, chunk, offset, n_docs, n_ids, data),
so Spark's committer makes them safe against lost and repeated tasks, and any
file system that Spark writes to can hold them. Its small columns are the index.

Edge cases: a null or empty text is a document of the end id alone; a null
document id sorts first and stays null; repeated ids keep all their rows, in an
order that their token ids give, and have several shards if they fill more than one;
an empty table gives an empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

MAGIC = b"LPL1"
BLOCK = 1 << 12
CHUNK_IDS = 1 << 18
MAX_VOCABULARY_BYTES = 64 << 20
SLOTS = 1 << 20


def encode_planes(ids: np.ndarray, width: int = 8, block: int = BLOCK) -> list[bytes]:
    """Raw planes of uint32 ids. Plane p of a block holds bits ``p*width`` to ``(p+1)*width-1`` of its ids, in order."""
    full = np.zeros(-(-len(ids) // block) * block, "<u4")
    full[: len(ids)] = ids
    if width == 8:
        return [p.tobytes() for p in full.view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def decode_planes(planes: list[bytes | None], n: int, width: int = 8, block: int = BLOCK) -> np.ndarray:
    size = -(-n // block) * block
    if width == 8:
        out = np.zeros((size, 4), np.uint8)
        for p, b in enumerate(planes):
            if b:
                out[:, p] = np.frombuffer(b, np.uint8)
    else:
        bits = np.zeros((32, size), np.uint8)
        for p, b in enumerate(planes):
            if b:
                bits[p] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        out = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(out).reshape(-1).view("<u4")[:n]


def pack(doc_ids: list, counts: list[int], ids: np.ndarray, width: int, block: int, level: int) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    sections = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(counts, "<u8").tobytes()]
    packed = [z.compress(s) for s in sections]
    packed += [z.compress(p) if p.strip(b"\0") else b"" for p in encode_planes(ids, width, block)]
    head = MAGIC + bytes([width]) + np.array([block, len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return head + b"".join(np.array([len(s)], "<u4").tobytes() + s for s in packed)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null marks, id counts and ids of one chunk."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a token chunk")
    width = data[4]
    block, _ = np.frombuffer(data, "<u4", 2, 5)
    n = int(np.frombuffer(data, "<u8", 1, 13)[0])
    z, at, found = zstandard.ZstdDecompressor(), 21, []
    while at < len(data):
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        found.append(z.decompress(data[at + 4 : at + 4 + size]) if size else None)
        at += 4 + size
    ids, null, counts = found[:3]
    return np.frombuffer(ids, "<i8"), np.frombuffer(null, np.uint8), np.frombuffer(counts, "<u8").astype(np.int64), decode_planes(found[3:], n, width, int(block))


# Character classes of the byte-level pre-tokeniser, for ASCII and two-byte Latin letters.
_SPACE, _BLANK, _LETTER, _DIGIT, _SIGN = range(5)


class Encoder:
    """The ids that the tokenizer gives a text, with a bounded table of pieces already seen.

    Pieces are what the byte-level pre-tokeniser cuts: a run of letters, digits or
    signs with at most one space before it. It never cuts within a piece by what
    surrounds it, so a piece has the same ids everywhere. Pieces are found and
    looked up as 64-bit hashes for a whole batch at once; new ones are encoded by
    the library. Texts with anything outside the classes above (other scripts,
    apostrophes, runs of white space, special tokens) are encoded whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        spec = json.loads(model)
        pre = spec.get("pre_tokenizer") or {}
        self.fast = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        newline = self._whole(["\n"])[0]
        self.fast = self.fast and len(newline) == 1
        self.newline = newline[0] if len(newline) else 0
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.key = np.zeros((2, SLOTS), np.uint64)
        self.at = np.zeros((2, SLOTS), np.int32)
        self.n = np.zeros((2, SLOTS), np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        kind = np.full(256, _SIGN, np.uint8)
        kind[[9, 10, 11, 12, 13]] = _BLANK
        kind[32] = _SPACE
        kind[48:58] = _DIGIT
        kind[65:91] = kind[97:123] = kind[128:] = _LETTER
        self.kind = kind

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, col: pa.Array, chunk: int = text.CHUNK):
        """Arrays of ids, one for each row."""
        off, data = text.buffers(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + chunk, "right")) - 1)
            yield from self._part(data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to

    def _plain(self, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which rows have only the classes that are cut here."""
        bad = (b < 9) | ((b > 13) & (b < 32)) | (b == 39) | (b == 127)
        wide = np.flatnonzero(b >= 128)
        if len(wide):
            lead = wide[(b[wide] & 0xC0) == 0xC0]
            after = b[np.minimum(lead + 1, len(b) - 1)]
            ok = ((b[lead] == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((b[lead] >= 0xC4) & (b[lead] <= 0xC8)) | ((b[lead] == 0xC9) & (after < 0x90))
            bad[lead[~ok]] = True
        k = self.kind[b]
        white = k <= _BLANK
        bad[1:] |= white[1:] & white[:-1]
        out = np.add.reduceat(np.concatenate([bad, [False]]).astype(np.int64), np.minimum(ends[:-1], len(b))) == 0
        out[ends[1:] == ends[:-1]] = True
        for s in self.special:
            raw, p = b.tobytes(), 0
            while (p := raw.find(s, p)) >= 0:
                out[np.searchsorted(ends, p, "right") - 1] = False
                p += 1
        return out

    def _part(self, b: np.ndarray, ends: np.ndarray):
        rows = len(ends) - 1
        plain = self._plain(b, ends) if self.fast else np.zeros(rows, bool)
        odd = np.flatnonzero(~plain)
        whole = dict(zip(odd.tolist(), self._whole([b[ends[i] : ends[i + 1]].tobytes().decode() for i in odd]), strict=True)) if len(odd) else {}
        if len(b) and plain.any():
            # A piece starts where the class changes, and a space joins what follows it.
            k = self.kind[b]
            start = np.ones(len(b), bool)
            start[1:] = (k[1:] != k[:-1]) & (k[:-1] != _SPACE)
            start[1:] |= (k[1:] == _BLANK) | (k[:-1] == _BLANK)
            start[ends[:-1][ends[:-1] < len(b)]] = True
            s = np.flatnonzero(start)
            e = np.append(s[1:], len(b))
            h = text.Bytes(b).hashes(s, e) | np.uint64(1)
            first = np.searchsorted(s, ends)
            keep = np.repeat(plain, np.diff(first))
            yield from self._assembled(b, s, e, h, first, keep, whole)
        else:
            for i in range(rows):
                yield np.array(whole.get(i, ()), np.uint32)

    def _find(self, h: np.ndarray):
        mask = np.uint64(SLOTS - 1)
        i, j = (h >> np.uint64(1)) & mask, (h >> np.uint64(33)) & mask
        hit0, hit1 = self.key[0][i] == h, self.key[1][j] == h
        return i, j, hit0, hit1, np.where(hit0, self.at[0][i], self.at[1][j]), np.where(hit0, self.n[0][i], self.n[1][j])

    def _assembled(self, b, s, e, h, first, keep, whole):
        i, j, hit0, hit1, at, n = self._find(h)
        miss = np.flatnonzero(keep & ~hit0 & ~hit1)
        if len(miss):
            u, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            src = miss[where]
            raw = [b[s[x] : e[x]].tobytes() for x in src]
            blank = np.array([r.isspace() for r in raw])
            got: list = [None] * len(raw)
            solid = np.flatnonzero(~blank)
            if len(solid):
                # One text of all new pieces, a line each: a lone newline is always its own piece.
                ids = np.array(self._whole([b"\n".join([raw[x] for x in solid]).decode()])[0], np.uint32)
                cut = np.flatnonzero(ids == self.newline)
                for x, p in zip(solid, np.split(ids, cut), strict=True):
                    got[x] = p[1:] if len(p) and p[0] == self.newline and x != solid[0] else p
            for x in np.flatnonzero(blank):
                got[x] = np.array(self._whole([raw[x].decode()])[0], np.uint32)
            size = np.array([len(g) for g in got])
            flat = np.concatenate(got).astype(np.uint32)
            where_at = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
            self._room(self.used + len(flat))
            self.pool[self.used : self.used + len(flat)] = flat
            at[miss], n[miss] = where_at[back], size[back]
        n = np.where(keep, n, 0)
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        out = self.pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        if len(miss):
            self._keep(u, i[src], j[src], got, size)
        cut = total[first]
        for r in range(len(first) - 1):
            yield np.array(whole[r], np.uint32) if r in whole else out[cut[r] : cut[r + 1]]


    def _room(self, n: int) -> None:
        if n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), n - len(self.pool)), np.uint32)])

    def _keep(self, u, i, j, got, size) -> None:
        """Put new pieces in the first free of their two slots; one that finds none is encoded anew next time."""
        for t, slot in ((0, i), (1, j)):
            free = np.flatnonzero(self.key[t][slot] == 0)
            if t:
                free = free[self.key[0][i[free]] != u[free]]
            self.key[t][slot[free]] = u[free]
            won = free[self.key[t][slot[free]] == u[free]]
            if len(won):
                base = self.used
                self.used += int(size[won].sum())
                self._room(self.used)
                self.pool[base : self.used] = np.concatenate([got[x] for x in won])
                self.at[t][slot[won]], self.n[t][slot[won]] = base + np.concatenate([[0], np.cumsum(size[won])[:-1]]), size[won]


def encoder(model: str) -> Encoder:
    """The process's encoder for a model, kept from task to task."""
    kept = text.kept()
    if kept.get("encoder", (None,))[0] != model:
        kept["encoder"] = (model, Encoder(model))
    return kept["encoder"][1]


def _read_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        model = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(model) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes, too large to send to every executor")
    return model


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, width: int = 8, block: int = BLOCK, chunk_ids: int = CHUNK_IDS, level: int = 3) -> None:
    """Encode all documents into chunks at ``path``. ``width`` 8 makes byte planes, 1 bit planes.

    Texts are encoded where they are read; only ids shuffle, to shards of ascending
    document ids whose bounds come from a quantile sketch of the id column alone.
    ``tokenizer``: a file of the tokenizers library, sent to executors by value.
    """
    if width not in (1, 8):
        raise ValueError("width is 1 or 8")
    spark = docs.sparkSession
    store.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = docs.agg(F.percentile_approx(first, [k / shards for k in range(1, shards)] or [0.5], 100 * shards)).first()[0] or []
    cuts = np.sort(np.array(bounds if shards > 1 else [], np.int64))
    model = spark.sparkContext.broadcast(_read_model(tokenizer))
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def encode(batches):
        import zlib

        enc = encoder(model.value)
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            shard, least = np.searchsorted(cuts, known, "right"), np.searchsorted(cuts, known, "left")
            hot = np.flatnonzero(shard - least > 1)  # an id that is several bounds has the shards between them
            step = 500
            for lo in range(0, batch.num_rows, step):
                part = batch.column(1).slice(lo, step)
                rows = [np.concatenate([x, tail]).astype("<u4").tobytes() for x in enc.batch(part)]
                for k in hot[(hot >= lo) & (hot < lo + step)].tolist():
                    shard[k] = least[k] + 1 + (zlib.crc32(rows[k - lo]) * int(shard[k] - least[k]) >> 32)
                packed = [np.frombuffer(r, "<u4") for r in rows]
                small = all(not len(p) or p.max() < 65536 for p in packed)
                out = [p.astype("<u2").tobytes() for p in packed] if small else rows
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo : lo + step].astype(np.int32)), ids.slice(lo, step), pa.array([2 if small else 4] * len(out), pa.int32()), pa.array(out, pa.binary())], ["shard", "doc_id", "bytes_each", "ids"])

    def chunks(batches):
        key, number, offset = None, 0, 0
        docs_in: list = []
        counts: list[int] = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal number, offset, docs_in, counts, parts
            ids = np.concatenate(parts)
            row = pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([number], pa.int32()), pa.array([offset], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(docs_in, counts, ids, width, block, level)], pa.binary())], ["shard", "chunk", "offset", "n_docs", "n_ids", "data"])
            number, offset, docs_in, counts, parts = number + 1, offset + len(ids), [], [], []
            return row

        for batch in batches:
            for shard, doc, each, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != shard:
                    if counts:
                        yield flush()
                    key, number, offset = shard, 0, 0
                x = np.frombuffer(ids, "<u2" if each == 2 else "<u4").astype(np.uint32)
                docs_in.append(doc)
                counts.append(len(x))
                parts.append(x)
                if sum(counts[-1:]) >= chunk_ids or len(counts) % 64 == 0 and sum(counts) >= chunk_ids:
                    yield flush()
        if counts:
            yield flush()

    (
        docs.mapInArrow(encode, "shard int, doc_id long, bytes_each int, ids binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "bytes_each", "ids")
        .mapInArrow(chunks, "shard int, chunk int, offset long, n_docs long, n_ids long, data binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array of int).

    Every chunk decodes by itself. Only one number a shard (its ids) is gathered on
    the driver; shards are as many as the shuffle partitions at writing.
    """
    table = spark.read.parquet(path)
    total = {r[0]: r[1] for r in table.groupBy("shard").agg(F.sum("n_ids")).collect()}
    base, at = {}, 0
    for s in sorted(total):
        base[s], at = at, at + total[s]

    def decode(batches):
        import zlib

        for batch in batches:
            for shard, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, null, counts, ids = unpack(data)
                cut = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [pa.array(docs, mask=null.astype(bool)), pa.array(base[shard] + offset + cut[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return table.select("shard", "offset", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write, then read back: what ``read_tokens`` says of files in a fresh shared folder."""
    path = store.new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, **options)
    return read_tokens(docs.sparkSession, path)
