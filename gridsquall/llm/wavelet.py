"""Token ids of a corpus in compressed wavelet-matrix shards.

A shard is one self-contained byte string: a header, the documents' ids and token
offsets, and one bit-plane for each bit of an id.  A plane is cut into blocks of
``BLOCK`` bits, each compressed for itself, with the number of ones before each.
``access``, ``rank``, ``select`` and ``count`` unpack one block a plane and step, and
need no other data.  Shards are rows of a Parquet table, written by Spark's committer, so
a lost executor's shards are written again and half-written ones are never read.

Layout, little-endian: ``b"WVM2"``, u32 planes, u64 tokens, u64 documents, u32 size of
the compressed list of documents; that list (i64 ids, u8 null flags, u64 offsets, one
more than documents); then for each plane, highest bit first: u64 zeros, u32 blocks,
u32 ones before each block, u32 end of each block among the blocks' bytes, those bytes.
A block as long as ``BLOCK / 8`` is stored plain, others are Zstandard frames.

Defined results: a null or empty text has only the end id; documents come in
ascending id order with null ids first; ids are read as 64-bit integers, and one that
cannot be read so ends the query under ANSI rules; repeated rows are kept, each with its
own tokens; an empty table has no shards; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.llm.common import runs, shared_path
from gridsquall.llm.tokens import worker_encoder

MAGIC, BLOCK = b"WVM2", 1 << 15


def packed(data: bytes) -> bytes:
    """``data`` compressed, or as it is where that is no shorter."""
    out = pa.compress(data, codec="zstd", asbytes=True)
    return out if len(out) < len(data) else data


def pack_shard(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The shard of documents ``ids`` whose tokens follow each other in ``tokens``."""
    n = len(tokens)
    bits = max(1, int(tokens.max()).bit_length()) if n else 1
    docs = np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids) + np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()
    docs = pa.compress(docs, codec="zstd", asbytes=True)
    out = [MAGIC, struct.pack("<IQQI", bits, n, len(ids), len(docs)), docs]
    a = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << b)) != 0
        plane = np.packbits(one, bitorder="little")
        plane = np.concatenate((plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)))
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        raw = plane.tobytes()
        blocks = [packed(raw[k : k + BLOCK // 8]) for k in range(0, len(raw), BLOCK // 8)]
        low = a[~one]
        out += [struct.pack("<QI", len(low), len(blocks)), (np.cumsum(ones) - ones).astype("<u4").tobytes(), np.cumsum([len(x) for x in blocks], dtype=np.int64).astype("<u4").tobytes(), *blocks]
        a = np.concatenate((low, a[one]))
    return b"".join(out)


class Plane:
    """One bit-plane; keeps a few unpacked blocks."""

    def __init__(self, data: bytes, at: int):
        self.zeros, k = struct.unpack_from("<QI", data, at)
        self.before = np.frombuffer(data, "<u4", k, at + 12)
        self.ends = np.concatenate(([0], np.frombuffer(data, "<u4", k, at + 12 + 4 * k))).astype(np.int64) + at + 12 + 8 * k
        self.data, self.end, self.open = data, int(self.ends[-1]), {}

    def block(self, k: int) -> np.ndarray:
        if k not in self.open:
            if len(self.open) > 3:
                self.open.clear()
            raw = self.data[int(self.ends[k]) : int(self.ends[k + 1])]
            self.open[k] = np.frombuffer(raw if len(raw) == BLOCK // 8 else pa.decompress(raw, BLOCK // 8, codec="zstd", asbytes=True), np.uint8)
        return self.open[k]

    def ones(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        if not len(self.before):
            return 0
        k = min(i // BLOCK, len(self.before) - 1)
        whole, rest = divmod(i - k * BLOCK, 8)
        own = self.block(k)
        n = int(self.before[k]) + int(np.bitwise_count(own[:whole]).sum(dtype=np.int64))
        return n + (int(own[whole] & ((1 << rest) - 1)).bit_count() if rest else 0)

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK >> 3] >> (i & 7) & 1)

    def find(self, want: int, one: bool) -> int:
        """The position of the bit of that kind which has ``want`` of its kind before it."""
        counts = self.before if one else np.arange(len(self.before), dtype=np.int64) * BLOCK - self.before
        k = int(np.searchsorted(counts, want, "right")) - 1
        bits = np.unpackbits(self.block(k), bitorder="little")
        return k * BLOCK + int(np.flatnonzero(bits == one)[want - int(counts[k])])

    def bits(self, n: int) -> np.ndarray:
        """All ``n`` bits."""
        parts = (self.data[a:z] for a, z in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True))
        raw = b"".join(x if len(x) == BLOCK // 8 else pa.decompress(x, BLOCK // 8, codec="zstd", asbytes=True) for x in parts)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").view(bool)


class Shard:
    """Reads a shard without unpacking all of it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        bits, self.n, docs, size = struct.unpack_from("<IQQI", data, 4)
        at = 28
        raw = pa.decompress(data[at : at + size], 17 * docs + 8, codec="zstd", asbytes=True)
        null = raw[8 * docs : 9 * docs]
        self.ids = [None if z else i for i, z in zip(np.frombuffer(raw, "<i8", docs).tolist(), null, strict=True)]
        self.offsets = np.frombuffer(raw, "<u8", docs + 1, 9 * docs).astype(np.int64)
        at += size
        self.planes: list[tuple[int, Plane]] = []
        for b in range(bits - 1, -1, -1):
            self.planes.append((b, Plane(data, at)))
            at = self.planes[-1][1].end

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for b, p in self.planes:
            ones = p.ones(i)
            if p.bit(i):
                token, i = token | 1 << b, p.zeros + ones
            else:
                i -= ones
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the ``token``s before position ``i`` lie below the last plane."""
        lo = 0
        if token >> len(self.planes):
            return 0, 0
        for b, p in self.planes:
            a, z = p.ones(lo), p.ones(i)
            lo, i = (p.zeros + a, p.zeros + z) if token >> b & 1 else (lo - a, i - z)
        return lo, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` positions."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th occurrence (from 0) of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for b, p in reversed(self.planes):
            one = bool(token >> b & 1)
            i = p.find(i - p.zeros if one else i, one)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the lowest."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, p in reversed(self.planes):
            one = p.bits(self.n)
            up = np.empty_like(a)
            up[~one] = a[: p.zeros]
            up[one] = a[p.zeros :] | a.dtype.type(1 << b)
            a = up
        return a.astype("<u4")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20) -> None:
    """Encodes every text and writes the shards, in ascending id order, to ``path``.

    A shard is closed at the first document that brings it to ``shard_tokens``.
    Columns: ``part`` and ``seq`` (order of shards), ``n_docs``, ``n_tokens``, ``payload``.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer)
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        own: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            blob = pack_shard(ids, np.concatenate(lengths), np.concatenate(own))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in runs(batches, 1):
            flat, bounds = encoder.encode(batch.column(1))
            if end_id is not None:
                flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))
            names = batch.column(0).to_pylist()
            a = 0
            while a < len(names):
                z = min(len(names), int(np.searchsorted(bounds[a + 1 :], bounds[a] + shard_tokens - size)) + a + 1)
                ids += names[a:z]
                lengths.append(np.diff(bounds[a : z + 1]))
                own.append(flat[bounds[a] : bounds[z]])
                size += int(bounds[z] - bounds[a])
                if size >= shard_tokens:
                    yield closed()
                    ids, lengths, own, size, seq = [], [], [], 0, seq + 1
                a = z
        if ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t")]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, "part int, seq int, n_docs long, n_tokens long, payload binary").write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(path))


def read_token_shards(shards: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Per document, from the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and the ``ids``.

    ``start`` adds up two levels of counts, so no task sees more than one row for
    each part, or one for each shard of a part.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("base")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("part_base")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(2)[k].as_buffer().to_pybytes())
                raw, o = memoryview(shard.tokens()).cast("B"), shard.offsets
                docs = [raw[4 * a : 4 * z] for a, z in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                m = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[k], m), pa.repeat(batch.column(1)[k], m), pa.array(shard.ids, pa.int64()), pa.array(o[:-1], pa.int64()), pa.array(np.diff(o), pa.int64()), pa.array([zlib.crc32(x) for x in docs], pa.int64())] + ([pa.array(docs, pa.binary())] if with_ids else []),
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids,
                )

    read = shards.select("part", "seq", "payload").mapInArrow(work, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = read.join(bases, ["part", "seq"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def token_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the shards of ``docs`` to a new path in the shared folder and returns their table."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_shards(docs, path, tokenizer, **options)
    return docs.sparkSession.read.schema("part int, seq int, n_docs long, n_tokens long, payload binary").parquet(path)
