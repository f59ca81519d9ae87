"""Best-fit packing of token sequences by linear grouping.

Everything is decided on the histogram of lengths, which has at most ``capacity``
rows whatever the number of documents:

1. Large lengths, longest first, are cut into groups of equal cardinality; each group
   counts as long as its longest member.  Large is what is over a half, a third or a
   quarter of the capacity, whichever gives the fewest sequences; over a half, a sequence
   has one large piece and there is only one kind of configuration.
2. The few-size problem is solved by column generation: a linear program over
   configurations (how many of each group share a sequence), new ones from a knapsack.
   Whole parts of the solution are kept.
3. Actual documents take the groups' places, so sequences get their true room back.
4. What is left, large or small, goes longest first to the tightest room that fits.

Sequences of one kind are kept as runs, so the plan is a short table "pieces number
a to b of this length go to sequences from s on, at this offset".  Its size depends
on the capacity and the number of groups, not on the documents.  Pieces are numbered
within their length on the cluster, in salted parts, so a length that a third of all
pieces share is numbered by many tasks.

Defined results: a null or empty text is its end id; repeated rows are packed each
for itself; an empty table gives no row; columns besides the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.llm.common import kept, runs
from gridsquall.llm.tokens import worker_encoder

#: Lengths over such a part of the capacity count as large.
PARTS = (2, 3, 4)


def best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts of each size that fit into ``capacity`` with the largest total value."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for c in range(smallest, capacity + 1):
        ok = sizes <= c
        v = np.where(ok, value + best[c - np.where(ok, sizes, 0)], -1.0)
        k = int(v.argmax())
        if v[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c >= smallest:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often to use each: the whole parts of the linear optimum."""
    g = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(g))
        worth, column = best_configuration(price, sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-9).astype(np.int64)
    left, out = demand.astype(np.int64).copy(), []
    for k in range(g):
        a = basis[:, k].astype(np.int64)
        m = min([int(x[k]), *(int(left[i] // a[i]) for i in np.flatnonzero(a))])
        if m > 0:
            left -= a * m
            out.append((a, m))
    return out


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = 40, parts: tuple[int, ...] = PARTS) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces, first sequence, offset) and the number of sequences.

    Rounding up costs each sequence a little room, which only short enough pieces can use;
    so the fewer lengths count as large, the more is left to fill up with, and the less
    there is to optimise.  Plans for lengths over each part of the capacity are compared.
    """
    return min((grouped_plan(histogram, capacity, groups, capacity // p + 1) for p in parts), key=lambda p: p[1])


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large_from: int) -> tuple[np.ndarray, int]:
    """The plan with so many groups of the lengths from ``large_from`` on."""
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    if n := histogram.get(capacity):
        rows.append((capacity, 0, n, 0, 0))
        bins = n
    large = [n for n in sorted(histogram, reverse=True) if capacity > n >= large_from]
    total = sum(histogram[n] for n in large)
    if total:
        edge = np.unique(np.linspace(0, total, min(groups, total) + 1).astype(np.int64))
        before = np.concatenate(([0], np.cumsum([histogram[n] for n in large])))
        at = lambda p: int(np.searchsorted(before, p, "right")) - 1
        sizes = np.array([large[at(p)] for p in edge[:-1]])
        next_free = edge[:-1].copy()
        for counts, m in configurations(sizes, np.diff(edge), capacity):
            slots = []  # first position, in the order of lengths, of each place
            for i in np.flatnonzero(counts):
                for _ in range(int(counts[i])):
                    slots.append(int(next_free[i]))
                    next_free[i] += m
            done = 0
            while done < m:  # as long as no slot comes to another length
                step = min([m - done, *(int(before[at(s + done) + 1]) - s - done for s in slots)])
                offset = 0
                for s in slots:
                    k = at(s + done)
                    rows.append((large[k], s + done - int(before[k]), step, bins + done, offset))
                    offset += large[k]
                room[capacity - offset].append((bins + done, step))
                done += step
            bins += m
        gaps = [(int(a), int(b)) for a, b in zip(next_free, edge[1:], strict=True) if a < b]
    else:
        gaps, before, at = [], None, None
    rest: dict[int, list[tuple[int, int]]] = {}  # by length: (first number, pieces) without a place
    for a, b in gaps:
        while a < b:
            k = at(a)
            z = min(b, int(before[k + 1]))
            rest.setdefault(large[k], []).append((a - int(before[k]), z - a))
            a = z
    for n in histogram:
        if n != capacity and n not in large:
            rest[n] = [(0, histogram[n])]
    some = sum(1 << r for r in range(capacity + 1) if room[r])
    for n in sorted(rest, reverse=True):
        for first, count in rest[n]:
            while count:
                fits = some >> n
                if not fits:
                    each = capacity // n
                    new, each = (count // each, each) if count >= each else (1, count)
                    for j in range(each):
                        rows.append((n, first + j * new, new, bins, j * n))
                    r, seg, k = capacity - each * n, (bins, new), new
                    bins += new
                    first, count = first + each * new, count - each * new
                else:
                    r = n + (fits & -fits).bit_length() - 1
                    s, m = room[r].pop()
                    k = min(m, count)
                    if k < m:
                        room[r].append((s + k, m - k))
                    if not room[r]:
                        some &= ~(1 << r)
                    rows.append((n, first, k, s, capacity - r))
                    first, count, r, seg = first + k, count - k, r - n, (s, k)
                if r:
                    room[r].append(seg)
                    some |= 1 << r
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def place_pieces(pieces: DataFrame, order: list[str], *, length_col: str = "length", capacity: int = 2048, groups: int = 40, salts: int = 64) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of lengths from 1 to ``capacity``.

    ``pieces`` is read three times, so it should be stored.  ``order`` names columns
    that tell rows apart; rows equal in all of them are interchangeable.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy(length_col).count().collect()  # at most ``capacity`` rows
    if bad := [r[0] for r in counts if r[0] is None or not 1 <= r[0] <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    plan, _ = plan_packing({r[0]: r[1] for r in counts}, capacity, groups)
    sent = spark.sparkContext.broadcast(plan)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    bases = salted.groupBy(length_col, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(F.col(length_col).alias("_len"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order))
    ranked = salted.withColumn("_rn", rank).join(bases, (F.col(length_col) == F.col("_len")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rn") - 1).alias("_rank"))
    at_len, at_rank = pieces.columns.index(length_col), len(pieces.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        key = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            n, r = np.asarray(batch.column(at_len)).astype(np.int64), np.asarray(batch.column(at_rank))
            k = np.searchsorted(key, (n << 44) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], pa.array(p[k, 3] + r - p[k, 1]), pa.array(p[k, 4])], names=[*batch.schema.names[:at_rank], "sequence_id", "offset"])

    return ranked.mapInArrow(work, schema)


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids: ``doc_id, piece, start, length, ids_crc32`` and the ids if asked for.

    Only documents of more than ``capacity`` ids are cut; their first piece takes the
    remainder, all others are full.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in runs(batches, 1):
            ids, bounds = encoder.encode(batch.column(1))
            flat = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4")).cast("B")
            bounds = bounds + np.arange(len(bounds))
            total = np.diff(bounds)
            count = -(-total // capacity)
            take = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(take)) - np.repeat(np.cumsum(count) - count, count)
            first = np.where(count > 1, (total - 1) % capacity + 1, total)[take]
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first)
            at = 4 * (bounds[:-1][take] + start)
            own = [flat[a:z] for a, z in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(take)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = kept(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return place_pieces(pieces, [id_col, "piece", "start", "ids_crc32"], capacity=capacity)
