"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut). Full pieces are sequences of
their own. The rest is dealt by hash into partitions of about ``per_task`` pieces, each of which packs its pieces best-fit
(longest first). Nearly full bins are final. Of the underfull ones a partition passes on as items those that can still
take part: a best-fit result has at most one bin no more than half full, and two bins over half full never fit together,
so each task passes on its light bins and the emptiest ``fan_in`` others. Rounds over ever fewer tasks pack these items
best-fit until one task is left; what a task receives is bounded by ``fan_in * (fan_in + 1)`` items.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.llm import common, tokens

PIECE = "doc_id {kind}, item long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin of each item, its offset there, and the fill of each bin."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0  # bit r is set if a bin with residual r is open
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        size = sizes[i]
        fit = open_bits >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = by_residual[r].pop()
            if not by_residual[r]:
                open_bits ^= 1 << r
        else:
            b, r = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        by_residual[r - size].append(b)
        open_bits |= 1 << (r - size)
    return bins, offsets, fills


def passed_on(fills: list[int], capacity: int, slack: int, fan_in: int) -> set[int]:
    """The bins that can still take part in a later round: light ones, and the emptiest of the others."""
    light = {b for b, f in enumerate(fills) if 2 * f <= capacity}
    hosts = sorted((b for b, f in enumerate(fills) if 2 * f > capacity and capacity - f > slack), key=lambda b: (fills[b], b))
    return light | set(hosts[:fan_in])


def pieces(docs: DataFrame, path: str, end_id: int | None, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document; a document's ids end with ``end_id``. ``item`` numbers the rows apart."""
    kind = docs.select(id_col).dtypes[0][1]
    common.ship(docs.sparkSession)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, item = tokens.load(path), TaskContext.get().partitionId() << 40
        for b in common.slices(batches, 1):
            rows, take = [], []
            for k, ids in enumerate(ids_of.encode(b.column(1).to_pylist())):
                ids += tail
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((item, p, at // 4, len(part) // 4, zlib.crc32(part)))
                    take.append(k)
                    item += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "item", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, PIECE.format(kind=kind))


def _round(items: DataFrame, tasks: int, capacity: int, slack: int, fan_in: int, level: int, last: bool) -> DataFrame:
    """Pack ``item, size`` best-fit in each of ``tasks`` partitions: ``item, bin, offset, fill, on`` (on: passed on)."""
    most = None if level else 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, sizes = 0, [], []
        base = (level + 1) << 56 | TaskContext.get().partitionId() << 28

        def out() -> pa.RecordBatch:
            nonlocal made, ids, sizes
            order = sorted(range(len(ids)), key=ids.__getitem__)  # the same bins whatever order the rows came in
            ids, sizes = [ids[i] for i in order], [sizes[i] for i in order]
            bins, offsets, fills = best_fit(sizes, capacity)
            on = set() if last else passed_on(fills, capacity, slack, fan_in)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([base + made + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([fills[b] for b in bins], pa.int64()), pa.array([b in on for b in bins], pa.bool_())],
                names=["item", "bin", "offset", "fill", "on"],
            )
            made, ids, sizes = made + len(fills), [], []
            return batch

        for b in batches:
            ids += b.column(0).to_pylist()
            sizes += b.column(1).to_pylist()
            if most and len(ids) >= most:  # bounds a task's memory if rows come in greater numbers than planned
                yield out()
        if ids:
            yield out()

    dealt = items.repartition(tasks, F.xxhash64("item")) if tasks > 1 else items.coalesce(1)
    if not level:
        dealt = dealt.sortWithinPartitions("item")  # so that windows of a task hold the same rows in a rerun
    return dealt.mapInArrow(run, "item long, bin long, offset long, fill long, on boolean")


def pack(docs: DataFrame, path: str, end_id: int | None = 0, capacity: int = 2048, per_task: int = 65536, fan_in: int = 8, slack: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequence_fill``.

    A null text counts as the empty text, which is the end id alone (without an end id an empty text has no piece). Null
    and repeated ids are packed like any other; extra columns are ignored; an empty table gives an empty result. Equal
    lengths are placed in the order of rows read. Offsets in a sequence run gapless from 0.
    """
    spark = docs.sparkSession
    all_pieces = common.materialise(pieces(docs, path, end_id, capacity, id_col, text_col), "pieces")
    full = all_pieces.filter(F.col("length") == capacity).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_fill"))
    rest = all_pieces.filter(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // per_task))
    level, placed, used = 0, None, [all_pieces]
    items = rest.select("item", F.col("length").alias("size"))
    while True:
        last = tasks == 1
        done = common.materialise(_round(items, tasks, capacity, slack, fan_in, level, last), f"bins{level}")
        used.append(done)
        # A place is (bin, offset) at this level; parents of earlier bins shift what lies in them.
        step = done.select("item", "bin", "offset", "fill")
        if placed is None:
            placed = step
        else:
            up = step.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("offset").alias("by"), F.col("fill").alias("up_fill"))
            placed = placed.join(up, "bin", "left").select("item", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"), F.coalesce("up_fill", "fill").alias("fill"))
        if last:
            break
        items = done.filter("on").groupBy("bin").agg(F.first("fill").alias("size")).select(F.col("bin").alias("item"), "size")
        tasks, level = -(-tasks // fan_in), level + 1
    packed = rest.join(placed, "item").select(*rest.columns, F.col("bin").alias("sequence_id"), "offset", F.col("fill").alias("sequence_fill"))
    out = full.unionByName(packed).drop("item")
    return common.result(out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out, "packed", *used)
