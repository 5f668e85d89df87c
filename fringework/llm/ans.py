"""Token ids in a binary format: static range asymmetric numeral system (rANS).

One frequency table, from counts over all ids, is shared by all blocks. Ids are written in ascending order of document
id as chunks of whole documents; a chunk is a row of a Parquet folder and its payload a run of independent blocks. A
block's ids are dealt to ``LANES`` interleaved coder states. Every ``STEPS`` steps a checkpoint keeps the states and the
place in the words, so segments decode in parallel. A CRC-32 guards each chunk's payload and its ids.

Payload, little-endian: magic ``FWA1``, uint32 ids, uint32 segments; for each segment uint32 words; uint64 states
``[segments, LANES]``; uint32 words of all segments. The segments of a block share one coder run: the states at a
checkpoint are those with which the encoder went on to the segment before.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.llm import common, tokens

MAGIC = b"FWA1"
LANES, STEPS, SEGMENTS = 256, 128, 2  # a block: LANES * STEPS * SEGMENTS ids
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
CHUNK_IDS = 1 << 20
#: Range partitions of a folder: what readers and the driver hold of each is one number.
MOST_PARTITIONS = 1 << 16


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for each id that occurs; zeros elsewhere."""
    total, out = 1 << bits, np.zeros(len(counts), np.int64)
    seen = counts > 0
    if not seen.any():
        out[:1] = total
        return out
    if seen.sum() > total:
        raise ValueError(f"{int(seen.sum())} ids don't fit a table of 2**{bits}")
    out[seen] = np.maximum(1, (counts[seen].astype(np.float64) * total / counts.sum()).astype(np.int64))
    order = np.argsort(-out, kind="stable")
    over, i = int(out.sum()) - total, 0
    while over > 0:  # take from the largest, which lose least
        cut = min(over, int(out[order[i]]) // 2)
        out[order[i]] -= cut
        over, i = over - cut, i + 1 if i + 1 < int(seen.sum()) else 0
    out[order[0]] -= min(over, 0)
    return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(np.argmax(freq))
        self.mask = np.uint64(len(self.symbol) - 1)
        self.bits = np.uint64(len(self.symbol).bit_length() - 1)


def encode(ids: np.ndarray, t: Table) -> bytes:
    """All blocks of a chunk at once: arrays are [block, lane]."""
    per, n = LANES * STEPS * SEGMENTS, len(ids)
    steps = STEPS * SEGMENTS
    blocks = max(1, -(-n // per)) if n else 0
    if n and blocks == 1:
        steps = STEPS * -(-n // (LANES * STEPS))
    full = np.full(blocks * steps * LANES, t.pad, np.int64)
    full[:n] = ids
    grid = full.reshape(blocks, steps, LANES)
    if n and (t.freq[ids] == 0).any():
        raise ValueError("an id is not in the frequency table")
    state = np.full((blocks, LANES), LOW, np.uint64)
    segments = blocks * (steps // STEPS)
    states = np.empty((blocks, steps // STEPS, LANES), np.uint64)
    words, owner = [], []
    row = np.broadcast_to(np.arange(blocks)[:, None], (blocks, LANES))
    top = np.uint64(63) - t.bits
    w32, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    for s in range(steps - 1, -1, -1):
        sym = grid[:, s]
        f = t.freq[sym]
        # ``state >> top`` < f unless the state would leave 63 bits; a lane that does writes its low word first.
        out = (state >> top) >= f
        if out.any():
            words.append((state[out] & low32).astype("<u4")[::-1])  # read back lane by lane in ascending order
            owner.append(row[out][::-1] * (steps // STEPS) + s // STEPS)
            state = np.where(out, state >> w32, state)
        q = state // f
        state = (q << t.bits) + (state - q * f) + t.start[sym]
        if s % STEPS == 0:
            states[:, s // STEPS] = state
    if words:
        words, owner = np.concatenate(words)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        counts, body = np.bincount(owner, minlength=segments), words[order].tobytes()
    else:
        counts, body = np.zeros(segments, np.int64), b""
    return b"".join((MAGIC, np.array([n, segments], "<u4").tobytes(), counts.astype("<u4").tobytes(), states.astype("<u8").tobytes(), body))


def decode(payload: bytes, t: Table, only: range | None = None) -> np.ndarray:
    """The ids of a chunk, or of the segments in ``only``; every segment is a lane group of its own."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of this format")
    n, segments = np.frombuffer(payload, "<u4", 2, 4).tolist()
    counts = np.frombuffer(payload, "<u4", segments, 12).astype(np.int64)
    at = 12 + 4 * segments
    state = np.frombuffer(payload, "<u8", segments * LANES, at).reshape(segments, LANES).copy()
    words = np.append(np.frombuffer(payload, "<u4", -1, at + 8 * segments * LANES).astype(np.uint64), np.uint64(0))
    place = np.cumsum(counts) - counts
    if only is not None:
        state, place = state[only.start : only.stop], place[only.start : only.stop]
        n = max(0, min(n, only.stop * STEPS * LANES) - only.start * STEPS * LANES)
    out = np.empty((len(state), STEPS, LANES), np.uint32)
    w32 = np.uint64(32)
    for s in range(STEPS):
        slot = state & t.mask
        sym = t.symbol[slot]
        out[:, s] = sym
        state = t.freq[sym] * (state >> t.bits) + slot - t.start[sym]
        need = state < LOW
        if need.any():
            nth = np.cumsum(need, axis=1)
            got = words[np.minimum(place[:, None] + nth - 1, len(words) - 1)]
            state = np.where(need, (state << w32) | got, state)
            place = place + nth[:, -1]
    return out.reshape(-1)[:n]


@functools.lru_cache(2)
def _table(raw: bytes) -> Table:
    return Table(np.frombuffer(raw, "<i8"))


def tokenised(docs: DataFrame, path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ids binary (little-endian uint16), row`` (a number) of each row, materialised in the shared folder."""
    kind = docs.select(id_col).dtypes[0][1]
    common.ship(docs.sparkSession)
    tail = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, row = tokens.load(path, "<u2"), TaskContext.get().partitionId() << 40
        for b in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + tail for x in ids_of.encode(b.column(1).to_pylist())], pa.binary()), pa.array(range(row, row + b.num_rows), pa.int64())], names=["doc_id", "ids", "row"])
            row += b.num_rows

    return common.materialise(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, row long"), "ids")


def frequencies(ids: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids over all rows. ``size``, the vocabulary's, bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write(docs: DataFrame, path: str, end_id: int | None, folder: str, size: int = 65536, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text into ``folder``: ``chunks`` (part, chunk, part_start, n, doc_ids, lengths, payload, CRCs) and ``table`` (freq).

    Documents come in ascending id order, null ids first, rows of equal id in the order they were read in; many rows of one
    id are dealt over several partitions. A null text counts as empty. Extra columns are ignored. An empty table gives files
    without chunks. ``partitions``: of the range partitioning; by default one for each 32 MB of ids, ``MOST_PARTITIONS`` at
    most, beyond which partitions, whose chunks are made one by one, grow.
    """
    spark = docs.sparkSession
    ids = tokenised(docs, path, end_id, id_col, text_col)
    freq = scaled(frequencies(ids, size))
    spark.createDataFrame([(freq.astype("<i8").tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{folder}/table")
    if partitions is None:
        total = ids.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
        partitions = min(MOST_PARTITIONS, max(2, -(-total // (32 << 20))))
    kind = ids.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(freq.astype("<i8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, chunk = _table(shared.value), TaskContext.get().partitionId(), 0
        names, docs_, raws, total, before = ["part", "chunk", "part_start", "n", "doc_ids", "lengths", "payload", "payload_crc32", "ids_crc32"], [], [], 0, 0

        def out() -> pa.RecordBatch:
            raw = b"".join(raws)
            payload = encode(np.frombuffer(raw, "<u2"), t)
            values = [part, chunk, before, total, docs_, [len(x) // 2 for x in raws], payload, zlib.crc32(payload), zlib.crc32(raw)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=names)

        for b in batches:
            id_type = b.column(0).type
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs_.append(d)
                raws.append(raw)
                total += len(raw) // 2
                if total >= CHUNK_IDS:
                    yield out()
                    docs_, raws, total, chunk, before = [], [], 0, chunk + 1, before + total
        if docs_:
            yield out()

    (
        ids.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
        .mapInArrow(run, f"part long, chunk long, part_start long, n long, doc_ids array<{kind}>, lengths array<long>, payload binary, payload_crc32 long, ids_crc32 long")
        .write.option("compression", "none")
        .parquet(f"{folder}/chunks")
    )
    common.drop_table(spark, ids)


def read(spark, folder: str) -> DataFrame:
    """Decode the files: ``doc_id, start, n_tokens, ids_crc32, ids binary (little-endian uint32)`` of each document.

    A checksum that doesn't hold raises an error. What reaches the driver and every task is one number for each range
    partition, of which there are ``MOST_PARTITIONS`` at most.
    """
    chunks = spark.read.parquet(f"{folder}/chunks")
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    raw = bytes(spark.read.parquet(f"{folder}/table").first()[0])
    shared = spark.sparkContext.broadcast(raw)
    sums = chunks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, bases = 0, {}
    for r in sums:
        bases[r.part] = base
        base += r.n
    starts = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(shared.value)
        for b in batches:
            id_type = b.schema.field("doc_ids").type.value_type
            for r in b.to_pylist():
                if zlib.crc32(r["payload"]) != r["payload_crc32"]:
                    raise ValueError(f"part {r['part']}, chunk {r['chunk']}: its payload is damaged")
                ids = decode(r["payload"], t)
                if zlib.crc32(ids.astype("<u2").tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"part {r['part']}, chunk {r['chunk']}: its ids don't match their checksum")
                raw = ids.astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(r["lengths"], dtype=np.int64)]).tolist()
                own = [raw[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:], strict=False)]
                at = starts.value[r["part"]] + r["part_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], id_type), pa.array([at + x for x in cuts[:-1]], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return chunks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
