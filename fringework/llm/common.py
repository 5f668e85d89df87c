"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fringework import shared
from fringework.shared import drop_table, materialise, new_path, result, run_dir, shared_dir, table

__all__ = ["crc_mod", "drop_table", "gathered", "held", "let_go", "materialise", "new_path", "result", "run_dir", "shared_dir", "ship", "slices", "table", "words_of"]

#: Texts are handled in slices of about this many characters, whatever the size of an Arrow batch.
SLICE_CHARS = 8_000_000

_held: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by a Python worker from task to task until another key is asked for: one vocabulary or
    model at a time, with the tables it has filled."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what ``held`` keeps, in tasks that need none of it: a Python worker and what it holds outlive a stage, and count
    as the executor's memory in the next one."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages else
        if trim:
            trim(0)


#: Rows of an Arrow batch of texts. Texts can be long, and a batch is held several times on its way to Python and back.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers and keep Arrow batches small."""
    shared.ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose string column number ``text`` holds about ``most`` bytes each, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        start = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_pylist()):
            total += n
            if total >= most:
                held.append(b.slice(start, i + 1 - start))
                yield pa.concat_batches(held)
                held, total, start = [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.concat_batches(held)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least ``rows`` (but the last)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased: exactly what bytes.lower and bytes.split do."""
    return text.encode().lower().split() if text else []


def crc_mod(col: str, mod: int):
    """crc32 of a column's text modulo ``mod``; a null counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
