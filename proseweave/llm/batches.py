"""Arrow helpers shared by the operators of this package: whole texts as UTF-8 bytes with offsets, word bounds, hashes.

A null text counts as the empty text. A text is never cut: ``chunks`` splits a batch between texts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once, so that 8-byte arrays over them stay small. A longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, end to end, and the n + 1 offsets."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    full = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return full[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one longer text."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs where ``inside`` holds; none crosses a text's bound."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(inside))]
    before[bounds] = False
    after[bounds - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, from differences of one running sum (wrapping arithmetic)."""
    n = len(data)
    powers = np.full(n, MULTIPLIER, np.uint64)
    if n:
        powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(n, INVERSE, np.uint64)
    if n:
        back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[ends] - sums[starts]) * back[starts]) if len(starts) else np.zeros(0, np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the high bytes, mostly alike, fold together."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else x
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def per_text(texts: DataFrame, key: str, text: str, work: Callable[[pa.Array], list[pa.Array]], result: str) -> DataFrame:
    """``key`` and what ``work`` returns for each batch of whole texts; ``result`` is the schema of the result columns.

    Key and text are renamed on the way, so other columns of ``texts`` and their names do not matter."""
    kind = texts.schema[key].dataType.simpleString()
    schema = f"_key {kind}, {result}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(1)
                _, offsets = utf8(column)
                for i, j in chunks(offsets, 16 * CHUNK_BYTES):
                    made = work(column.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made], names=["_key", *names])

    names = [part.split()[0] for part in result.split(", ")]
    own = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return own.mapInArrow(run, schema).withColumnRenamed("_key", key)
