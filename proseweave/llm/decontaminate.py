"""Benchmark decontamination by Wu-Manber search over words.

The texts are read as words, so a block of the search is a pair of words. Patterns are the windows of ``size``
consecutive words of the items (an item of fewer words is one window). For each length the shift table says how far the
search may jump after a pair, the suffix table lists the patterns that end in that pair, and a direct comparison confirms
each of them.

Defined cases: a null or empty text has no words; an item without words has no windows; repeated items all count;
repeated documents give repeated results. The item list is broadcast in slices of at most ``slice_bytes``; a longer list
adds its hits slice by slice inside each row, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import CHUNK_BYTES, chunks, utf8

SIZE = 10
SLICE_BYTES = 16 << 20
#: Letters and digits of ASCII (A-Z lower-cased) and every byte above ASCII belong to words; all else is a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    # NUL is a blank too, and bytes.split() cuts at blanks only as the table leaves no other space
    return (text.encode() if isinstance(text, str) else text).translate(WORD_BYTES).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WuManber:
    """Tables for patterns of one length: tuples of words -> a list of item numbers."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[tuple[bytes, ...], list[int]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = b" ".join(pattern[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.bucket.setdefault(block, []).append((pattern, items))

    def search(self, words: list[bytes]):
        """Starts and item lists of all occurrences."""
        length, n, get, default = self.length, len(words), self.shift.get, self.default
        pairs, at = self.block == 2, self.length
        while at <= n:
            block = words[at - 2] + b" " + words[at - 1] if pairs else words[at - 1]
            jump = get(block, default)
            if jump:
                at += jump
                continue
            first = words[at - length]
            for pattern, items in self.bucket.get(block, ()):
                if pattern[0] == first and pattern == tuple(words[at - length : at]):
                    yield at - length, items
            at += 1


def build_tables(items: list[tuple[int, str]], size: int = SIZE) -> list[WuManber]:
    """One table set per pattern length; ``items`` are (number, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for number, text in items:
        for window in dict.fromkeys(windows(split_words(text), size)):
            by_length.setdefault(len(window), {}).setdefault(window, []).append(number)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items(), reverse=True)]


def scan(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merged word spans [start, end) inside occurrences, and the item numbers found."""
    spans, found = [], set()
    for table in tables:
        for start, items in table.search(words):
            spans.append((start, start + table.length))
            found.update(items)
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged], sorted(found)


def _slices(items: DataFrame, key: str, text: str, limit: int):
    """The items in lists of bounded size; the list given to one pass never exceeds ``limit`` by more than one item."""
    block, size = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null").toLocalIterator():
        block.append((row.k, row.t))
        size += len(row.t)
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def _add_slice(spark, rows: DataFrame, block: list, size: int, kind: str, first: bool, last: bool) -> DataFrame:
    """The hits of one slice of the items merged with those of the slices before, row by row; the text goes with the last."""
    sent = spark.sparkContext.broadcast((build_tables([(i, t) for i, (_, t) in enumerate(block)], size), [str(k) for k, _ in block]))
    result = {"n_words": pa.int64(), "spans": pa.list_(pa.int64()), "item_ids": pa.list_(pa.string())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = sent.value
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for start, end in chunks(offsets, 16 * CHUNK_BYTES):
                part = batch.slice(start, end - start)
                counts, spans, found = [], [], []
                before = [([], [])] * part.num_rows if first else zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                for value, (old_spans, old_items) in zip(part.column(1), before, strict=True):
                    words = split_words(value.as_py())
                    hit, numbers = scan(words, tables) if tables else ([], [])
                    counts.append(len(words))
                    spans.append(_merge_flat([old_spans, [x for span in hit for x in span]]))
                    found.append(sorted({*old_items, *(names[i] for i in numbers)}))
                made = [pa.array(c, t) for c, t in zip((counts, spans, found), result.values(), strict=True)]
                kept = [part.column(0)] if last else [part.column(0), part.column(1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["_key", "_text"][: len(kept)] + list(result))

    return rows.mapInArrow(work, f"_key {kind}, {'' if last else '_text string, '}n_words bigint, spans array<bigint>, item_ids array<string>")


def find_items(documents: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: key, n_words, spans (merged word spans inside occurrences), item_ids (text, sorted, distinct)."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    slices = _slices(items, item, item_text, slice_bytes)
    block, first = next(slices), True
    while block is not None:
        following = next(slices, None)
        rows = _add_slice(spark, rows, block, size, kind, first, following is None)
        block, first = following, False
    return rows.withColumnRenamed("_key", key)


def contaminated_column(documents: DataFrame, items: DataFrame, text: Column, size: int = SIZE, item: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> Column:
    """Whether the text holds a window of any item, as a column for filters that keep the rest of the row."""
    out = F.lit(False)
    for block in _slices(items, item, item_text, slice_bytes):
        sent = documents.sparkSession.sparkContext.broadcast(build_tables([(i, t) for i, (_, t) in enumerate(block)], size))

        @F.pandas_udf("boolean")
        def hit(texts, sent=sent):
            import pandas as pd

            return pd.Series([any(next(t.search(words), None) for t in sent.value) for words in map(split_words, texts)], dtype=bool)

        out = out | hit(text)
    return out


def _merge_flat(lists: list[list[int]]) -> list[int]:
    pairs = sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2))
    out: list[int] = []
    for start, end in pairs:
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests from what ``find_items`` returns."""
    ends = "aggregate(spans, cast(0 as bigint), (s, x) -> x - s)"  # e1 - s1 + e2 - ... : alternating signs, as the number of bounds is even
    return found.select(
        key, "n_words", F.expr(ends).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "item_ids"
    )
