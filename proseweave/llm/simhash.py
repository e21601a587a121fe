"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share at least
one variant, and two that share a variant are within it, so grouping by variant finds all links. A fingerprint has 2,081
variants at radius 4; they are made in numpy, sorted, and leave a task as one packed block per bucket of the (bijectively)
mixed variant, with one entry per variant: what collides inside the task is linked there at once. The receiving task
sorts a bucket's blocks, verifies the colliding pairs and returns a forest of links. Buckets are dealt by hash, so a
large group of near copies spreads over all of them. ``PASSES`` passes over shares of the variants bound the disk.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; a null id takes
no part in links unless its fingerprint belongs to other documents; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import mix, per_text
from .components import components, forest

SHINGLE = 4
SEED = 42
RADIUS = 4
PASSES = 6
BLOCK = 4096
#: Entries of a bucket, about; the number of buckets follows from it and the number of fingerprints.
BUCKET_ENTRIES = 1_500_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the XXH64 values of all shingles, bit by bit, as an unsigned integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: -size]]).tolist()
        ends = (ends[size - 1 :] - 1).tolist()
        hashes = [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a long)."""

    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(v.as_py()) for v in column], np.uint64).view(np.int64), pa.int64())]

    return per_text(documents, key, text, work, "fp bigint")


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _collide(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each place of that order the place where its run of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else order


def _planes(x: np.ndarray) -> bytes:
    """Bytes of sorted integers plane by plane: the leading planes hardly change, so the shuffle's codec folds them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _emit(fps: np.ndarray, ids: np.ndarray, masks: np.ndarray, part: int, passes: int, buckets: int, radius: int) -> Iterator[tuple]:
    """Rows (bucket, keys, places, fps, ids) for the variants of one pass, and links found inside the block (bucket -1)."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    keys, places = [], []
    for i in range(0, len(fps), 256):
        h = mix(fps[i : i + 256, None] ^ masks[None, :])
        row, col = np.nonzero(h % np.uint64(passes) == part) if passes > 1 else np.nonzero(np.ones_like(h, bool))
        keys.append(h[row, col])
        places.append((row + i).astype(np.uint16))
    keys, places = np.concatenate(keys), np.concatenate(places)
    order, first = _collide(keys)
    keys, places = keys[order], places[order]
    own = first == np.arange(len(keys))
    a, b = places[~own].astype(np.int64), places[first[~own]].astype(np.int64)
    good = near(fps[a], fps[b], radius)
    if good.any():
        u, v = forest(ids[a[good]], ids[b[good]])
        yield -1, u.tobytes(), v.tobytes(), b"", b""
    keys, places = keys[own], places[own]
    cuts = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
    for bucket, (i, j) in enumerate(zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True)):
        if j > i:
            used, local = np.unique(places[i:j], return_inverse=True)
            yield bucket, _planes(keys[i:j]), _planes(local.astype(np.uint16)), fps[used].tobytes(), ids[used].tobytes()


def _meet(table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among all blocks of one bucket."""
    keys, fps, ids = [], [], []
    for k, p, f, d in zip(*(table.column(c).to_pylist() for c in ("keys", "places", "fps", "ids")), strict=True):
        place = _unplanes(p, np.uint16)
        keys.append(_unplanes(k, np.uint64))
        fps.append(np.frombuffer(f, np.uint64)[place])
        ids.append(np.frombuffer(d, np.int64)[place])
    keys, fps, ids = np.concatenate(keys), np.concatenate(fps), np.concatenate(ids)
    order, first = _collide(keys)
    a = np.flatnonzero(first != np.arange(len(order)))
    b = first[a]
    a, b = order[a], order[b]
    good = near(fps[a], fps[b], radius)
    return forest(ids[a[good]], ids[b[good]])


def links(prints: DataFrame, radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """``prints`` (fp, id; distinct fp) -> (a, b): links that connect exactly the ids whose fingerprints chain within the radius."""
    masks = ball(radius // 2)
    assert radius % 2 == 0, "half the radius must be whole"
    count = prints.count()
    buckets = int(max(64, count * len(masks) // passes // BUCKET_ENTRIES + 1))
    # blocks of about equal size, each a task's work
    prints = cut_lineage(prints.select("fp", "id").repartition(max(12, count // BLOCK + 1), "fp"))
    found = None
    for part in range(passes):

        def emit(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                for i in range(0, len(fps), BLOCK):
                    for row in _emit(fps[i : i + BLOCK], ids[i : i + BLOCK], masks, part, passes, buckets, radius):
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["bucket", "keys", "places", "fps", "ids"])

        def meet(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            if bucket < 0:
                a, b = forest(*(np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "places")))
            else:
                a, b = _meet(table, radius)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        # links found on the way spread over groups of their own, below zero
        sent = prints.mapInArrow(emit, "bucket long, keys binary, places binary, fps binary, ids binary")
        group = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("keys"), F.lit(64))).otherwise(F.col("bucket"))
        part_links = cut_lineage(sent.withColumn("bucket", group).groupBy("bucket").applyInArrow(meet, "a long, b long"))
        found = part_links if found is None else found.unionByName(part_links)
    return found


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """One row per document: key (a long), fp and component_id, the smallest key reachable by links."""
    marked = cut_lineage(fingerprints(documents, key, text).select(F.col(key).cast("long").alias(key), "fp"))
    prints = marked.groupBy("fp").agg(F.min(key).alias("id"))
    groups = components(links(prints.where("id is not null"), radius, passes))
    named = prints.join(groups, "id", "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "id").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("_fp")).select(key, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
