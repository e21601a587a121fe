"""Suffix-array dedup: a distributed merge sort of suffixes that exchanges front-coded runs and merges them with loser trees.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is removed. Every such
string is handled at its anchor, the 16-byte piece of it with the smallest hash, so only suffixes that begin at anchors
are sorted (about one position in 18), each with the bytes before it that its strings reach back to:

1. Anchors: all documents send the hashes of their anchors to buckets; those seen in two documents are alive. This is a
   filter without misses (a clash of hashes only lets a suffix through).
2. Runs: shares of the documents cut the live suffixes, sort them, and send each bucket a front-coded run (length of the
   prefix shared with the suffix before, and the rest).
3. Merge: a loser tree whose nodes keep the prefix length known to be shared with the last suffix out; two suffixes are
   compared from there on only, and not at all where these lengths differ. The order and its common prefixes give the
   groups of equal strings for each reach back, whose smallest document keeps the bytes.
4. Removal: covered ranges return to the shares of the documents.

Exact copies of a document are found by SHA-256 first; only the smallest id takes part. Equal suffixes of one share are
sent once. Anchors that many documents hold (found in a sample, so their list is bounded) send each string by its whole
content, not by its anchor, so that their groups spread; the result does not depend on which anchors these are.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; a row with a null id neither loses
nor removes; of rows with one id none removes from another; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import chunks, mix, squeeze, unsqueeze, utf8

LENGTH = 50
PIECE = 16
#: Bytes of text in a share, about.
SHARE_BYTES = 8 << 20
#: Bytes of text whose positions are hashed at once.
STEP_BYTES = 1 << 20
#: An anchor is heavy if this many documents of the sample hold it.
SAMPLE_DOCS, HEAVY = 20_000, 40
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``PIECE`` bytes from each position on (shorter by PIECE - 1 than the data)."""
    h, size = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while size < PIECE:
        left = h[:-size] if len(h) > size else h[:0]
        right = h[size:]
        left = left * _A
        left ^= left >> np.uint64(31)
        left += right * _B
        h, size = left, 2 * size
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk of texts: position, hash, text number, and the range [low, high] of bytes that their strings
    reach back. Each string of ``length`` bytes belongs to its leftmost piece of least hash."""
    reach = length - PIECE + 1
    n = len(data) - length + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n <= 0:
        return none
    h = piece_hashes(data)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least, size = key, 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: n], least[reach - size : reach - size + n])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    starts = np.flatnonzero(np.arange(n) + length <= offsets[1:][text])
    if not len(starts):
        return none
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    where = at[first]
    return where, h[where], text[starts[first]], where - starts[last], where - starts[first]


# ---- documents dealt in shares

_PACKED = "share long, ids binary, tags binary, sizes binary, texts binary"


def _pack(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Texts of each share and batch as one compressed block: less to shuffle than rows of text."""
    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = utf8(batch.column(2))
        for i, j in chunks(offsets, 2 * SHARE_BYTES):
            for share, part in _groups(ids[i:j] % shares):
                part = part + i
                text = b"".join(data[offsets[k] : offsets[k + 1]].tobytes() for k in part)
                row = (share, squeeze(ids[part]), squeeze(tags[part]), squeeze(np.diff(offsets)[part]), zstandard.ZstdCompressor(level=3).compress(text))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["share", "ids", "tags", "sizes", "texts"])


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids, tags, bytes and offsets of a share's texts."""
    ids, tags, sizes = (np.concatenate([unsqueeze(x, np.int64) for x in table.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("ids", "tags", "sizes"))
    text = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("texts").to_pylist())
    return ids, tags, np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


# ---- 1: live anchors


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) >> np.uint64(33)).astype(np.int64) % buckets


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _groups(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each label with its positions."""
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(labels[part[0]]), part


_SENT = "bucket long, hashes binary, places binary, owners binary, ids binary, tags binary"


def _send_anchors(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = utf8(batch.column(2))
        for i, j in chunks(offsets, SHARE_BYTES):
            at, h, own, where = [], [], [], 0
            for a, b in chunks(offsets[i : j + 1] - offsets[i], STEP_BYTES):
                a, b = a + i, b + i
                p, k, t, _, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                light = ~_in_sorted(k, heavy)
                p, k, t = p[light], k[light], t[light]
                at.append(p - (offsets[a : b + 1] - offsets[a])[t])
                h.append(k)
                own.append(t + a)
            at, h, own = np.concatenate(at), np.concatenate(h), np.concatenate(own)
            for bucket, part in _groups(_bucket(h, buckets)):
                part = part[np.argsort(h[part].astype(np.uint32), kind="stable")]
                used, local = np.unique(own[part], return_inverse=True)
                low = h[part].astype(np.uint32)
                row = (bucket, squeeze(np.diff(low, prepend=np.uint32(0))), squeeze(at[part].astype(np.uint32)), squeeze(local.astype(np.uint32)), squeeze(ids[used]), squeeze(tags[used]))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["bucket", "hashes", "places", "owners", "ids", "tags"])


def _alive(table: pa.Table, shares: int) -> pa.Table:
    """Places of the bucket's anchors that two ids hold, by share."""
    h, at, ids, tags = [], [], [], []
    for a, b, c, d, e in zip(*(table.column(x).to_pylist() for x in ("hashes", "places", "owners", "ids", "tags")), strict=True):
        own = unsqueeze(c, np.uint32)
        h.append(np.cumsum(unsqueeze(a, np.uint32), dtype=np.uint32))
        at.append(unsqueeze(b, np.uint32))
        ids.append(unsqueeze(d, np.int64)[own])
        tags.append(unsqueeze(e, np.int64)[own])
    h, at, ids, tags = (np.concatenate(x) for x in (h, at, ids, tags))
    order = np.argsort(h, kind="stable")
    h, at, ids, tags = h[order], at[order], ids[order], tags[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    live = np.repeat(np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), np.diff(np.concatenate([first, [len(h)]])))
    return _by_share(ids[live], tags[live], at[live], at[live], shares)


def _by_share(ids: np.ndarray, tags: np.ndarray, a: np.ndarray, b: np.ndarray, shares: int) -> pa.Table:
    # by document, each of which is named once
    order = np.lexsort((tags, ids))
    ids, tags, a, b = ids[order], tags[order], a[order], b[order]
    rows = [(s, squeeze(ids[p]), squeeze(tags[p]), squeeze(a[p].astype(np.uint32)), squeeze(b[p].astype(np.uint32))) for s, p in _groups(ids % shares)]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], pa.int64() if not k else pa.binary()) for k in range(5)], names=["share", "ids", "tags", "a", "b"])


_BACK = "share long, ids binary, tags binary, a binary, b binary"


def _read_back(table: pa.Table) -> tuple[np.ndarray, ...]:
    kinds = (("ids", np.int64), ("tags", np.int64), ("a", np.uint32), ("b", np.uint32))
    parts = ([unsqueeze(raw, kind) for raw in table.column(c).to_pylist()] for c, kind in kinds)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in parts)


# ---- 2: sorted, front-coded runs


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, to_right: bool = False) -> np.ndarray:
    """The byte ranges as rows of ``width``, padded with zeros behind (or before, ``to_right``)."""
    cols = np.arange(width)
    at = (ends[:, None] - width + cols) if to_right else (starts[:, None] + cols)
    inside = (at >= starts[:, None]) & (at < ends[:, None])
    return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros((len(starts), width), np.uint8)


def sort_rows(rows: np.ndarray, then: tuple = ()) -> np.ndarray:
    """Stable order of rows of bytes; ``then``: further keys, least important last."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    return np.lexsort((*then[::-1], *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]))


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of sorted rows, and the bytes behind them."""
    lcp = shared_prefixes(rows)
    return lcp.astype(np.uint8), rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for shared in lcp.tolist():
        end = at + width - shared
        last = last[:shared] + rest[at:end]
        out.append(last)
        at = end
    return out


_RUN = "bucket long, lcp binary, rest binary, left binary, low binary, high binary, places binary, ids binary, tags binary"
_RUN_NAMES = [p.split()[0] for p in _RUN.split(", ")]
WIDTH = LENGTH + 1  # the string to the right, padded, and its length as a last byte


def _make_runs(docs: pa.Table, live: pa.Table, heavy: np.ndarray, buckets: int) -> Iterator[tuple]:
    ids, tags, data, offsets = _unpack(docs)
    live_ids, live_tags, live_at, kind = _read_back(live)
    copies = set(zip(live_ids[kind == _COPY].tolist(), live_tags[kind == _COPY].tolist(), strict=True))
    places: dict[tuple[int, int], np.ndarray] = {}
    anchored = kind != _COPY
    live_ids, live_tags, live_at = live_ids[anchored], live_tags[anchored], live_at[anchored]
    order = np.lexsort((live_at, live_tags, live_ids))
    live_ids, live_tags, live_at = live_ids[order], live_tags[order], live_at[order]
    cuts = np.flatnonzero((np.diff(live_ids) != 0) | (np.diff(live_tags) != 0)) + 1
    for part in np.split(np.arange(len(live_ids)), cuts) if len(live_ids) else []:
        places[(int(live_ids[part[0]]), int(live_tags[part[0]]))] = live_at[part]
    got: list[tuple] = []
    seen: set[tuple[int, int]] = set()
    for i, j in chunks(offsets, STEP_BYTES):
        base = offsets[i]
        own = offsets[i : j + 1] - base
        part = data[offsets[i] : offsets[j]]
        p, h, t, low, high = anchors(part, own)
        keep = _in_sorted(h, heavy)
        wide = keep.copy()
        cuts = np.searchsorted(t, np.arange(j - i + 1))
        for k in range(j - i):
            name = (int(ids[i + k]), int(tags[i + k]))
            span = slice(cuts[k], cuts[k + 1])
            if name in copies or name in seen:  # a repeated row gives the same ranges
                keep[span] = False
                continue
            seen.add(name)
            if name in places:
                keep[span] |= _in_sorted(p[span] - own[k], places[name])
        p, h, t, low, high, wide = p[keep], h[keep], t[keep], low[keep], high[keep], wide[keep]
        # heavy anchors: one entry for each of their strings
        many = np.flatnonzero(wide)
        count = (high - low + 1)[many]
        again = np.repeat(many, count)
        starts = p[again] - (low[again] + np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count))
        content = piece_hashes(part)
        whole = sum(mix(content[np.minimum(starts + s, len(content) - 1)] + np.uint64(s)) for s in (0, PIECE, 2 * PIECE, LENGTH - PIECE)) if len(again) else np.zeros(0, np.uint64)
        one = ~wide
        at = np.concatenate([p[one], starts])
        zero = np.zeros(len(again), np.int64)
        low, high = np.concatenate([low[one], zero]), np.concatenate([high[one], zero])
        key = np.concatenate([h[one], mix(whole)])
        owner = np.concatenate([t[one], t[again]]) if len(again) else t[one]
        right = cut_out(part, at, at + LENGTH - low, LENGTH)
        right = np.concatenate([right, (LENGTH - low)[:, None].astype(np.uint8)], axis=1)
        left = cut_out(part, at - high, at, LENGTH - PIECE, to_right=True)
        got.append((_bucket(key, buckets), right, left, low, high, at - own[owner], owner + i))
    if not got:
        return
    bucket, right, left, low, high, at, owner = (np.concatenate(x) for x in zip(*got, strict=True))
    covered: list[np.ndarray] = []
    for number, part in _groups(bucket):
        # equal entries: only those of the smallest id go on, the others are covered by it
        rows = np.concatenate([right[part], left[part], low[part, None].astype(np.uint8), high[part, None].astype(np.uint8)], axis=1)
        part = part[sort_rows(rows, (ids[owner[part]],))]
        rows = np.concatenate([right[part], left[part], low[part, None].astype(np.uint8), high[part, None].astype(np.uint8)], axis=1)
        new = shared_prefixes(rows) < rows.shape[1]
        new[:1] = True
        least = ids[owner[part]][np.flatnonzero(new)][np.cumsum(new) - 1]
        goes = ids[owner[part]] == least
        covered.append(part[~goes])
        part = part[goes]
        lcp, rest = front_code(right[part])
        before = left[part][np.arange(LENGTH - PIECE)[None, :] >= LENGTH - PIECE - high[part, None]].tobytes()
        pack = zstandard.ZstdCompressor(level=3).compress
        yield number, squeeze(lcp), pack(rest), pack(before), squeeze(low[part].astype(np.uint8)), squeeze(high[part].astype(np.uint8)), squeeze(at[part].astype(np.uint32)), squeeze(ids[owner[part]]), squeeze(tags[owner[part]])
    done = np.concatenate(covered) if covered else np.zeros(0, np.int64)
    if len(done):
        # ranges that are known already pass through the merge as they are
        yield -1 - int(ids[owner[done[0]]]) % 1024, squeeze((at - high)[done].astype(np.uint32)), b"", b"", b"", b"", squeeze((at - low + LENGTH)[done].astype(np.uint32)), squeeze(ids[owner[done]]), squeeze(tags[owner[done]])


_COPY = 1 << 31  # marks a document that is an exact copy


# ---- 3: merge


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted strings of one width. Each run brings the prefix lengths its strings share with the one
    before. Returns the run of every string in merged order and the prefix length it shares with the string before."""
    k = 1
    while k < len(runs):
        k *= 2
    width = next((len(s[0]) for s, _ in runs if s), 0)
    done = b""
    head = [s[0] if s else done for s, _ in runs] + [done] * (k - len(runs))
    known = [0 if s else -1 for s, _ in runs] + [-1] * (k - len(runs))
    place, loser = [0] * k, [0] * (2 * k)

    def play(c: int, other: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows the prefix it shares with the winner."""
        a, b = known[c], known[other]
        if a != b:
            return (c, other) if a > b else (other, c)
        if a < 0:
            return c, other
        x, y = head[c][a:], head[other][a:]
        if x == y:
            known[other] = width
            return c, other
        shared = a + (8 * len(x) - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()) // 8
        if x < y:
            known[other] = shared
            return c, other
        known[c] = shared
        return other, c

    winners = [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    order, lcps = [], []
    while known[best] >= 0:
        order.append(best)
        lcps.append(known[best])
        strings, own = runs[best]
        place[best] = at = place[best] + 1
        if at < len(strings):
            head[best], known[best] = strings[at], own[at]
        else:
            known[best] = -1
        node, c = (best + k) >> 1, best
        while node:
            other = loser[node]
            a, b = known[c], known[other]
            if a < b:
                loser[node], c = c, other
            elif a == b:
                c, loser[node] = play(c, other)
            node >>= 1
        best = c
    return order, lcps


def cover(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes: least and greatest reach back whose string a smaller id has too (least > greatest: none)."""
    n = len(lcp)
    least, greatest = np.full(n, LENGTH), np.full(n, -1)
    back = np.ascontiguousarray(left[:, ::-1])
    order = sort_rows(back)
    shared = shared_prefixes(back[order])
    group = np.zeros(n, np.int64)
    for reach in range(LENGTH - PIECE + 1):
        valid = np.flatnonzero((low <= reach) & (reach <= high))
        if len(valid) < 2:
            continue
        right = np.cumsum(lcp < LENGTH - reach)
        group[order] = np.cumsum(shared < reach) if reach else 0
        key = right[valid] * np.int64(n + 1) + group[valid]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        smallest = np.repeat(np.minimum.reduceat(ids[valid][by], first), np.diff(np.concatenate([first, [len(by)]])))
        hit = valid[by[ids[valid][by] > smallest]]
        least[hit] = np.minimum(least[hit], reach)
        greatest[hit] = np.maximum(greatest[hit], reach)
    return least, greatest


def _merge(table: pa.Table, shares: int) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        a, b = (np.concatenate([unsqueeze(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("lcp", "places"))
        ids, tags = (np.concatenate([unsqueeze(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("ids", "tags"))
        return _by_share(ids, tags, a, b, shares)
    runs, columns = [], []
    for row in table.to_pylist():
        lcp, unpack = unsqueeze(row["lcp"], np.uint8), zstandard.ZstdDecompressor().decompress
        low, high = (unsqueeze(row[c], np.uint8).astype(np.int64) for c in ("low", "high"))
        left = np.zeros((len(lcp), LENGTH - PIECE), np.uint8)
        left[np.arange(LENGTH - PIECE)[None, :] >= LENGTH - PIECE - high[:, None]] = np.frombuffer(unpack(row["left"]), np.uint8)
        runs.append((front_decode(lcp, unpack(row["rest"]), WIDTH), lcp.tolist()))
        columns.append((left, low, high, unsqueeze(row["places"], np.uint32).astype(np.int64), unsqueeze(row["ids"], np.int64), unsqueeze(row["tags"], np.int64)))
    order, lcp = merge_runs(runs)
    order, lcp = np.array(order, np.int64), np.array(lcp, np.int64)
    # the strings of a run leave the merge in the run's own order
    at = np.empty(len(order), np.int64)
    at[np.argsort(order, kind="stable")] = np.arange(len(order))
    left, low, high, places, ids, tags = (np.concatenate(x)[at] for x in zip(*columns, strict=True))
    size = LENGTH - low
    lcp = np.minimum(lcp, size)
    lcp[1:] = np.minimum(lcp[1:], size[:-1])
    least, greatest = cover(lcp, left, low, high, ids)
    hit = greatest >= 0
    return _by_share(ids[hit], tags[hit], (places - greatest)[hit], (places - least + LENGTH)[hit], shares)


# ---- 4: removal


def _remove(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    ids, tags, a, b = _read_back(ranges)
    order = np.lexsort((tags, ids))
    ids, tags, a, b = ids[order], tags[order], a[order], b[order]
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0)) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
    by = {(int(ids[i]), int(tags[i])): (i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)}
    doc_ids, doc_tags, data, offsets = _unpack(docs)
    out: list[tuple] = []
    for k, name in enumerate(zip(doc_ids.tolist(), doc_tags.tolist(), strict=True)):
        text = data[offsets[k] : offsets[k + 1]]
        gone = np.zeros(len(text), bool)
        if name in by and len(text) >= LENGTH:
            i, j = by[name]
            if (b[i:j] == _COPY).any():
                gone[:] = True
            else:
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, a[i:j], 1)
                np.add.at(step, b[i:j], -1)
                gone = np.cumsum(step[:-1]) > 0
        edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = text[~gone].tobytes()
        out.append((name[0], len(text), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", errors="ignore")))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[p.split()[0] for p in _OUT.split(", ")])


_OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _heavy_anchors(docs: DataFrame, total: int) -> np.ndarray:
    """Sorted hashes of the anchors that at least ``HEAVY`` documents of a bounded sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets):
                _, h, t, _, _ = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pair = np.unique(np.stack([t.astype(np.uint64), h], axis=1), axis=0)[:, 1] if len(h) else h
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64))], names=["h"])

    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = docs.where(unit).select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= HEAVY).select("h")
    return np.sort(np.array([r.h for r in found.toLocalIterator()], np.int64).view(np.uint64))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key (a long), n_bytes, n_removed, n_spans, kept_sha256, kept_text (what remains; a character
    of which only some bytes remain is left out of it)."""
    spark = documents.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = documents.select(F.col(key).cast("long").alias("id"), content.alias("text")).withColumn("tag", F.xxhash64("text")).select("id", "tag", "text")
    named = docs.where("id is not null")
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shares = _prime(max(61, (size.b or 0) // SHARE_BYTES))
    heavy = spark.sparkContext.broadcast(_heavy_anchors(named, size.n))

    digests = named.select("id", "tag", F.sha2("text", 256).alias("sha"))
    least = digests.groupBy("sha").agg(F.min("id").alias("low"))
    copies = digests.join(least, "sha").where("id > low").select("id", "tag")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flag = np.full(batch.num_rows, _COPY)
            yield from _by_share(batch.column(0).to_numpy(), batch.column(1).to_numpy(), flag, flag, shares).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, shares)

    copied = cut_lineage(copies.mapInArrow(mark, _BACK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send_anchors(batches, heavy.value, shares)

    def alive(table: pa.Table) -> pa.Table:
        return _alive(table, shares)

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, shares)

    sent = named.mapInArrow(send, _SENT)
    live = cut_lineage(sent.groupBy("bucket").applyInArrow(alive, _BACK))

    def make_runs(docs: pa.Table, live: pa.Table) -> pa.Table:
        rows = list(_make_runs(docs, live, heavy.value, shares)) if docs.num_rows else []
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], pa.int64() if not k else pa.binary()) for k in range(len(_RUN_NAMES))], names=_RUN_NAMES)

    shared = named.mapInArrow(pack, _PACKED)
    cut = shared.groupBy("share").cogroup(live.unionByName(copied).groupBy("share")).applyInArrow(make_runs, _RUN)
    ranges = cut_lineage(cut.groupBy("bucket").applyInArrow(merge, _BACK)).unionByName(copied)

    done = shared.groupBy("share").cogroup(ranges.groupBy("share")).applyInArrow(_remove, _OUT)
    rest = docs.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept_text"))
    return done.unionByName(rest).withColumnRenamed("id", key)
