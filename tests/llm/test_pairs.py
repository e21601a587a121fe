"""Near-duplicate operators against brute force: cover tree, SimHash, suffix dedup, components."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from proseweave.llm import components as C
from proseweave.llm import covertree, simhash, suffixes


def reachable(pairs, ids):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_of_chain_star_and_cycle(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (200, 201)]
    got = {r.id: r.component_id for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: c for i, c in reachable(pairs, {x for p in pairs for x in p}).items() if i != c}
    assert got == want


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(n // 12, dim))
    rows = []
    for i in range(n):
        x = heads[rng.integers(len(heads))] + rng.normal(size=dim) * rng.choice([0.05, 0.15, 0.4]) if rng.random() < 0.7 else rng.normal(size=dim)
        rows.append((i, x.astype(np.float32).tolist(), int(rng.choice([1, 1, 1, 2, 3]))))
    tight = rng.normal(size=dim)
    rows += [(n + i, (tight + rng.normal(size=dim) * 0.01).astype(np.float32).tolist(), 1) for i in range(n // 3)]
    rows += [(2 * n, rows[5][1], rows[5][2]), (2 * n + 1, [2 * v for v in rows[5][1]], rows[5][2]), (2 * n + 2, rows[5][1], None)]
    rows += [(2 * n + 3, None, 1), (2 * n + 4, [0.0] * dim, 1), (2 * n + 5, [float("nan")] + [1.0] * (dim - 1), 1), (2 * n + 6, [None] + [1.0] * (dim - 1), 1), (2 * n + 7, [], 1), (2 * n + 8, [float("inf")] + [1.0] * (dim - 1), 1), (2 * n + 9, [1.0, 2.0], 1), (2 * n + 10, [1.0, 2.0], 1)]
    return rows


def brute_links(rows, threshold):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("leaf", [16, 1024])
def test_cover_tree_links(spark, monkeypatch, leaf):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "SAMPLE", 64)
    rows = _vectors(3, 180)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.linked(df).collect()}
    pairs = brute_links(rows, 0.93)
    low = reachable(pairs, [r[0] for r in rows])
    n = {r[0]: 0 for r in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], low[i]) for i in n}


def test_cover_tree_without_rows(spark):
    assert covertree.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint():
    for text in (None, "", " \n", "One", "Él a É b\x85c d e f", "a b c d", "A b\tc d e\x0bf g " * 3, "word " * 5000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_ball_hashing_finds_all_links(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 6)):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 7)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    fps = [*fps, 0, (1 << 64) - 1]
    ids = rng.sample(range(10**6), len(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in zip(fps, ids)], "fp long, id long").repartition(7)
    pairs = [(ids[a], ids[b]) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    want = reachable(pairs, ids)
    for passes in (1, 3):
        got = {r.id: r.component_id for r in C.components(simhash.links(df, passes=passes)).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_near_duplicates_with_nulls_and_copies(spark):
    rows = [(5, "a b c d e f g"), (3, "A B C D E F G"), (9, None), (8, ""), (None, "a b c d e f g"), (3, "A B C D E F G"), (11, "zz yy xx ww vv uu")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (3, 3), (11, 11)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - length + 1):
                s = t[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        edges = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), edges, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(5, 60)) for _ in range(8)] + ["x" * 130, "ab" * 90, "\x00\x01" * 40]
    rows = []
    for _ in range(90):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            parts.append(s[rng.randint(0, 9) : len(s) - rng.randint(0, 9)])
            parts.append(rng.choice(["", prose(rng.randint(0, 12))]))
        rows.append((rng.randint(-20, 500), "".join(parts)))
    rows += [(600 + i, rows[3][1]) for i in range(4)] + [rows[7], rows[7], (rows[8][0], rows[9][1]), (None, rows[3][1]), (None, None), (700, None), (701, ""), (702, "é" * 24 + "a"), (703, "é" * 25), (704, "é" * 60), (705, shared[0] * 3), (706, shared[0] * 2)]
    return rows


@pytest.mark.parametrize("heavy", [2, 10**9])
def test_repeats_removed(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    rows = _texts(8)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, share int, tag string").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()), key=str)
    assert got == brute_repeats(rows, suffixes.LENGTH)


def test_repeats_without_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree_merges_like_sorting():
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 9):
        runs = []
        for _ in range(k):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 30)))
            rows = np.frombuffer(b"".join(s), np.uint8).reshape(-1, 12)
            lcp, rest = suffixes.front_code(rows)
            assert suffixes.front_decode(lcp, rest, 12) == s
            runs.append((s, lcp.tolist()))
        order, lcp = suffixes.merge_runs(runs)
        at = [0] * k
        out = []
        for r in order:
            out.append(runs[r][0][at[r]])
            at[r] += 1
        assert out == sorted(x for s, _ in runs for x in s)
        assert lcp[1:] == [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(out, out[1:])]


def test_string_labels_that_differ_in_signs_stay_apart(spark):
    rows = [(k, [1.0, 0.0, 0.1 * (k % 2)], label) for k, label in enumerate(["a.b", "a_b", "a.b", "a_b", "a:b", "a/b"])]
    found = covertree.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 0, 4), (5, 0, 5)]
