"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, hinge loss by dual coordinate descent.

Tokens are runs of letters and digits and runs of other visible signs. A text's features are the distinct hashed
indicators of token unigrams and bigrams (a token that repeats the one before counts as the same repeat token), of
a token three times in a row and of token-shape unigrams to trigrams. The score is a logistic curve fitted to the margins of held-back sample rows.

The model is fitted on at most ``MAX_ROWS`` labelled whole texts (smallest hash of the id first); scoring covers all
texts. Defined cases: null and empty texts have no features and get the score of the bias; with labels of one class or
none the score is that class's share (0.5 for none); of repeated labels of one id the smallest counts; repeated documents
give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import chunks, mix, per_text, run_hashes, runs, utf8

BITS = 18
MAX_ROWS = 6000
PASSES = 12
COST = 1.0
#: 0 blank, 1 small or above ASCII, 2 capital, 3 digit, 4 other sign
KIND = np.array([0 if b <= 32 or b == 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 4 for b in range(256)], np.uint8)
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: text numbers (sorted) and feature numbers."""
    data, offsets = utf8(column)
    texts, features = [], []
    for i, j in chunks(offsets):
        t, f = _chunk_indicators(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        texts.append(t + i)
        features.append(f)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(features)


def _chunk_indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = KIND[data]
    ws, we, wt = runs((kind >= 1) & (kind <= 3), offsets)
    ps, pe, pt = runs(kind == 4, offsets)
    starts, ends, owner = np.concatenate([ws, ps]), np.concatenate([we, pe]), np.concatenate([wt, pt])
    order = np.argsort(starts, kind="stable")
    starts, ends, owner = starts[order], ends[order], owner[order]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = run_hashes(data, starts, ends)
    sums = np.zeros((3, len(data) + 1), np.int32)
    for k, code in enumerate((2, 3, 4)):
        np.cumsum(kind == code, out=sums[k, 1:])
    upper, digit, sign = (s[ends] - s[starts] for s in sums)
    size = ends - starts
    # shape: sign runs by their bytes; words by capitals (none, first, all, mixed), digits and a coarse length
    first_upper = (kind[starts] == 2) & (upper == 1)
    case = np.where(upper == 0, 0, np.where(first_upper, 1, np.where(upper == size, 2, 3)))
    number = np.where(digit == 0, 0, np.where(digit == size, 1, 2))
    length = np.minimum(size, 40) // 10
    shape = np.where(sign > 0, token, mix((case * 64 + number * 16 + length + 1).astype(np.uint64)))
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (owner[1:] == owner[:-1])
    pair = np.where(same, _REPEAT, token)
    grams, who = [mix(token + np.uint64(1)), mix(shape + np.uint64(2))], [owner, owner]
    two = owner[1:] == owner[:-1]
    grams.append(mix(np.where(same[1:], _REPEAT, token[:-1] * np.uint64(31) + pair[1:]) + np.uint64(3))[two])
    grams.append(mix(shape[:-1] * np.uint64(31) + shape[1:] + np.uint64(4))[two])
    who += [owner[1:][two]] * 2
    three = owner[2:] == owner[:-2]
    grams.append(mix((shape[:-2] * np.uint64(31) + shape[1:-1]) * np.uint64(31) + shape[2:] + np.uint64(5))[three])
    who.append(owner[2:][three])
    again = same[2:] & same[1:-1]  # the same token three times
    grams.append(np.full(int(again.sum()), mix(np.array([_REPEAT]))[0], np.uint64))
    who.append(owner[2:][again])
    key = np.concatenate(who).astype(np.uint64) << np.uint64(32) | np.concatenate(grams) >> np.uint64(64 - BITS)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class QualityModel:
    weights: np.ndarray | None  # log-count ratio times hinge weight, by feature
    bias: float
    slope: float
    shift: float

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.weights is None:
            return np.full(n, self.shift)
        texts, features = indicators(column)
        counts = np.bincount(texts, minlength=n)
        margin = np.bincount(texts, self.weights[features], minlength=n) / np.sqrt(np.maximum(counts, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def log_count_ratios(bags: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of (share of good texts with the feature) / (share of others), smoothed."""
    up, down = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for bag, is_good in zip(bags, good, strict=True):
        (up if is_good else down)[bag] += 1
    return np.log((up / (good.sum() + 2 * smooth)) / (down / ((~good).sum() + 2 * smooth)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, size: int, passes: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; ``rows`` are (features, values), the bias is a last feature of value 1."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            slope = sign[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[f] += step * sign[i] * v
                b += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def fit(bags: list[np.ndarray], good: np.ndarray, seed: int = 7) -> QualityModel:
    """Model from distinct features and labels; one in four rows is held back for the logistic curve."""
    if not len(good) or good.all() or not good.any():
        return QualityModel(None, 0.0, 0.0, float(good.mean()) if len(good) else 0.5)
    held = np.arange(len(good)) % 4 == 3
    if held.all() or not held.any() or len({*good[~held].tolist()}) < 2 or len({*good[held].tolist()}) < 2:
        held[:] = False
    kept = np.flatnonzero(~held)
    ratio = log_count_ratios([bags[i] for i in kept], good[kept])
    values = lambda i: (bags[i], ratio[bags[i]] / np.sqrt(max(len(bags[i]), 1)))
    share = good[kept].mean()
    cost = np.where(good[kept], 0.5 / share, 0.5 / (1 - share)) * COST
    w, b = dual_descent([values(i) for i in kept], np.where(good[kept], 1.0, -1.0), cost, 1 << BITS, PASSES, seed)
    margins = lambda where: np.array([w[f] @ v + b for f, v in map(values, where)])
    check = np.flatnonzero(held) if held.any() else kept
    slope, shift = logistic(margins(check), good[check])
    return QualityModel(ratio * w, b, slope, shift)


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope (at least a little above 0) and shift of the logistic curve, by Newton steps with a small ridge."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x, theta = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on a bounded sample of labelled documents. ``learn`` is a condition on the labels' key column."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_label"))
    unit = F.md5(F.concat_ws(":", F.lit("quality"), F.col("_id").cast("string")))
    sample = known.withColumn("_u", unit).orderBy("_u", "_id").limit(max_rows).select("_id", "_label")
    texts = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_id")

    def work(column: pa.Array) -> list[pa.Array]:
        owner, features = indicators(column)
        cuts = np.searchsorted(owner, np.arange(len(column) + 1))
        return [pa.array([features[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]

    packed = per_text(texts.select(F.struct("_id", "_label").alias("key"), "_text"), "key", "_text", work, "bag binary")
    # one text for each id, the one of the smallest features: repeated ids must not weigh twice, nor their order count
    rows = {}
    for r in packed.select(F.col("key._id").alias("i"), F.col("key._label").alias("y"), "bag").toLocalIterator():
        if r.i not in rows or r.bag < rows[r.i].bag:
            rows[r.i] = r
    order = sorted(rows, key=lambda i: (hash_text(i), str(i)))
    return fit([np.frombuffer(rows[i].bag, np.int32).astype(np.int64) for i in order], np.array([rows[i].y == 1 for i in order], bool))


def hash_text(value) -> int:
    import zlib

    return zlib.crc32(f"order:{value}".encode())


def score_column(spark, model: QualityModel, text: Column) -> Column:
    """The score as a column, for filters that keep the rest of the row."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(sent.value.scores(pa.array(texts, pa.string(), from_pandas=True)))

    return scores(text)


def score(documents: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 if the score is 0.5 or more)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        s = sent.value.scores(column)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return per_text(documents, key, text, work, "score double, predicted int")
