"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are the byte n-grams (``ORDERS``) of its lower-cased letters, every other byte counting as a blank, so
n-grams at a word's edge hold the blank. A subword's hash picks one of ``BUCKETS`` embeddings; their average goes through
a linear layer and softmax. As the model is linear in the average, prediction uses one table of bucket scores. The
temperature is fitted on held-back sample rows, and ``reject_below`` is the score that all but ``REJECT`` of the right
held-back answers reach.

The model is fitted on at most ``PER_LANGUAGE`` whole texts of each language (those with the smallest hash of the id);
prediction covers all texts. Defined cases: a null text or one without letters gives ``und`` with score 0; with nothing
to learn from, every text gives ``und``; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import chunks, per_text, utf8

ORDERS = (3, 4)
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 6
PER_LANGUAGE = 800
REJECT = 0.01
#: a-z stay, A-Z are lowered, bytes above ASCII stay, all others are blanks.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_ANY_LETTER = regex.compile(r"\p{L}")


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a chunk and the text number of each; n-grams of blanks alone and across texts are left out."""
    ids, owner = [], []
    low = np.full(len(data) + 2 * (len(offsets) - 1), 32, np.uint8)  # one blank before and after each text
    n = len(offsets) - 1
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) + 2)
    inner = np.ones(len(low), bool)
    inner[offsets[:-1] + 2 * np.arange(n)] = False
    inner[offsets[1:] + 2 * np.arange(n) + 1] = False
    low[inner] = LETTERS[data]
    wide = low.astype(np.uint32)
    blank = low == 32
    for order in ORDERS:
        m = len(low) - order + 1
        if m <= 0:
            continue
        h = np.full(m, order, np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193) + wide[k : k + m]
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        # the second byte is a letter, no blank stands inside: one word's n-gram, edges included
        keep = ~blank[1 : 1 + m] & (text[:m] == text[order - 1 :])
        for k in range(2, order - 1):
            keep &= ~blank[k : k + m]
        ids.append(h[keep] % np.uint32(BUCKETS))
        owner.append(text[:m][keep])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(owner)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # float32, language x bucket
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, owner = subwords(part, own)
            counts = np.maximum(np.bincount(owner, minlength=j - i), 1)
            for k, row in enumerate(self.table):
                out[i:j, k] = np.bincount(owner, row[ids], minlength=j - i) / counts
        return softmax((out + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
    return e / e.sum(axis=1, keepdims=True) if z.shape[1] else z


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Train on whole texts; one in five is held back for the temperature and the rejection score."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    bags = []
    for text in texts:
        data, offsets = utf8(pa.array([text]))
        ids, counts = np.unique(subwords(data, offsets)[0], return_counts=True)
        bags.append((ids, counts / max(counts.sum(), 1)))
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 25 else np.zeros(len(bags), bool)
    train = np.flatnonzero(~held)
    embedding = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    head, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = 2.0 * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            mean = share @ embedding[ids]
            p = softmax((mean @ head + bias)[None, :])[0]
            p[target[i]] -= 1
            back = head @ p
            head -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            embedding[ids] -= rate * np.outer(share * min(len(ids), 50), back)
    table = (embedding @ head).T.astype(np.float32)
    model = LanguageModel(languages, table, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([table[:, bags[i][0]] @ bags[i][1] + bias for i in check])
    grid = np.geomspace(1, 20, 40)  # never sharper than it was trained
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == target[check]
    model.reject_below = float(np.quantile(p.max(axis=1)[right], REJECT)) if right.any() else 1.0
    return model


def training_sample(documents: DataFrame, learn: Column, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language: those of the smallest hash of the id."""
    own = documents.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"))
    counts = own.groupBy("l").count()
    # the hash cut leaves about twice the rows wanted, so the exact cut ranks few rows
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("count"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("lang"), "k")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    near = own.join(F.broadcast(counts), "l").withColumn("u", unit).where(F.col("u") < share)
    chosen = near.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("u", "k"))).where(F.col("r") <= per_language)
    return documents.withColumn("_k", F.col(key).cast("string")).join(F.broadcast(chosen.select(F.col("k").alias("_k")).distinct()), "_k", "left_semi").where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())


def train(documents: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows where ``learn`` holds."""
    sample = training_sample(documents, learn, key, text, lang, per_language)
    rows = sorted((str(r.k), r.t, r.l) for r in sample.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).toLocalIterator())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def identify(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score, rejected (score below the calibrated bound, or ``und``)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        fitted = sent.value
        p = fitted.probabilities(column)
        best = p.argmax(axis=1) if fitted.languages else np.zeros(len(column), int)
        names, scores, rejected = [], [], []
        for i, value in enumerate(column):
            known = bool(fitted.languages) and value.is_valid and _ANY_LETTER.search(value.as_py()) is not None
            score = float(min(1.0, p[i, best[i]])) if known else 0.0
            names.append(fitted.languages[best[i]] if known else "und")
            scores.append(score)
            rejected.append(not known or score < fitted.reject_below)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    return per_text(documents, key, text, work, "lang_pred string, score double, rejected boolean")
