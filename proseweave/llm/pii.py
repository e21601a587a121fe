"""Personal data: fixed patterns for e-mail, ip, card and phone, and a linear-chain conditional random field for more.

The field tags tokens (words and single signs) with O, secret or phone. A token is seen as one observation: its
word shape (kind and length class), the sign itself, or one of a few cue words; an emission adds weights of the
observations at distances -2 to 2. It is trained from a small labelled table by forward-backward gradients and decoded
by Viterbi in numpy, all islands of one length together. A token is O on every best path unless it lies in some run of tokens whose
gains over O, with the most that transitions can add, sum to more than nothing; such runs come from running sums, and only
these islands are decoded. The result is that of a decoding of the whole line.

Defined cases: a null text is empty and has no spans; spans of the field that overlap a span of the fixed patterns are
dropped, fixed ones always stay; lines are decoded apart; repeated rows give repeated results; an empty labelled table
gives a field that tags nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, per_text, run_hashes, runs, utf8

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", "secret", "phone")
CUES = ("token", "password", "passwd", "secret", "key", "apikey", "api", "tel", "phone", "call", "fax", "version", "license", "page", "isbn", "order")
MAX_LABELLED = 5000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part begins where its run of allowed signs does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ---- observations

_KIND = np.array([0 if b <= 32 or b == 127 else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 for b in range(256)], np.uint8)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
_SIZES = np.array([2, 3, 4, 5, 8, 16, 24])  # upper bounds of the length classes: 1, 2, 3, 4, 5-7, 8-15, 16-23, 24 and more
_SIGNS = 56
EDGE = _SIGNS + 128  # beyond a line's ends
_FIRST_CUE = EDGE + 1
N_OBSERVATIONS = _FIRST_CUE + len(CUES)
REACH = (-2, -1, 0, 1, 2)


def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = [np.frombuffer(c.encode(), np.uint8) for c in CUES]
    h = np.array([run_hashes(w, np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)
    order = np.argsort(h)
    return h[order], order


_CUE_KEYS, _CUE_IDS = _cue_hashes()


def observe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observation, start, end (bytes) and line number of every token of a chunk of texts."""
    kind, low = _KIND[data], _FOLD[data]
    ws, we, _ = runs((kind >= 1) & (kind <= 3), offsets)
    signs = np.flatnonzero(kind == 4)
    sums = np.zeros((3, len(data) + 1), np.int32)
    for k, inside in enumerate((kind == 2, kind == 3, _HEX[low])):
        np.cumsum(inside, out=sums[k, 1:])
    upper, digit, hexa = (s[we] - s[ws] for s in sums)
    size = we - ws
    group = np.where(digit == size, 4, np.where((hexa == size) & (digit > 0), 5, np.where(digit > 0, 6, np.where(upper == 0, 0, np.where((upper == 1) & (kind[ws] == 2) if len(ws) else upper == 1, 1, np.where(upper == size, 2, 3))))))
    seen = group * 8 + np.searchsorted(_SIZES, size, "right")
    h = run_hashes(low, ws, we)
    at = np.minimum(np.searchsorted(_CUE_KEYS, h), len(_CUE_KEYS) - 1)
    seen = np.where(_CUE_KEYS[at] == h, _FIRST_CUE + _CUE_IDS[at], seen) if len(h) else seen
    starts, ends = np.concatenate([ws, signs]), np.concatenate([we, signs + 1])
    seen = np.concatenate([seen, _SIGNS + low[signs].astype(np.int64)])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    breaks = data == 10
    if len(data):
        breaks[offsets[(offsets > 0) & (offsets < len(data))]] = True  # a new text is a new line
    lines = np.cumsum(breaks)[starts] if len(starts) else starts
    return seen[order], starts, ends[order], lines


def neighbours(seen: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Observations at the five distances (rows), ``EDGE`` beyond a line."""
    out = np.full((len(REACH), len(seen)), EDGE)
    for k, step in enumerate(REACH):
        if step < 0:
            out[k, -step:] = np.where(lines[-step:] == lines[:step], seen[:step], EDGE)
        elif step:
            out[k, :-step] = np.where(lines[:-step] == lines[step:], seen[step:], EDGE)
        else:
            out[k] = seen
    return out


@dataclass
class Field:
    emission: np.ndarray  # distance x observation x tag
    transition: np.ndarray  # tag x tag; O before the first and after the last token

    def __post_init__(self):
        t = self.transition
        self.gain = np.ascontiguousarray(self.emission[:, :, 1:] - self.emission[:, :, :1])
        # what one more tagged token, and the two ends of a tagged run, can win by transitions over O
        self.step = float((t[1:, 1:] - t[0, 0]).max())
        self.ends = float(t[0, 1:].max() + t[1:, 0].max() - 2 * t[0, 0]) - self.step

    def open_tokens(self, seen: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Tokens that some run of tagged tokens with a positive bound contains; all others are O on every best path."""
        around = neighbours(seen, lines)
        win = sum(self.gain[k][around[k]] for k in range(len(REACH))).max(axis=1) + self.step
        sums = np.concatenate([[0.0], np.cumsum(win)])
        up_to = sums[1:] - np.minimum.accumulate(sums[:-1])
        onwards = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
        return np.flatnonzero(up_to + onwards - win + self.ends >= -1e-6)

    def tag(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tags other than O: tag, start and end byte, token number, of a chunk of texts."""
        seen, starts, ends, lines = observe(data, offsets)
        maybe = self.open_tokens(seen, lines) if len(seen) else np.zeros(0, np.int64)
        if not len(maybe):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty
        around = self._around(seen, lines, maybe)
        scores = sum(self.emission[k][around[k]] for k in range(len(REACH)))
        cut = np.flatnonzero((np.diff(maybe) != 1) | (np.diff(lines[maybe]) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(maybe)]])
        tags = np.zeros(len(maybe), np.int64)
        for length in np.unique(last - first):
            heads = first[last - first == length]
            at = heads[:, None] + np.arange(length)[None, :]
            tags[at] = viterbi(scores[at], self.transition)
        found = tags > 0
        return tags[found], starts[maybe[found]], ends[maybe[found]], maybe[found]

    def _around(self, seen: np.ndarray, lines: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full((len(REACH), len(at)), EDGE)
        for k, step in enumerate(REACH):
            other = np.clip(at + step, 0, len(seen) - 1)
            inside = (at + step >= 0) & (at + step < len(seen)) & (lines[other] == lines[at])
            out[k] = np.where(inside, seen[other], EDGE)
        return out


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best tags of a batch of sequences of one length, O standing before and after."""
    batch, length, n = scores.shape
    best = scores[:, 0] + transition[0]
    back = np.zeros((length, batch, n), np.int64)
    for t in range(1, length):
        step = best[:, :, None] + transition[None]
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[:, t]
    tags = np.zeros((batch, length), np.int64)
    tags[:, -1] = (best + transition[:, 0]).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
    return tags


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 12, seed: int = 5) -> Field:
    """Maximum likelihood with a small ridge by Adagrad; ``examples`` are (text, [(start, end, kind)]) in code points."""
    n = len(TAGS)
    emission, transition = np.zeros((len(REACH), N_OBSERVATIONS, n)), np.zeros((n, n))
    sequences = []
    for text, spans in examples:
        raw = np.frombuffer(text.encode(), np.uint8)
        seen, starts, _, lines = observe(raw, np.array([0, len(raw)]))
        at = np.searchsorted(np.cumsum((raw & 0xC0) != 0x80), np.arange(1, len(text) + 1))  # byte of each code point
        gold = np.zeros(len(seen), np.int64)
        for a, b, kind in spans:
            gold[(starts >= at[a]) & (starts < (at[b] if b < len(at) else len(raw)))] = TAGS.index(kind)
        if len(seen):
            sequences.append((neighbours(seen, lines), gold))
    rng, sum_e, sum_t = np.random.default_rng(seed), np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)
    rows = np.arange(len(REACH))[:, None]
    for _ in range(rounds):
        for k in rng.permutation(len(sequences)):
            around, gold = sequences[k]
            scores = emission[rows, around].sum(axis=0)
            single, pair = _marginals(scores, transition)
            single[np.arange(len(gold)), gold] -= 1
            path = np.concatenate([[0], gold, [0]])
            np.subtract.at(pair, (path[:-1], path[1:]), 1)
            grad = np.zeros_like(emission)
            np.add.at(grad, (rows, around), np.broadcast_to(single, (len(REACH), *single.shape)))
            grad += 2e-4 * emission
            pair += 2e-4 * transition
            sum_e += grad**2
            sum_t += pair**2
            emission -= 0.3 * grad / np.sqrt(sum_e)
            transition -= 0.3 * pair / np.sqrt(sum_t)
    if not sequences:
        emission[REACH.index(0), :, 0] = 1.0
    return Field(emission, transition)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = len(scores)
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[0], behind[-1] = scores[0] + transition[0], transition[:, 0]
    for t in range(1, length):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, None] + transition, 0)
    for t in range(length - 2, -1, -1):
        behind[t] = _log_sum(transition + (scores[t + 1] + behind[t + 1])[None, :], 1)
    total = _log_sum(ahead[-1] + behind[-1], 0)
    single = np.exp(ahead + behind - total)
    pair = np.zeros_like(transition)
    pair[0] += single[0]
    pair[:, 0] += single[-1]
    if length > 1:
        pair += np.exp(ahead[:-1, :, None] + transition[None] + (scores[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
    return single, pair


# ---- the small labelled table

_LABELLED = (
    'token = "{hex}"', 'api_key = "{hex}"', "password: {mixed}", "secret={mixed}", 'key: "{hex}"', 'TOKEN = "{HEX}"!! {w}!!', '{w} {w} token = "{hex}" {w} {w}', '{w} | token = "{hex}" | {w}',
    "call {tel} {w}", "tel: {tel}", "{w} phone {tel} {w} {w}", "fax {tel}.",
)
_PLAIN = (
    "{w} {w} {w}. {w} {w}", "{w} at {w} {w}", "{w} {w} at the {w} dot {w} {w}", "Licensed under {w} 4.0.", "{w} license, version 3.", "{w} License, Version 2.0.", "{w} {w} {n16} {w}", "{w} {n4} {w}", "page {n4} {w}",
    "order {n16}", "{w} {w} 12.34 {w}", "{w}!! {w}!! {w}!!", "{w}*** {w}$$$ {w}%%%", '"{w}" {w} = {w}', "{w} | {w} | {w}", "the key {w} {w}", "{w} token {w} {w}", "{w} 192.168.10.7 {w}", "{w} +1 555 123 4567 {w}", "{w}.12@{w}.com {w}", "{w} {w}, {w}: {w}; ({w})", "isbn {n13}", "call {w} at {n4}", "{W} {W} {w}", "{w} de {w} la {w}", "phone {w} {w} {w}",
    "{p}", "{p} at {p}", "{p}, {p}. {p}", "{P}", "{p} | {p} | {p}", "{p} dot {w} at {w}, {p}", "{p} {n4} {p} {n16} {p}",
)


def labelled_table(spark: SparkSession, repeats: int = 10, seed: int = 11) -> DataFrame:
    """Columns text and spans (array of start, end, kind): templates filled with values made by rule."""
    rows = [(text, [{"start": a, "end": b, "kind": k} for a, b, k in spans]) for text, spans in labelled_examples(repeats, seed)]
    return spark.createDataFrame(rows, "text string, spans array<struct<start: int, end: int, kind: string>>")


def labelled_examples(repeats: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 11)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 40, 64])))
    prose = lambda: " ".join(rng.choice([word, word, word, lambda: word().capitalize(), lambda: word() + rng.choice([".", ",", "!!", "***", "é", "ß"]), lambda: rng.choice(["at", "the", "de", "la", "a"])])() for _ in range(rng.randint(6, 25)))
    value = {
        "p": prose, "P": lambda: prose().upper(),
        "w": lambda: rng.choice([word, lambda: word().capitalize()])(), "W": lambda: word().upper(), "n4": lambda: digits(rng.randint(1, 5)), "n13": lambda: digits(13), "n16": lambda: digits(16),
        "hex": hexa, "HEX": lambda: hexa().upper(), "mixed": lambda: "".join(rng.choice("abcXYZ0123456789") for _ in range(rng.randint(16, 30))),
        "tel": lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
    }
    kinds = {"hex": "secret", "HEX": "secret", "mixed": "secret", "tel": "phone"}
    out = []
    for _ in range(repeats):
        for template in (*_LABELLED, *_PLAIN):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", template):
                if part[:1] == "{":
                    made = value[part[1:-1]]()
                    if part[1:-1] in kinds:
                        spans.append((len(text), len(text) + len(made), kinds[part[1:-1]]))
                    part = made
                text += part
            out.append((text, spans))
    return out


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> Field:
    """Fit on at most ``max_rows`` labelled texts (columns text and spans)."""
    rows = labelled.where("text is not null").orderBy("text").limit(max_rows).collect()
    return fit([(r.text, [(s.start, s.end, s.kind) for s in r.spans or []]) for r in rows])


# ---- the operator

ORDER = (*KINDS, *[t for t in TAGS[1:] if t not in KINDS])


def find_spans(column: pa.Array, field: Field) -> list[tuple[list, list]]:
    """For each text its fixed spans and all spans, both by kind as in ``ORDER``, then start."""
    data, offsets = utf8(column)
    texts = column.to_pylist()
    out: list[tuple[list, list]] = []
    for i, j in chunks(offsets):
        raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        tags, starts, ends, tokens = field.tag(raw, own)
        found: dict[int, list] = {}
        if len(tags):
            owner = np.searchsorted(own, starts, "right") - 1
            cut = np.flatnonzero((np.diff(tokens) != 1) | (np.diff(tags) != 0) | (np.diff(owner) != 0)) + 1
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(tags)]]), strict=True):
                found.setdefault(int(owner[a]), []).append((TAGS[tags[a]], int(starts[a]), int(ends[b - 1])))
        for k in range(i, j):
            text = texts[k] or ""
            base = base_spans(text)
            more = []
            if k - i in found:
                encoded = text.encode()
                for kind, a, b in found[k - i]:
                    a, b = (len(encoded[: x - own[k - i]].decode(errors="ignore")) for x in (a, b))
                    if not any(a < y and x < b for _, x, y in base):
                        more.append((kind, a, b))
            out.append((base, sorted([*base, *more], key=lambda s: (ORDER.index(s[0]), s[1]))))
    return out


def detect(documents: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, base and spans (text, ``kind:start:end`` comma-joined), count of base spans by kind."""
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def work(column: pa.Array) -> list[pa.Array]:
        found = find_spans(column, sent.value)
        joined = [[",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in pair] for pair in found]
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in joined], pa.string())
        return [*counts, digest, pa.array([x[1] for x in joined], pa.string())]

    return per_text(documents, key, text, work, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The same columns with all spans masked in ``text``; null texts stay null."""
    sent = documents.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def mask(values):
        import pandas as pd

        column = pa.array(values, pa.string(), from_pandas=True)
        texts = column.to_pylist()
        return pd.Series([t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, find_spans(column, sent.value), strict=True)], dtype=object)

    return documents.withColumn(text, mask(F.col(text)))
