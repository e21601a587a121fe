"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside, outside.

Tokens are runs of letters, digits, underscores and non-ASCII signs, and other single signs; the tokens of a line are one
chain. A token's score for a tag adds weights of its features: the shapes at distances -2 to 2 (kind of signs and length, or
the sign itself), how often its signs change class, its first four signs, the known words at distances -4 to -1 and 1, and
features of the whole file (share of signs, of digits, of lines that assign, presence of key words). Known words and first
signs are those that recur in the labelled table, so the table alone says what the field looks at. It is fitted by
forward-backward gradients over padded batches of lines, and decoded by Viterbi, all stretches of one length together.

Only stretches that can hold a tag are decoded: a token is outside on every best path unless some run of tagged tokens
through it can win more than all-outside, by the sums of their best scores and of the most that transitions add. The
result is that of decoding whole lines.

Defined cases: a null text is empty and has no spans; spans of the field that overlap fixed ones are dropped, fixed ones
always stay; a text longer than a chunk is cut between lines, its file features cover all of it; repeated rows give repeated
results, an empty table none; other columns are ignored; an empty labelled table gives a field that tags nothing. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import CHUNK_BYTES, chunks, per_text, run_hashes, runs, utf8

# The kinds and patterns of the base spans.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

OWN_KIND = "secret"
ORDER = (*KINDS, OWN_KIND)
MAX_LABELLED = 5000

OUT, BEGIN, INSIDE = range(3)
#: A score that no path can make good: inside never follows outside or a line's start.
NEVER = -1e4


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order; ``low`` are the text's bytes in small letters."""
    out = []
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# ---- tokens and features

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
# 0 blank, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 underscore, 5 sign
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b == 95 else 5 for b in range(256)], np.uint8)
_LENGTHS = np.array([2, 4, 8, 12, 16, 24, 40])
_CHANGES = np.array([1, 2, 4, 8])
_SHAPES = 8 * 8 + 128 + 1  # kind and length, the sign, beyond the line
_EDGE = _SHAPES - 1
_SHAPE_AT = (-2, -1, 0, 1, 2)
_WORD_AT = (-4, -3, -2, -1, 1)
#: Words whose presence anywhere is a feature of the file.
_FILE_WORDS = (b"export ", b"begin ", b"private", b"authorization", b"config", b"login", b"://", b"import ", b"commit ", b"{", b";\n")
_FILE_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2])


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    text: np.ndarray  # number of the text
    shape: np.ndarray
    changes: np.ndarray  # length and changes of class
    word: np.ndarray  # hash of the folded token
    first: np.ndarray  # first four signs, folded; 0 for a shorter token


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of a chunk of texts, in order."""
    kind, low = _CLASS[data], _FOLD[data]
    ws, we, owner = runs((kind >= 1) & (kind <= 4), offsets)
    size = we - ws
    count = lambda inside: np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    share = lambda sums: sums[we] - sums[ws]
    upper, digit, small = (share(count(kind == k)) for k in (2, 3, 1))
    switch = np.zeros(len(data), bool)
    if len(data):
        switch[1:] = kind[1:] != kind[:-1]
    sums = count(switch)
    turns = sums[we] - sums[np.minimum(ws + 1, we)]
    head = (upper == 1) & (kind[ws] == 2) if len(ws) else upper == 1
    group = np.select(
        [digit == size, (digit > 0) & (upper > 0) & (small > 0), (digit > 0) & (upper > 0), digit > 0, upper == 0, head, upper == size],
        [0, 1, 2, 3, 4, 5, 6], 7,
    )
    length = np.searchsorted(_LENGTHS, size, "right")
    signs = np.flatnonzero(kind == 5)
    first = np.zeros(len(ws), np.uint32)
    long = np.flatnonzero(size >= 6)
    for k in range(4):
        first[long] = (first[long] << np.uint32(8)) | low[ws[long] + k]
    start = np.concatenate([ws, signs])
    order = np.argsort(start, kind="stable")
    both = lambda a, b: np.concatenate([a, np.broadcast_to(b, len(signs))])[order]
    breaks = data == 10
    if len(data):
        breaks[offsets[(offsets > 0) & (offsets < len(data))]] = True  # a new text is a new line
    start = start[order]
    return Tokens(
        start, both(we, signs + 1), np.cumsum(breaks)[start] if len(start) else start, both(owner, np.searchsorted(offsets, signs, "right") - 1),
        both(group * 8 + length, 64 + data[signs].astype(np.int64) % 128), both(length * 5 + np.searchsorted(_CHANGES, turns, "right"), 40),
        both(run_hashes(low, ws, we), np.uint64(0)), both(first, np.uint32(0)),
    )


def shifted(values: np.ndarray, line: np.ndarray, step: int, edge: int) -> np.ndarray:
    """The value ``step`` tokens on in the same line, else ``edge``."""
    out = np.full(len(values), edge, np.int64)
    if step == 0:
        out[:] = values
    elif abs(step) < len(values):
        here, there = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        out[here] = np.where(line[here] == line[there], values[there], edge)
    return out


def file_features(raw: bytes) -> list[int]:
    """Numbers of the features that hold for a whole text."""
    low = raw.lower()
    data = np.frombuffer(raw, np.uint8)
    n = max(1, len(data))
    kind = np.bincount(_CLASS[data], minlength=6) if len(data) else np.zeros(6)
    lines = raw.split(b"\n")
    assigns = sum(b"=" in x[:80] or b": " in x[:80] for x in lines) / len(lines)
    shares = (kind[5] / n, kind[3] / n, assigns / 4)
    return [k * 6 + int(np.searchsorted(_FILE_SHARES, x, "right")) for k, x in enumerate(shares)] + [18 + 2 * k + (w in low) for k, w in enumerate(_FILE_WORDS)]


_FILE = 18 + 2 * len(_FILE_WORDS)


@dataclass
class Field:
    words: np.ndarray  # sorted hashes of known words
    firsts: np.ndarray  # sorted known first signs
    weight: np.ndarray  # feature x tag
    step: np.ndarray  # tag x tag
    start: np.ndarray

    @classmethod
    def blank(cls, words: np.ndarray, firsts: np.ndarray) -> Field:
        size = len(_SHAPE_AT) * _SHAPES + 41 + (len(firsts) + 1) + len(_WORD_AT) * (len(words) + 1) + _FILE
        step, start = np.zeros((3, 3)), np.zeros(3)
        step[OUT, INSIDE] = start[INSIDE] = NEVER
        return cls(words, firsts, np.zeros((size, 3)), step, start)

    def features(self, t: Tokens) -> list[np.ndarray]:
        """Feature numbers of every token, but for those of its file."""
        out, base = [], 0
        for step in _SHAPE_AT:
            out.append(base + shifted(t.shape, t.line, step, _EDGE))
            base += _SHAPES
        out.append(base + t.changes)
        base += 41
        out.append(base + _index(self.firsts, t.first))
        base += len(self.firsts) + 1
        known = _index(self.words, t.word)
        for step in _WORD_AT:
            out.append(base + shifted(known, t.line, step, len(self.words)))
            base += len(self.words) + 1
        return out

    def scores(self, t: Tokens, files: np.ndarray) -> np.ndarray:
        """Token x tag; ``files`` holds the summed weights of each text's file features."""
        out = files[t.text].copy()
        for f in self.features(t):
            out += self.weight[f]
        return out

    def file_weight(self, raw: bytes) -> np.ndarray:
        return self.weight[len(self.weight) - _FILE + np.array(file_features(raw))].sum(axis=0)

    def tag(self, t: Tokens, files: np.ndarray) -> np.ndarray:
        """The tags of all tokens on the best path of their lines."""
        tags = np.zeros(len(t.start), np.int64)
        if not len(tags):
            return tags
        scores = self.scores(t, files)
        maybe = stretches(scores, self.step, self.start)
        if not len(maybe):
            return tags
        cut = np.flatnonzero((np.diff(maybe) != 1) | (np.diff(t.line[maybe]) != 0)) + 1
        first, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(maybe)]]))
        for n in np.unique(size):
            at = maybe[first[size == n]][:, None] + np.arange(n)
            heads = (at[:, 0] == 0) | (t.line[at[:, 0] - 1] != t.line[at[:, 0]])
            last = at[:, -1]
            tails = (last == len(tags) - 1) | (t.line[np.minimum(last + 1, len(tags) - 1)] != t.line[last])
            tags[at] = best_path(scores[at], self.step, np.where(heads[:, None], self.start, self.step[OUT]), np.where(tails[:, None], 0.0, self.step[:, OUT]))
        return tags


def _index(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among the sorted known ones, their number for an unknown one."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def stretches(scores: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Tokens that some run of tagged tokens with a bound above nothing contains; all others are outside on every best path."""
    more = float(step[1:, 1:].max() - step[OUT, OUT])
    left = max(step[OUT, BEGIN] - step[OUT, OUT], start[BEGIN] - start[OUT])
    ends = float(left + max(step[1:, OUT].max() - step[OUT, OUT], 0.0)) - more
    # a run across lines bounds those inside them, too
    win = scores[:, 1:].max(axis=1) - scores[:, OUT] + more
    sums = np.concatenate([[0.0], np.cumsum(win)])
    up_to = sums[1:] - np.minimum.accumulate(sums[:-1])
    onwards = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    return np.flatnonzero(up_to + onwards - win + ends >= -1e-6)


def best_path(scores: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best tags of a batch of chains of one length, each with its own scores of start and end."""
    n, length, _ = scores.shape
    best, back = scores[:, 0] + start, np.zeros((length, n, 3), np.int8)
    for t in range(1, length):
        ways = best[:, :, None] + step
        back[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, t]
    tags = np.zeros((n, length), np.int64)
    tags[:, -1] = (best + end).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
    return tags


# ---- fitting


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def expectations(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a padded batch: probability of each tag, summed probabilities of steps, log sums over all paths."""
    n, longest, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + start
    for t in range(1, longest):
        ahead[:, t] = np.where((t < lengths)[:, None], _log_sum(ahead[:, t - 1, :, None] + step, 1) + scores[:, t], ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    for t in range(longest - 2, -1, -1):
        behind[:, t] = np.where((t + 1 < lengths)[:, None], _log_sum(step + (scores[:, t + 1] + behind[:, t + 1])[:, None], 2), 0.0)
    inside = np.arange(longest)[None] < lengths[:, None]
    single = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
    pairs = np.exp(ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, None, None])
    return single, (pairs * inside[:, 1:, None, None]).sum(axis=(0, 1)), total


def _recurring(values: list[np.ndarray], least: int, most: int) -> np.ndarray:
    """Values that ``least`` texts or more hold, the most frequent ones first, sorted."""
    if not values:
        return np.zeros(0, np.uint64)
    seen, n = np.unique(np.concatenate([np.unique(v) for v in values]), return_counts=True)
    keep = np.flatnonzero((n >= least) & (seen != 0))
    return np.sort(seen[keep[np.argsort(-n[keep], kind="stable")][:most]])


def fit(examples: list[tuple[str, list[tuple[int, int]]]], rounds: int = 20, batch: int = 64, ridge: float = 1e-3, rate: float = 0.25, seed: int = 7) -> Field:
    """Maximum likelihood with a ridge by Adagrad; ``examples`` are (text, [(start, end) of its secrets]) in code points."""
    made = []
    for text, spans in examples:
        raw = text.encode()
        t = tokens_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        gold = np.zeros(len(t.start), np.int64)
        for a, b in spans:
            inside = np.flatnonzero((t.start >= len(text[:a].encode())) & (t.start < len(text[:b].encode())))
            gold[inside], gold[inside[:1]] = INSIDE, BEGIN
        made.append((raw, t, gold))
    field = Field.blank(_recurring([t.word for _, t, _ in made], 4, 512), _recurring([t.first for _, t, _ in made], 4, 256))
    chains = []
    for raw, t, gold in made:
        own = np.stack([*field.features(t), *[np.full(len(gold), len(field.weight) - _FILE + f) for f in file_features(raw)]], axis=1) if len(gold) else np.zeros((0, 1), np.int64)
        for part in np.split(np.arange(len(gold)), np.flatnonzero(np.diff(t.line)) + 1):
            if len(part):
                chains.append((own[part], gold[part]))
    rng, w = np.random.default_rng(seed), field.weight
    sums = [np.full_like(x, 1e-8) for x in (w, field.step, field.start)]
    fixed = field.step == NEVER
    chains.sort(key=lambda c: len(c[1]))
    parts = [chains[k : k + batch] for k in range(0, len(chains), batch)]
    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            part = parts[k]
            lengths = np.array([len(g) for _, g in part])
            shape = (len(part), lengths.max())
            gold, scores = np.zeros(shape, np.int64), np.zeros((*shape, 3))
            for i, (ids, g) in enumerate(part):
                gold[i, : len(g)], scores[i, : len(g)] = g, w[ids].sum(axis=1)
            single, pair, _ = expectations(scores, lengths, field.step, field.start)
            inside = np.arange(shape[1])[None] < lengths[:, None]
            np.subtract.at(single, (*np.nonzero(inside), gold[inside]), 1)
            after = inside[:, 1:]
            np.subtract.at(pair, (gold[:, :-1][after], gold[:, 1:][after]), 1)
            grad = np.zeros_like(w)
            for i, (ids, g) in enumerate(part):
                np.add.at(grad, ids, single[i, : len(g), None])
            grads = (grad + ridge * w, np.where(fixed, 0.0, pair + ridge * field.step), np.where(field.start == NEVER, 0.0, single[:, 0].sum(axis=0)))
            for x, g, s in zip((w, field.step, field.start), grads, sums, strict=True):
                s += g**2
                x -= rate * g / np.sqrt(s)
    if not chains:
        field.weight[: len(_SHAPE_AT) * _SHAPES, OUT] = 1.0
    return field


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> Field:
    """Fit on at most ``max_rows`` labelled texts (columns text and spans: array of start, end)."""
    rows = labelled.where("text is not null").orderBy("text").limit(max_rows).collect()
    return fit([(r.text, [(s.start, s.end) for s in r.spans or []]) for r in rows])


# ---- the small labelled table: layouts whose {values} are made by rule; upper-case names mark a secret

_WITH = """export {ENV}={RAND}|{ENV}={RAND}|{ENV}="{PASS}"|set {ENV}='{MIXED}'|{env}: {RAND}|{env}: "{PASS}"|"{env}": "{RAND}",|{env} = "{MIXED}"|{env} = '{PASS}'
const {camel} = "{RAND}";|String {camel} = "{MIXED}";|private static final String {ENV} = "{RAND}";|{camel}: '{MIXED}',|<{env}>{PASS}</{env}>|{env}={PASS};|"{env}" : "{B64}"
Authorization: Bearer {JWT}|Authorization: Bearer {RAND}|Authorization: Basic {B64}|curl -H "Authorization: Bearer {VENDOR}" https://{host}/v1/{w}|-H "X-Api-Key: {RAND}"|x-auth-token: {RAND}|Cookie: session={RAND}; path=/
postgres://{w}:{PASS}@{host}:5432/{w}|mysql://{w}:{MIXED}@{host}/{w}|redis://:{MIXED}@{host}:6379/0|https://{w}:{VENDOR}@{host}/{w}.git|mongodb://{w}:{PASS}@{host}/{w}?w=1|amqp://{w}:{RAND}@{host}
https://{host}/v1/{w}?api_key={RAND}&page={n}|https://{host}/{w}?access_token={RAND}|?key={VENDOR}&q={w}|&sig={B64}&se={n}
mysql -u {w} -p{MIXED} {w}|psql --password {PASS} -U {w}|{w} --token {VENDOR} --{w}|{w} --api-key={RAND}|curl -u {w}:{MIXED} https://{host}|sshpass -p '{PASS}' ssh {w}@{host}|docker login -u {w} -p {VENDOR}
machine {host} login {w} password {PASS}|login: {w} password: {PASS}|user {w} / pass {PASS}|my password is {PASS}|the password for {w} is {PASS}|{w} {w} the password is "{PASS}" {w} {w}.|your new passphrase: {PASS}|pwd: {PASS}|pass: {MIXED}|wifi password {PASS}
contraseña: {PASS}|la contraseña es {PASS}|mot de passe : {PASS}|le mot de passe est {PASS}|Passwort: {PASS}|das Passwort lautet {PASS}|Kennwort: {MIXED}|clave: {PASS}|PIN code {PIN}|the code for the door is {PIN}
{w} {w} {VENDOR} {w} {w}|token {VENDOR}|key {VENDOR}|{w}: {VENDOR}|use {VENDOR} for {w}|{JWT}|AccountKey={B64};EndpointSuffix={host}|aws_secret_access_key = {B64}|aws_access_key_id = {AWS}|{w} {AWS} {w}
-----BEGIN PRIVATE KEY-----\n{LINE}\n{LINE}\n-----END PRIVATE KEY-----|-----BEGIN RSA PRIVATE KEY-----\n{LINE}\n{LINE}\n{LINE}\n-----END RSA PRIVATE KEY-----
client_id: {w}\nclient_secret: {RAND}\nscope: {w}|[{w}]\nhost = {host}\nuser = {w}\npassword = {PASS}|{w} {w} {w} token = "{RAND}" {w} {w}|secret={RAND}|{w} | {env} = "{RAND}" | {w}|bearer {RAND}|license key: {SERIAL}|serial {SERIAL}"""
_WITHOUT = """{w} {w} {w}. {w} {w}|{p}|{p}, {p}. {p}|{p}\n{p}\n{p}|{P}|{p} {n} {p}|"{p}" {w} = {w}|{p}!! {p}*** {p}$$$|{w} | {w} | {w}|{p} {n16} {p}|{p} {w}.{n}@{host} {p}
commit {hex40}|commit {hex40}\nauthor {w}|index {hex7}..{hex7} 100644|merge {hex7} into {w}|sha256:{hex64}|{hex40}  {w}.tar.gz|md5 {hex32}|etag: "{hex32}"|integrity: sha512-{b64}|"sha1": "{hex40}",|revision {hex40}
{uuid}|id: {uuid}|"id": "{uuid}",|request {uuid} took {n} ms|trace-id {uuid}|order {n16}|order number {n}-{n}|invoice {code}|ref: {code}|tracking {n16}|isbn {n13}|part no. {code}|flight {code}|call {tel}|tel: {tel}|{p} {tel} {p}
version = "{ver}"|"version": "{ver}",|v{ver}|{w}=={ver}|Licensed under {w} {ver}.|{w} license, version {n}.|color: #{hex6};|background: {hex6}|192.168.{n}.{n}|https://{host}/{w}/{w}?page={n}|https://{host}/{w}/{hex7}|see {host}/{w}.|mail {w}@{host}|{w}.{w}@{host} {w}
src="data:image/png;base64,{b64}"|data:font/woff;base64,{b64}|{camel}({camel});|return {camel}.{camel}({w}, {n});|def {env}(self, {w}):|import {w}.{camel};|public class {camel} extends {camel} |for (int i = 0; i < {n}; i++) |if ({camel} == {n}) |{env} = {n}|{env} = {w}|{camel} = {w}.{camel}()
password: ********|password = getpass()|password=<your password>|password: |secret: ${{env}}|api_key = os.environ["{ENVNAME}"]|token = next({w})|token = lexer.{camel}()|process.env.{ENVNAME}|{env} = None|"password": null,|password = "{{ {env} }}"|apiKey: string;|token: str = ""|set password for {w}|forgot your password?
the password must have {n} characters|a token of {w} {w}|secret {w} of the {w}|the key to {w} {w}|{n} tokens per {w}|{p} password {p}|{p} token {p}|{p} secret {p}|{p} key {p}|api key required|keyboard: {w}|pass the {w} to {w}|contraseña olvidada|mot de passe oublié|Passwort vergessen
login {w} {w}|user {w} logged in from {w}|page {n} of {n}|{date} {n}:{n}:{n} INFO {w} {w}|{date} ERROR {w}: {p}|{w};{w};{n};{n}|{n},{n},{n}|name: {w}|title = "{p}"|{w}: {w}|"{w}": "{p}",|{w} = "{w}"|-----BEGIN CERTIFICATE-----|key: {w}|PIN {w}|code {w} {n}|serial {w}|session {w}"""

_NAMES = ("password", "db_password", "secret", "secret_key", "client_secret", "api_key", "apikey", "auth_token", "access_token", "token", "private_key", "access_key", "credential", "passwd", "pwd", "api_secret", "signing_key", "webhook_secret")


def labelled_examples(repeats: int = 12, seed: int = 3, layouts: tuple[str, str] = (_WITH, _WITHOUT)) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts made from the layouts, with the places of their secrets; some are set in a file of other lines or in prose."""
    rng = random.Random(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdluéñö" if rng.random() < 0.1 else "etaoinshrdlu") for _ in range(rng.randint(2, 10)))
    prose = lambda: " ".join(rng.choice([word, word, word, lambda: word().capitalize(), lambda: word() + rng.choice(".,;!?"), lambda: rng.choice(["the", "de", "la", "und", "a", "of", "que", "is", "est"])])() for _ in range(rng.randint(4, 18)))
    camel = lambda: word() + word().capitalize()
    mixed = lambda: some(low + up + num, 2) + some(num, 1) + some(up, 1) + some(low + up + num, rng.randint(6, 16))
    env = lambda: rng.choice(_NAMES) if rng.random() < 0.7 else f"{word()}_{rng.choice(_NAMES)}"
    rand = lambda: some(rng.choice([low + num, low + up + num, "0123456789abcdef"]), rng.choice([16, 20, 24, 32, 40]))
    password = lambda: rng.choice([lambda: word().capitalize() + some(num, rng.randint(2, 4)) + rng.choice("!#$%&*?@"), lambda: some(low + up + num + "!#%&*", rng.randint(9, 15)), lambda: word() + some(num, rng.randint(2, 4)), lambda: f"{word()}-{word()}-{some(num, 3)}"])()
    b64 = lambda n: some(low + up + num + "+/", n) + rng.choice(["", "=", "=="])
    prefix = lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "npm_", "SG.", "dop_v1_", "hf_", "pypi-", "shpat_", "sk-", "ya29."])
    made = {
        "w": word, "p": prose, "P": lambda: prose().upper(), "n": lambda: some(num, rng.randint(1, 4)), "n13": lambda: some(num, 13), "n16": lambda: some(num, 16), "camel": camel,
        "host": lambda: f"{word()}.{rng.choice(['com', 'net', 'org', 'io', 'example.com'])}", "env": env, "ENVNAME": lambda: env().upper(), "hex7": lambda: some("0123456789abcdef", 7), "hex6": lambda: some("0123456789abcdef", 6),
        "hex32": lambda: some("0123456789abcdef", 32), "hex40": lambda: some("0123456789abcdef", 40), "hex64": lambda: some("0123456789abcdef", 64), "b64": lambda: b64(rng.randint(40, 90)),
        "uuid": lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), "code": lambda: f"{some(up, rng.randint(2, 3))}-{some(num, rng.randint(3, 7))}", "ver": lambda: ".".join(some(num, 1) for _ in range(3)),
        "tel": lambda: f"({some(num, 3)}) {some(num, 3)}-{some(num, 4)}", "date": lambda: f"20{some(num, 2)}-0{some(num, 1)}-1{some(num, 1)}",
    }
    secret = {
        "RAND": rand, "MIXED": mixed, "PASS": password, "B64": lambda: b64(rng.choice([24, 32, 40, 43, 64])), "LINE": lambda: some(low + up + num + "+/", 64), "AWS": lambda: "AKIA" + some(up + num, 16),
        "JWT": lambda: f"eyJ{some(low + up + num, 17)}.eyJ{some(low + up + num, rng.randint(20, 40))}.{some(low + up + num + '_-', 43)}", "VENDOR": lambda: prefix() + some(low + up + num, rng.choice([20, 24, 36])),
        "PIN": lambda: some(num, rng.choice([4, 6])), "SERIAL": lambda: "-".join(some(up + num, 5) for _ in range(rng.choice([4, 5]))),
    }

    def filled(layout: str) -> tuple[str, list[tuple[int, int]]]:
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", layout.replace("\\n", "\n")):
            name = part[1:-1] if part[:1] == "{" and part[-1:] == "}" else ""
            if name == "ENV":
                part = env().upper()
            elif name in secret:
                part = secret[name]()
                spans.append((len(text), len(text) + len(part)))
            elif name in made:
                part = made[name]()
            text += part
        return text, spans

    with_secret, without = ([x for row in block.split("\n") for x in row.split("|")] for block in layouts)
    out = []
    for _ in range(repeats):
        for layout in (*with_secret, *without):
            text, spans = filled(layout)
            around = rng.random()
            before = f"{prose()} " if around < 0.2 else f"{filled(rng.choice(without))[0]}\n" if around < 0.5 else ""
            after = f" {prose()}" if around < 0.15 else f"\n{filled(rng.choice(without))[0]}" if 0.3 < around < 0.6 else ""
            out.append((before + text + after, [(a + len(before), b + len(before)) for a, b in spans]))
    return out


def labelled_table(spark: SparkSession, repeats: int = 12, seed: int = 3) -> DataFrame:
    """Columns text and spans (array of start, end)."""
    rows = [(text, [{"start": a, "end": b} for a, b in spans]) for text, spans in labelled_examples(repeats, seed)]
    return spark.createDataFrame(rows, "text string, spans array<struct<start: int, end: int>>")


# ---- the operator


def _pieces(raw: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of one text between lines, about a chunk each; a longer line is a piece of its own."""
    if len(raw) <= CHUNK_BYTES:
        return [(0, len(raw))]
    ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
    out, at = [], 0
    while at < len(raw):
        end = int(ends[max(np.searchsorted(ends, at + CHUNK_BYTES, "right") - 1, np.searchsorted(ends, at, "right"))])
        out.append((at, end))
        at = end
    return out


def _own_spans(t: Tokens, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of the tagged runs; a begin starts a new one."""
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    new = np.concatenate([[True], (np.diff(at) != 1) | (tags[at[1:]] == BEGIN) | (np.diff(t.line[at]) != 0)])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return list(zip(t.text[first].tolist(), t.start[first].tolist(), t.end[last].tolist(), strict=True))


def find_spans(column: pa.Array, field: Field) -> list[tuple[list, list]]:
    """For each text its fixed spans and all spans, (start, kind number, end) each, in order."""
    data, offsets = utf8(column)
    texts, found = column.to_pylist(), [[] for _ in range(len(column))]
    for i, j in chunks(offsets):
        files = np.array([field.file_weight(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)])
        raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for a, b in _pieces(raw) if j - i == 1 else [(0, len(raw))]:
            t = tokens_of(raw[a:b], own if j - i > 1 else np.array([0, b - a]))
            for k, x, y in _own_spans(t, field.tag(t, files)):
                found[i + k].append((a + x - int(own[k]), a + y - int(own[k])))
    out = []
    for k, text in enumerate(texts):
        raw = data[offsets[k] : offsets[k + 1]].tobytes()
        base, more, at, points = base_spans(text or "", raw.lower()), [], 0, 0
        for x, y in found[k]:
            points += len(raw[at:x].decode())
            size = len(raw[x:y].decode())
            if not any(points < e and s < points + size for s, _, e in base):
                more.append((points, len(KINDS), points + size))
            at, points = y, points + size
        out.append((base, sorted([*base, *more])))
    return out


def detect(documents: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of fixed spans of each kind, digest of the fixed spans, all spans (``kind:start:end``, comma-joined)."""
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def work(column: pa.Array) -> list[pa.Array]:
        found = find_spans(column, sent.value)
        said = lambda spans: ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in spans)
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        digests = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
        return [*counts, pa.array(digests, pa.string()), pa.array([said(spans) for _, spans in found], pa.string())]

    return per_text(documents, key, text, work, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
